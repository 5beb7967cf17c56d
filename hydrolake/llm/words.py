"""Exact words of many texts as Arrow arrays: cut by a class of bytes, compared as bytes, never as hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from hydrolake.llm.tokens import LOWER, SPACES, join_texts


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie outside all ranges (ends inclusive): those that words are made of."""
    inside = np.ones(256, bool)
    for a, b in ranges:
        inside[a : b + 1] = False
    return inside


#: Everything but ASCII white space; and ASCII letters, digits and all that is not ASCII.
VISIBLE = byte_class(*((b, b) for b in SPACES))
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass
class Words:
    """``starts`` and ``ends`` of all words in ``data``; text number d has the words ``firsts[d]`` to ``firsts[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    array: pa.Array

    @property
    def doc(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def cut(texts: list[bytes], inside: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of bytes of the class ``inside`` (a line feed is never in it), A-Z in lower case if wanted."""
    data, begins = join_texts(texts)
    if lower:
        data = LOWER[data]
    of_word = inside[data]
    edges = np.flatnonzero(np.diff(of_word.view(np.int8), prepend=0))  # the buffer ends with a separator
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[of_word])])
    return Words(data, starts, ends, np.searchsorted(starts, begins), array)
