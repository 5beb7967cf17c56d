"""Hashing of bytes and words with numpy, and batching, for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash, its inverse modulo 2**64, and the shifts and multipliers of the final mixing.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53))
#: Characters of text that a worker handles at a time.
SLICE_BYTES = 2_000_000

SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = np.array(x, dtype=U64)
    for shift, factor in MIX:
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(33))


def combine(*parts) -> np.ndarray:
    """One hash of several integer arrays; the order of the arguments matters."""
    out = mix(parts[0])
    for p in parts[1:]:
        out = mix(out * U64(BASE) + np.asarray(p).astype(U64))
    return out


def byte_values(seed: int) -> np.ndarray:
    """A pseudo-random 64-bit value for each byte."""
    return combine(np.arange(1, 257, dtype=U64), np.full(256, seed, U64))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Prefix sums from which the hash of any byte range of a buffer follows in a few operations."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(byte_values(seed)[data] * powers(n, BASE), out=self.sums[1:])
        self.inverse = powers(n + 1, BASE_INVERSE)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of each range of ``width`` bytes, by its start."""
        return mix((self.sums[width:] - self.sums[: len(self.sums) - width]) * self.inverse[: len(self.sums) - width] + U64(width))


IS_SPACE = np.isin(np.arange(256), list(SPACES))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a line feed after each, and where each begins (with the end of the buffer last)."""
    data = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, split at the six ASCII spaces, A-Z in lower case if wanted.

    Returns the buffer, the start and the end of each word in it, each word's
    hash, and for each text the number of its first word (total last).
    """
    data, begins = join_texts(texts)
    if lower:
        data = LOWER[data]
    space = IS_SPACE[data]
    before = np.concatenate([[True], space[:-1]]) if len(space) else space
    starts = np.flatnonzero(~space & before)
    after = np.concatenate([space[1:], [True]]) if len(space) else space
    ends = np.flatnonzero(~space & after) + 1
    return data, starts, ends, Rolling(data).of(starts, ends), np.searchsorted(starts, begins)


def shingles(word_hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a text, and the text's number.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(firsts)
    n = len(word_hashes)
    doc = np.repeat(np.arange(len(counts)), counts)
    parts = []
    if n >= width:
        h = word_hashes[: n - width + 1]
        for i in range(1, width):
            h = h * U64(BASE) + word_hashes[i : n - width + 1 + i]
        inside = doc[: n - width + 1] == doc[width - 1 :]
        parts.append((mix(h[inside]), doc[: n - width + 1][inside]))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = counts[short] > k
            whole[has] = whole[has] * U64(BASE) + word_hashes[firsts[short][has] + k]
        parts.append((combine(whole, counts[short]), short))
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, d = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece take about ``most`` bytes; a longer text is a piece alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if v is None else len(v) for v in batch.column(column).to_pylist()], np.int64)
        piece = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def encoded(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
