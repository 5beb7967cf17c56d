"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least max(``LEAST``, ``TIMES`` * q) words that no
neighbouring word extends keeping period q. A text is collapsed by dropping the
words that any run contains after that run's first q words.

Method, for each batch of texts. Prefix doubling names every block of 2**k words
(equal names: equal blocks of one text) and ends in the suffix array of each
text; a block's occurrences are one interval of that array. Blocks of 2**k words
at every ``step(k)``-th place ask a wavelet matrix over the suffix array for the
next occurrence of themselves in the neighbouring window of 2**k starts (range
successor: how many values of the interval are not beyond the block, then the
value of that rank). The block and its next occurrence are the first two of the
progression that its occurrences form inside a run, their difference is a
candidate period, and the names of blocks, taken from the longest down, extend
it to both sides.

No run is missed: its last q words aside, it has at least 3q words (5 if q = 1),
and for 2**(k-1) < q <= 2**k these hold ``step(k)`` blocks of 2**k words, of
which one asks. No candidate is wrong:
a block of q words or more inside a run of period q occurs next exactly q words
later, so the difference is the smallest period, and what is extended is checked
word for word through the names. Words are compared as bytes.

Null texts and texts without words have no runs and collapse to the empty text.
Repeated rows are worked on each, an empty table gives an empty table. A text is
worked on as a whole, in memory that grows with its words (about 80 bytes each);
texts are batched by size, so memory does not grow with the table. Columns of the
input named like a result are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hydrolake.llm.tokens import encoded, slices
from hydrolake.llm.words import VISIBLE, Words, cut

#: Words that a run has at least, and periods that it has at least.
LEAST, TIMES = 6, 4
#: Characters of text that are worked on together.
TOGETHER = 1_000_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def step(k: int) -> int:
    """Every so many places a block of 2**k words asks for its next occurrence."""
    return 4 if k < 3 else 1 << (k - 1)


@dataclass
class Blocks:
    """Suffix array and dyadic block names of several texts, each text apart.

    ``order`` has the text's suffixes, in the places of the text's words; ``names[k][i]`` is the first
    place in ``order`` of those that begin with the 2**k words at i, ``ends[k][p]`` where they end if p is
    such a first place. Blocks that would leave the text have a name of their own. Levels
    end where all names differ.
    """

    order: np.ndarray
    names: list[np.ndarray]
    ends: list[np.ndarray]


def groups_of(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 slot of each sorted key's group; a group's slots are consecutive."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(new, len(keys)))
    begin = slots[new]
    return np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)


def suffix_blocks(ids: np.ndarray, firsts: np.ndarray) -> Blocks:
    """Prefix doubling; only suffixes that still share a name are sorted again."""
    n = len(ids)
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    last = firsts[1:][doc]
    key = doc * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key).astype(np.int32)
    begin, end = groups_of(key[order], np.arange(n))
    name = np.empty(n, np.int32)
    name[order] = begin
    bound = np.empty(n, np.int32)
    bound[begin] = end
    names, ends, width = [name], [bound], 1
    slots = np.flatnonzero(end - begin > 1)
    while len(slots):
        at = order[slots]
        beyond = at.astype(np.int64) + width
        follow = np.where(beyond < last[at], name[np.minimum(beyond, n - 1)], -1)
        key = name[at].astype(np.int64) * (n + 1) + follow + 1
        by = np.argsort(key)
        at = at[by]
        order[slots] = at
        begin, end = groups_of(key[by], slots)
        name, bound = name.copy(), bound.copy()
        name[at] = begin
        bound[begin] = end
        shared = end - begin > 1
        slots, width = slots[shared], width * 2
        if len(slots):
            names.append(name)
            ends.append(bound)
    return Blocks(order, names, ends)


class Wavelet:
    """Wavelet matrix over numbers below 2**bits: for each bit from the highest, how many of the first i have it unset."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.unset = []
        for b in reversed(range(self.bits)):
            low = (values >> b) & 1 == 0
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(low, out=count[1:])
            self.unset.append(count)
            values = np.concatenate([values[low], values[~low]])

    def not_above(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers at lo..hi are at most x."""
        found = np.zeros(len(lo), np.int32)
        for b, unset in zip(reversed(range(self.bits)), self.unset):
            a, z = unset[lo], unset[hi]
            up = (x >> b) & 1 == 1
            found += np.where(up, z - a, 0)
            lo = np.where(up, lo - a + unset[-1], a)
            hi = np.where(up, hi - z + unset[-1], z)
        return found + (hi - lo)

    def ranked(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of that rank (from 0) among those at lo..hi."""
        found = np.zeros(len(lo), np.int32)
        for b, unset in zip(reversed(range(self.bits)), self.unset):
            a, z = unset[lo], unset[hi]
            up = rank >= z - a
            rank = np.where(up, rank - (z - a), rank)
            lo = np.where(up, lo - a + unset[-1], a)
            hi = np.where(up, hi - z + unset[-1], z)
            found |= np.where(up, np.int32(1 << b), 0)
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest number above x among those at lo..hi, -1 if there is none."""
        rank = self.not_above(lo, hi, x)
        out = np.full(len(lo), -1, np.int32)
        has = np.flatnonzero(rank < hi - lo)
        out[has] = self.ranked(lo[has], hi[has], rank[has])
        return out


def candidates(blocks: Blocks, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks that occur again within their own length, and the distances."""
    base = np.repeat(firsts[:-1], np.diff(firsts)).astype(np.int32)
    wavelet = Wavelet(blocks.order - base[blocks.order])
    at, lo, hi, width = [], [], [], []
    for k, (name, end) in enumerate(zip(blocks.names, blocks.ends)):
        asks = np.arange(len(name), dtype=np.int32)
        asks = asks[(asks - base) % step(k) == 0]
        begin = name[asks]
        close = end[begin]
        shared = close - begin > 1
        at.append(asks[shared])
        lo.append(begin[shared])
        hi.append(close[shared])
        width.append(np.full(len(at[-1]), 1 << k, np.int32))
    at, lo, hi, width = map(np.concatenate, (at, lo, hi, width))
    own = at - base[at]
    distance = wavelet.successor(lo, hi, own) - own
    # Shorter distances are found by shorter blocks.
    good = (distance > width // 2) & (distance <= width)
    return at[good], distance[good]


def extended(blocks: Blocks, firsts: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest stretch around ``at`` whose words ``period`` apart are equal."""
    doc = np.searchsorted(firsts, at, "right") - 1
    first, last = firsts[doc], firsts[doc + 1]
    low = at.astype(np.int64)
    high = low.copy()
    for k in reversed(range(len(blocks.names))):
        name, width = blocks.names[k], 1 << k
        fits = high + period + width <= last
        x = np.where(fits, high, 0)
        high += np.where(fits & (name[x] == name[np.where(fits, x + period, 0)]), width, 0)
        fits = low - width >= first
        x = np.where(fits, low - width, 0)
        low -= np.where(fits & (name[x] == name[np.where(fits, x + period, 0)]), width, 0)
    return low, high + period


def runs_of(ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin (in ``ids``), length and period of all runs, by begin, then period."""
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    firsts = firsts.astype(np.int64)
    blocks = suffix_blocks(ids.astype(np.int64), firsts)
    at, period = candidates(blocks, firsts)
    begin, end = extended(blocks, firsts, at, period)
    length = end - begin
    long = length >= np.maximum(LEAST, TIMES * period)
    found = np.unique(np.stack([begin[long], period[long].astype(np.int64), length[long]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def kept_texts(words: Words, kept: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    data = words.data.copy()
    ends = words.ends[kept]
    data[ends] = 32
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, words.starts[kept], 1)
    np.add.at(change, ends + 1, -1)
    out = data[np.cumsum(change[:-1], dtype=np.int8).view(bool)].tobytes()
    sizes = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(np.where(kept, words.ends - words.starts + 1, 0), out=sizes[1:])
    cuts = sizes[words.firsts].tolist()
    return [out[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


def collapse(df: DataFrame, text: str = "text", n_words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add the number of words, all runs by start and period (word numbers from 0) and the collapsed text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {n_words: T.LongType(), runs: T.ArrayType(RUN, False), collapsed: T.StringType()}
    target = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])
    schema = to_arrow_schema(target)
    run_type = schema.field(runs).type

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TOGETHER):
            words = cut(encoded(batch.column(text)), VISIBLE)
            ids = words.array.dictionary_encode().indices.to_numpy()
            begin, length, period = runs_of(ids, words.firsts)
            doc = np.searchsorted(words.firsts, begin, "right") - 1
            # A word is dropped by the runs that cover it beyond their first period.
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, begin + period, 1)
            np.add.at(cover, begin + length, -1)
            back = kept_texts(words, np.cumsum(cover[:-1]) == 0)
            fields = [pa.array(x.astype(np.int64)) for x in (begin - words.firsts[doc], length, period)]
            offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(run_type.value_type)))
            results = {n_words: pa.array(np.diff(words.firsts).astype(np.int64)), runs: lists.cast(run_type), collapsed: pa.array(back, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([results[f.name] if f.name in results else batch.column(f.name) for f in schema], schema=schema)

    return df.mapInArrow(run, target)
