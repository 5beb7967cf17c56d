"""Byte-level BPE: texts to token ids and back, as a rank file prescribes.

A text is cut by a pattern; each piece is a row of bytes whose neighbouring
pair of lowest rank is merged again and again, the leftmost of equals first.
A segment tree over the byte positions holds in each node the smallest
(rank, position) below it, so the root names the next merge, and a merge
changes three leaves: its own, the one of the token that it swallowed, and the
one of the live neighbour on its left. Pieces of equal tree size are merged
together, one merge of every piece at a time; the few long pieces one by one.

Null texts count as empty: no ids, no bytes. Rows that repeat are encoded each.
An empty table gives an empty table. Columns of the input that share a name
with a result are replaced by it; all other columns pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hydrolake.llm.tokens import BASE, slices

#: No pair that can be merged.
NEVER = np.int64(2**62)
#: Position bits in a tree node; ranks stand above them.
SHIFT = 40
#: A size class with fewer pieces is merged piece by piece.
MANY = 24
#: Bytes of pieces merged in step; their trees should stay in the cache.
TOGETHER = 1 << 17
#: Pieces whose ids a task remembers; when as many are known, it starts anew.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from a file of ``base64 id`` lines (read by the driver)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def slot_of(key: np.ndarray, size: int) -> np.ndarray:
    return (np.asarray(key).astype(np.uint64) * np.uint64(BASE) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def open_table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values in a hash table with open addressing, at most a quarter full; -1 marks a free slot."""
    size = 1 << (4 * max(1, len(pairs)) - 1).bit_length()
    keys, values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    left = np.array(list(pairs), np.int64)
    made = np.array(list(pairs.values()), np.int64)
    at = slot_of(left, size)
    while len(left):
        free = keys[at] < 0
        keys[at[free]], values[at[free]] = left[free], made[free]
        placed = keys[at] == left
        values[at[placed]] = made[placed]
        left, made, at = left[~placed], made[~placed], (at[~placed] + 1) & (size - 1)
    return keys, values


class Vocabulary:
    """What workers need: token bytes by id, and the id that each mergeable pair of ids makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.width = max(ranks.values()) + 1
        self.tokens = [b""] * self.width
        for token, i in ranks.items():
            self.tokens[i] = token
        pairs = {ranks[t[:k]] * self.width + ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys, self.made = open_table(pairs)
        self.pairs = pairs
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.bytes < 0).any():
            raise ValueError("the ranks must hold all 256 bytes")

    def __getstate__(self):
        return {"tokens": self.tokens, "width": self.width, "keys": self.keys, "made": self.made, "bytes": self.bytes}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.pairs = None

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that make no token."""
        key = left * self.width + right
        at = slot_of(key, len(self.keys))
        there = self.keys[at]
        wrong = np.flatnonzero((there != key) & (there >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            there[wrong] = self.keys[at[wrong]]
            wrong = wrong[(there[wrong] != key[wrong]) & (there[wrong] >= 0)]
        return np.where(there == key, self.made[at], -1)

    def pair(self, left: int, right: int) -> int:
        if self.pairs is None:
            self.pairs = {k: i for k, i in zip(self.keys.tolist(), self.made.tolist()) if k >= 0}
        return self.pairs.get(left * self.width + right, -1)


def merge_one(piece: bytes, v: Vocabulary) -> list[int]:
    """Ids of one piece, by a segment tree in plain lists; n merges of log n steps."""
    never = int(NEVER)
    n = len(piece)
    token = [int(v.bytes[b]) for b in piece]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << max(0, n - 1).bit_length()
    tree = [never] * (2 * size)
    for p in range(n - 1):
        r = v.pair(token[p], token[p + 1])
        if r >= 0:
            tree[size + p] = r << SHIFT | p
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(p: int) -> None:
        value = never
        if 0 <= p < n and token[p] >= 0 and right[p] < n:
            r = v.pair(token[p], token[right[p]])
            if r >= 0:
                value = r << SHIFT | p
        k = size + p
        tree[k] = value
        k >>= 1
        while k:
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    while tree[1] < never:
        p = tree[1] & ((1 << SHIFT) - 1)
        gone = right[p]
        token[p] = tree[1] >> SHIFT
        token[gone] = -1
        right[p] = right[gone]
        if right[p] < n:
            left[right[p]] = p
        put(gone)
        put(p)
        if left[p] >= 0:
            put(left[p])
    return [t for t in token if t >= 0]


def merge_many(pieces: list[bytes], size: int, v: Vocabulary) -> list[np.ndarray]:
    """Ids of pieces of at most ``size`` bytes (a power of two): a tree for each, all merged in step."""
    w = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(w, size)
    column = np.arange(size)
    live = column < lengths[:, None]
    token = np.where(live, v.bytes[data], -1)
    right = np.broadcast_to(column + 1, (w, size)).copy()
    left = np.broadcast_to(column - 1, (w, size)).copy()
    tree = np.full((w, 2 * size), NEVER, np.int64)
    if size > 1:
        pairs = live[:, 1:]
        rank = np.full((w, size - 1), -1, np.int64)
        rank[pairs] = v.merged(token[:, :-1][pairs], token[:, 1:][pairs])
        tree[:, size : 2 * size - 1] = np.where(rank >= 0, rank << SHIFT | column[:-1], NEVER)
    k = size
    while k > 1:
        k //= 2
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

    # From here on all arrays are flat: a piece's cells begin at its base.
    token, right, left, tree = token.ravel(), right.ravel(), left.ravel(), tree.ravel()

    def put(row, at):
        """Set the leaves of these positions anew, then their ancestors."""
        base = row * size
        nxt = right[base + at]
        ends = lengths[row]
        has = np.flatnonzero((token[base + at] >= 0) & (nxt < ends))
        value = np.full(len(row), NEVER, np.int64)
        rank = v.merged(token[base[has] + at[has]], token[base[has] + nxt[has]])
        value[has] = np.where(rank >= 0, rank << SHIFT | at[has], NEVER)
        root = row * (2 * size)
        node = at + size
        tree[root + node] = value
        for _ in range(size.bit_length() - 1):
            node >>= 1
            below = root + 2 * node
            tree[root + node] = np.minimum(tree[below], tree[below + 1])

    row = np.flatnonzero(tree[1 :: 2 * size] < NEVER) if size > 1 else np.zeros(0, int)
    while len(row):
        best = tree[row * (2 * size) + 1]
        base = row * size
        at = best & ((1 << SHIFT) - 1)
        gone = right[base + at]
        after = right[base + gone]
        token[base + at] = best >> SHIFT
        token[base + gone] = -1
        right[base + at] = after
        inside = after < lengths[row]
        left[base[inside] + after[inside]] = at[inside]
        before = left[base + at]
        has = before >= 0
        put(np.concatenate([row, row, row[has]]), np.concatenate([gone, at, before[has]]))
        row = row[tree[row * (2 * size) + 1] < NEVER]
    token = token.reshape(w, size)
    kept = token >= 0
    return np.split(token[kept], np.cumsum(kept.sum(axis=1))[:-1])


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each piece as packed little-endian unsigned 32-bit integers; a piece that is a token is its id."""
    out: list[bytes] = [b""] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        whole = v.ids.get(p)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif p:
            by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
    for size, group in by_size.items():
        if len(group) < MANY:
            found = [np.array(merge_one(pieces[i], v)) for i in group]
        else:
            step = max(MANY, TOGETHER // size)
            found = [ids for k in range(0, len(group), step) for ids in merge_many([pieces[i] for i in group[k : k + step]], size, v)]
        for i, ids in zip(group, found):
            out[i] = ids.astype("<u4").tobytes()
    return out


def decode_ids(packed: bytes, v: Vocabulary) -> bytes:
    return b"".join(map(v.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _with(batch: pa.RecordBatch, schema: pa.Schema, **new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in schema], schema=schema)


def _extended(df: DataFrame, *columns: tuple[str, T.DataType]) -> T.StructType:
    new = {name for name, _ in columns}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in columns])


def narrow(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of code points below 256, its classes written out, for the faster standard
    library; None if it has escapes other than these four."""
    classes = {name: "".join(re.escape(chr(i)) for i in range(256) if regex.match(name, chr(i))) for name in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    if "\\" in regex.sub(r"\\p\{[LN]\}|\\[sS]", "", pattern):
        return None
    parts = regex.split(r"(\[[^\]]*\])", pattern)  # character sets are the odd ones
    for i, part in enumerate(parts):
        for name, chars in classes.items():
            part = part.replace(name, chars if i % 2 else f"[{chars}]")
        parts[i] = part
    return re.compile("".join(parts))


def cutter(pattern: str):
    """The function that cuts a text into the pattern's matches."""
    wide, low = regex.compile(pattern), narrow(pattern)

    def cut(text: str) -> list[str]:
        if low:
            try:
                text.encode("latin-1")
                return low.findall(text)
            except UnicodeEncodeError:
                pass
        return wide.findall(text)

    return cut


def encode(df: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the token ids of ``text`` as packed little-endian unsigned 32-bit integers (binary)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    target = _extended(df, (ids, T.BinaryType()))
    schema = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cut, known = shared.value, cutter(pattern), {}
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            pieces = [cut(t) for t in texts]
            new = list(set().union(*pieces) - known.keys())
            if len(known) + len(new) > REMEMBERED:
                known = {}
                new = list(set().union(*pieces))
            known.update(zip(new, encode_pieces([p.encode() for p in new], v)))
            packed = [b"".join(map(known.__getitem__, p)) for p in pieces]
            yield _with(batch, schema, **{ids: pa.array(packed, pa.binary())})

    return df.mapInArrow(run, target)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes that the packed ``ids`` stand for (null ids: empty)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    target = _extended(df, (decoded, T.BinaryType()))
    schema = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in slices(batches, ids):
            back = [decode_ids(x or b"", v) for x in batch.column(ids).to_pylist()]
            yield _with(batch, schema, **{decoded: pa.array(back, pa.binary())})

    return df.mapInArrow(run, target)
