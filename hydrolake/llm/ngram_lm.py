"""Language-model scores from a log-frequency Bloom filter.

Training counts of n-grams (orders 1 to ``ORDER``) are quantised on a
logarithmic scale: a count c has level 1 + floor(log_b c), and the filter holds
the n-gram once for each level up to its own. A count is read by probing level
after level until one is absent, so a false positive can only raise it, and a
rise by d levels needs d false positives in a row. An n-gram is never probed
beyond the level that its last word and its history have, since it cannot be
more frequent than they are; whether a probe is left out or its answer cut
comes to the same.

With c(.) the count in the middle of the level read, N tokens and V distinct
ones, the probabilities are smoothed with Dirichlet priors:
  P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
  P(w | h) = (c(h w) + m P(w | shorter h)) / (c(h) + m)

Every training n-gram is counted, by a shuffle of (hash, count) rows that tasks
have combined before; what is gathered grows with the corpus. The filter has
``BITS_PER_KEY`` bits for each (n-gram, level), however many there are. Its size
follows from the counts alone. Up to ``BROADCAST_BYTES`` it is broadcast, and
each task scores its texts by probing it. A larger one stays in its parts: texts
are read in groups of about ``GROUP`` tokens, each group sends its distinct
n-grams to the parts that may hold them, and the levels come back to the
group's texts, so a task holds one part of the filter or a few groups, not the
whole. Both ways read the same levels and give the same scores.

Tokens are words split at ASCII spaces, A-Z in lower case, then one end token
per text. Words are told apart by a 64-bit hash. Null texts count as empty:
they are the end token alone. Rows that repeat are counted and scored each. Without
training texts every probability is 1. An empty
table gives an empty table. Columns of the input named like a result are
replaced; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.columns import apart
from hydrolake.llm.tokens import BASE, U64, combine, encoded, mix, slices, words
from hydrolake.sources.shared import materialize

#: Longest n-grams, base of the count levels, weight of the shorter history.
ORDER, LEVEL_BASE, PRIOR = 2, 2.0, 8.0
#: Bits of the filter for each n-gram and level, and hash functions.
BITS_PER_KEY, HASHES = 8, 3
#: Bits of a block, which holds all bits of an n-gram's level, and parts of the filter, built apart: so many (a power of
#: two), doubled until none has more than ``PART_BYTES``.
BLOCK_BITS, PARTS, PART_BYTES = 1 << 13, 512, 16 << 20
#: An n-gram's id has so many bits more than the number of training tokens: an absent one is taken for another once in 4,096.
SPARE_BITS, LEAST_ID_BITS = 12, 40
#: Bytes up to which the whole filter is broadcast.
BROADCAST_BYTES = 128 << 20
#: Words whose exact counts are broadcast; the others' are joined.
FREQUENT = 500_000
#: Partial counts that a task holds at a time, tokens of the texts whose levels are read together, and probes made at a time.
HELD, GROUP, PROBED = 4_000_000, 1 << 20, 1 << 19
END = U64(0xE0F5_0000_0000_0001)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token last in each text, and the text's number of each."""
    _, _, _, hashes, firsts = words(texts)
    counts = np.diff(firsts)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(hashes) + len(texts), U64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = hashes
    return out, np.repeat(np.arange(len(texts)), counts + 1)


def ngrams(token: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram inside a text and where its last token is."""
    h = token.copy()
    last = np.arange(len(token))
    for back in range(1, n):
        ok = last >= back
        ok[ok] = doc[last[ok]] == doc[last[ok] - back]
        h, last = h[ok], last[ok]
        h = h * U64(BASE) + token[last - back]
    return (combine(h, np.full(len(h), n)) if n > 1 else h), last


def combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def partial_counts(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of the n-grams of a task's texts, combined as far as ``HELD`` keys allow."""
    keys, counts, held = [], [], 0
    for batch in slices(batches, "text"):
        token, doc = tokens(encoded(batch.column("text")))
        key, count = np.unique(ngrams(token, doc, n)[0], return_counts=True)
        keys.append(key)
        counts.append(count.astype(np.int64))
        held += len(key)
        if held > HELD:
            yield combined(keys, counts)
            keys, counts, held = [], [], 0
    if keys:
        yield combined(keys, counts)


def unigram_counts(texts: DataFrame) -> DataFrame:
    """``key`` (a token's hash) and ``count`` over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, count in partial_counts(batches, 1):
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000].astype(np.int64)), pa.array(count[i : i + 100_000])], names=["key", "count"])

    return texts.select("text").mapInArrow(run, "key bigint, count bigint").groupBy("key").agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class Ids:
    """How the filter knows n-grams: by ids of ``bits`` bits, the highest of which tell the part, one of ``parts``."""

    bits: int
    parts: int

    def of(self, key: np.ndarray) -> np.ndarray:
        return mix(key) >> U64(64 - self.bits)

    def part(self, ids: np.ndarray) -> np.ndarray:
        """The part of the filter that holds all levels of an n-gram."""
        return (ids >> U64(self.bits - self.parts.bit_length() + 1)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Numbers with the bytes of one rank together, so that what is zero compresses."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def rising(ids: np.ndarray) -> bytes:
    """Ascending numbers as the ``planes`` of their differences."""
    return planes(np.diff(ids, prepend=U64(0)))


def from_rising(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=U64)


def level_of(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(base) + 1e-9).astype(np.int64)


def places(ids: np.ndarray, level: np.ndarray, blocks: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of n-grams at levels within their part, and the bits in it (one row per hash function)."""
    h = mix(ids ^ mix(level.astype(U64)))
    block = ((h >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)
    g = mix(h + U64(BASE))
    step = (g >> U64(32)) | U64(1)
    bits = np.stack([(g + U64(i) * step) & U64(BLOCK_BITS - 1) for i in range(hashes)])
    return block, bits.astype(np.int64)


def filled(ids: np.ndarray, counts: np.ndarray, blocks: int, hashes: int, base: float) -> np.ndarray:
    """The bytes of one part from its n-grams' whole counts."""
    level = level_of(counts, base)
    out = np.zeros(blocks * BLOCK_BITS, bool)
    for low in range(0, len(ids), 500_000):
        some = level[low : low + 500_000]
        at = np.repeat(np.arange(len(some)), some)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(some) - some, some) + 1
        block, bit = places(ids[low + at], nth, blocks, hashes)
        for b in bit:
            out[block * BLOCK_BITS + b] = True
    return np.packbits(out, bitorder="little")


@dataclass
class Filter:
    """The filter's bytes and what is needed to read counts from it."""

    bits: np.ndarray
    ids: Ids
    blocks: int
    hashes: int
    base: float
    n_tokens: int
    n_words: int
    most: tuple[int, ...]
    order: int
    prior: float

    @property
    def filled(self) -> float:
        return float(np.unpackbits(self.bits).mean()) if len(self.bits) else 0.0

    def levels(self, key: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 if absent, never above ``limit``."""
        ids = self.ids.of(key)
        return self.read(ids, self.ids.part(ids), limit)

    def read(self, ids: np.ndarray, part: np.ndarray, limit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        live, level = np.flatnonzero(limit >= 1), 1
        while len(live):
            block, bit = places(ids[live], np.full(len(live), level), self.blocks, self.hashes)
            block += part[live] * self.blocks
            there = np.ones(len(live), bool)
            for b in bit:
                there &= (self.bits[block * (BLOCK_BITS // 8) + (b >> 3)] >> (b & 7).astype(np.uint8) & 1).astype(bool)
            live = live[there]
            out[live] = level
            level += 1
            live = live[limit[live] >= level]
        return out

    def middle(self, level: np.ndarray) -> np.ndarray:
        """The count that a level stands for: 0 for level 0, else the middle of the counts that have it."""
        low = np.ceil(self.base ** (level - 1) - 1e-9)
        high = np.maximum(low, np.ceil(self.base**level - 1e-9) - 1)
        return np.where(level == 0, 0.0, (low + high) / 2)

    def log10(self, token: np.ndarray, doc: np.ndarray, read: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each token given the tokens before it in its text; ``read(n)``, if given, has the levels,
        without a limit, of the distinct tokens (1) or of all n-grams in their order."""
        if not self.n_tokens:
            return np.zeros(len(token))

        def levels(n: int, key: np.ndarray, limit: np.ndarray) -> np.ndarray:
            return np.minimum(read(n), limit) if read else self.levels(key, limit)

        distinct, at = np.unique(token, return_inverse=True)
        own = levels(1, distinct, np.full(len(distinct), self.most[0]))[at]
        p = (self.middle(own) + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1))
        history, history_level = np.arange(len(token)), own  # level of the n-gram that ends at each token
        for n in range(2, self.order + 1):
            key, last = ngrams(token, doc, n)
            before = np.full(len(token), 0)
            before[1:] = history_level[:-1]
            limit = np.minimum(np.minimum(before[last], own[last]), self.most[n - 1])
            level = levels(n, key, limit)
            whole, part = self.middle(before[last]), np.minimum(self.middle(level), self.middle(before[last]))
            p[last] = (part + self.prior * p[last]) / (whole + self.prior)
            history_level = np.zeros(len(token), np.int64)
            history_level[last] = level
        return np.log10(p)


def by_part(how: Ids, ids: np.ndarray) -> tuple[pa.Array, pa.Array, list[tuple[int, int]]]:
    """Ascending ids, one row for each part of the filter: the part, its ids packed, and where they stand."""
    part = how.part(ids)
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    ends = list(zip(cut[:-1], cut[1:]))
    return pa.array([int(part[a]) for a, _ in ends], pa.int32()), pa.array([rising(ids[a:b]) for a, b in ends], pa.binary()), ends


def filter_parts(
    unigrams: DataFrame,
    texts: DataFrame,
    order: int = ORDER,
    base: float = LEVEL_BASE,
    prior: float = PRIOR,
    bits_per_key: int = BITS_PER_KEY,
    hashes: int = HASHES,
    most_bytes: int | None = None,
) -> tuple[Filter, DataFrame]:
    """The filter of all training texts without its bits, and those by ``part`` as ``bytes`` (with ``n_set``, how many
    are set); ``unigrams`` are the texts' token counts (``key``, ``count``).

    Tasks send their n-grams' partial counts packed by part of the filter; each
    part sums them and sets its bits. Only a caller that gives ``most_bytes`` has the filter kept below a size, at the
    price of more absent n-grams that seem present.
    """
    stats = unigrams.agg(F.count("*").alias("words"), F.sum("count").alias("tokens")).head()
    n_tokens = int(stats["tokens"] or 0)
    # Room for every n-gram that occurs, were all of them different.
    wanted = (n_tokens * (order - 1) + stats["words"]) * bits_per_key
    if most_bytes is not None:
        wanted = min(wanted, most_bytes * 8)
    n_parts = PARTS
    while wanted > n_parts * PART_BYTES * 8:
        n_parts *= 2
    blocks = max(1, -(-wanted // (n_parts * BLOCK_BITS)))
    how = Ids(min(60, max(LEAST_ID_BITS, n_tokens.bit_length() + SPARE_BITS)), n_parts)

    def counted(key: np.ndarray, count: np.ndarray, n: int) -> pa.RecordBatch:
        ids = how.of(key)
        order = np.argsort(ids)
        part, keys, ends = by_part(how, ids[order])
        count = count[order]
        counts = pa.array([planes(count[a:b]) for a, b in ends], pa.binary())
        return pa.RecordBatch.from_arrays([part, pa.array([n] * len(ends), pa.int32()), keys, counts], names=["part", "n", "keys", "counts"])

    schema = "part int, n int, keys binary, counts binary"

    def gather(n: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, count in partial_counts(batches, n):
                if len(key):
                    yield counted(key, count, n)

        return texts.select("text").mapInArrow(run, schema)

    def repack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield counted(np.asarray(batch.column("key")).astype(U64), np.asarray(batch.column("count")), 1)

    rows = unigrams.mapInArrow(repack, schema)
    for n in range(2, order + 1):
        rows = rows.unionByName(gather(n))

    def fill(key, table):
        keys, counts, most = [], [], {}
        for n, k, c in zip(*(table.column(x).to_pylist() for x in ("n", "keys", "counts"))):
            keys.append(from_rising(k))
            counts.append(from_planes(c).astype(np.int64))
            most.setdefault(n, []).append(len(keys) - 1)
        top = {n: int(level_of(combined([keys[i] for i in at], [counts[i] for i in at])[1], base).max()) for n, at in most.items()}
        k, c = combined(keys, counts)
        bits = filled(k, c, blocks, hashes, base)
        return pa.table(
            {
                "part": pa.array([key[0].as_py()], pa.int32()),
                "most": pa.array([[top.get(n, 0) for n in range(1, order + 1)]], pa.list_(pa.int32())),
                "n_set": pa.array([int(np.unpackbits(bits).sum())], pa.int64()),
                "bytes": pa.array([bits.tobytes()], pa.binary()),
            }
        )

    parts = materialize(rows.groupBy("part").applyInArrow(fill, "part int, most array<int>, n_set bigint, bytes binary"), "filter")
    most = tuple(x or 0 for x in parts.agg(*[F.max(F.col("most")[i]) for i in range(order)]).head())
    return Filter(np.zeros(0, np.uint8), how, blocks, hashes, base, n_tokens, int(stats["words"]), most, order, prior), parts


def whole_bytes(model: Filter) -> int:
    """Bytes of all parts together."""
    return model.ids.parts * model.blocks * BLOCK_BITS // 8


def gathered(model: Filter, parts: DataFrame) -> Filter:
    """The filter with its bits, on the driver; the caller knows that ``whole_bytes`` is small."""
    size = model.blocks * BLOCK_BITS // 8
    bits = np.zeros(whole_bytes(model), np.uint8)
    found = parts.select("part", "bytes").toArrow()
    for part, data in zip(found.column("part").to_pylist(), found.column("bytes")):
        bits[part * size : (part + 1) * size] = np.frombuffer(data.as_buffer(), np.uint8)
    return replace(model, bits=bits)


def build(unigrams: DataFrame, texts: DataFrame, **options) -> Filter:
    """The filter with its bits, gathered on the driver: for small models; see ``filter_parts``."""
    return gathered(*filter_parts(unigrams, texts, **options))


def all_ids(how: Ids, token: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """Ids of the distinct tokens and of the n-grams of each higher order, in their order."""
    return [how.of(np.unique(token)), *(how.of(ngrams(token, doc, n)[0]) for n in range(2, order + 1))]


def model_scores(texts: DataFrame, model: Filter, parts: DataFrame) -> DataFrame:
    """``_row`` and ``score`` of texts (``_row``, ``_group``, ``text``), from the filter's parts."""
    top = max(model.most)
    small = "u1" if top < 256 else "<u2"

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in slices(batches, "text"):
            groups = np.asarray(batch.column("_group"))
            cut = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cut[:-1], cut[1:]):
                yield int(groups[a]), batch.slice(a, b - a)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(group: int, ids: list[np.ndarray]) -> pa.RecordBatch:
            part, keys, ends = by_part(model.ids, np.unique(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([part, keys, pa.array([group] * len(ends), pa.int64())], names=["part", "keys", "_group"])

        group, ids = None, []
        for at, batch in runs(batches):
            if ids and group != at:
                yield sent(group, ids)
                ids = []
            group = at
            ids += all_ids(model.ids, *tokens(encoded(batch.column("text"))), model.order)
        if ids:
            yield sent(group, ids)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, batch in runs(batches):
            texts = encoded(batch.column("text"))
            row = [group, planes(np.asarray(batch.column("_row")).astype(U64)), planes(np.array([len(t) for t in texts])), pa.compress(b"".join(texts), "zstd", asbytes=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["_group", "rows", "sizes", "texts"])

    def read(part: pa.Table, probes: pa.Table) -> pa.Table:
        found: dict[int, list[np.ndarray]] = {}
        for group, keys in zip(probes.column("_group").to_pylist(), probes.column("keys").to_pylist()):
            found.setdefault(group, []).append(from_rising(keys))
        # A group that two tasks have read sends its n-grams in two pieces.
        asked = {g: k[0] if len(k) == 1 else np.unique(np.concatenate(k)) for g, k in found.items()}
        out = {g: np.zeros(len(k), small) for g, k in asked.items()}
        if part.num_rows and asked:
            own = replace(model, bits=np.frombuffer(part.column("bytes")[0].as_py(), np.uint8))
            key, ends = np.concatenate(list(asked.values())), np.cumsum([len(k) for k in asked.values()])
            pieces = [key[i : i + PROBED] for i in range(0, len(key), PROBED)]
            level = np.concatenate([own.read(k, np.zeros(len(k), np.int64), np.full(len(k), top)) for k in pieces])
            out = dict(zip(asked, (x.astype(small) for x in np.split(level, ends[:-1]))))
        number = (probes if probes.num_rows else part).column("part")[0].as_py()
        return pa.table({"_group": pa.array(out, pa.int64()), "part": pa.array([number] * len(out), pa.int32()), "levels": pa.array([x.tobytes() for x in out.values()], pa.binary())})

    def score(docs: pa.Table, levels: pa.Table) -> pa.Table:
        rows, texts = [], []
        for row, sizes, data in zip(*(docs.column(c).to_pylist() for c in ("rows", "sizes", "texts"))):
            ends = np.cumsum(from_planes(sizes).astype(np.int64)).tolist()
            data = pa.decompress(data, ends[-1], "zstd", asbytes=True)
            rows.append(from_planes(row).astype(np.int64))
            texts += [data[a:b] for a, b in zip([0, *ends], ends)]
        if not texts:
            return pa.table({"_row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        token, doc = tokens(texts)
        ids = all_ids(model.ids, token, doc, model.order)
        _, at = np.unique(np.concatenate(ids), return_inverse=True)
        # Parts in order, and the ids of each ascending: the order of all ids.
        level = np.frombuffer(b"".join(levels.sort_by("part").column("levels").to_pylist()), small).astype(np.int64)[at]
        by_order = np.split(level, np.cumsum([len(x) for x in ids])[:-1])
        value = model.log10(token, doc, lambda n: by_order[n - 1])
        return pa.table({"_row": pa.array(np.concatenate(rows)), "score": pa.array(np.bincount(doc, value, len(texts)))})

    probes = texts.select("_group", "text").mapInArrow(probe, "part int, keys binary, _group bigint")
    levels = parts.select("part", "bytes").groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(read, "_group bigint, part int, levels binary")
    packed = texts.select("_row", "_group", "text").mapInArrow(pack, "_group bigint, rows binary, sizes binary, texts binary")
    return packed.groupBy("_group").cogroup(levels.groupBy("_group")).applyInArrow(score, "_row bigint, score double")


def frequent_words(unigrams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the most frequent words: at most ``most`` of them, none rarer than one left out."""
    scale = F.floor(F.log2("count") * 16).cast("int")
    sizes = unigrams.groupBy(scale.alias("scale")).count().orderBy(F.desc("scale")).collect()  # 16 rows per doubling
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["scale"]
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    found = unigrams.where(scale >= least).toArrow()
    key, count = np.asarray(found.column("key")).astype(U64), np.asarray(found.column("count"))
    order = np.argsort(key)
    return key[order], count[order]


def scored(df: DataFrame, train: DataFrame, frequent: int = FREQUENT, broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """``df`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (exact smoothed unigrams) and
    ``score`` (the filter's model) of ``text``; ``train`` holds the texts to learn from. A filter of more than
    ``broadcast_bytes`` stays in its parts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    df, named = apart(df.drop("n_tokens", "n_known", "train_tokens", "base_score", "score"), ["text"])
    unigrams = materialize(unigram_counts(train), "unigrams")
    model, parts = filter_parts(unigrams, train, **options)
    keys, counts = frequent_words(unigrams, frequent)
    all_words = len(keys) == model.n_words
    total, distinct = model.n_tokens, model.n_words
    in_parts = total > 0 and whole_bytes(model) > broadcast_bytes
    shared = spark.sparkContext.broadcast((keys, counts, None if in_parts else gathered(model, parts)))
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("_group", T.LongType())]
    own.append(T.StructField("_score", T.DoubleType()))
    lists = [T.StructField("_rare", T.ArrayType(T.LongType())), T.StructField("_times", T.ArrayType(T.LongType()))]
    target = T.StructType([df.schema[c] for c in df.columns] + own + lists)
    schema = to_arrow_schema(target)
    floor = total + 0.5 * (distinct + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, whole = shared.value
        group, held = TaskContext.get().partitionId() << 33, 0
        for batch in slices(batches, "text"):
            texts = encoded(batch.column("text"))
            token, doc = tokens(texts)
            n = len(texts)
            # Texts of about GROUP tokens in all, in the task's order, make a group.
            sizes = np.bincount(doc, minlength=n)
            groups = group + (held + np.cumsum(sizes) - sizes) // GROUP
            held += int(sizes.sum())
            at = np.minimum(np.searchsorted(known, token), max(0, len(known) - 1))
            is_known = known[at] == token if len(known) else np.zeros(len(token), bool)
            base = np.zeros(len(token))
            if total:
                base[is_known] = np.log10((count[at[is_known]] + 0.5) / floor)
                if all_words:
                    base[~is_known] = math.log10(0.5 / floor)
            rare, times = pa.array([[]] * n, pa.list_(pa.int64())), pa.array([[]] * n, pa.list_(pa.int64()))
            if not all_words:
                # The other words of each text, each once, with how often it occurs.
                key, owner = token[~is_known], doc[~is_known]
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])) if len(key) else np.zeros(0, int)
                offsets = pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32))
                rare = pa.ListArray.from_arrays(offsets, pa.array(key[first].astype(np.int64)))
                times = pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(first, len(key)))))
            own = [
                pa.array(sizes),
                pa.array(np.bincount(doc, is_known, n).astype(np.int64)),
                pa.array(np.bincount(doc, base, n)),
                pa.array(groups),
                pa.nulls(n, pa.float64()) if whole is None else pa.array(np.bincount(doc, whole.log10(token, doc), n)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own, rare, times], schema=schema)

    stored = df.mapInArrow(run, target)
    if in_parts or not all_words:
        # The rows are stored with a number, by which the scores and the exact counts of their rare words come back.
        stored = materialize(stored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    out = stored.drop("_rare", "_times", "_group", "_score") if in_parts else stored.drop("_rare", "_times", "_group").withColumnRenamed("_score", "score")
    if in_parts:
        out = out.join(model_scores(stored.select("_row", "_group", "text"), model, parts), "_row", "left")
    extra = {"_base": F.lit(0.0), "_known": F.lit(0)}
    if not all_words:
        rare = stored.select("_row", F.inline(F.arrays_zip(F.col("_rare").alias("key"), F.col("_times").alias("times"))))
        met = rare.join(unigrams, "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        sums = met.groupBy("_row").agg(
            F.sum(F.col("times") * F.log10((F.col("count") + 0.5) / F.lit(floor))).alias("_base"),
            F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("_known"),
        )
        out = out.join(sums, "_row", "left")
        extra = {"_base": F.coalesce("_base", F.lit(0.0)), "_known": F.coalesce("_known", F.lit(0))}
    out = out.select(
        *df.columns,
        "n_tokens",
        (F.col("n_known") + extra["_known"]).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + extra["_base"]).alias("base_score"),
        "score",
    )
    return named(out)
