"""Removal of repeated byte strings, by refining q-gram buckets.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
elsewhere, in the same document or another; strings never cross documents.

Suffixes are put into buckets by their first ``GRAM`` bytes, and a bucket's
pointer is the place of its first suffix in the sorted order. Buckets are
refined by sorting their suffixes on the pointers found some bytes further on:
suffixes that agree in d bytes are told apart by the pointers at offset d, which
stand for d bytes as well. The pointers are updated and the next refinement
reads the updated ones, so the depth doubles until it is ``LENGTH``. Suffixes
that are alone in their bucket are never sorted again. The first buckets are
found by a hash of the gram, so strings that are left in one bucket are compared
byte by byte at the end.

What makes it distributed is the first, sparse bucketing. Every string of
``LENGTH`` bytes names one of its ``ANCHOR``-grams, the leftmost of smallest
hash; equal strings name the same one. Anchors are counted with a map-side
combine, and a bitmap of those that occur in different texts or twice in one,
16 MB whatever the input, tells each task which of its strings may
repeat. Their bytes, each anchor's strings in one stretch, meet by anchor. A
stretch that a task has already sent twice is settled there, by a cryptographic
digest of 128 bits. The strings of anchors with very many texts meet by such a
digest of their own instead, so no common passage lands in one task.

Documents with equal texts lose all bytes if they have ``LENGTH`` of them.
Null texts count as empty. Rows that repeat an id and a text are documents
like others, copies of each other. An empty table gives an empty table.
Columns of the input named like a result are replaced; others pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.columns import apart
from hydrolake.llm.filters import hash_filter
from hydrolake.llm.tokens import U64, Rolling, encoded, join_texts, slices
from hydrolake.sources.shared import materialize

#: Bytes of a string that must not repeat, and of the sampled anchors.
LENGTH, ANCHOR = 200, 64
#: Bytes of the first buckets, and strings that are compared byte by byte at a time.
GRAM, COMPARED = 50, 50_000
#: Bits of the bitmap of anchors that repeat.
FILTER_BITS = 1 << 27
#: Anchors in this many texts, or in more than this share of all anchors' occurrences, are split by string.
COMMON, COMMON_SHARE = 10_000, 1e-6
#: Anchor occurrences that one group of the last step receives at most on average.
GROUP = 50_000

KEY = ("_id", "_text_hash")


def keyed(docs: DataFrame) -> DataFrame:
    """Key by which results come back to documents, even where doc_id is null or repeats."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_text_hash": F.xxhash64("text")})


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values, by its start."""
    span = 1
    while 2 * span <= width:
        x = pick(x[: len(x) - span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Anchors:
    """For the texts of a buffer: which strings of ``length`` bytes name which anchor.

    ``low``, ``high``: first and last start of the strings of one anchor;
    ``hash``: the anchor's hash; ``doc``: the text's number.
    """

    def __init__(self, texts: list[bytes], length: int, anchor: int):
        self.data, self.begins = join_texts(texts)
        n = len(self.data)
        self.low = self.high = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(sizes) or sizes.max() < length:
            return
        gram = Rolling(self.data).windows(anchor)
        width = length - anchor + 1
        least = sliding(gram, width, np.minimum)  # by the string's start
        inside = np.zeros(n + 1, np.int64)
        long = sizes >= length
        np.add.at(inside, self.begins[:-1][long], 1)
        np.add.at(inside, (self.begins[:-1] + sizes - length + 1)[long], -1)
        valid = np.cumsum(inside)[: len(least)] > 0
        least = np.where(valid, least, U64(0))
        padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(len(gram) - len(least), U64)])
        named = np.flatnonzero(gram == sliding(padded, width, np.maximum)[: len(gram)])
        # Runs of strings with one smallest hash, cut after each anchor: the leftmost at or after the start is named.
        change = np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])])
        cut = named + 1
        change[cut[cut < len(change)]] = True
        low = np.flatnonzero(change)
        high = np.concatenate([low[1:] - 1, [len(least) - 1]])
        ok = valid[low]
        low, high = low[ok], high[ok]
        value, rank = np.unique(gram[named], return_inverse=True)
        at = np.sort(rank.astype(np.int64) << 40 | named)
        want = np.searchsorted(value, least[low]).astype(np.int64) << 40 | low
        place = at[np.searchsorted(at, want)] & ((1 << 40) - 1)
        # Neighbouring runs of one anchor are one stretch.
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (low[1:] != high[:-1] + 1)])) if len(low) else np.zeros(0, int)
        self.low = low[first]
        self.high = high[np.append(first[1:] - 1, len(high) - 1)] if len(first) else high[:0]
        self.hash = gram[place[first]]
        self.doc = np.searchsorted(self.begins, self.low, side="right") - 1


def singles_out(digests: np.ndarray) -> np.ndarray:
    """Whether each digest, a row of two numbers, occurs more than once."""
    order = np.lexsort(digests.T)
    same = (digests[order[1:]] == digests[order[:-1]]).all(axis=1)
    out = np.zeros(len(digests), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def same_bytes(data: np.ndarray, at: np.ndarray, pointer: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each of ``at`` is also at another place of the same bucket."""
    order = np.argsort(pointer, kind="stable")
    at, pointer = at[order], pointer[order]
    first = np.flatnonzero(np.concatenate([[True], pointer[1:] != pointer[:-1]]))
    size = np.diff(np.append(first, len(at)))
    head = at[np.repeat(first, size)]
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    equal = np.empty(len(at), bool)
    for low in range(0, len(at), COMPARED):
        some = slice(low, low + COMPARED)
        equal[some] = (strings[at[some]] == strings[head[some]]).all(axis=1)
    found = np.repeat(size > 1, size)
    # Buckets in which the gram's hash has brought different strings together.
    for b in np.flatnonzero(~np.logical_and.reduceat(equal, first)).tolist():
        texts = [strings[p].tobytes() for p in at[first[b] : first[b] + size[b]].tolist()]
        times = Counter(texts)
        found[first[b] : first[b] + size[b]] = [times[t] > 1 for t in texts]
    out = np.empty(len(at), bool)
    out[order] = found
    return out


def repeated(data: np.ndarray, starts: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """Which of the strings of ``length`` bytes at ``starts`` (different places) occur at several of these places."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    depths = [min(gram, length)]
    while depths[-1] < length:
        depths.append(min(2 * depths[-1], length))
    # Offsets in a string whose pointers are read at each depth.
    offsets = [np.zeros(1, np.int64)]
    for low, high in zip(depths[-2::-1], depths[:0:-1]):
        offsets.insert(0, np.unique(np.concatenate([offsets[0], offsets[0] + high - low])))
    value = Rolling(data).windows(depths[0])
    pointer, alone = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    live = np.arange(len(starts))
    for i, depth in enumerate(depths):
        if not len(live):
            return out
        marked = np.zeros(len(value), bool)
        for offset in offsets[i].tolist():
            marked[starts[live] + offset] = True
        at = np.flatnonzero(marked & ~alone)
        old = pointer[at]
        # The bucket, then the pointer at the end of what its suffixes have in common.
        key = value[at] if i == 0 else old * len(value) + pointer[at + depth - depths[i - 1]]
        order = np.argsort(key)
        at, old, key = at[order], old[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(at)]
        size = np.diff(np.append(first, len(at)))
        bucket = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))[: len(at)]
        # Parts of a bucket keep to the places that it had.
        pointer[at] = old + np.repeat(first, size) - np.repeat(bucket, np.diff(np.append(bucket, len(at))))
        alone[at] = np.repeat(size == 1, size)
        live = live[~alone[starts[live]]]
    if len(live):
        out[live] = same_bytes(data, starts[live], pointer[starts[live]], length)
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places starts[i], starts[i] + 1, ... (counts[i] of them), one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def runs_of(flag: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within one row."""
    if not len(flag):
        return np.zeros(0, int), np.zeros(0, int)
    joined = flag[1:] & flag[:-1] & (row[1:] == row[:-1])
    return np.flatnonzero(flag & ~np.concatenate([[False], joined])), np.flatnonzero(flag & ~np.concatenate([joined, [False]]))


def anchor_counts(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``h``, ``n`` texts that hold the anchor, and whether they differ or one holds it twice: ``again``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = encoded(batch.column("text"))
            a = Anchors(texts, length, anchor)
            text_id = Rolling(a.data).of(a.begins[:-1], a.begins[1:]) if len(texts) else np.zeros(0, U64)
            order = np.lexsort((a.hash, a.doc))
            h, d = a.hash[order], a.doc[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, int)
            twice = np.diff(np.append(first, len(h))) > 1
            yield pa.RecordBatch.from_arrays([pa.array(h[first].astype(np.int64)), pa.array(text_id[d[first]].astype(np.int64)), pa.array(twice)], names=["h", "t", "twice"])

    found = docs.select("text").mapInArrow(run, "h bigint, t bigint, twice boolean").groupBy("h")
    counts = found.agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.max("twice").alias("twice"))
    return counts.select("h", "n", ((F.col("a") < F.col("b")) | F.col("twice")).alias("again"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, filter_bits: int = FILTER_BITS, common: int = COMMON) -> DataFrame:
    """Spans of bytes to remove: the document's key, ``low`` and ``high`` (exclusive); spans may overlap."""
    spark = docs.sparkSession
    counts = materialize(anchor_counts(docs, length, anchor), "anchors")
    again = counts.where("again")
    total = counts.agg(F.sum("n")).head()[0] or 0
    bitmap = np.zeros(filter_bits // 8, np.uint8)
    for row in hash_filter(again, "h", filter_bits).toLocalIterator():  # filter_bits / 32768 rows of 4 KB
        at = (row["_bucket"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(row["_bits"], np.uint8)
    many = max(common, int(total * COMMON_SHARE))
    hot = np.sort(np.array([r["h"] for r in again.where(F.col("n") > many).select("h").collect()], np.int64).astype(U64))  # at most 1 / COMMON_SHARE
    groups = max(16, total // GROUP)
    shared = spark.sparkContext.broadcast((bitmap, hot))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of strings that may repeat, packed by group; group -1: spans that are settled here."""
        bits, often = shared.value
        sent: dict[bytes, int] = {}

        def fresh(digests: list[bytes]) -> np.ndarray:
            """Whether each is the task's first or second."""
            out = np.empty(len(digests), bool)
            for i, x in enumerate(digests):
                n = sent.get(x, 0)
                out[i] = n < 2
                if n < 2:
                    sent[x] = n + 1
            return out

        def packed(batch, group, kind, doc, low, count, blobs) -> pa.RecordBatch:
            order = np.argsort(group, kind="stable")
            group, doc, low, count = group[order], doc[order], low[order], count[order]
            edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
            offsets = pa.array(edge, pa.int32())
            ids = [np.asarray(batch.column(c))[doc] for c in KEY]
            blob = [b"".join([blobs[i] for i in order[a:b]]) for a, b in zip(edge[:-1], edge[1:])] if blobs else [b""] * (len(edge) - 1)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(group[edge[:-1]] if len(group) else group, pa.int64()),
                    pa.array([kind] * (len(edge) - 1), pa.int32()),
                    *[pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in ids],
                    pa.ListArray.from_arrays(offsets, pa.array(low, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64())),
                    pa.array(blob, pa.binary()),
                ],
                names=["part", "kind", "ids", "hashes", "lows", "counts", "bytes"],
            )

        for batch in slices(batches, "text"):
            a = Anchors(encoded(batch.column("text")), length, anchor)
            bit = (a.hash % U64(filter_bits)).astype(np.int64)
            maybe = (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            common_one = np.isin(a.hash, often) if len(often) else np.zeros(len(a.hash), bool)
            data = a.data.tobytes()
            for split in (False, True):
                some = np.flatnonzero(maybe & (common_one == split))
                if not len(some):
                    continue
                low, high, doc, h = a.low[some], a.high[some], a.doc[some], a.hash[some]
                if split:
                    count = high - low + 1
                    low = spread(low, count)
                    doc, high = np.repeat(doc, count), low
                blobs = [data[x:y] for x, y in zip(low.tolist(), (high + length).tolist())]
                digests = [blake2b(x, digest_size=16).digest() for x in blobs]
                new = fresh(digests)
                begin = a.begins[doc]
                old = ~new
                if old.any():
                    yield packed(batch, np.full(old.sum(), -1), 0, doc[old], (low - begin)[old], (high - low + 1)[old], None)
                if split:
                    blobs, h = digests, np.frombuffer(b"".join(digests), "<u8")[::2]
                blobs = [x for x, fine in zip(blobs, new.tolist()) if fine]
                low, high, doc, begin = low[new], high[new], doc[new], begin[new]
                group = (h[new] % U64(groups)).astype(np.int64)
                yield packed(batch, group, 1 + split, doc, low - begin, high - low + 1, blobs)

    def refine(key, table):
        """Spans of the strings of a group that occur more than once in it."""
        out = []
        for kind in (1, 2):
            rows = table.filter(pa.compute.equal(table.column("kind"), kind))
            if not rows.num_rows:
                continue
            ids, hashes, low, count = (np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("ids", "hashes", "lows", "counts"))
            data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
            row = np.repeat(np.arange(len(low)), count)
            if kind == 1:
                begin = np.cumsum(count + length - 1) - (count + length - 1)
                flag = repeated(data, spread(begin, count), length)
            else:
                flag = singles_out(data.view("<u8").reshape(-1, 2))
            place = spread(low, count)
            first, last = runs_of(flag, row)
            out.append((ids[row[first]], hashes[row[first]], place[first], place[last] + length))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip((*KEY, "low", "high"), columns)})

    sent = materialize(docs.select(*KEY, "text").mapInArrow(send, "part bigint, kind int, ids array<bigint>, hashes array<bigint>, lows array<bigint>, counts array<bigint>, bytes binary"), "stretches")
    settled = sent.where("part < 0").select(F.inline(F.arrays_zip("ids", "hashes", "lows", "counts"))).select(
        F.col("ids").alias("_id"), F.col("hashes").alias("_text_hash"), F.col("lows").alias("low"), (F.col("lows") + F.col("counts") + (length - 1)).alias("high")
    )
    met = sent.where("part >= 0").groupBy("part").applyInArrow(refine, "_id bigint, _text_hash bigint, low bigint, high bigint")
    return met.unionByName(settled)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, **options) -> DataFrame:
    """All documents with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that stay) in place of ``text``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    results = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
    docs, named = apart(docs.drop(*[f.name for f in results]), ["doc_id", "text"])
    base = keyed(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    spans = repeated_spans(base, length, anchor, **options)
    digests = base.select(*KEY, F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("high")).where(F.col("high") >= length)
    twice = materialize(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "copied-texts")
    copies = digests.join(twice, "digest").select(*KEY, F.lit(0).cast("long").alias("low"), "high").distinct()
    spans = spans.unionByName(copies).groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("_spans"))
    joined = base.join(spans, list(KEY), "left").drop(*KEY)
    kept_columns = [c for c in docs.columns if c != "text"]
    target = T.StructType([docs.schema[c] for c in kept_columns] + results)
    schema = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, removed, pieces, kept = [], [], [], []
            for text, spans in zip(encoded(batch.column("text")), batch.column("_spans").to_pylist()):
                merged: list[list[int]] = []
                for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(high, merged[-1][1])
                    else:
                        merged.append([low, high])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                pieces.append(len(merged))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept_columns], pa.array(sizes), pa.array(removed), pa.array(pieces), pa.array(kept, pa.binary())], schema=schema)

    return named(joined.select(*kept_columns, "text", "_spans").mapInArrow(run, target))
