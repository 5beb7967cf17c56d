"""Near-duplicate documents by DartMinHash signatures.

A document is the weighted set of its five-word shingles (weight: how often the
shingle occurs), similarity is weighted Jaccard, sum of minima over sum of
maxima. Darts are thrown at the plane of weight and rank of every element: the
number of darts in a region, their ranks and their coordinates follow from a
hash of element, unit of weight and rank interval alone, so equal elements of
two documents meet the same darts. A document keeps the darts below its
weights and of these the earliest of each of ``k`` coordinates. Rank intervals
double, and a document is thrown at until about ``k ln k + 2k`` darts are
expected, then until no coordinate is empty; large documents need few darts
per element.

Exact copies are one class before anything else. Bands of the signature put
classes into buckets. Each bucket compares its members with one of them, the
one whose buckets are fullest, so copies of one original need one comparison
each. Pairs are verified on the texts. Members of one bucket that are still in
different components are then compared with each other in blocks, by signature
alone; those that have a promising partner meet again in the same blocks with
their texts, and only links leave these. So no pair that shares a bucket is
lost, pairs inside a component are not compared, and no text is copied because
of a bucket that it shares with unlike ones. Classes are the components of verified pairs.

Words are split at ASCII spaces, A-Z in lower case; a text of one to four words
is one shingle. Texts without words, null ones included, are in no group:
each is its own class. Rows that repeat an id and a text are one document; of
texts under one id each is a document, and the id has a row for each. A null
doc_id is an id of its own. Empty tables give empty tables.
Columns named like those of the result are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.filters import hash_filter, maybe_in
from hydrolake.llm.graph import components
from hydrolake.llm.tokens import BASE, U64, combine, encoded, mix, shingles, slices, words
from hydrolake.sources.shared import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: Bands, and coordinates in a band. At similarity 0.8 a pair misses all bands with probability 3e-5.
BANDS, ROWS = 20, 4
#: First rank interval, as a power of two; each later one ends at twice the rank.
FIRST = -6
#: Share of equal coordinates below which a pair is not verified; at similarity 0.8 that happens with probability 2e-5.
PROMISING = 0.6
#: Classes in a block of the last comparison.
BLOCK = 256

UNIT = 2.0**-53


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * UNIT


def poisson(mean: float, u: np.ndarray) -> np.ndarray:
    """Poisson counts from uniform numbers."""
    last = int(mean + 12 * math.sqrt(mean) + 20)
    logs = np.cumsum(np.log(np.maximum(np.arange(last + 1), 1)))
    return np.searchsorted(np.cumsum(np.exp(np.arange(last + 1) * math.log(mean) - mean - logs)), u, side="right")


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signature of each document: ``k`` hashes; all zero for documents without elements."""
    units = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    cell, cell_doc = combine(element[at], unit), doc[at]
    root = mix(cell) * U64(BASE)
    room = np.minimum(weight[at] - unit, 1.0)  # what of the unit lies below the weight
    total = np.bincount(doc, weight, n_docs)
    out = np.zeros((n_docs, k), U64)
    # The level at which a document expects enough darts.
    enough = np.full(n_docs, -(2**30))
    some = total > 0
    enough[some] = np.maximum(0, np.ceil(np.log2((k * math.log(k) + 2 * k) / total[some])).astype(int) - FIRST)
    best = np.full((n_docs, k), np.inf)
    open_docs, level = some.copy(), 0
    while open_docs.any():
        live = np.flatnonzero(open_docs[cell_doc])
        low = 0.0 if level == 0 else 2.0 ** (FIRST + level - 1)
        high = 2.0 ** (FIRST + level)
        seed = mix(root[live] + U64(level))
        count = poisson(high - low, uniform(seed))
        hit = np.flatnonzero(count)
        dart = np.repeat(seed[hit], count[hit])
        number = np.arange(len(dart)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        dart = combine(dart, number + 1)
        owner = np.repeat(live[hit], count[hit])
        inside = room[owner] >= 1
        if not inside.all():
            inside |= uniform(combine(dart, np.full(len(dart), 3))) < room[owner]
            dart, owner = dart[inside], owner[inside]
        rank = low + (high - low) * uniform(combine(dart, np.full(len(dart), 1)))
        coordinate = (combine(dart, np.full(len(dart), 2)) % U64(k)).astype(np.int64)
        d = cell_doc[owner]
        order = np.lexsort((dart, rank, coordinate, d))
        d, coordinate, rank, dart = d[order], coordinate[order], rank[order], dart[order]
        place = d * k + coordinate
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
        # Ranks of a level are above those of all earlier ones.
        new = first[~np.isfinite(best[d[first], coordinate[first]])]
        best[d[new], coordinate[new]] = rank[new]
        out[d[new], coordinate[new]] = dart[new]
        full = np.isfinite(best).all(axis=1)
        open_docs &= ~(full & (enough <= level))
        level += 1
    return out


def weighted_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often each occurs, and the text's number; ordered by text and shingle."""
    _, _, _, hashes, firsts = words(texts)
    h, d = shingles(hashes, firsts, width)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, int)
    return h[new], np.diff(np.append(new, len(h))), d[new]


def signed(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``signature`` (packed 32-bit hashes) and ``bands`` (a key for each);
    the last two are null for texts without words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, digest binary, signature binary, bands array<bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        for batch in slices(batches, "text"):
            texts = encoded(batch.column("text"))
            h, n, d = weighted_shingles(texts, width)
            s = signatures(h, n.astype(np.float64), d, len(texts), k)
            has = np.bincount(d, minlength=len(texts)) > 0
            key = np.empty((len(texts), bands), U64)
            for b in range(bands):
                key[:, b] = combine(np.full(len(texts), b), *s[:, b * rows : (b + 1) * rows].T)
            packed = (s >> U64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([p.tobytes() if x else None for p, x in zip(packed, has)], pa.binary()),
                    pa.array([r.astype(np.int64).tolist() if x else None for r, x in zip(key, has)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "signature", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sets: sorted distinct elements and their weights."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    shared = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Of distinct pairs (a, b) of class digests, those whose texts are similar enough, with ``similarity``."""
    left = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            n = batch.num_rows
            # A text that is on many pairs of the slice is cut once.
            column = encoded(batch.column("text_a")) + encoded(batch.column("text_b"))
            number = {t: i for i, t in enumerate(dict.fromkeys(column))}
            h, w, d = weighted_shingles(list(number), width)
            ends = np.searchsorted(d, np.arange(len(number) + 1))
            sets = [(h[i:j], w[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            found = np.array([jaccard(sets[number[column[i]]], sets[number[column[n + i]]]) for i in range(n)])
            keep = np.flatnonzero(found >= least - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(found[keep])],
                names=["a", "b", "similarity"],
            )

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def promising(pairs: DataFrame, classes: DataFrame, least: float, k: int) -> DataFrame:
    """Pairs whose signatures agree in a share of at least ``least`` coordinates."""
    sig = classes.select("digest", "signature")
    both = pairs.join(sig.withColumnsRenamed({"digest": "a", "signature": "sa"}), "a").join(sig.withColumnsRenamed({"digest": "b", "signature": "sb"}), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, k) for c in ("sa", "sb"))
            keep = pa.array(np.flatnonzero((sa == sb).mean(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def pairs_apart(table: pa.Table, bands: int, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a pair of blocks that are to be compared: one of the first block, and those of the second that are in
    other components, have a promising signature and share no earlier band with it."""
    part, x, y, band = (np.asarray(table.column(c).combine_chunks()) for c in ("part", "x", "y", "band"))
    number: dict[bytes, int] = {}
    label = np.array([number.setdefault(c, len(number)) for c in table.column("component").to_pylist()])
    s = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(-1, bands, rows)
    right = np.flatnonzero(part == y)
    for i in np.flatnonzero(part == x).tolist():
        over = right[right > i] if x[0] == y[0] else right
        over = over[label[over] != label[i]]
        same = s[over] == s[i]
        earlier = same.all(axis=2)[:, : band[0]].any(axis=1)
        found = over[~earlier & (same.mean(axis=(1, 2)) >= PROMISING)]
        if len(found):
            yield i, found


def block_links(members: DataFrame, texts: DataFrame, width: int, least: float, bands: int, rows: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b, similarity) between members of one bucket that are in different components.

    ``members``: key, n (rows of the key), band, digest, component, signature;
    ``texts``: digest, text. A bucket is cut into blocks by a hash; each pair of
    blocks is one task's work, so no bucket is ever in one place, and only links
    leave it. A pair that shares several buckets is looked at in that of its
    first common band, by signature and then by text, unless links found before
    already connect it. Texts go only to the blocks where they have a partner.
    """
    dealt = members.withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    copies = dealt.select("key", "band", "digest", "component", "signature", "part", other)
    copies = copies.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")}).drop("other")

    def partnered(key, table):
        keep = np.zeros(table.num_rows, bool)
        for i, found in pairs_apart(table, bands, rows):
            keep[i] = True
            keep[found] = True
        return table.filter(pa.array(keep))

    def run(key, table):
        digest = table.column("digest").to_pylist()
        label = table.column("component").to_pylist()
        h, w, d = weighted_shingles(encoded(table.column("text").combine_chunks()), width)
        ends = np.searchsorted(d, np.arange(len(digest) + 1))
        root = {c: c for c in label}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        out = []
        for i, found in pairs_apart(table, bands, rows):
            for j in found.tolist():
                p, q = find(label[i]), find(label[j])
                if p != q:
                    alike = jaccard((h[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]), (h[ends[j] : ends[j + 1]], w[ends[j] : ends[j + 1]]))
                    if alike >= least - 1e-12:
                        root[p] = q
                        out.append((digest[i], digest[j], alike))
        a, b, f = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(f, pa.float64())})

    near = materialize(copies.groupBy("key", "x", "y").applyInArrow(partnered, copies.schema), "partnered")
    return near.join(texts.select("digest", "text"), "digest").groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary, similarity double")


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id`` and ``class_id`` (the smallest doc_id of its group; its own for texts without
    words)."""
    k = bands * rows
    base = materialize(signed(docs, width, bands, rows), "signatures")
    ids = base.select("doc_id", "digest", F.col("signature").isNull().alias("blank")).distinct()
    classes = base.where("signature IS NOT NULL").groupBy("digest").agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    # Buckets with two members at least.
    placed = classes.select("digest", F.posexplode("bands").alias("band", "key"))
    # Summaries of a key are stored before they are joined back, so that Spark can split a hot key.
    full = materialize(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    buckets = materialize(placed.join(full, "key"), "buckets")
    load = buckets.groupBy("digest").agg(F.sum("n").alias("load"))
    heads = buckets.select("key", "digest").join(load, "digest").groupBy("key").agg(F.max(F.struct("load", "digest")).alias("best"))
    heads = materialize(heads.select("key", F.col("best.digest").alias("head")), "heads")
    first = buckets.select("key", "digest").join(heads, "key").where("digest != head").select(F.least("digest", "head").alias("a"), F.greatest("digest", "head").alias("b")).distinct()
    involved = buckets.select("digest").distinct()
    texts = docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text").withColumn("_h", F.xxhash64("digest"))
    texts = maybe_in(texts, "_h", hash_filter(involved.select(F.xxhash64("digest").alias("_h")), "_h"))
    texts = materialize(texts.groupBy("digest").agg(F.first("text").alias("text")).join(involved, "digest", "left_semi"), "suspects")
    links = materialize(verified(promising(first, classes, PROMISING, k), texts, width, least), "links")
    # Pairs without a head that share a bucket but no component yet.
    found = components(links, "a", "b")
    rest = buckets.join(heads, "key").where("digest != head").join(found.withColumnRenamed("node", "digest"), "digest", "left")
    rest = rest.select("key", "band", "digest", F.coalesce("component", "digest").alias("component"))
    apart = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low != high")
    apart = materialize(apart.select("key", "n"), "split-buckets")
    members = rest.join(apart, "key").join(classes.select("digest", "signature"), "digest")
    more = materialize(block_links(members, texts, width, least, bands, rows), "links")
    group = joined_components(found, more)
    named = ids.join(group.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = materialize(named.groupBy("component").agg(F.min("doc_id").alias("smallest")), "smallest")
    joined = named.join(smallest, "component")
    return joined.select("doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("smallest")).alias("class_id"))


def joined_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b), which are few: a graph of components only."""
    if not more.limit(1).count():
        return found
    ends = [found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b")]
    links = more.join(ends[0], "a", "left").join(ends[1], "b", "left")
    links = links.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = components(links, "a", "b").select(F.col("node").alias("_from"), F.col("component").alias("_root"))
    # Every node of a new link has a row, those that had no link before too.
    nodes = found.unionByName(merged.select(F.col("_from").alias("node"), F.col("_from").alias("component"))).distinct()
    return nodes.join(merged, F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_root", "component").alias("component")).distinct()


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, the one with the smallest id; texts without words all stay."""
    name = max(["_kept", *docs.columns], key=len) + "_"  # longer than any other, so no column of the table
    out = near_duplicates(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
