"""Nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised by its own codebook, so k centroids a half
make k * k cells. A query ranks the centroids of either half and walks the
centroid pairs in the order of their summed distance (minus the inner product)
with a heap, until the cells it has met hold ``share`` of all entries and at
least ``least`` of them. The entries of these cells are reranked by the exact
inner product in double precision.

The codebooks are fitted on at most ``SAMPLE`` vectors; every vector is
indexed. Equal vectors are one entry with its k + 1 smallest ids, which is all
that a result of k can hold, so copies cost one comparison. Cells are packed
into blocks of about ``BLOCK`` entries, large cells cut into several; queries
go to the blocks in chunks, so a task's work is bounded. Queries with equal
vectors are searched once.

Vectors that are null, zero, or hold null or non-finite components take no
part; nor do those whose length is not the most frequent one (of equals the
largest). Repeated rows count once; an id never finds itself, whatever its vectors, and a query id with several vectors
is answered for the one that comes first in order. Rows with a null id take no part. An empty table gives an
empty table. Other columns are not carried, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.sources.shared import materialize

#: Centroids of a half, vectors that they are fitted on at most, and rounds of fitting.
CENTROIDS, SAMPLE, ROUNDS = 64, 16384, 12
#: Share of the entries, and number of them, that a query looks at.
SHARE, LEAST = 0.5, 2000
#: Entries of a block, and queries of a chunk.
BLOCK, CHUNK = 8192, 512


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Distinct (vec_id, embedding) that take part, components as doubles."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    # Minus zero is zero, so that equal vectors are equal keys.
    v = v.where(F.col("vec_id").isNotNull() & fine & some).withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    length = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return v.where(F.size("embedding") == (length["n"] if length else 0)).distinct()


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """``entry`` (the smallest id), ``embedding`` and ``ids`` (the k + 1 smallest) of each distinct vector."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= k + 1)
    ids = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.get("ids", F.lit(0)).alias("entry"), "embedding", "ids")


def codebook(sample: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; a centroid without rows stays where it is."""
    k = max(1, min(k, len(sample)))
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, column, k) for column in sample.T], axis=1) if sample.shape[1] else np.zeros((k, 0))
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * rows @ centroids.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> list[int]:
    """Cells in the order of the summed distances ``first[i] + second[j]`` until they hold ``need`` entries."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    width, cells, held = len(second), [], 0
    # The next column of each row that was begun; row i + 1 begins when (i, 0) is met.
    heap = [(x[0] + y[0], 0, 0)]
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if counts[cell]:
            cells.append(cell)
            held += counts[cell]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    centroids: int = CENTROIDS,
    share: float = SHARE,
    least: int = LEAST,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` for every query; ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    all_ids = materialize(usable(vectors), "vectors")
    index = materialize(entries(all_ids, k), "entries")
    # Rows in the order of a hash are a random sample that is the same in every run.
    sample = index.orderBy(F.xxhash64("embedding"), "entry").limit(SAMPLE).select("embedding").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = matrix(sample.column("embedding"))
    half = rows.shape[1] // 2
    first, second = codebook(rows[:, :half], centroids, ROUNDS), codebook(rows[:, half:], centroids, ROUNDS)
    books = spark.sparkContext.broadcast((first, second))

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("embedding"))
                cell = nearest(x[:, :half], one) * len(two) + nearest(x[:, half:], two)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    schema = "entry bigint, embedding array<double>, ids array<bigint>, cell int"
    located = materialize(index.mapInArrow(locate, schema), "located")
    counts = np.zeros(len(first) * len(second), np.int64)
    for row in located.groupBy("cell").count().collect():  # one number per cell, as many as there are centroid pairs
        counts[row["cell"]] = row["count"]
    total = int(counts.sum())
    # Blocks: small cells share one, a large cell has several of its own.
    parts = np.maximum(1, -(-counts // block))
    begin, at, held = np.zeros(len(counts), np.int64), 0, 0
    for cell in np.flatnonzero(counts).tolist():
        if held and (parts[cell] > 1 or held + counts[cell] > block):
            at, held = at + 1, 0
        begin[cell] = at
        held += counts[cell]
        if parts[cell] > 1:
            at, held = at + int(parts[cell]), 0
    need = min(total, max(least, int(np.ceil(share * total))))
    plan = spark.sparkContext.broadcast((first, second, counts, begin, parts, need))
    asked = all_ids.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = materialize(asked.join(index.select("entry", "embedding"), "embedding").select("query_id", "entry"), "asked")
    searched = located.select("entry", "embedding").join(asked.select("entry").distinct(), "entry")
    chunks = max(1, -(-asked.count() // chunk))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, size, start, n_parts, enough = plan.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 64):
                batch = whole.slice(cut, 64)
                x = matrix(batch.column("embedding"))
                a, b = -(x[:, :half] @ one.T), -(x[:, half:] @ two.T)
                row, where, seen = [], [], []
                for i in range(len(x)):
                    by_block: dict[int, list[int]] = {}
                    for cell in walk(a[i], b[i], size, enough):
                        for p in range(n_parts[cell]):
                            by_block.setdefault(int(start[cell]) + p, []).append(cell)
                    row += [i] * len(by_block)
                    where += by_block
                    seen += by_block.values()
                out = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([out.column("entry"), out.column("embedding"), pa.array(where, pa.int64()), pa.array(seen, pa.list_(pa.int32()))], names=["entry", "embedding", "block", "cells"])

    def compare(key, left, right):
        """The best k + 1 entries of a block for each query of a chunk, ties to the smaller id."""
        names = ["entry", "id", "score"]
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        if not left.num_rows or not right.num_rows:
            return empty
        score = matrix(left.column("embedding")) @ matrix(right.column("embedding")).T
        cells, cell = np.unique(np.array(right.column("cell")), return_inverse=True)
        met = np.zeros((left.num_rows, len(cells)), bool)
        for i, seen in enumerate(left.column("cells").to_pylist()):
            met[i, np.searchsorted(cells, seen)] = True
        score[~met[:, cell]] = -np.inf
        query, own, ids = left.column("entry").to_pylist(), np.array(right.column("entry")), right.column("ids").to_pylist()
        most = min(k + 1, score.shape[1])
        least_score = np.partition(score, score.shape[1] - most, axis=1)[:, -most]
        out = []
        for i, q in enumerate(query):
            good = np.flatnonzero((score[i] >= least_score[i]) & (score[i] > -np.inf))
            found = [(-s, v) for j, s in zip(good.tolist(), score[i, good].tolist()) for v in ids[j]]
            out += [(q, v, -s) for s, v in sorted(found)[: k + 1]]
        if not out:
            return empty
        e, v, s = zip(*out)
        return pa.table([pa.array(e, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=names)

    deal = F.pmod(F.xxhash64("entry"), F.lit(chunks)).cast("int").alias("chunk")
    queries = searched.mapInArrow(spread, "entry bigint, embedding array<double>, block bigint, cells array<int>").withColumn("chunk", deal)
    part = F.pmod(F.xxhash64("entry"), F.get("parts", F.col("cell")))
    lookup = located.withColumns({"begins": F.lit(begin.tolist()), "parts": F.lit(parts.tolist())})
    blocks = lookup.select("entry", "embedding", "ids", "cell", (F.get("begins", F.col("cell")) + part).alias("block"))
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    best = queries.groupBy("block", "chunk").cogroup(blocks.groupBy("block", "chunk")).applyInArrow(compare, "entry bigint, id bigint, score double")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    answers = asked.join(lists, "entry").select("query_id", F.posexplode(others).alias("at", "f"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.minus")).alias("score"))
