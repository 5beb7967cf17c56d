"""Ranked lexical search without random access (NRA) over impact-sorted postings.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z
in lower case. With N documents that hold a term, L terms in them, n terms in a
document, df documents holding a term and tf occurrences in a document,

    weight  w = floor(1000 * ln((2N + 2) / (2 df + 1)))
    measure m = 100 - 25 + (25 n N) div L
    impact    = w * ((10**9 * tf) div (1000 tf + 12 m))

and the score of a document is the sum of its impacts over the query's terms,
repeats included. Returned are each query's ``k`` highest scores above 0, equal
scores by ascending id, null ids last.

Method. One pass over the documents keeps the postings of the queries' terms,
with n, in a table of the shared folder; N, L and df are sums over it. A second
pass reads that table in segments of about ``POSTINGS`` postings. In a segment
each term's list is sorted by impact, and for each query the lists are read
sequentially, each to the same depth, which doubles twice from round to round. What a document
has collected is its lower bound; that plus the next impact of each list
in which it has not been seen is its upper bound. Reading goes on until no unseen
document, and no seen one whose bounds differ, can reach the k-th lower bound:
then membership, ties and scores are final. The k-th score of a task's earlier
segments is the least that later ones must reach. A task sends k rows per query at most,
and the best of all tasks are the result. No posting is shuffled, so a term in every
document costs no more than its share of each segment.

Queries go to the tasks in blocks of at most ``BLOCK`` different (query, term) pairs
(or one query, if it has more), each with passes of its own.

Rows that repeat are documents or queries of their own. Null and empty texts
hold no terms: such documents count nowhere, such queries have no rows. Empty
tables give an empty result. Only id and text are read, so other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.tokens import encoded, slices
from hydrolake.llm.words import ALPHANUMERIC, cut
from hydrolake.sources.shared import materialize

#: (query, term) pairs of a block of queries; postings of a segment; entries that the first round reads of each list.
BLOCK, POSTINGS, DEPTH = 500_000, 1_000_000, 64

NUMBERS = T.ArrayType(T.IntegerType(), False)


def counted(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """(id, n, terms, times) of each row (id, text) that holds a term: its different terms and how often each occurs.

    With a vocabulary only its terms are listed, as places in it; n counts all terms.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)
    terms = NUMBERS if vocabulary is not None else T.ArrayType(T.BinaryType(), False)
    target = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", terms), T.StructField("times", NUMBERS)])
    schema = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else pa.array(shared.value, pa.binary())
        for batch in slices(batches, "text"):
            words = cut(encoded(batch.column("text")), ALPHANUMERIC, lower=True)
            if known is None:
                encoding = words.array.dictionary_encode()
                names, ids = encoding.dictionary, encoding.indices.to_numpy()
            else:
                names, ids = known, pc.fill_null(pc.index_in(words.array, known), -1).to_numpy()
            size = max(1, len(names))
            pairs = np.sort((words.doc * size + ids)[ids >= 0])
            new = np.flatnonzero(np.diff(pairs, prepend=-1))
            times = np.diff(np.append(new, len(pairs))).astype(np.int32)
            doc, term = np.divmod(pairs[new], size)
            n = np.diff(words.firsts)
            full = np.flatnonzero(n)
            offsets = pa.array(np.append(np.searchsorted(doc, full), len(doc)).astype(np.int32))
            term = pa.array(term.astype(np.int32))
            columns = [batch.column("id").take(pa.array(full)), pa.array(n[full].astype(np.int64))]
            lists = (names.take(term) if known is None else term, pa.array(times))
            columns += [pa.ListArray.from_arrays(offsets, x).cast(schema.field(f).type) for f, x in zip(("terms", "times"), lists)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, target)


def document_frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents with each term; a task sends one row per term at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term.astype(np.int64)), "found": pa.array(found[term])})

    rows = postings.select("terms").mapInArrow(run, "term long, found long").groupBy("term").agg(F.sum("found").alias("found")).collect()
    df = np.zeros(size, np.int64)
    for r in rows:
        df[r["term"]] = r["found"]
    return df


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of ``tf`` occurrences among ``n`` terms, without the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int = 1, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of highest score, at least ``floor`` (itself at least 1), ties to the smaller number; and the scores.

    ``lists`` has (documents below ``size``, their impacts) for each term, by falling impact.
    """
    lower = np.zeros(size, np.int64)
    read = [0] * len(lists)
    while True:
        for i, (docs, impacts) in enumerate(lists):
            upto = min(len(docs), depth)
            lower[docs[read[i] : upto]] += impacts[read[i] : upto]  # a list holds a document once
            read[i] = upto
        bounds = [int(impacts[at]) if at < len(impacts) else 0 for (_, impacts), at in zip(lists, read)]
        unseen = sum(bounds)
        least = floor
        if size > k:
            least = max(least, int(np.partition(lower, size - k)[size - k]))
        if unseen < least:
            upper = lower + unseen
            for (docs, _), at, bound in zip(lists, read, bounds):
                if bound:
                    upper[docs[:at]] -= bound
            inside = np.flatnonzero(upper >= least)
            if (upper[inside] == lower[inside]).all():
                best = inside[np.lexsort((inside, -lower[inside]))][:k]
                return best, lower[best]
        depth *= 4


@dataclass
class Block:
    """A block of queries for the tasks: each query's key, and the places of its terms in ``weights`` with their number."""

    keys: list[int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int


def search_segment(block: Block, n: np.ndarray, docs: np.ndarray, terms: np.ndarray, times: np.ndarray, k: int, floors: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best documents of a segment for each query; ``docs`` are numbers in ``n``, in order of their ids."""
    impact = saturation(times.astype(np.int64), n[docs], block.n_docs, block.n_terms)
    order = np.lexsort((-impact, terms))
    docs, impact = docs[order], impact[order]
    begin = np.searchsorted(terms[order], np.arange(len(block.weights) + 1))
    out = []
    for own, repeats, floor in zip(block.terms, block.times, floors):
        scale = block.weights[own] * repeats
        lists = [(docs[begin[t] : begin[t + 1]], impact[begin[t] : begin[t + 1]] * s) for t, s in zip(own.tolist(), scale.tolist()) if s and begin[t] < begin[t + 1]]
        out.append(nra(lists, len(n), k, floor))
    return out


def search(postings: DataFrame, block: Block, k: int) -> DataFrame:
    """(query, id, score): each task's ``k`` best documents for each query of a block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = postings.sparkSession.sparkContext.broadcast(block)
    target = T.StructType([T.StructField("query", T.LongType()), postings.schema["id"], T.StructField("score", T.LongType())])
    schema = to_arrow_schema(target)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            has = pc.greater(pc.list_value_length(batch.column("terms")), 0)
            held.append(batch.filter(has))
            size += len(held[-1].column("terms").flatten())
            if size >= POSTINGS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best = [[] for _ in b.keys]  # (-score, id is null, id) of each query
        for part in segments(batches):
            part = part.take(pc.sort_indices(part, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
            lists = part.column("terms").chunk(0)
            ids = part.column("id").to_pylist()
            docs = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            floors = [max(1, -x[-1][0]) if len(x) == k else 1 for x in best]
            found = search_segment(b, part.column("n").to_numpy(), docs, lists.flatten().to_numpy(), part.column("times").chunk(0).flatten().to_numpy(), k, floors)
            for x, (d, s) in zip(best, found):
                x += [(-score, ids[i] is None, ids[i]) for i, score in zip(d.tolist(), s.tolist())]
                x.sort(key=lambda r: r[:2] if r[1] else r)
                del x[k:]
        rows = [(key, i, -s) for key, x in zip(b.keys, best) for s, _, i in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return postings.mapInArrow(run, target)


def blocks_of(queries: DataFrame, most: int) -> Iterator[list]:
    """The queries in blocks of bounded size; the driver holds a partition of them at a time."""
    held, size = [], 0
    for r in queries.select("query", "terms", "times").toLocalIterator():
        if held and size + len(r["terms"]) > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r["terms"])
    if held:
        yield held


def rank(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", query_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, score) of the ``k`` best documents of each row of ``queries``; rank counts from 1."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    asked = counted(queries.select(F.col(query_id).alias("id"), F.col(text).cast("string").alias("text")))
    asked = materialize(asked.withColumn("query", F.monotonically_increasing_id()), "ranking-queries")
    target = f"query long, id {docs.schema[doc_id].dataType.simpleString()}, score long"
    found = spark.createDataFrame([], target)
    for part in blocks_of(asked, block):
        vocabulary = sorted({t for r in part for t in map(bytes, r["terms"])})
        place = {t: i for i, t in enumerate(vocabulary)}
        postings = materialize(counted(rows, vocabulary), "ranking-postings")
        totals = postings.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        df = document_frequencies(postings, len(vocabulary))
        weights = np.array([weight(totals["n"], x) for x in df.tolist()], np.int64)
        terms = [np.array([place[bytes(t)] for t in r["terms"]]) for r in part]
        times = [np.array(r["times"], np.int64) for r in part]
        found = found.unionAll(search(postings, Block([r["query"] for r in part], terms, times, weights, totals["n"], totals["l"]), k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(asked.select("query", F.col("id").alias("asked")), "query")
    return named.select(F.col("asked").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")
