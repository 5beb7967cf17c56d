"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams of code points (in lower case, runs of
ASCII white space as one space). Every feature has the ratio
r = log((p + a) / P) - log((q + a) / Q): p and q count the toxic and the other
training texts that hold it, over all labelled training rows, in Spark. A
logistic regression learns one weight per feature on x * r, on a bounded sample
of labelled rows in which each class has its share of all. Toxic marks are rare strings, so a
text is judged by the sum over its features; features whose ratio is small or
within the noise of their count have r = 0.

Inputs of a score are the text alone. Null texts count as empty and score like
any text without features. Rows that repeat are scored each. Labels that are
null are left out; a doc_id labelled twice trains twice. With no labelled row,
or one class only, every score is the share of toxic rows (0 without rows). An
empty table gives an empty table. Columns named like a result are replaced;
others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.filters import hash_filter, maybe_in
from hydrolake.llm.tokens import BASE, U64, mix, slices
from hydrolake.sources.shared import materialize

#: Lengths of n-grams and the number of hash buckets (a power of two).
ORDERS, BUCKETS = (4, 5), 1 << 20
#: Rows that the logistic regression sees at most, of each class.
SAMPLE = 3000
#: Smoothing of the counts, the number of standard errors by which the classes must differ, and the least ratio: with
#: many rows even the slightest difference is beyond noise, but only strong ones tell a class.
SMOOTH, NOISE, RATIO = 0.5, 4.0, 1.0
#: Strength of the squared penalty, and Newton steps at most.
PENALTY, STEPS = 1.0, 20

BLANKS = re.compile("[\t\n\x0b\x0c\r ]+")


def features(texts: list[str], orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text and the text's number, ordered by text."""
    marker = np.full(buckets, -1, np.int64)
    ids, owners = [], []
    for number, text in enumerate(texts):
        points = np.frombuffer(BLANKS.sub(" ", f" {text} ").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        parts = []
        for n in orders:
            if len(points) >= n:
                h = points[: len(points) - n + 1].copy()
                for i in range(1, n):
                    h *= U64(BASE)
                    h += points[i : len(points) - n + 1 + i]
                parts.append(mix(h + U64(n)) & U64(buckets - 1))
        if parts:
            found = np.concatenate(parts).astype(np.int64)
            # Of equal numbers the last one to write its place stays.
            place = np.arange(len(found))
            marker[found] = place
            found = found[marker[found] == place]
            ids.append(found)
            owners.append(np.full(len(found), number))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Model:
    """A score is 1 / (1 + exp(-(bias + sum of the weights of a text's features)))."""

    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]

    def score(self, texts: list[str]) -> np.ndarray:
        ids, owners = features(texts, self.orders, len(self.weights))
        margin = self.bias + np.bincount(owners, self.weights[ids], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def ratio_counts(rows: DataFrame, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each feature, by class, and texts of each class, over all rows (text, label).

    A task sends one row per label and group of 4096 buckets; what reaches the driver is
    two counts per bucket whatever the table's size.
    """
    group = 4096

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        totals = np.zeros(2, np.int64)
        for batch in slices(batches, "text"):
            label = np.array(batch.column("label").to_pylist(), np.int64)
            ids, owners = features([t or "" for t in batch.column("text").to_pylist()], orders, buckets)
            for y in (0, 1):
                counts[y] += np.bincount(ids[label[owners] == y], minlength=buckets)
                totals[y] += (label == y).sum()
        label, part, found = [], [], []
        for y in (0, 1):
            if totals[y]:
                label.append(y)
                part.append(-1)
                found.append(np.array([totals[y]]))
                for g in range(0, buckets, group):
                    if counts[y, g : g + group].any():
                        label.append(y)
                        part.append(g)
                        found.append(counts[y, g : g + group])
        yield pa.RecordBatch.from_pydict({"label": label, "part": pa.array(part, pa.int64()), "found": pa.array([x.astype("<i8").tobytes() for x in found], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(x, "<i8") for x in table.column("found").to_pylist())
        return pa.table({"label": [key[0].as_py()], "part": [key[1].as_py()], "found": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "label bigint, part bigint, found binary"
    counts, totals = np.zeros((2, buckets)), np.zeros(2)
    for row in rows.mapInArrow(run, schema).groupBy("label", "part").applyInArrow(add, schema).collect():
        found = np.frombuffer(row["found"], "<i8")
        if row["part"] < 0:
            totals[row["label"]] = found[0]
        else:
            counts[row["label"], row["part"] : row["part"] + len(found)] = found
    return counts, totals


def log_count_ratios(counts: np.ndarray, totals: np.ndarray, smooth: float, noise: float, least: float = RATIO) -> np.ndarray:
    """The ratio of each feature, 0 where it is below ``least`` or the two classes' shares differ by less than
    ``noise`` standard errors."""
    q, p = counts
    r = np.log((p + smooth) / (totals[1] + 2 * smooth)) - np.log((q + smooth) / (totals[0] + 2 * smooth))
    m = (p + q) / totals.sum()
    error = np.sqrt(m * (1 - m) * (1 / totals).sum())
    return np.where((np.abs(p / totals[1] - q / totals[0]) > noise * error) & (np.abs(r) >= least), r, 0.0)


def fit_logistic(ids: np.ndarray, owners: np.ndarray, y: np.ndarray, r: np.ndarray, share: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights (on features scaled by ``r``) and bias of a logistic regression in which the toxic rows have the weight
    ``share`` of all, and ``penalty`` times half the squared weights is added, by Newton steps with conjugate gradients."""
    used = r[ids] != 0
    ids, owners = ids[used], owners[used]
    kept, ids = np.unique(ids, return_inverse=True)
    x = r[kept][ids]
    n, size = len(y), len(kept)
    heavy = np.where(y == 1, share * n / max(1, (y == 1).sum()), (1 - share) * n / max(1, (y == 0).sum()))

    def forward(v):  # the last entry is the bias
        return v[-1] + np.bincount(owners, x * v[ids], n)

    def back(e):
        return np.append(np.bincount(ids, x * e[owners], size), e.sum())

    def loss(v, margin):
        return (heavy * np.logaddexp(0, np.where(y == 1, -margin, margin))).sum() + 0.5 * penalty * (v[:-1] ** 2).sum()

    shrink = np.append(np.full(size, penalty), 1e-6)
    w = np.zeros(size + 1)
    margin = forward(w)
    for _ in range(steps):
        prob = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        slope = back(heavy * (prob - y)) + shrink * w
        if np.abs(slope).max() < 1e-4 * n:
            break
        curve = heavy * prob * (1 - prob)
        move, rest = np.zeros_like(w), -slope
        to, size2 = rest.copy(), rest @ rest
        for _ in range(30):
            bent = back(curve * forward(to)) + shrink * to
            far = size2 / max(to @ bent, 1e-300)
            move, rest = move + far * to, rest - far * bent
            now = rest @ rest
            if now < 1e-4 * (slope @ slope):
                break
            to, size2 = rest + now / size2 * to, now
        pace, before = 1.0, loss(w, margin)
        step = forward(move)
        while pace > 1e-6 and loss(w + pace * move, margin + pace * step) > before:
            pace /= 2
        w, margin = w + pace * move, margin + pace * step
    out = np.zeros(len(r))
    out[kept] = w[:-1] * r[kept]
    return out, float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    only: Column | None = None,
    orders: tuple[int, ...] = ORDERS,
    buckets: int = BUCKETS,
    sample: int = SAMPLE,
) -> Model:
    """Fit on the documents that have a label, restricted by ``only`` (a condition on doc_id).

    The sample holds, of each class, the ``sample`` rows with the smallest hash of id and text.
    """
    known = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("_id"), F.col(label).cast("long").alias("label")).where("label IN (0, 1)")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = (rows if only is None else rows.where(only)).withColumn("_h", F.xxhash64("doc_id"))
    # Only texts that pass a bitmap of the labelled ids are sent to meet their labels.
    rows = maybe_in(rows, "_h", hash_filter(known.select(F.xxhash64("_id").alias("_h")), "_h"))
    # A merge join at every size: small label tables would be broadcast, large ones not, and the cost would jump between.
    rows = rows.join(known.hint("merge"), F.col("doc_id") == F.col("_id"))
    rows = materialize(rows.select("text", "label", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("order")), "labelled")
    counts, totals = ratio_counts(rows.select("text", "label"), orders, buckets)
    if totals.min() == 0:
        share = totals[1] / totals.sum() if totals.sum() else 0.0
        return Model(np.zeros(buckets), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))), orders)
    # Twice the share that the sample needs: few texts are read for it, and no sort sees them.
    share = [min(1.0, 2 * sample / totals[y]) for y in (0, 1)]
    some = rows.where(F.col("order") < F.when(F.col("label") == 1, int(share[1] * (1 << 40))).otherwise(int(share[0] * (1 << 40))))
    shared = docs.sparkSession.sparkContext.broadcast(log_count_ratios(counts, totals, SMOOTH, NOISE))

    def telling(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, owners = features(texts, orders, buckets)
            keep = r[ids] != 0
            ids, owners = ids[keep], owners[keep]
            ends = np.searchsorted(owners, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("order"), pa.array([ids[i:j].astype("<i4").tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())],
                names=["label", "order", "ids"],
            )

    told = materialize(some.mapInArrow(telling, "label bigint, order bigint, ids binary"), "sample")
    taken = [t for y in (0, 1) for t in told.where(F.col("label") == y).orderBy("order", "ids").limit(sample).collect()]
    y = np.array([t["label"] for t in taken])
    lists = [np.frombuffer(t["ids"], "<i4") for t in taken]
    ids = np.concatenate(lists).astype(np.int64)
    owners = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    weights, bias = fit_logistic(ids, owners, y, shared.value, totals[1] / totals.sum(), PENALTY, STEPS)
    return Model(weights, bias, orders)


def score(df: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Add ``column``, the toxicity of ``text`` from 0 to 1; all other columns pass through."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(column)
    target = T.StructType([*df.schema.fields, T.StructField(column, T.DoubleType())])
    schema = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = shared.value.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], schema=schema)

    return df.mapInArrow(run, target)
