"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Trees see at most ``sample`` rows each, drawn by hash from the whole table, a
draw of its own for each, and are built in parallel. Scoring streams Arrow
batches through vectorised tree walks. The threshold is the exact
contamination quantile of the training scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.ml.classify import anomaly_features
from hydrolake.operators.cleaning import Imputer, fit_imputer
from hydrolake.operators.quantiles import exact_quantiles
from hydrolake.operators.splits import SEED, hash52
from hydrolake.sources.shared import materialize

#: Rows that a tree draws beyond its sample in the mean, as a factor, so that rarely any draw is short.
SURPLUS = 2.0
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth int, size int"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (n - 1.0) / np.maximum(n, 1.0), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """One isolation tree over a small sample, as rows of (node, feature, threshold, left, right, depth, size)."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    next_id = 1
    while todo:
        node, members, depth = todo.pop()
        part = x[members]
        spread = part.max(axis=0) - part.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= max_depth or len(members) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth, len(members)))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] <= cut
        nodes.append((node, f, cut, next_id, next_id + 1, depth, len(members)))
        todo += [(next_id, members[below], depth + 1), (next_id + 1, members[~below], depth + 1)]
        next_id += 2
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    features: list[str]
    medians: dict[str, float]
    sample: int
    offset: float
    nodes: pd.DataFrame = field(repr=False)  # at most trees * (2 * sample - 1) rows

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (lower = stranger, below 0 = anomaly), ``anomaly`` (1 / -1) and ``anomaly_label``."""
        raw = _raw_score(df, self.features, self.medians, self.sample, self.nodes)
        return (
            raw.withColumn("score", F.col("_raw") - F.lit(self.offset))
            .drop("_raw")
            .withColumn("anomaly", F.when(F.col("score") < 0, -1).otherwise(1))
            .withColumn("anomaly_label", F.when(F.col("anomaly") == -1, "anomaly").otherwise("normal"))
        )

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(i, f, self.medians[f], self.sample, self.offset) for i, f in enumerate(self.features)]
        spark.createDataFrame(rows, "position int, feature string, median double, sample int, offset double").write.mode(
            "overwrite"
        ).parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        rows = sorted(spark.read.parquet(f"{path}/features").collect(), key=lambda r: r.position)  # one row per feature
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # bounded by the forest size
        return cls([r.feature for r in rows], {r.feature: r["median"] for r in rows}, rows[0].sample, rows[0].offset, nodes)


def _raw_score(df: DataFrame, features: Sequence[str], medians: dict, sample: int, nodes: pd.DataFrame) -> DataFrame:
    trees = [
        {c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth", "size")}
        for _, g in nodes.sort_values(["tree", "node"]).groupby("tree")
    ]
    shared = df.sparkSession.sparkContext.broadcast(trees)  # bounded by the forest size
    norm = float(average_path(sample))

    @F.pandas_udf("double")
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one feature comes as itself
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            rows, total = np.arange(len(x)), np.zeros(len(x))
            for t in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = t["feature"][at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = x[rows, np.maximum(f, 0)] <= t["threshold"][at]
                    at = np.where(inner, np.where(goes_left, t["left"][at], t["right"][at]), at)
                total += t["depth"][at] + average_path(t["size"][at])
            yield pd.Series(-np.exp2(-total / len(shared.value) / norm))

    filled = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c] if medians[c] is not None else 0.0)) for c in features]
    return df.withColumn("_raw", walk(*filled))


def draw(rows: DataFrame, n: int, key: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """For every tree (``tree``) the ``sample`` of all ``n`` rows whose hash of row and tree is smallest.

    A bound on the hash leaves about twice the sample to be ranked, whatever the table's size.
    """
    bound = min(1.0, (SURPLUS * sample + 64) / max(n, 1)) * float(1 << 52)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hash52(["_h", t], seed) <= bound)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(hash52(["_h", "tree"], seed), "_h"))
    spread = rows.withColumn("_h", F.xxhash64(*key, F.lit(seed))).withColumn("tree", F.explode(chosen))
    return spread.withColumn("_rank", rank).filter(F.col("_rank") <= sample).drop("_rank", "_h")


def fit(
    df: DataFrame,
    key: Sequence[str] = ("station_code", "date"),
    trees: int = 100,
    contamination: float = 0.05,
    sample: int = 256,
    seed: int = SEED,
    features: Sequence[str] | None = None,
) -> IsolationForest:
    """``key`` identifies a row; it decides by hash which rows the trees see."""
    features = list(features or anomaly_features(df))
    if not features:
        raise ValueError("no feature columns")
    imputer: Imputer = fit_imputer(df, "median", features)
    rows = imputer.transform(df.select(*key, *[F.col(c).cast("double").alias(c) for c in features if c not in key]))
    n = rows.count()
    sample = min(sample, n)
    drawn = draw(rows, n, key, trees, sample, seed).select("tree", *features)
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf[features].sort_values(features).to_numpy(dtype=float)
        grown = grow(ordered, np.random.default_rng([seed, tree]), depth)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right", "depth", "size"])
        out.insert(0, "tree", tree)
        return out

    nodes = drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()  # bounded by the forest size
    medians = {c: imputer.values[c] for c in features}
    raw = materialize(_raw_score(rows, features, medians, sample, nodes).select("_raw"), "scores")
    offset = exact_quantiles(raw, {"o": (F.col("_raw"), contamination)})["o"]
    return IsolationForest(features, medians, sample, float(offset), nodes)
