"""Deterministic train/test splits.

Every split is a threshold on a hash (or on the date), found exactly with
``ordered_values``. Assigning a row is then a plain projection: no join, no
global ranking, and the result does not depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.operators.quantiles import ordered_values

SEED = 42


def hash52(cols: Sequence[Column | str], seed: int = SEED) -> Column:
    """52-bit hash as a double: exact in floating point, so it can be thresholded."""
    mask = F.lit((1 << 52) - 1)
    return F.xxhash64(*cols, F.lit(seed)).bitwiseAND(mask).cast("double")


def random_split(
    df: DataFrame, key: Sequence[str], test: float = 0.2, label: str | None = None, seed: int = SEED
) -> DataFrame:
    """Add ``split``; with ``label`` every class keeps its share (stratified)."""
    h = hash52(key, seed)
    if label is None:
        sizes = {None: df.count()}
    else:
        sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    member = {c: (F.lit(True) if label is None else F.col(label) == c) for c in sizes}
    wanted = {
        f"c{i}": (F.when(member[c], h), [max(1, floor(n * test + 0.5)) - 1]) for i, (c, n) in enumerate(sizes.items())
    }
    limits = ordered_values(df, wanted)
    is_test = F.lit(False)
    for i, c in enumerate(sizes):
        if limits[f"c{i}"][0] is not None:
            is_test = is_test | (member[c] & (h <= limits[f"c{i}"][0]))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def group_split(
    df: DataFrame, group: str = "station_code", test: float = 0.2, seed: int = SEED, order: Column | None = None
) -> DataFrame:
    """Whole groups go to one side: the ``ceil(test * groups)`` groups with the
    smallest hash (or ``order`` value) are the test side."""
    h = hash52([F.trim(F.col(group).cast("string"))], seed) if order is None else order.cast("double")
    groups = df.select(group, h.alias("_h")).distinct()
    n_test = ceil(groups.count() * test)
    limit = ordered_values(groups, {"h": (F.col("_h"), [n_test - 1])})["h"][0]
    return df.withColumn("split", F.when(h <= limit, "test").otherwise("train"))


def group_folds(df: DataFrame, group: str, folds: int, seed: int = SEED) -> tuple[DataFrame, int]:
    """Add ``fold``: groups are spread evenly over at most one fold per group."""
    h = hash52([F.trim(F.col(group).cast("string"))], seed)
    groups = df.select(group).distinct().select(h.alias("_h"))
    n = groups.count()
    k = max(2, min(folds, n))
    limits = ordered_values(groups, {"h": (F.col("_h"), _fold_ranks(n, k))})["h"]
    return df.withColumn("fold", _fold_of(h, limits)), k


def stratified_folds(
    df: DataFrame, key: Sequence[str], label: str, folds: int, seed: int = SEED
) -> tuple[DataFrame, int]:
    """Add ``fold``: every class is spread evenly over the folds."""
    h = hash52(key, seed)
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    smallest = min(sizes.values())
    k = max(2, min(folds, smallest)) if smallest >= 2 else 2
    wanted = {f"c{i}": (F.when(F.col(label) == c, h), _fold_ranks(n, k)) for i, (c, n) in enumerate(sizes.items())}
    limits = ordered_values(df, wanted)
    fold = F.lit(0)
    for i, c in enumerate(sizes):
        fold = F.when(F.col(label) == c, _fold_of(h, limits[f"c{i}"])).otherwise(fold)
    return df.withColumn("fold", fold), k


def _fold_ranks(n: int, k: int) -> list[int]:
    """Ranks of the last member of every fold but the last."""
    return [max(0, (n * (i + 1)) // k - 1) for i in range(k - 1)]


def _fold_of(h: Column, limits: Sequence[float | None]) -> Column:
    fold = F.lit(0)
    for limit in limits:
        if limit is not None:
            fold = fold + F.when(h > limit, 1).otherwise(0)
    return fold


def fold_count(n_groups: int, smallest_class: int, folds: int = 5) -> int:
    """Folds never exceed the groups or the smallest class, and are at least two."""
    k = min(folds, n_groups)
    if smallest_class >= 2:
        k = min(k, smallest_class)
    return min(max(2, k), n_groups)


def time_split(df: DataFrame, test: float = 0.2, val: float = 0.1, order: str = "date") -> DataFrame:
    """Chronological train/val/test per station, sizes rounded down but at least one.

    For daily series and their samples (one row per station and day).
    """
    station = Window.partitionBy("station_code")
    n = F.count("*").over(station)
    n_test = F.greatest(F.lit(1), F.floor(n * test))
    n_val = F.greatest(F.lit(1), F.floor((n - n_test) * val)) if val else F.lit(0)
    pos = F.row_number().over(station.orderBy(order))
    return df.withColumn(
        "split", F.when(pos > n - n_test, "test").when(pos > n - n_test - n_val, "val").otherwise("train")
    )


def chronological_split(df: DataFrame, test: float = 0.2, tie: Column | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """Whole-table chronological split: the ``max(1, floor(n * test))`` newest rows are the test side.

    Rows of the boundary day are divided by ``tie`` (default: a hash of ``key``,
    by default of the whole row). The number is exact where no two rows of that
    day have the same tie; only rows equal in every column must stay together.
    """
    tie = (hash52(list(key or df.columns)) if tie is None else tie).cast("double")
    day = F.unix_date("date").cast("double")
    n = df.filter(F.col("date").isNotNull()).count()
    rank = n - max(1, int(n * test))
    boundary = ordered_values(df, {"day": (day, [rank])})["day"][0]
    if boundary is None:
        return df.withColumn("split", F.lit("train"))
    before = df.filter(day < boundary).count()
    edge = ordered_values(df, {"tie": (F.when(day == boundary, tie), [rank - before])})["tie"][0]
    is_test = (day > boundary) | ((day == boundary) & (tie >= edge))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))
