"""Writers. Every write is a distributed Spark write into a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.functions.wqi import status_label
from hydrolake.operators.history import upsert
from hydrolake.operators.scaling import LinearScaler
from hydrolake.sources.shared import staged


def write_by_river(df: DataFrame, path: str) -> None:
    """One folder per river. The rebalance groups rows by river but lets AQE split a
    river that holds a third of the table into many write tasks."""
    df.hint("rebalance", F.col("river_name")).write.mode("overwrite").partitionBy("river_name").option("header", True).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """The five columns of the readings export, named for people."""
    df.select(
        F.col("station_name").alias("Station Name"),
        F.col("river_name").alias("River"),
        F.col("date").alias("Date"),
        F.col("wqi").alias("WQI"),
        status_label("river_status").alias("River Status"),
    ).write.mode("overwrite").option("header", True).csv(path)


def write_training_set(df: DataFrame, scaler: LinearScaler, path: str, targets: Sequence[str] = ("river_status",)) -> None:
    """Train, test and full tables plus the scaler parameters. Expects ``split``."""
    keep = [c for c in df.columns if c in scaler.shift or c in targets]
    for part in ("train", "test"):
        df.filter(F.col("split") == part).select(*keep).write.mode("overwrite").parquet(f"{path}/{part}")
    df.write.mode("overwrite").parquet(f"{path}/full")
    scaler.as_rows(df.sparkSession).write.mode("overwrite").parquet(f"{path}/scaler")


def replace_readings(df: DataFrame, path: str) -> None:
    """Full replace of the readings table, partitioned by year."""
    _by_year(df).write.mode("overwrite").partitionBy("year").parquet(path)


def _by_year(df: DataFrame) -> DataFrame:
    """Rows grouped by year into evenly sized files (AQE splits large years and
    merges small ones), sorted so that row groups can be skipped by station and date."""
    grouped = df.withColumn("year", F.year("date")).hint("rebalance", F.col("year"))
    return grouped.sortWithinPartitions("station_code", "date")


def read_table(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame | None:
    """A stored table, or None when nothing has been written yet."""
    try:
        return spark.read.options(**(options or {})).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def upsert_table(
    updates: DataFrame,
    path: str,
    keys: Sequence[str] = ("date", "station_code"),
    order: str = "_ord",
    by_order: bool = False,
) -> None:
    """Durable upsert into a table partitioned by year; replay-safe.

    Only the years that occur among the updates are read and rewritten. The
    merged years are first written to the shared folder, then swapped in with a
    dynamic partition overwrite, so a failed job can be run again. The staged
    copy goes once the swap has succeeded.
    """
    spark = updates.sparkSession
    updates = updates.filter(F.col("date").isNotNull())
    stored = read_table(spark, path)
    if stored is None:
        merged = upsert(updates.limit(0), updates, keys, order, by_order)
    else:
        years = [r[0] for r in updates.select(F.year("date")).distinct().collect()]  # one row per calendar year
        merged = upsert(stored.filter(F.col("year").isin(years)).drop("year"), updates, keys, order, by_order)
    with staged(_by_year(merged), "upsert") as years:
        years.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def append_events(events: DataFrame, path: str, run_id: str) -> None:
    """Add a run's events to the log, one folder per run: a repeated run replaces its own events."""
    rows = events.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def save_cache(points: DataFrame, path: str) -> None:
    """Forecast cache: JSON lines, one point per line."""
    points.write.mode("overwrite").json(path)


CACHE_SCHEMA = (
    "date date, station_code string, station_name string, river_name string, wqi double, river_status string"
)


def load_cache(spark: SparkSession, path: str, min_points: int = 100) -> DataFrame | None:
    """Cached forecast points, or None when fewer than ``min_points`` are dated."""
    try:
        points = spark.read.schema(CACHE_SCHEMA).json(path).filter(F.col("date").isNotNull())
        enough = len(points.select("date").take(min_points)) == min_points
    except AnalysisException:
        return None
    return points if enough else None
