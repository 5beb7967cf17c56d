"""Monitoring-schema views over the generated test tables.

The test tables hold orders and events, not river samples; these projections
give them the shape of monitoring tables. All literals are doubles.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.constants import STATIONS
from hydrolake.functions.rivers import river_of_station
from hydrolake.functions.wqi import add_wqi, status
from hydrolake.operators.cleaning import dedup_first

AS_OF = date(2000, 6, 30)
CUTOFF = 2000
END = date(2001, 12, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _station() -> Column:
    return F.concat(F.lit("S0"), (1 + F.col("l_suppkey") % 7).cast("string"))


def measurements(spark: SparkSession, sf_dir: str, with_nulls: bool = False) -> DataFrame:
    """One row per line item; ``with_nulls`` blanks two parameters on every seventh line number."""
    gap = F.col("l_linenumber") == 7

    def maybe(x: Column) -> Column:
        return F.when(~gap, x) if with_nulls else x

    return table(spark, sf_dir, "lineitem").select(
        _station().alias("station_code"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_quantity") / 5.0).alias("do_"),
        (F.col("l_discount") * 40.0).alias("bod"),
        maybe(F.col("l_extendedprice") / 3000.0).alias("cod"),
        (F.col("l_tax") * 12.5).alias("an"),
        maybe((F.col("l_orderkey") % 120).cast("double")).alias("tss"),
        (5.5 + (F.col("l_partkey") % 36) / 10.0).alias("ph"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("_ord"),
    )


def daily_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first per station and day, with index and status."""
    return add_wqi(dedup_first(measurements(spark, sf_dir)))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving rows: one per station and day."""
    return daily_measurements(spark, sf_dir).select(
        (F.col("_ord.l_orderkey") * 8 + F.col("_ord.l_linenumber")).alias("id"),
        (F.col("_ord.l_orderkey") % 5).alias("dataset_id"),
        "station_code",
        river_of_station("station_code").alias("station_name"),
        river_of_station("station_code").alias("river_name"),
        "date",
        "wqi",
        "river_status",
        F.lit("historical").alias("data_type"),
        F.col("_ord.l_orderkey").alias("l_orderkey"),
        F.col("_ord.l_partkey").alias("l_partkey"),
    )


def forecast_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings moved one year ahead with a fixed perturbation of the index."""
    return moved_ahead(readings(spark, sf_dir))


def moved_ahead(rows: DataFrame) -> DataFrame:
    """The forecast points of ``readings``."""
    moved = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("wqi") + (F.col("l_orderkey") % 11) - 5.0))
    return rows.select(
        "id",
        "station_code",
        "station_name",
        "river_name",
        F.date_add("date", 365).alias("date"),
        moved.alias("wqi"),
        status(moved).alias("river_status"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select(
        "station_code",
        "date",
        F.col("wqi").alias("y_true"),
        (F.col("wqi") + (F.col("l_partkey") % 9) - 4.0).alias("y_pred"),
    )


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(STATIONS), "station_code string, river_name string, latitude double, longitude double"
    )


def alerts_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("triggered_at"),
        F.concat(F.lit("S0"), (1 + F.col("o_custkey") % 7).cast("string")).alias("station_code"),
        F.when(rank == "1", "critical").when(rank.isin("2", "3"), "warning").otherwise("info").alias("severity"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("resolved").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, "forecast").when(F.col("o_orderkey") % 3 == 1, "anomaly").otherwise("historical").alias("source"),
        (F.col("o_totalprice") / 5000.0).alias("wqi_value"),
        (F.col("o_orderkey") % 4 == 0).alias("is_read"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.date_add(F.lit(date(1999, 1, 1)), (F.col("c_custkey") % 700).cast("int")).alias("created_at"),
        (F.col("c_custkey") % 2 == 0).alias("is_read"),
    )


def stream_schema(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "events").schema


def stream_readings(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as timestamped readings."""
    return events.select(
        F.concat(F.lit("S0"), (1 + F.col("user_id") % 7).cast("string")).alias("station_code"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.least(F.lit(100.0), F.col("value")).alias("wqi"),
        F.col("event_id"),
    )
