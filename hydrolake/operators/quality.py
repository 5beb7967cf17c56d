"""Data-quality checks and audit searches; every check is one aggregate row."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.operators.history import latest_per_station, readings_filter
from hydrolake.operators.marts import one_row
from hydrolake.operators.series import gaps


def check_filters(hist: DataFrame, station_name: str) -> DataFrame:
    """Without arguments the filter keeps everything; with a station it keeps something."""
    counts = hist.agg(
        F.count("*").alias("base_count"),
        F.count_if(readings_filter()).alias("unfiltered_count"),
        F.count_if(readings_filter(station_name=station_name)).alias("station_count"),
    )
    return counts.withColumn("passed", (F.col("base_count") == F.col("unfiltered_count")) & (F.col("station_count") > 0))


def check_kpis(summary_row: DataFrame, hist: DataFrame, expected_stations: int) -> DataFrame:
    """KPI row against a recomputation from the newest readings (mean within 0.01)."""
    again = latest_per_station(hist).agg(F.avg("wqi").alias("recomputed_avg"), F.count("*").alias("recomputed_stations"))
    return one_row(summary_row.select("total_stations", "avg_wqi"), again).withColumn(
        "passed",
        (F.col("total_stations") == expected_stations)
        & (F.col("recomputed_stations") == expected_stations)
        & (F.abs(F.col("avg_wqi") - F.col("recomputed_avg")) <= 0.01),
    )


def check_timeline(hist: DataFrame, as_of: date) -> DataFrame:
    """No historical row after ``as_of`` and no missing day inside a station."""
    late = (F.lower(F.coalesce("data_type", F.lit("historical"))) == "historical") & (F.col("date") > F.lit(as_of))
    future = hist.agg(F.count_if(late).alias("rows_after_as_of"))
    holes = gaps(hist).agg(F.count("*").alias("gap_count"), F.coalesce(F.max("gap_days"), F.lit(0)).alias("largest_gap"))
    return one_row(future, holes).withColumn(
        "passed", (F.col("rows_after_as_of") == 0) & (F.col("gap_count") == 0)
    )


def check_fields(df: DataFrame) -> DataFrame:
    """Dates usable (at least ten characters) and the required fields filled."""
    text = F.col("date").cast("string")
    return df.agg(
        F.count_if(text.isNull() | (F.length(text) < 10)).alias("bad_dates"),
        F.count_if(F.col("station_name").isNotNull()).alias("with_station_name"),
        F.count_if(F.col("wqi").isNotNull()).alias("with_wqi"),
    ).withColumn(
        "passed", (F.col("bad_dates") == 0) & (F.col("with_station_name") > 0) & (F.col("with_wqi") > 0)
    )


def search_feedback(
    df: DataFrame,
    date_from: date | None = None,
    date_to: date | None = None,
    name: str | None = None,
    email: str | None = None,
    is_read: bool | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Date range, case-insensitive contains on name and email, read flag; newest first, the first ``limit`` if given."""
    if date_from:
        df = df.filter(F.col("created_at").cast("date") >= F.lit(date_from))
    if date_to:
        df = df.filter(F.col("created_at").cast("date") <= F.lit(date_to))
    if name:
        df = df.filter(F.lower(F.coalesce("name", F.lit(""))).contains(name.strip().lower()))
    if email:
        df = df.filter(F.lower("email").contains(email.strip().lower()))
    if is_read is not None:
        df = df.filter(F.col("is_read") == is_read)
    found = df.orderBy(F.desc("created_at"), F.desc("id"))
    return found if limit is None else found.limit(limit)


def export_audit(df: DataFrame, fmt: Column | str, data_range: Column | str) -> DataFrame:
    """Audit rows of exports: upper-case format and range, both trimmed."""
    f = F.col(fmt) if isinstance(fmt, str) else fmt
    r = F.col(data_range) if isinstance(data_range, str) else data_range
    return df.withColumns(
        {
            "format": F.upper(F.trim(F.coalesce(f, F.lit("")))),
            "data_range": F.trim(F.coalesce(r, F.lit(""))),
        }
    )
