"""Incremental ingest, late-data-aware dedup, durable upsert and daily means.

Every job is a file-source stream with an explicit schema. State is bounded by
a watermark, and each sink can replay a batch without changing its result.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hydrolake.constants import CUTOFF_YEAR, POLLUTED, SLIGHT
from hydrolake.functions.rivers import river_of_station
from hydrolake.functions.wqi import status
from hydrolake.operators.alerts import reading_alert_message, severity_of
from hydrolake.operators.history import latest_per_station, measured_until
from hydrolake.sources.generations import GenerationTable
from hydrolake.sources.shared import new_path

#: Batches between two compactions of a stream's table.
COMPACT_EVERY = 32


def read_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """File source; new files of the folder (or glob) become new rows."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def with_status(rows: DataFrame) -> DataFrame:
    """Streamed readings get day, river and status; rows without station or time are dropped."""
    return rows.filter(F.col("station_code").isNotNull() & F.col("ts").isNotNull()).withColumns(
        {
            "date": F.col("ts").cast("date"),
            "river_name": river_of_station("station_code"),
            "river_status": status("wqi"),
        }
    )


def dedup_stream(rows: DataFrame, delay: str = "2 days") -> DataFrame:
    """One row per station and day. The state of a key is dropped once the
    watermark is ``delay`` past its first row, so ``delay`` must exceed a day plus
    the lateness to tolerate."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["station_code", "date"])


def daily_means(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean index per station and day; a day is final once the watermark has passed it."""
    return (
        rows.withWatermark("ts", delay)
        .groupBy("station_code", F.window("ts", "1 day"))
        .agg(F.avg("wqi").alias("avg_wqi"), F.count("*").alias("n"))
        .select("station_code", F.col("window.start").cast("date").alias("date"), "avg_wqi", "n")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Process everything that is there now into a Parquet table and return the table."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or new_path(spark, "checkpoint"))
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def records_table(path: str) -> GenerationTable:
    """The stored readings of a stream: the newest event wins whatever batch brought it."""
    return GenerationTable(path, by_order=True)


def upsert_batch(
    records_path: str, alerts_path: str | None, cutoff_year: int = CUTOFF_YEAR, compact_every: int = COMPACT_EVERY
) -> Callable[[DataFrame, int], None]:
    """Batch function: add the readings as a generation, then write the alerts of this batch.

    The newest event wins, so neither the file order nor a replay changes the table; a replay
    rewrites the same generation and the same alert partition. What is written is as large as the
    batch; every ``compact_every`` batches are folded.
    """
    table = records_table(records_path)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read several times below; a lost executor recomputes it from the files
        try:
            rows = batch.filter(F.col("date") <= F.lit(date(cutoff_year, 12, 31))).select(
                "date", "station_code", F.col("river_name").alias("station_name"), "river_name", "wqi",
                "river_status", F.lit("historical").alias("data_type"), F.lit(False).alias("is_predicted"),
                F.col("event_id").alias("_ord"), F.col("event_id").alias("id"),
            )
            table.append(rows, batch_id)
            if (batch_id + 1) % compact_every == 0:
                table.compact(batch.sparkSession)
            if alerts_path:
                newest = latest_per_station(rows.withColumn("id", F.col("_ord")))
                alerts = newest.filter(F.col("river_status").isin(SLIGHT, POLLUTED)).select(
                    "station_code", "date", "wqi", "river_status", severity_of(F.col("river_status")).alias("severity"),
                    reading_alert_message().alias("message"), F.lit(batch_id).cast("long").alias("batch_id"),
                )
                alerts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(alerts_path)
        finally:
            batch.unpersist()

    return run


def start_upsert(
    stream: DataFrame,
    records_path: str,
    alerts_path: str | None,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "1 minute",
    cutoff_year: int = CUTOFF_YEAR,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Durable, replay-safe ingest of a readings stream (once, or every ``interval``)."""
    writer = (
        stream.writeStream.foreachBatch(upsert_batch(records_path, alerts_path, cutoff_year, compact_every))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def daily_refresh(
    stream: DataFrame,
    records_path: str,
    checkpoint: str,
    as_of: date,
    cutoff_year: int = CUTOFF_YEAR,
) -> DataFrame:
    """One daily tick: take in what is new, then return the newest row per station up
    to ``as_of``. Predicted rows of passed days count as history until a
    measurement replaces them."""
    query = start_upsert(stream, records_path, None, checkpoint, cutoff_year=cutoff_year)
    query.awaitTermination()
    records = records_table(records_path).read(stream.sparkSession)
    return latest_per_station(measured_until(records, as_of))
