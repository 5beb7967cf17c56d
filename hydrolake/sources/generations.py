"""Upsert without rewriting: batches are added as generations, readers merge, compaction folds.

A table is a folder of parts, ``level=0/part=<generation>`` for a batch and
``level=1/part=<id>`` for what a compaction folded, each with folders by period (month). Every row carries the
generation that brought it, so which row of a key is newest follows from the rows
alone: any copy of a row may be stored twice without changing the table. That
makes every step repeatable. A batch writes its own rows only and a replay overwrites its own
part; a compaction writes its result first and then removes what it has read, so
what a failed one leaves behind is folded by the next. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.operators.cleaning import dedup
from hydrolake.operators.history import valid_record
from hydrolake.sources.sinks import read_table

GENERATION = "_generation"
LAYOUT = ("level", "part", "period")


@dataclass(frozen=True)
class GenerationTable:
    """Rows with ``keys`` (a ``date`` among them) at ``path``; of one key the newest counts.

    Newest is the highest generation, then the highest ``order`` in it; with ``by_order`` the
    highest ``order`` wins whatever generation it came with.
    """

    path: str
    keys: Sequence[str] = ("date", "station_code")
    order: str = "_ord"
    by_order: bool = False
    #: What a compaction rewrites together, as a pattern of the date: months, or years of small tables.
    period: str = "yyyy-MM"

    def _newest(self, rows: DataFrame) -> DataFrame:
        by = [F.desc(self.order), F.desc(GENERATION)] if self.by_order else [F.desc(GENERATION), F.desc(self.order)]
        return dedup(rows, list(self.keys), by)

    def append(self, updates: DataFrame, generation: int) -> None:
        """Add a batch; the same generation again replaces what it brought before."""
        rows = self._newest(updates.filter(valid_record()).withColumn(GENERATION, F.lit(generation).cast("long")))
        self._write(rows, f"{self.path}/level=0/part={generation:012d}")

    def _write(self, rows: DataFrame, path: str) -> None:
        placed = rows.withColumn("period", F.date_format("date", self.period))
        sorted_ = placed.hint("rebalance", F.col("period")).sortWithinPartitions("period", *self.keys)
        sorted_.write.mode("overwrite").partitionBy("period").parquet(path)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The newest row of each key, or None where nothing has been written yet."""
        stored = read_table(spark, f"{self.path}/level=*/part=*/period=*", {"basePath": self.path, "mergeSchema": True})
        return None if stored is None else self._newest(stored).drop(GENERATION, *LAYOUT)

    def next_generation(self, spark: SparkSession) -> int:
        stored = read_table(spark, f"{self.path}/level=*/part=*/period=*", {"basePath": self.path})
        return 0 if stored is None else (stored.agg(F.max(GENERATION)).first()[0] or 0) + 1

    def compact(self, spark: SparkSession) -> None:
        """Fold all batches into level 1, reading and rewriting the periods that occur in them only."""
        fs, path = _file_system(spark, self.path)
        batches = [str(s.getPath()) for s in fs.globStatus(path(f"{self.path}/level=0/part=*")) or []]
        new = [str(s.getPath()) for s in fs.globStatus(path(f"{self.path}/level=0/part=*/period=*")) or []]
        periods = {p.rsplit("/", 1)[1] for p in new}
        folded = [str(s.getPath()) for s in fs.globStatus(path(f"{self.path}/level=1/part=*/period=*")) or []]
        folded = [p for p in folded if p.rsplit("/", 1)[1] in periods]
        if new:
            rows = spark.read.options(basePath=self.path, mergeSchema=True).parquet(*new, *folded).drop(*LAYOUT)
            self._write(self._newest(rows), f"{self.path}/level=1/part={uuid.uuid4().hex}")
        for old in [*batches, *folded]:
            fs.delete(path(old), True)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path
