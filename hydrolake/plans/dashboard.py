"""The state that dashboards read: one row per station and day, folded in batch by batch.

Raw readings and forecast points are reduced when they arrive and written as a generation;
every screen merges the few rows that are left instead of deduplicating the raw tables again. A
replayed batch changes nothing, and generations are folded by ``compact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.constants import FORECAST_END
from hydrolake.operators.history import complete_reading, historical_slice
from hydrolake.operators.marts import summary
from hydrolake.sources.generations import GenerationTable

READING = ["id", "station_code", "station_name", "river_name", "date", "wqi", "river_status", "data_type"]
POINT = ["id", "station_code", "station_name", "river_name", "date", "wqi", "river_status"]


@dataclass(frozen=True)
class DashboardState:
    """Two generation tables below ``path``: the reading of highest id and the point of lowest id per station and day."""

    path: str

    @property
    def readings(self) -> GenerationTable:
        return GenerationTable(f"{self.path}/readings", order="_ord", by_order=True, period="yyyy")

    @property
    def points(self) -> GenerationTable:
        return GenerationTable(f"{self.path}/points", order="_ord", by_order=True, period="yyyy")

    def add_readings(self, rows: DataFrame, generation: int) -> None:
        self.readings.append(complete_reading(rows).select(*READING, F.col("id").alias("_ord")), generation)

    def add_points(self, rows: DataFrame, generation: int) -> None:
        self.points.append(rows.select(*POINT, (-F.col("id")).alias("_ord")), generation)

    def compact(self, spark: SparkSession) -> None:
        self.readings.compact(spark)
        self.points.compact(spark)

    def forecast(self, spark: SparkSession) -> DataFrame:
        stored = self.points.read(spark)
        if stored is None:
            raise ValueError("no forecast points have been added")
        return stored.select(*POINT)

    def history(self, spark: SparkSession, as_of: date) -> DataFrame:
        """The historical slice of what has been added."""
        stored, points = self.readings.read(spark), self.points.read(spark)
        if stored is None:
            raise ValueError("no readings have been added")
        return historical_slice(stored.select(*READING), None if points is None else points.select(*POINT), as_of)

    def summary(self, alerts: DataFrame, as_of: date, end: date = FORECAST_END, river: str | None = None) -> DataFrame:
        spark = alerts.sparkSession
        return summary(self.history(spark, as_of), alerts, self.forecast(spark), as_of, end, river)
