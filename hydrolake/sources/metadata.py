"""Upload metadata: which stations a new table names, and whether they are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.constants import MULTIPLE_RIVERS, RIVER_BY_CODE
from hydrolake.functions.rivers import normalize_code, river_of_station


def upload_codes(df: DataFrame) -> DataFrame:
    """One row per distinct station code: river, whether it is registered, and a warning if not."""
    code = normalize_code("station_code")
    known = F.col("station_code").isin(*RIVER_BY_CODE)
    return (
        df.select(code.alias("station_code"))
        .filter("station_code <> ''")
        .distinct()
        .withColumn("river_name", river_of_station("station_code"))
        .withColumn("is_known", known)
        .withColumn(
            "warning",
            F.when(
                ~known,
                F.concat(F.lit("Station code "), "station_code", F.lit(" is not registered; readings will use 'Unknown River'.")),
            ),
        )
    )


def upload_summary(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row: code counts, the river label, and whether a strict upload is refused."""
    label = F.when(F.min("river_name") == F.max("river_name"), F.min("river_name")).when(
        F.count("*") > 0, MULTIPLE_RIVERS
    )
    return (
        upload_codes(df)
        .agg(
            F.count("*").alias("n_codes"),
            F.count_if(~F.col("is_known")).alias("n_unknown"),
            label.alias("river_name"),
        )
        .withColumn("rejected", F.lit(strict) & (F.col("n_unknown") > 0))
    )
