"""From raw sheets to features, training sets and stored readings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hydrolake.constants import CUTOFF_YEAR, LAG_ROWS, PARAMETERS, ROLLING_ROWS
from hydrolake.functions.wqi import add_wqi
from hydrolake.operators.cleaning import coerce_numeric, dedup, dedup_first, drop_all_null, impute, impute_by_group
from hydrolake.operators.history import append_dedup, filter_years, to_readings, to_record_rows
from hydrolake.operators.scaling import LinearScaler, fit_minmax, fit_scaler, varying_columns
from hydrolake.operators.series import engineer_features, numeric_feature_columns
from hydrolake.operators.splits import chronological_split
from hydrolake.sources.generations import GenerationTable
from hydrolake.sources.monitoring import ORDER
from hydrolake.sources.shared import materialize
from hydrolake.sources.sheets import read_sheets


def clean(df: DataFrame, order: str = "_ord") -> DataFrame:
    """Numbers typed, first row per station and day kept, empty rows dropped."""
    return drop_all_null(dedup_first(coerce_numeric(df), order=order))


def base_frame(df: DataFrame, strategy: str = "median", year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """clean -> impute -> index, on the raw scale.

    The cleaned table is stored once: the imputation statistics and every later
    consumer read it instead of repeating the dedup shuffle.
    """
    cleaned = materialize(clean(filter_years(df, year_from, year_to)).drop("_ord"), "cleaned")
    return add_wqi(impute(cleaned, strategy))


def feature_frame(
    base: DataFrame, rolling_rows: int = ROLLING_ROWS, lag_rows: Sequence[int] = LAG_ROWS, normalize: bool = True
) -> tuple[DataFrame, LinearScaler | None]:
    """Rolling statistics and lags, scaled to 0..1 when ``normalize``."""
    features = engineer_features(base, rolling_rows, lag_rows)
    if not normalize:
        return features, None
    # Stored, so that the windows run once for the scaler's bounds and the scaled rows.
    features = materialize(features, "features")
    scaler = fit_minmax(features, numeric_feature_columns(features))
    return scaler.transform(features), scaler


def preprocess(
    df: DataFrame,
    strategy: str = "median",
    rolling_rows: int = ROLLING_ROWS,
    lag_rows: Sequence[int] = LAG_ROWS,
    normalize: bool = True,
    year_from: int | None = None,
    year_to: int | None = None,
) -> DataFrame:
    """ingest result -> clean -> impute -> index -> features."""
    return feature_frame(base_frame(df, strategy, year_from, year_to), rolling_rows, lag_rows, normalize)[0]


@dataclass(frozen=True)
class TrainingSet:
    rows: DataFrame  # scaled features, target and ``split``
    features: list[str]
    scaler: LinearScaler
    counts: dict[str, int]


def _observed(observation: Observation) -> dict[str, int]:
    """The counts observed; none where the optimizer has proved the table empty and dropped what observes it."""
    try:
        return observation.get
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return {}


def prepare_training(
    df: DataFrame,
    strategy: str = "median",
    method: str = "minmax",
    test: float = 0.2,
    drop_low_variance: bool = False,
    tie=None,
) -> TrainingSet:
    """load -> clean -> impute -> index -> select -> scale -> chronological split.

    Row counts per stage are observed while the stages are stored: no job only counts them.
    """
    seen = {name: Observation(name) for name in ("raw", "clean", "imputed", "sides")}
    n = F.count(F.lit(1)).alias("n")
    cleaned = materialize(clean(df.observe(seen["raw"], n)).drop("_ord").observe(seen["clean"], n), "cleaned")
    scored = materialize(add_wqi(impute(cleaned, strategy)).observe(seen["imputed"], n), "scored")
    features = [c for c in (*PARAMETERS, "wqi") if c in scored.columns]
    if drop_low_variance:
        features = varying_columns(scored, features)
    scaler = fit_scaler(scored, features, method)
    split = chronological_split(scaler.transform(scored), test, tie)
    sides = [F.count_if(F.col("split") == side).alias(side) for side in ("train", "test")]
    split = materialize(split.observe(seen["sides"], *sides), "split")
    counts = {name: _observed(seen[name]).get("n", 0) for name in ("raw", "clean", "imputed")} | _observed(seen["sides"])
    return TrainingSet(split, features, scaler, {name: count for name, count in counts.items() if count or name not in ("train", "test")})


def prepare_upload(df: DataFrame, cutoff_year: int = CUTOFF_YEAR) -> DataFrame:
    """Uploaded sheet -> cleaned, imputed, scored rows dated up to the cutoff year.

    All rows are processed; there is no cap on the size of an upload.
    """
    cleaned = materialize(clean(df), "upload")
    return filter_years(add_wqi(impute(cleaned)), year_to=cutoff_year)


def ingest_upload(
    df: DataFrame,
    readings: DataFrame,
    records_path: str,
    dataset_id: int,
    source: str,
    cutoff_year: int = CUTOFF_YEAR,
) -> DataFrame:
    """Add one upload: its records as generation ``dataset_id``, and the readings with its rows (newest wins)."""
    rows = materialize(prepare_upload(df, cutoff_year), "prepared")
    records = to_record_rows(rows, dataset_id, source, cutoff_year).withColumn("_ord", F.lit(0))
    GenerationTable(records_path).append(records, dataset_id)
    new = to_readings(rows).withColumn("dataset_id", F.lit(dataset_id).cast("long")).withColumn("_ord", F.lit(1))
    return append_dedup(readings.withColumn("_ord", F.lit(0)), new, cutoff_year=cutoff_year).drop("_ord")


def rebuild_readings(sheets: Sequence[tuple[int, DataFrame]], cutoff_year: int = CUTOFF_YEAR) -> DataFrame:
    """Readings from all registered sheets: one union ordered by dataset id, one dedup (highest id wins)."""
    if not sheets:
        raise ValueError("no sheets given")
    stacked = None
    for dataset_id, sheet in sorted(sheets, key=lambda s: s[0]):
        rows = to_readings(prepare_upload(sheet, cutoff_year)).withColumn("dataset_id", F.lit(dataset_id).cast("long"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return append_dedup(stacked.limit(0), stacked, order="dataset_id", cutoff_year=cutoff_year)


def rebuild_from_registry(spark: SparkSession, registry: DataFrame, folder: str | Sequence[str], cutoff_year: int = CUTOFF_YEAR) -> DataFrame:
    """Readings from all files below ``folder`` that a registry (dataset_id, file_path) names.

    One job for all of them, however many files and layouts: sheets are read together,
    cleaned and imputed with the medians of their own dataset, then the highest dataset id wins.
    """
    sheets = read_sheets(spark, folder, registry.select("dataset_id", "file_path"))
    first = dedup(coerce_numeric(sheets), ["dataset_id", "station_code", "date"], [F.asc(ORDER)])
    cleaned = materialize(drop_all_null(first).drop(ORDER), "sheets")
    scored = filter_years(add_wqi(impute_by_group(cleaned, ["dataset_id"])), year_to=cutoff_year)
    rows = to_readings(scored, keep=["dataset_id"])
    return append_dedup(rows.limit(0), rows, order="dataset_id", cutoff_year=cutoff_year)
