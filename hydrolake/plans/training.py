"""End-to-end training, forecasting and enhancement jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.constants import ALERT_HORIZON_DAYS, FORECAST_END
from hydrolake.ml import classify, forecast, isolation, regress
from hydrolake.operators.alerts import (
    anomaly_alerts,
    clear_alerts,
    combine_alerts,
    first_forecast_alert,
    threshold_alerts,
    to_alert_events,
)
from hydrolake.operators.history import to_log
from hydrolake.operators.metrics import class_report, classification_metrics, confusion, labelled, regression_metrics
from hydrolake.operators.series import trend
from hydrolake.plans.preprocessing import base_frame, feature_frame
from hydrolake.sources.shared import materialize
from hydrolake.sources.generations import GenerationTable
from hydrolake.sources.sinks import append_events


def metric_rows(section: str, row: DataFrame) -> DataFrame:
    """One metrics row -> (section, metric, value) rows."""
    numeric = [f.name for f in row.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    doubles = row.select(*[F.col(c).cast("double").alias(c) for c in numeric])
    return doubles.unpivot([], numeric, "metric", "value").withColumn("section", F.lit(section))


def keyed_metric_rows(section: str, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A metrics table -> the same rows, with the keys of a row in the section's name."""
    numeric = [f.name for f in table.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name not in keys]
    name = F.concat_ws(" ", F.lit(section), *[F.col(k).cast("string") for k in keys]).alias("section")
    doubles = table.select(name, *[F.col(c).cast("double").alias(c) for c in numeric])
    return doubles.unpivot(["section"], numeric, "metric", "value").select("metric", "value", "section")


@dataclass(frozen=True)
class Trained:
    classifier: classify.StatusClassifier
    forecaster: forecast.Forecaster
    anomalies: isolation.IsolationForest
    metrics: DataFrame  # section, metric, value


def train_all(
    df: DataFrame,
    year_from: int | None = None,
    year_to: int | None = None,
    settings: forecast.Settings = forecast.Settings(),
    forest: dict | None = None,
    folds: int | None = None,
) -> Trained:
    """Train the three models on one table; ``folds`` adds a cross-validation of the classifier to the metrics.

    The base frame is stored once and read by all of them. The forecaster is
    pooled over stations, so there is no loop over stations.
    """
    base = materialize(base_frame(df, "median", year_from, year_to), "base")
    scaled = materialize(feature_frame(base)[0], "features")
    classifier, scored = classify.train_classifier(base, **(forest or {}))
    scored = materialize(scored.select("label", "prediction"), "scored")
    forecaster, samples = forecast.fit(base.select("station_code", "date", "wqi", *settings.extra), settings)
    anomalies = isolation.fit(scaled)
    flagged = anomalies.score(scaled).agg(F.count("*").alias("rows"), F.count_if(F.col("anomaly") == -1).alias("anomalies"))
    document = (
        metric_rows("classification", classification_metrics(scored))
        .unionByName(metric_rows("anomaly", flagged))
        .unionByName(metric_rows("data", base.agg(F.count("*").alias("rows"))))
    )
    for section, row in forecast.forecast_document(samples).items():
        document = document.unionByName(metric_rows(section, row))
    for table, section, keys in (
        (confusion(scored), "confusion", ("label", "prediction")),
        (class_report(scored), "class", ("class",)),
        (forecast.metrics_per_station(samples), "station", ("station_code",)),
    ):
        document = document.unionByName(keyed_metric_rows(section, table, [k for k in keys if k in table.columns]))
    if folds:
        document = document.unionByName(metric_rows("cross_validation", classify.cv_summary(classify.cross_validate(base, folds=folds, **(forest or {})))))
    return Trained(classifier, forecaster, anomalies, document)


def evaluate_classifier(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """Metrics of a stored classifier on labelled rows."""
    model = classify.StatusClassifier.load(spark, path)
    return classification_metrics(model.predict(labelled(df)))


def classifier_details(spark: SparkSession, path: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confusion counts, per-class report) of a stored classifier."""
    scored = materialize(
        classify.StatusClassifier.load(spark, path).predict(labelled(df)).select("label", "prediction"), "scored"
    )
    return confusion(scored), class_report(scored)


def evaluate_regressor(path: str, df: DataFrame) -> DataFrame:
    return regression_metrics(regress.score_regressor(regress.load_regressor(path), df))


@dataclass(frozen=True)
class ForecastRun:
    points: DataFrame
    log: DataFrame
    alerts: DataFrame


def run_forecast(
    model: forecast.Forecaster,
    history: DataFrame,
    as_of: date,
    start: date,
    end: date = FORECAST_END,
    run_id: str = "run",
    records_path: str | None = None,
    events_path: str | None = None,
    previous_alerts: DataFrame | None = None,
) -> ForecastRun:
    """forecast -> log -> first alert per station in the window -> durable records.

    The points are stored once and feed all four outputs.
    """
    rolled = forecast.rollout_until(model, history, start, end).withColumn("run_id", F.lit(run_id))
    points = materialize(rolled, "points")
    alerts = first_forecast_alert(points, as_of, ALERT_HORIZON_DAYS, end)
    if previous_alerts is not None:
        alerts = clear_alerts(previous_alerts, "forecast").unionByName(alerts, allowMissingColumns=True)
    if records_path:
        records = points.select(
            "date", "station_code", "station_name", "wqi", F.col("river_status").alias("pollution_status"),
            F.lit("forecast").alias("data_source"), F.lit(True).alias("is_predicted"), F.lit(0).alias("_ord"),
        )
        table = GenerationTable(records_path)
        table.append(records, table.next_generation(records.sparkSession))
    if events_path:
        append_events(to_alert_events(alerts), events_path, run_id)
    return ForecastRun(points, to_log(points), alerts)


@dataclass(frozen=True)
class Enhancement:
    forecast: DataFrame
    anomalies: DataFrame
    alerts: DataFrame
    trend: DataFrame


def enhance(
    df: DataFrame, days: int = 14, threshold: float = 60.0, key: Sequence[str] = ("station_code", "date")
) -> Enhancement:
    """Short-horizon forecast, anomaly labels, one combined alert list and the trend per station."""
    series = forecast.augment(df.select("station_code", "date", "wqi"))
    model, _ = forecast.fit(series, forecast.Settings(horizon=days))
    table = materialize(forecast.next_days(model, df, days), "next_days")
    scored = materialize(isolation.fit(df, key).score(df), "anomalies")
    alerts = combine_alerts(threshold_alerts(table, threshold), anomaly_alerts(scored))
    return Enhancement(table, scored, alerts, trend(table, "predicted_wqi"))
