"""Pollution alerts and the alert event log."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.constants import (
    ALERT_ADVICE,
    ALERT_HORIZON_DAYS,
    ANOMALY_REASON,
    CLEAN,
    FORECAST_END,
    POLLUTED,
    SLIGHT,
)
from hydrolake.functions.rivers import matches_river, river_of_station
from hydrolake.functions.wqi import status, status_key, status_label
from hydrolake.operators.cleaning import dedup
from hydrolake.operators.history import latest_per_station, within_year

BAD = (SLIGHT, POLLUTED)


def advice(status_col: Column) -> Column:
    return (
        F.when(status_col == SLIGHT, ALERT_ADVICE[SLIGHT])
        .when(status_col == POLLUTED, ALERT_ADVICE[POLLUTED])
        .otherwise("")
    )


def severity_of(status_col: Column) -> Column:
    return F.when(status_col == SLIGHT, "warning").otherwise("critical")


def _band() -> Column:
    return status(F.coalesce("wqi", F.lit(0.0)), null_as=POLLUTED)


def _shown_name() -> Column:
    return F.coalesce(F.nullif(F.col("station_name"), F.lit("")), F.col("station_code"))


def _river() -> Column:
    return F.coalesce(F.nullif(F.col("river_name"), F.lit("")), river_of_station("station_code", "station_name"))


def _alert_rows(df: DataFrame, kind: str) -> DataFrame:
    return (
        df.withColumn("_band", _band())
        .filter(F.col("_band").isin(*BAD))
        .select(
            "station_code",
            _shown_name().alias("station_name"),
            _river().alias("river_name"),
            "date",
            "wqi",
            F.col("_band").alias("river_status"),
            advice(F.col("_band")).alias("message"),
            F.lit(kind).alias("alert_type"),
        )
    )


def historical_alerts(hist: DataFrame, river: str | None = None) -> DataFrame:
    """Stations whose newest reading is not clean, newest first."""
    scope = hist.filter(matches_river(river)) if river else hist
    return _alert_rows(latest_per_station(scope), "historical").orderBy(F.desc("date"), F.desc("station_name"))


def loaded_file_alerts(hist: DataFrame) -> DataFrame:
    """Variant raised when a table is loaded: with severity and a full sentence."""
    rows = _alert_rows(latest_per_station(hist), "historical")
    text = F.format_string(
        "%s: %s water quality is %s (WQI: %.1f) on %s.",
        "river_name", "station_name", status_label("river_status"), F.col("wqi"), F.col("date").cast("string"),
    )
    return rows.withColumns(
        {"message": text, "severity": severity_of(F.col("river_status")),
         "parameter_triggered": F.lit("WQI (latest observation)")}
    )


def reading_alert_message() -> Column:
    """Sentence for one new reading."""
    return F.format_string(
        "%s water quality is %s (WQI: %.1f) on %s.",
        _shown_name(), status_label(_band()), F.coalesce("wqi", F.lit(0.0)), F.col("date").cast("string"),
    )


def window_points(points: DataFrame, as_of: date, days: int = ALERT_HORIZON_DAYS, end: date = FORECAST_END) -> DataFrame:
    """Points in (as_of, as_of + days], never past ``end``."""
    last = min(as_of + timedelta(days=days), end)
    return points.filter((F.col("date") > F.lit(as_of)) & (F.col("date") <= F.lit(last)))


def forecast_alerts(
    points: DataFrame, as_of: date, river: str | None = None, days: int = ALERT_HORIZON_DAYS, end: date = FORECAST_END
) -> DataFrame:
    """Every non-clean point of the alert window, earliest first."""
    scope = window_points(points, as_of, days, end)
    if river:
        scope = scope.filter(matches_river(river, river=None))
    return _alert_rows(scope, "forecast").orderBy("date", "station_code")


def first_forecast_alert(
    points: DataFrame, as_of: date, days: int | None = ALERT_HORIZON_DAYS, end: date = FORECAST_END, model: str = "Forecast"
) -> DataFrame:
    """First non-clean point per station (``days=None``: over the whole horizon), with severity and message."""
    scope = window_points(points, as_of, days, end) if days is not None else points.filter(
        (F.col("date") > F.lit(as_of)) & (F.col("date") <= F.lit(end))
    )
    bad = scope.withColumn("river_status", F.coalesce("river_status", _band())).filter(F.col("river_status").isin(*BAD))
    first = bad.groupBy("station_code").agg(F.min_by(F.struct("date", "wqi", "river_status"), "date").alias("p"))
    window = f"{days}-day window" if days is not None else "horizon"
    text = F.format_string(
        f"{model} {window}: %s predicted %s (WQI %.1f) first on %s. "
        "Further dates in window may also require monitoring.",
        "station_code", status_label("river_status"), F.coalesce("wqi", F.lit(0.0)), F.date_format("date", "dd MMM yyyy"),
    )
    return first.select("station_code", "p.*").withColumns(
        {"severity": severity_of(F.col("river_status")), "message": text, "alert_type": F.lit("forecast")}
    )


def threshold_alerts(forecast: DataFrame, threshold: float = 60.0, value: str = "predicted_wqi") -> DataFrame:
    """One alert per predicted value under the threshold."""
    wqi = F.coalesce(value, F.lit(0.0))
    text = F.format_string("Predicted WQI (%.2f) is below threshold (%.1f).", wqi, F.lit(float(threshold)))
    return forecast.filter(wqi < threshold).select(
        F.lit("ForecastThreshold").alias("alert_type"),
        F.lit("high").alias("severity"),
        F.col("station_name"),
        F.col("date"),
        F.round(wqi, 2).alias("wqi"),
        text.alias("message"),
    )


def anomaly_alerts(scored: DataFrame) -> DataFrame:
    """Alerts from labelled rows (``anomaly_label``)."""
    return scored.filter(F.lower("anomaly_label") == "anomaly").select(
        F.lit("Anomaly").alias("alert_type"),
        F.lit("medium").alias("severity"),
        F.col("station_name"),
        F.col("date"),
        F.col("wqi").cast("double").alias("wqi"),
        F.lit("Isolation Forest detected an anomaly pattern.").alias("message"),
    )


def anomaly_records(scored: DataFrame) -> DataFrame:
    """Detected rows of a scored table as anomaly records."""
    return scored.filter(F.col("anomaly") == -1).select(
        "date",
        "station_code",
        _shown_name().alias("station_name"),
        river_of_station("station_code", "station_name").alias("river_name"),
        "wqi",
        F.col("score"),
        F.lit(ANOMALY_REASON).alias("reason"),
    )


def anomaly_event_alerts(records: DataFrame) -> DataFrame:
    """Alerts raised from anomaly records (always critical)."""
    text = F.format_string(
        "Isolation Forest anomaly at %s: %s. Score %.3f.", "station_name", "reason", F.col("score")
    )
    return records.select(
        "station_code",
        "station_name",
        "date",
        "wqi",
        F.when(F.col("wqi").isNotNull(), status("wqi")).otherwise(SLIGHT).alias("river_status"),
        F.lit("critical").alias("severity"),
        text.alias("message"),
        F.lit("anomaly").alias("alert_type"),
    )


def combine_alerts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two alert lists, one per (type, station, date); the first list wins. Newest first."""
    stacked = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    kept = dedup(stacked, ["alert_type", "station_name", "date"], [F.asc("_side"), F.asc("wqi")])
    return kept.drop("_side").orderBy(F.desc("date"), "station_name")


# --- event log -------------------------------------------------------------------


def normalize_severity(severity: Column | str, river_status: Column | str) -> Column:
    """Any severity word, else the status, to the bands low / medium / critical."""
    s = F.lower(F.trim(F.coalesce(F.col(severity) if isinstance(severity, str) else severity, F.lit(""))))
    r = status_key(F.coalesce(F.col(river_status) if isinstance(river_status, str) else river_status, F.lit("")))
    return (
        F.when(s.isin("critical", "crit"), "critical")
        .when(s.isin("low", "info"), "low")
        .when(s.isin("medium", "warning", "warn"), "medium")
        .when(r == POLLUTED, "critical")
        .otherwise("medium")
    )


def to_alert_events(alerts: DataFrame) -> DataFrame:
    """Alert rows -> event-log rows (status active). Missing optional columns are allowed."""

    def opt(c: str, kind: str = "string") -> Column:
        return F.col(c) if c in alerts.columns else F.lit(None).cast(kind)

    source = F.lower(F.trim(F.coalesce(opt("source"), opt("alert_type"), F.lit("system"))))
    trigger = F.coalesce(
        F.nullif(opt("parameter_triggered"), F.lit("")),
        F.when(source == "anomaly", "Isolation Forest").when(source == "forecast", "WQI forecast").otherwise("WQI"),
    )
    return alerts.select(
        opt("triggered_at", "timestamp").alias("triggered_at"),
        F.nullif(F.trim("station_code"), F.lit("")).alias("station_code"),
        F.nullif(F.trim(F.coalesce(opt("station_name"), F.col("station_code"))), F.lit("")).alias("station_name"),
        normalize_severity(opt("severity"), opt("river_status")).alias("severity"),
        trigger.alias("parameter_triggered"),
        opt("wqi", "double").cast("double").alias("wqi_value"),
        F.lit("active").alias("status"),
        F.coalesce("message", F.lit("")).alias("message"),
        source.alias("source"),
    )


def query_events(events: DataFrame, status_is: str | None = None, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Events by status and source, newest first; the first ``limit`` if given."""
    if status_is and status_is.strip().lower() in ("active", "resolved"):
        events = events.filter(F.lower("status") == status_is.strip().lower())
    if source and source.strip():
        events = events.filter(F.lower("source") == source.strip().lower())
    found = events.orderBy(F.desc("triggered_at"), F.desc("id"))
    return found if limit is None else found.limit(limit)


def set_event_status(events: DataFrame, ids: DataFrame, new_status: str) -> DataFrame:
    """Mark the listed events resolved or active; all other rows stay as they are."""
    if new_status not in ("active", "resolved"):
        raise ValueError("status must be 'active' or 'resolved'")
    chosen = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        events.join(chosen, "id", "left")
        .withColumn("status", F.when(F.col("_hit"), new_status).otherwise(F.col("status")))
        .drop("_hit")
    )


def clear_alerts(alerts: DataFrame, kind: str) -> DataFrame:
    """Drop all alerts of one type, before they are regenerated."""
    return alerts.filter(F.lower(F.coalesce("alert_type", F.lit(""))) != kind)


def unread_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """Unread alerts, newest event date (else creation time) first; the first ``limit`` if given."""
    when = F.coalesce(F.col("date").cast("string"), F.col("created_at").cast("string"))
    found = alerts.filter(~F.coalesce("is_read", F.lit(False))).withColumn("_when", when).orderBy(F.desc("_when"), F.desc("id"))
    return (found if limit is None else found.limit(limit)).drop("_when")


def banner_alert(alerts: DataFrame, as_of: date) -> DataFrame:
    """At most one alert of the day: slightly polluted comes before polluted."""
    rank = F.when(F.col("river_status") == SLIGHT, 0).otherwise(1)
    return (
        alerts.filter((F.col("date") == F.lit(as_of)) & F.lower("river_status").isin(*BAD))
        .orderBy(rank, F.desc("date"), F.desc("station_name"))
        .limit(1)
    )


def filter_alerts(
    alerts: DataFrame,
    status_is: str | None = None,
    station: str | None = None,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Alert-screen filters, chronological, then by station."""
    if status_is:
        alerts = alerts.filter(status_key("river_status") == status_key(F.lit(status_is)))
    if station:
        key = F.trim(F.coalesce(F.nullif(F.col("station_code"), F.lit("")), F.col("station_name"), F.lit("")))
        alerts = alerts.filter(key == station)
    if year is not None:
        alerts = alerts.filter(within_year(year))
    if month is not None:
        alerts = alerts.filter(F.month("date") == month)
    return alerts.orderBy("date", _shown_name())


def clean_alert_violations(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("n_alerts"),
        F.count_if(~F.col("river_status").isin(*BAD)).alias("n_invalid"),
        F.count_if(F.col("river_status") == CLEAN).alias("n_clean"),
    )
