"""Alerts and data-quality checks (survey sections H and L)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.constants import POLLUTED, SLIGHT
from hydrolake.operators import alerts, marts, quality
from hydrolake.sources.shared import materialize
from workload.expressions import hist
from workload.registry import AS_OF, END, query, rounded

_ADVICE = "CASE river_status WHEN 'slightly_polluted' THEN 'Monitor closely' ELSE 'Immediate attention required' END"
_LABEL = "CASE river_status WHEN 'slightly_polluted' THEN 'Slightly Polluted' ELSE 'Polluted' END"


@query(
    "h01_historical_alerts",
    f"""SELECT station_code, station_name, river_name, date, round(wqi, 6) AS wqi, river_status, {_ADVICE} AS message, 'historical' AS alert_type
        FROM latest WHERE river_status <> 'clean'""",
)
def historical_alerts(spark, sf):
    return rounded(alerts.historical_alerts(hist(spark, sf)))


@query(
    "h01_loaded_file_alerts",
    f"""SELECT station_code, date, CASE river_status WHEN 'slightly_polluted' THEN 'warning' ELSE 'critical' END AS severity,
        river_name || ': ' || station_name || ' water quality is ' || {_LABEL} || ' (WQI: ' || printf('%.1f', wqi) || ') on ' || CAST(date AS VARCHAR) || '.' AS message
        FROM latest WHERE river_status <> 'clean'""",
)
def loaded_file_alerts(spark, sf):
    return alerts.loaded_file_alerts(hist(spark, sf)).select("station_code", "date", "severity", "message")


@query(
    "h02_forecast_alerts",
    f"""SELECT station_code, station_name, river_name, date, round(wqi, 6) AS wqi, river_status, {_ADVICE} AS message, 'forecast' AS alert_type
        FROM points WHERE date > {AS_OF} AND date <= {AS_OF} + 7 AND river_status <> 'clean'""",
)
def forecast_alerts(spark, sf):
    return rounded(alerts.forecast_alerts(A.forecast_points(spark, sf), A.AS_OF))


def _first(name: str, until: str, window: str, days):
    @query(
        name,
        f""", f AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date) AS rn FROM points WHERE date > {AS_OF} AND date <= {until} AND river_status <> 'clean')
        SELECT station_code, date, round(wqi, 6) AS wqi, river_status, CASE river_status WHEN 'slightly_polluted' THEN 'warning' ELSE 'critical' END AS severity,
          'Forecast {window}: ' || station_code || ' predicted ' || {_LABEL} || ' (WQI ' || printf('%.1f', wqi) || ') first on ' || strftime(date, '%d %b %Y')
          || '. Further dates in window may also require monitoring.' AS message, 'forecast' AS alert_type FROM f WHERE rn = 1""",
    )
    def run(spark, sf):
        return rounded(alerts.first_forecast_alert(A.forecast_points(spark, sf), A.AS_OF, days, A.END))

    return run


_first("h03_first_alert_in_window", f"{AS_OF} + 7", "7-day window", 7)
_first("h03_first_alert_in_horizon", END, "horizon", None)


@query(
    "h04_threshold_alerts",
    f"""SELECT 'ForecastThreshold' AS alert_type, 'high' AS severity, station_name, date, round(wqi, 2) AS wqi,
        'Predicted WQI (' || printf('%.2f', wqi) || ') is below threshold (60.0).' AS message FROM points WHERE date > {AS_OF} AND wqi < 60""",
)
def threshold_alerts(spark, sf):
    ahead = A.forecast_points(spark, sf).filter(F.col("date") > F.lit(A.AS_OF))
    return alerts.threshold_alerts(ahead, 60.0, value="wqi")


@query(
    "h05_anomaly_alerts",
    "SELECT 'Anomaly' AS alert_type, 'medium' AS severity, station_name, date, round(wqi, 6) AS wqi, 'Isolation Forest detected an anomaly pattern.' AS message FROM hist WHERE wqi < 55",
)
def anomaly_alerts(spark, sf):
    label = F.when(F.col("wqi") < 55, "Anomaly").otherwise("normal")
    return rounded(alerts.anomaly_alerts(hist(spark, sf).withColumn("anomaly_label", label)))


@query(
    "h05_anomaly_events",
    """SELECT station_code, station_name, date, round(wqi, 6) AS wqi, river_status, 'critical' AS severity,
       'Isolation Forest anomaly at ' || station_name || ': Abnormal spike. Score ' || printf('%.3f', (wqi - 55e0)/1000e0) || '.' AS message, 'anomaly' AS alert_type FROM hist WHERE wqi < 55""",
)
def anomaly_events(spark, sf):
    scored = hist(spark, sf).withColumns(
        {"score": (F.col("wqi") - 55.0) / 1000.0, "anomaly": F.when(F.col("wqi") < 55, -1).otherwise(1)}
    )
    return rounded(alerts.anomaly_event_alerts(alerts.anomaly_records(scored)))


@query(
    "h06_alert_events",
    f"""SELECT date AS triggered_at, station_code, station_name, CASE WHEN river_status = 'polluted' THEN 'critical' ELSE 'medium' END AS severity,
        'WQI forecast' AS parameter_triggered, round(wqi, 6) AS wqi_value, 'active' AS status, {_ADVICE} AS message, 'forecast' AS source
        FROM points WHERE date > {AS_OF} AND date <= {AS_OF} + 7 AND river_status <> 'clean'""",
)
def alert_events(spark, sf):
    raised = alerts.forecast_alerts(A.forecast_points(spark, sf), A.AS_OF)
    return rounded(alerts.to_alert_events(raised.withColumn("triggered_at", F.col("date"))))


@query(
    "h07_query_events",
    "SELECT id, triggered_at, severity, source FROM alerts_log WHERE status = 'active' AND source = 'anomaly' ORDER BY triggered_at DESC, id DESC LIMIT 200",
)
def query_events(spark, sf):
    return alerts.query_events(A.alerts_log(spark, sf), "Active", " anomaly ", limit=200).select("id", "triggered_at", "severity", "source")


@query("h07_resolve_events", "SELECT id, CASE WHEN id % 11 = 0 THEN 'resolved' ELSE status END AS status FROM alerts_log")
def resolve_events(spark, sf):
    events = A.alerts_log(spark, sf).select("id", "status")
    return alerts.set_event_status(events, events.filter("id % 11 = 0"), "resolved")


@query("h08_clear_alerts", "SELECT source AS alert_type, count(*) AS n FROM alerts_log WHERE source <> 'forecast' GROUP BY 1")
def clear_alerts(spark, sf):
    rows = A.alerts_log(spark, sf).withColumnRenamed("source", "alert_type")
    return alerts.clear_alerts(rows, "forecast").groupBy("alert_type").agg(F.count("*").alias("n"))


@query(
    "h09_unread_alerts",
    "SELECT id, triggered_at AS date FROM alerts_log WHERE NOT is_read ORDER BY triggered_at DESC, id DESC LIMIT 50",
)
def unread_alerts(spark, sf):
    rows = A.alerts_log(spark, sf).select(
        "id", F.col("triggered_at").alias("date"), F.col("triggered_at").alias("created_at"), "is_read"
    )
    return alerts.unread_alerts(rows, limit=50).select("id", "date")


@query(
    "h09_banner_alert",
    f"""SELECT station_code, river_status FROM latest WHERE river_status <> 'clean' AND date = {AS_OF}
        ORDER BY CASE river_status WHEN 'slightly_polluted' THEN 0 ELSE 1 END, date DESC, station_name DESC LIMIT 1""",
)
def banner_alert(spark, sf):
    return alerts.banner_alert(alerts.historical_alerts(hist(spark, sf)), A.AS_OF).select("station_code", "river_status")


@query(
    "h10_filter_alerts",
    "SELECT station_code, date, round(wqi, 6) AS wqi, river_status FROM points WHERE river_status = 'slightly_polluted' AND station_code = 'S02' AND year(date) = 2001 AND month(date) = 3",
)
def filter_alerts(spark, sf):
    raised = A.forecast_points(spark, sf).filter(F.col("river_status").isin(SLIGHT, POLLUTED))
    out = alerts.filter_alerts(raised, "Slightly Polluted", "S02", 2001, 3)
    return rounded(out.select("station_code", "date", "wqi", "river_status"))


# --- L: checks -------------------------------------------------------------------


@query(
    "l01_check_filters",
    """SELECT count(*) AS base_count, count(*) AS unfiltered_count, count(*) FILTER (station_name = 'Sungai Klang') AS station_count,
       count(*) FILTER (station_name = 'Sungai Klang') > 0 AS passed FROM hist""",
)
def check_filters(spark, sf):
    return quality.check_filters(hist(spark, sf), "Sungai Klang")


@query(
    "l02_check_kpis",
    "SELECT count(*) AS total_stations, count(*) AS recomputed_stations, round(avg(wqi), 6) AS avg_wqi, round(avg(wqi), 6) AS recomputed_avg, count(*) = 7 AS passed FROM latest",
)
def check_kpis(spark, sf):
    slice_ = materialize(hist(spark, sf), "slice")  # read by the summary and by the check
    kpis = marts.summary(slice_, A.alerts_log(spark, sf), A.forecast_points(spark, sf), A.AS_OF, A.END)
    return rounded(quality.check_kpis(kpis, slice_, 7))


@query(
    "l03_check_alerts",
    "SELECT count(*) AS n_alerts, CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_clean FROM latest WHERE river_status <> 'clean'",
)
def check_alerts(spark, sf):
    return alerts.clean_alert_violations(alerts.historical_alerts(hist(spark, sf)))


@query(
    "l04_check_timeline",
    f""", g AS (SELECT date - lag(date) OVER (PARTITION BY station_code ORDER BY date) AS days FROM readings)
    SELECT (SELECT count(*) FROM readings WHERE date > {AS_OF}) AS rows_after_as_of, count(*) FILTER (days > 1) AS gap_count,
      CAST(max(days) FILTER (days > 1) AS INTEGER) AS largest_gap, FALSE AS passed FROM g""",
)
def check_timeline(spark, sf):
    return quality.check_timeline(A.readings(spark, sf), A.AS_OF)


@query(
    "l05_check_fields",
    "SELECT count(*) FILTER (date IS NULL) AS bad_dates, count(station_name) AS with_station_name, count(wqi) AS with_wqi, TRUE AS passed FROM readings",
)
def check_fields(spark, sf):
    return quality.check_fields(A.readings(spark, sf))


@query(
    "l06_search_feedback",
    """SELECT id, name, email, created_at FROM feedback WHERE created_at BETWEEN DATE '1999-03-01' AND DATE '2000-08-31' AND lower(name) LIKE '%er#0000%'
       AND email LIKE '%8@example%' AND is_read ORDER BY created_at DESC, id DESC LIMIT 500""",
)
def search_feedback(spark, sf):
    out = quality.search_feedback(
        A.feedback(spark, sf), date(1999, 3, 1), date(2000, 8, 31), name="ER#0000", email="8@EXAMPLE", is_read=True, limit=500
    )
    return out.select("id", "name", "email", "created_at")


@query(
    "l07_export_audit",
    """SELECT o_orderkey AS export_id, upper(o_orderpriority || ' priority export') AS format,
       trim(o_orderstatus || '  ' || o_orderpriority) AS data_range FROM orders ORDER BY o_orderkey DESC LIMIT 200""",
)
def export_audit(spark, sf):
    rows = A.table(spark, sf, "orders")
    out = quality.export_audit(
        rows,
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" priority export ")),
        F.concat(F.lit("  "), "o_orderstatus", F.lit("  "), "o_orderpriority"),
    ).withColumnRenamed("o_orderkey", "export_id")
    return marts.top_recent(out, "export_id", 200).select("export_id", "format", "data_range")
