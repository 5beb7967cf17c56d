"""Joins, aggregates, sorted pages and set operations (survey sections C, D, F, G)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.constants import PARAMETERS
from hydrolake.functions.wqi import with_envelope
from hydrolake.operators import alerts, cleaning, history, marts, register, series
from hydrolake.plans.dashboard import DashboardState
from hydrolake.sources.shared import materialize, new_path
from workload.expressions import STRESS_SQL, hist
from workload.registry import AS_OF, END, band, query, rounded


# --- C: joins -------------------------------------------------------------------


@query("c01_historical_slice", "SELECT id, station_code, river_name, date, round(wqi, 6) AS wqi, river_status, data_type, is_predicted FROM hist")
def historical_slice(spark, sf):
    return rounded(hist(spark, sf).drop("station_name"))


@query(
    "c01_historical_slice_raw",
    f"""SELECT station_code, date, max(l_orderkey*8 + l_linenumber) AS id FROM measurements WHERE date <= {AS_OF} GROUP BY ALL""",
)
def historical_slice_raw(spark, sf):
    """Several rows per station and day: the newest must win."""
    raw = A.measurements(spark, sf).select(
        "station_code",
        F.lit(None).cast("string").alias("station_name"),
        F.lit(None).cast("string").alias("river_name"),
        "date",
        F.lit(50.0).alias("wqi"),
        F.lit("polluted").alias("river_status"),
        F.lit(None).cast("string").alias("data_type"),
        (F.col("_ord.l_orderkey") * 8 + F.col("_ord.l_linenumber")).alias("id"),
    )
    return history.historical_slice(raw, None, A.AS_OF).select("station_code", "date", "id")


@query(
    "c02_enrich_river",
    """SELECT m.station_code, coalesce(s.river_name, 'Unknown River') AS river_name, count(*) AS n FROM
       (SELECT 'S' || lpad(CAST(1 + l_suppkey % 9 AS VARCHAR), 2, '0') AS station_code FROM lineitem) m LEFT JOIN stations s USING (station_code) GROUP BY ALL""",
)
def enrich_river(spark, sf):
    code = F.concat(F.lit("S"), F.lpad((1 + F.col("l_suppkey") % 9).cast("string"), 2, "0"))
    rows = A.table(spark, sf, "lineitem").select(code.alias("station_code"), F.lit(None).cast("string").alias("station_name"))
    return marts.enrich_river(rows, A.stations(spark)).groupBy("station_code", "river_name").agg(F.count("*").alias("n"))


def _latest_stations(spark, sf):
    return marts.latest_stations(hist(spark, sf))


@query(
    "c03_latest_with_coordinates",
    """SELECT l.station_code, l.river_name, round(l.wqi, 6) AS latest_wqi, l.river_status, l.date AS last_reading_date, s.latitude, s.longitude
       FROM latest l LEFT JOIN (SELECT * FROM stations WHERE station_code <> 'S05') s USING (station_code)""",
)
def latest_with_coordinates(spark, sf):
    admin = A.stations(spark).filter("station_code <> 'S05'")
    return rounded(marts.with_admin_coordinates(_latest_stations(spark, sf), admin))


@query(
    "c03_coordinates_by_name",
    """, own AS (SELECT station_code, river_name, 1e0 AS latitude, 2e0 AS longitude FROM latest)
    SELECT o.station_code, o.river_name, CASE WHEN o.station_code IN ('S01', 'S02') THEN s.latitude ELSE 1e0 END AS latitude,
      CASE WHEN o.station_code IN ('S01', 'S02', 'S03') THEN s.longitude ELSE 2e0 END AS longitude FROM own o JOIN stations s USING (station_code)""",
)
def coordinates_by_name(spark, sf):
    # S01 is registered by code, S02 and S03 by name only, S03 without a latitude; the others are not registered.
    register = A.stations(spark).filter("station_code <= 'S03'")
    admin = register.withColumns(
        {
            "station_code": F.when(F.col("station_code") == "S01", F.col("station_code")),
            "latitude": F.when(F.col("station_code") != "S03", F.col("latitude")),
        }
    )
    own = _latest_stations(spark, sf).select("station_code", "river_name", F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    return marts.with_admin_coordinates(own, admin)


_COVERAGE = """, cov AS (SELECT station_code, count(DISTINCT date) AS coverage_days, min(date) AS date_from, max(date) AS date_to,
    CAST(max(date) - min(date) AS INTEGER) + 1 AS span_days, least(100e0, round(100e0*count(DISTINCT date)/(CAST(max(date) - min(date) AS INTEGER) + 1), 1)) AS coverage_pct,
    strftime(min(date), '%b %Y') || '–' || strftime(max(date), '%b %Y') AS range_label FROM hist GROUP BY 1)
"""


@query(
    "c04_stations_with_coverage",
    _COVERAGE
    + """SELECT s.station_code, coalesce(coverage_days, 0) AS coverage_days, date_from, date_to, coalesce(span_days, 0) AS span_days,
      coalesce(coverage_pct, 0e0) AS coverage_pct, coalesce(range_label, 'No dated readings') AS range_label
    FROM stations s LEFT JOIN (SELECT * FROM cov WHERE station_code <> 'S04') c USING (station_code)""",
)
def stations_with_coverage(spark, sf):
    cov = marts.coverage(hist(spark, sf)).filter("station_code <> 'S04'")
    return marts.with_coverage(A.stations(spark).select("station_code"), cov)


@query(
    "c05_placeholders",
    """SELECT station_code, river_name, FALSE AS data_coming_soon FROM latest WHERE station_code NOT IN ('S02', 'S06')
       UNION ALL SELECT station_code, river_name, TRUE FROM stations WHERE station_code IN ('S02', 'S06')""",
)
def placeholders(spark, sf):
    present = _latest_stations(spark, sf).filter("station_code not in ('S02', 'S06')").select("station_code", "river_name")
    return marts.add_placeholders(present, A.stations(spark).select("station_code", "river_name"))


@query(
    "c05_unregistered_stations",
    "SELECT DISTINCT 'S' || lpad(CAST(1 + l_suppkey % 9 AS VARCHAR), 2, '0') AS station_code FROM lineitem WHERE l_suppkey % 9 > 6",
)
def unregistered_stations(spark, sf):
    code = F.concat(F.lit("S"), F.lpad((1 + F.col("l_suppkey") % 9).cast("string"), 2, "0"))
    rows = A.table(spark, sf, "lineitem").select(code.alias("station_code"), F.lit(None).cast("string").alias("station_name"))
    return marts.unregistered_stations(rows, A.stations(spark))


@query(
    "c06_calendar",
    f"""SELECT s.station_code, CAST(d AS DATE) AS date, round(h.wqi, 2) AS wqi, CASE WHEN h.wqi IS NOT NULL THEN {band('h.wqi')} END AS status
        FROM (SELECT DISTINCT station_code FROM hist) s, generate_series(DATE '1999-01-01', DATE '1999-12-31', INTERVAL 1 DAY) t(d)
        LEFT JOIN hist h ON h.station_code = s.station_code AND h.date = CAST(d AS DATE)""",
)
def calendar(spark, sf):
    return marts.calendar(hist(spark, sf), 1999)


@query(
    "c06_calendar_without_readings",
    f"""SELECT 'S99' AS station_code, CAST(d AS DATE) AS date, round(h.wqi, 2) AS wqi, CASE WHEN h.wqi IS NOT NULL THEN {band('h.wqi')} END AS status
        FROM generate_series(DATE '1999-01-01', DATE '1999-12-31', INTERVAL 1 DAY) t(d) LEFT JOIN hist h ON h.station_code = 'S99' AND h.date = CAST(d AS DATE)""",
)
def calendar_without_readings(spark, sf):
    return marts.calendar(hist(spark, sf), 1999, " s99 ")


@query(
    "c07_compare_long",
    """SELECT station_code, river_name, date, round(wqi, 6) AS wqi, river_status FROM (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date DESC) AS rn
       FROM hist WHERE station_code IN ('S01', 'S03') AND year(date) = 1998) WHERE rn <= 100""",
)
def compare_long(spark, sf):
    return rounded(marts.compare_long(hist(spark, sf), ["s01", "S03", "S01"], 1998, limit=100))


@query(
    "c07_compare_wide",
    """SELECT date, round(max(CASE WHEN station_code = 'S01' THEN wqi END), 6) AS "S01", round(max(CASE WHEN station_code = 'S03' THEN wqi END), 6) AS "S03"
       FROM hist WHERE station_code IN ('S01', 'S03') GROUP BY 1""",
)
def compare_wide(spark, sf):
    return rounded(marts.compare_wide(hist(spark, sf), ["S01", "S03"]))


@query(
    "c08_flag_anomalies",
    "SELECT id, date, station_code, wqi < 55 AS is_anomaly FROM hist",
)
def flag_anomalies(spark, sf):
    rows = materialize(hist(spark, sf).select("id", "date", "station_code", "wqi"), "slice")  # both sides read it
    return marts.flag_anomalies(rows, rows.filter("wqi < 55")).drop("wqi")


@query(
    "c09_dataset_rivers",
    """, reg AS (SELECT k AS dataset_id, CASE WHEN k = 0 THEN 'Given' END AS own FROM generate_series(0, 11) t(k)),
    r AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN CAST(substr(station_code, 3, 1) AS BIGINT) ELSE 8 + l_orderkey % 3 END AS dataset_id, river_name FROM readings),
    seen AS (SELECT dataset_id, min(river_name) AS lo, max(river_name) AS hi FROM r GROUP BY 1)
    SELECT reg.dataset_id, coalesce(own, CASE WHEN lo = hi THEN lo WHEN lo IS NOT NULL THEN 'Multiple rivers' END) AS river_name FROM reg LEFT JOIN seen USING (dataset_id)""",
)
def dataset_rivers(spark, sf):
    rows = A.readings(spark, sf)
    ident = F.when(F.col("l_orderkey") % 2 == 0, F.substring("station_code", 3, 1).cast("long")).otherwise(8 + F.col("l_orderkey") % 3)
    registry = spark.range(12).select(F.col("id").alias("dataset_id"), F.when(F.col("id") == 0, "Given").alias("river_name"))
    return marts.dataset_rivers(registry, rows.withColumn("dataset_id", ident))


@query(
    "c10_measured_rows",
    """, rec AS (SELECT station_code, date, wqi, l_linenumber > 3 AS is_predicted, l_orderkey*8 + l_linenumber AS record_id, l_partkey, l_suppkey FROM
        (SELECT *, tss AS wqi FROM measurements))
    SELECT station_code, date, is_predicted, record_id FROM (SELECT *, row_number() OVER (PARTITION BY station_code, date ORDER BY is_predicted, record_id DESC) AS rn FROM rec) WHERE rn = 1""",
)
def measured_rows(spark, sf):
    records = A.measurements(spark, sf).select(
        F.lower("station_code").alias("station_code"),
        "date",
        (F.col("_ord.l_linenumber") > 3).alias("is_predicted"),
        (F.col("_ord.l_orderkey") * 8 + F.col("_ord.l_linenumber")).alias("record_id"),
    )
    return marts.measured_rows(records)


@query(
    "c11_actual_vs_predicted",
    """SELECT coalesce(a.station_code, p.station_code) AS station_code, coalesce(a.date, p.date) AS date, round(a.wqi, 6) AS actual_wqi, round(p.wqi, 6) AS predicted_wqi
       FROM readings a FULL JOIN points p ON a.station_code = p.station_code AND a.date = p.date""",
)
def actual_vs_predicted(spark, sf):
    return rounded(marts.actual_vs_predicted(A.readings(spark, sf), A.forecast_points(spark, sf)))


# --- D: aggregates ------------------------------------------------------------------


@query(
    "d01_summary",
    f"""SELECT count(*) AS total_stations, round(avg(wqi), 6) AS avg_wqi, count(*) FILTER (wqi >= 81) AS clean_count,
        count(*) FILTER (wqi >= 60 AND wqi < 81) AS slightly_polluted_count, count(*) FILTER (wqi < 60) AS polluted_count,
        (SELECT count(*) FROM alerts_log WHERE NOT is_read) AS recent_alerts_count, (SELECT count(*) FROM hist) AS total_records,
        (SELECT round(avg(wqi), 6) FROM points WHERE date > {AS_OF} AND date <= {END}) AS predicted_avg_wqi FROM latest""",
)
def summary(spark, sf):
    return rounded(marts.summary(hist(spark, sf), A.alerts_log(spark, sf), A.forecast_points(spark, sf), A.AS_OF, A.END))


_STATES = {}


def _state(spark, sf):
    """Readings and points in three batches, the second replayed; stored once per session, read by several screens.

    The raw table is deduplicated once: batches and points are taken from the stored rows of one day and station each.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key in _STATES:
        return _STATES[key]
    state = DashboardState(new_path(spark, "dashboard"))
    readings = materialize(A.readings(spark, sf), "readings")
    points = A.moved_ahead(readings)
    for generation, rest in enumerate((0, 1, 1, 2)):
        state.add_readings(readings.filter(F.col("id") % 3 == rest), rest)
        state.add_points(points.filter(F.col("id") % 3 == rest), rest)
        if generation == 1:
            state.compact(spark)
    _STATES[key] = state
    return state


@query(
    "d01_summary_from_state",
    f"""SELECT count(*) AS total_stations, round(avg(wqi), 6) AS avg_wqi, count(*) FILTER (wqi >= 81) AS clean_count,
        count(*) FILTER (wqi >= 60 AND wqi < 81) AS slightly_polluted_count, count(*) FILTER (wqi < 60) AS polluted_count,
        (SELECT count(*) FROM alerts_log WHERE NOT is_read) AS recent_alerts_count, (SELECT count(*) FROM hist) AS total_records,
        (SELECT round(avg(wqi), 6) FROM points WHERE date > {AS_OF} AND date <= {END}) AS predicted_avg_wqi FROM latest""",
)
def summary_from_state(spark, sf):
    return rounded(_state(spark, sf).summary(A.alerts_log(spark, sf), A.AS_OF, A.END))


@query("d04_coverage_from_state", _COVERAGE + "SELECT * FROM cov")
def coverage_from_state(spark, sf):
    return marts.coverage(_state(spark, sf).history(spark, A.AS_OF))


@query(
    "d08_rollup_from_state",
    "SELECT CAST(date_trunc('month', date) AS DATE) AS bucket, round(avg(wqi), 6) AS avg_wqi FROM hist GROUP BY 1 ORDER BY 1 DESC LIMIT 36",
)
def rollup_from_state(spark, sf):
    return rounded(marts.rollup_mean(_state(spark, sf).history(spark, A.AS_OF), "monthly", buckets=36))


@query(
    "d01_summary_of_river",
    f"""SELECT count(*) AS total_stations, round(avg(wqi), 6) AS avg_wqi, count(*) FILTER (wqi >= 81) AS clean_count,
        count(*) FILTER (wqi >= 60 AND wqi < 81) AS slightly_polluted_count, count(*) FILTER (wqi < 60) AS polluted_count,
        (SELECT count(*) FROM alerts_log WHERE NOT is_read) AS recent_alerts_count, (SELECT count(*) FROM hist) AS total_records,
        (SELECT round(avg(wqi), 6) FROM points WHERE date > {AS_OF} AND date <= {END} AND river_name = 'Sungai Kulim') AS predicted_avg_wqi
        FROM latest WHERE river_name = 'Sungai Kulim'""",
)
def summary_of_river(spark, sf):
    return rounded(
        marts.summary(hist(spark, sf), A.alerts_log(spark, sf), A.forecast_points(spark, sf), A.AS_OF, A.END, river="Sungai Kulim")
    )


@query(
    "d02_overview",
    f"""SELECT count(*) AS total_records, count(DISTINCT station_code) AS total_stations, min(date) AS historical_date_from, {AS_OF} AS latest_date,
        {AS_OF} + 1 AS forecast_date_from, {END} AS forecast_date_to FROM hist""",
)
def overview(spark, sf):
    return marts.overview(hist(spark, sf), A.AS_OF, A.END)


@query("d03_predicted_average", f"SELECT round(avg(wqi), 6) AS predicted_avg_wqi FROM points WHERE date > {AS_OF} AND date <= {END}")
def predicted_average(spark, sf):
    return rounded(marts.predicted_average(A.forecast_points(spark, sf), A.AS_OF, A.END))


@query("d04_station_coverage", _COVERAGE + "SELECT * FROM cov")
def station_coverage(spark, sf):
    return marts.coverage(hist(spark, sf))


@query(
    "d05_prediction_sanity",
    """SELECT station_code, round(min(wqi/50e0), 6) AS min_wqi, round(max(wqi/50e0), 6) AS max_wqi, round(avg(wqi/50e0), 6) AS avg_wqi, count(*) AS total,
       count(*) FILTER (wqi/50e0 < 1) AS suspicious_low FROM points WHERE date >= DATE '2000-01-01' GROUP BY 1""",
)
def prediction_sanity(spark, sf):
    unscaled = A.forecast_points(spark, sf).withColumn("wqi", F.col("wqi") / 50.0)
    return rounded(marts.prediction_sanity(unscaled, date(2000, 1, 1)))


@query("d06_available_years", "SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM hist")
def available_years(spark, sf):
    return marts.available_years(hist(spark, sf))


@query("d06_river_names", "SELECT DISTINCT river_name FROM hist")
def river_names(spark, sf):
    return marts.river_names(hist(spark, sf))


@query("d06_station_choices", "SELECT station_code, river_name AS station_name, river_name FROM latest WHERE river_name = 'Sungai Perak'")
def station_choices(spark, sf):
    rows = _latest_stations(spark, sf).withColumn("station_name", F.col("river_name"))
    return marts.station_choices(rows, "Sungai Perak").select("station_code", "station_name", "river_name")


@query(
    "d07_filtered_counts",
    f"""SELECT 'historical' AS kind, count(*) AS n FROM hist WHERE year(date) = 1998 AND river_status = 'clean'
        UNION ALL SELECT 'forecast', count(*) FROM points WHERE date > {AS_OF} AND date <= {END} AND year(date) = 2001 AND river_status = 'clean'""",
)
def filtered_counts(spark, sf):
    past = marts.filtered_count(history.filter_readings(hist(spark, sf), year=1998, status_is="clean"))
    ahead = history.filter_forecast(A.forecast_points(spark, sf), A.AS_OF, A.END, year_from=2001, year_to=2001, status_is="clean")
    return past.withColumn("kind", F.lit("historical")).unionByName(
        marts.filtered_count(ahead).withColumn("kind", F.lit("forecast"))
    )


def _rollup(grain: str, unit: str, n: int):
    @query(
        f"d08_rollup_{grain}",
        f"SELECT CAST(date_trunc('{unit}', date) AS DATE) AS bucket, round(avg(wqi), 6) AS avg_wqi FROM hist GROUP BY 1 ORDER BY 1 DESC LIMIT {n}",
    )
    def run(spark, sf):
        return rounded(marts.rollup_mean(hist(spark, sf), grain, buckets=n))

    return run


for _grain, _unit, _n in (("monthly", "month", 36), ("yearly", "year", 10), ("daily", "day", 365)):
    _rollup(_grain, _unit, _n)


@query(
    "d09_rollup_with_bounds",
    f""", e AS (SELECT date, wqi, greatest(0e0, wqi - least(12e0, greatest(3e0, 0.08e0*greatest(wqi, 1e0)))) AS lo,
        least(100e0, wqi + least(12e0, greatest(3e0, 0.08e0*greatest(wqi, 1e0)))) AS hi FROM points WHERE date > {AS_OF})
    SELECT CAST(date_trunc('month', date) AS DATE) AS bucket, round(avg(wqi), 6) AS avg_wqi, round(avg(lo), 6) AS avg_wqi_lower, round(avg(hi), 6) AS avg_wqi_upper
    FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 36""",
)
def rollup_with_bounds(spark, sf):
    points = A.forecast_points(spark, sf).filter(F.col("date") > F.lit(A.AS_OF))
    return rounded(marts.rollup_mean(marts.with_open_envelope(points), "monthly", ("wqi", "wqi_lower", "wqi_upper"), buckets=36))


@query(
    "d10_alerts_by_severity",
    """SELECT s.severity, s.position, count(a.id) AS n FROM (VALUES ('critical', 1), ('warning', 2), ('info', 3)) s(severity, position)
       LEFT JOIN alerts_log a ON a.severity = s.severity GROUP BY ALL""",
)
def alerts_by_severity(spark, sf):
    return marts.alerts_by_severity(A.alerts_log(spark, sf))


@query(
    "d11_index_distribution",
    """SELECT station_code, count(*) AS n, round(avg(wqi), 2) AS mean, round(min(wqi), 2) AS min, round(max(wqi), 2) AS max, round(stddev_samp(wqi), 2) AS std
       FROM readings GROUP BY 1""",
)
def index_distribution(spark, sf):
    return marts.wqi_distribution(A.readings(spark, sf))


@query(
    "d12_trailing_baseline",
    "SELECT station_code, round(avg(wqi), 6) AS baseline_wqi FROM (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date DESC) AS rn FROM hist) WHERE rn <= 10 GROUP BY 1",
)
def trailing_baseline(spark, sf):
    return rounded(series.trailing_baseline(hist(spark, sf)))


@query(
    "d13_alert_screen_counts",
    f"SELECT count(*) FILTER (wqi BETWEEN 60 AND 80) AS slightly_polluted_today, count(*) FILTER (wqi < 60) AS polluted_today FROM hist WHERE date = {AS_OF}",
)
def alert_screen_counts(spark, sf):
    return marts.alert_screen_counts(hist(spark, sf), A.AS_OF)


@query(
    "d14_report_preview",
    "SELECT count(*) AS records, round(avg(wqi), 6) AS avg_wqi, count(DISTINCT station_code) AS stations FROM hist WHERE date BETWEEN DATE '1997-03-01' AND DATE '1999-05-31'",
)
def report_preview(spark, sf):
    return rounded(marts.report_preview(hist(spark, sf), date(1997, 3, 1), date(1999, 5, 31)))


_CONTRIBUTION = " UNION ALL ".join(
    f"SELECT station_code, date, wqi, {i} AS slot, '{p}' AS parameter, {STRESS_SQL[p]} AS score, {p} AS raw FROM cleaned" for i, p in enumerate(PARAMETERS)
)


@query(
    "d15_parameter_contribution",
    f""", s AS ({_CONTRIBUTION}),
    t AS (SELECT *, sum(score) OVER (PARTITION BY station_code, date) AS total, row_number() OVER (PARTITION BY station_code, date ORDER BY score DESC, slot) AS rank FROM s)
    SELECT station_code, date, CAST(rank AS INTEGER) AS rank, parameter, round(score, 2) AS stress_score,
      round(100e0*score/CASE WHEN total = 0 THEN 1e0 ELSE total END, 2) AS contribution_pct, round(raw, 6) AS raw_value, round(wqi, 6) AS wqi FROM t""",
)
def parameter_contribution(spark, sf):
    from hydrolake.functions.wqi import add_wqi

    first = materialize(cleaning.dedup_first(A.measurements(spark, sf, with_nulls=True)), "first")
    rows = add_wqi(cleaning.impute(first))
    return rounded(marts.contribution(rows).drop("label"))


_SPLIT = """, split AS (SELECT *, CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split FROM readings)
"""


def _split(spark, sf):
    when = F.when(F.col("date") < F.lit(date(1999, 1, 1)), "train").when(F.col("date") < F.lit(date(2000, 1, 1)), "val").otherwise("test")
    return A.readings(spark, sf).withColumn("split", when)


@query(
    "d16_split_stats",
    _SPLIT + "SELECT split, count(*) AS n, round(avg(wqi), 6) AS mean, round(stddev_pop(wqi), 6) AS std, round(min(wqi), 6) AS min, round(max(wqi), 6) AS max FROM split GROUP BY 1",
)
def split_stats(spark, sf):
    return rounded(marts.split_stats(_split(spark, sf)))


@query(
    "d16_split_shift",
    _SPLIT
    + """, d AS (SELECT avg(wqi) FILTER (split = 'test') - avg(wqi) FILTER (split = 'train') AS m, stddev_pop(wqi) FILTER (split = 'test') - stddev_pop(wqi) FILTER (split = 'train') AS s FROM split)
    SELECT round(m, 6) AS d_mean, round(s, 6) AS d_std, abs(m) > 3 OR abs(s) > 5 AS large_shift FROM d""",
)
def split_shift(spark, sf):
    return rounded(marts.split_shift(_split(spark, sf)))


@query(
    "d17_missing_profile",
    """SELECT 'cod' AS column_name, count(*) FILTER (cod IS NULL) AS missing_count FROM holed UNION ALL SELECT 'tss', count(*) FILTER (tss IS NULL) FROM holed""",
)
def missing_profile(spark, sf):
    return cleaning.missing_profile(A.measurements(spark, sf, with_nulls=True).drop("_ord"), top=10)


@query(
    "d18_forecast_checks",
    """SELECT station_code, count(*) AS n, round(avg(wqi), 6) AS mean, round(stddev_samp(wqi), 6) AS std, round(min(wqi), 6) AS min, round(max(wqi), 6) AS max,
       CASE station_code WHEN 'S04' THEN avg(wqi) >= 70 WHEN 'S02' THEN avg(wqi) >= 35 ELSE TRUE END AS mean_ok, stddev_samp(wqi) >= 2 AS std_ok FROM points GROUP BY 1""",
)
def forecast_checks(spark, sf):
    return rounded(marts.forecast_checks(A.forecast_points(spark, sf), {"S04": 70.0, "S02": 35.0}))


@query(
    "d18_forecast_spread",
    """, m AS (SELECT station_code, avg(wqi) AS mean FROM points GROUP BY 1)
    SELECT round(max(mean) - min(mean), 6) AS spread, count(*) AS stations, count(*) < 2 OR max(mean) - min(mean) >= 5 AS spread_ok FROM m""",
)
def forecast_spread(spark, sf):
    return rounded(marts.forecast_spread(A.forecast_points(spark, sf)))


@query(
    "d19_page_average",
    "SELECT round(avg(wqi), 6) AS avg_wqi FROM (SELECT * FROM hist ORDER BY date, station_code LIMIT 25 OFFSET 50)",
)
def page_average(spark, sf):
    return rounded(marts.page_average(marts.readings_page(hist(spark, sf), limit=25, offset=50)))


# --- F: sort, limit, top-k ------------------------------------------------------------


@query(
    "f01_readings_page_by_date",
    "SELECT station_code, station_name, river_name, date, round(wqi, 6) AS wqi, river_status, data_type FROM hist ORDER BY date DESC, station_code LIMIT 200 OFFSET 100",
)
def readings_page_by_date(spark, sf):
    return rounded(marts.readings_page(hist(spark, sf), "date", descending=True, limit=200, offset=100))


@query(
    "f01_forecast_page_by_index",
    f"""SELECT station_code, station_name, river_name, date, round(wqi, 6) AS wqi, river_status, 'forecast' AS data_type FROM points
        WHERE date > {AS_OF} AND date <= {END} ORDER BY points.wqi, station_code, date LIMIT 150""",
)
def forecast_page_by_index(spark, sf):
    points = history.filter_forecast(A.forecast_points(spark, sf), A.AS_OF, A.END)
    return rounded(marts.readings_page(points, "wqi", limit=150))


@query("f02_tail", "SELECT id, station_code, date FROM hist ORDER BY date DESC, station_code DESC LIMIT 120")
def tail(spark, sf):
    return history.tail(hist(spark, sf), 120, ["date", "station_code"]).select("id", "station_code", "date")


@query("f03_full_listing", f"SELECT station_code, station_name, river_name, date, round(wqi, 6) AS wqi, {band('wqi')} AS status FROM hist")
def full_listing(spark, sf):
    return rounded(marts.full_listing(hist(spark, sf)))


@query("f04_newest_events", "SELECT id, triggered_at, severity FROM alerts_log ORDER BY triggered_at DESC, id DESC LIMIT 200")
def newest_events(spark, sf):
    return marts.top_recent(A.alerts_log(spark, sf), ["triggered_at", "id"], 200).select("id", "triggered_at", "severity")


@query(
    "f05_forecast_table",
    f"""SELECT date, river_name, station_name, round(wqi, 6) AS wqi, river_status, round(wqi_lower, 2) AS wqi_lower FROM (SELECT *, greatest(0e0, wqi - least(12e0, greatest(3e0, 0.08e0*greatest(wqi, 1e0)))) AS wqi_lower FROM points)
        WHERE date > {AS_OF} AND date BETWEEN DATE '2001-02-01' AND DATE '2001-06-30'""",
)
def forecast_table(spark, sf):
    out = marts.forecast_table(A.forecast_points(spark, sf), A.AS_OF, 2001, month_from=2, month_to=6)
    return rounded(with_envelope(out).select("date", "river_name", "station_name", "wqi", "river_status", "wqi_lower"))


@query(
    "f06_rank_experiments",
    """SELECT s_nationkey AS experiment, CASE WHEN s_nationkey % 6 = 0 THEN NULL ELSE round(avg(s_acctbal), 6) END AS r2 FROM supplier GROUP BY 1""",
)
def rank_experiments(spark, sf):
    scores = A.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("experiment")).agg(F.avg("s_acctbal").alias("r2"))
    broken = F.when(F.col("experiment") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("r2"))
    return rounded(marts.rank_experiments(scores.withColumn("r2", broken)))


# --- G: set operations ---------------------------------------------------------------


@query(
    "g01_union_all",
    "SELECT station_code, count(*) AS n, count(id) AS n_id FROM (SELECT station_code, id FROM readings UNION ALL SELECT station_code, NULL FROM points) GROUP BY 1",
)
def union_all(spark, sf):
    both = A.readings(spark, sf).select("station_code", "id").unionByName(
        A.forecast_points(spark, sf).select("station_code"), allowMissingColumns=True
    )
    return both.groupBy("station_code").agg(F.count("*").alias("n"), F.count("id").alias("n_id"))


@query(
    "g02_combine_alerts",
    """, a AS (SELECT 'T' AS alert_type, station_name, date, wqi, 0 AS side FROM points WHERE wqi < 60 UNION ALL
        SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'T' ELSE 'A' END, station_name, date, wqi, 1 FROM readings WHERE wqi < 60)
    SELECT alert_type, station_name, date, round(wqi, 6) AS wqi FROM (SELECT *, row_number() OVER (PARTITION BY alert_type, station_name, date ORDER BY side) AS rn FROM a) WHERE rn = 1""",
)
def combine_alerts(spark, sf):
    cols = ["alert_type", "station_name", "date", "wqi"]
    first = A.forecast_points(spark, sf).filter("wqi < 60").withColumn("alert_type", F.lit("T")).select(*cols)
    kind = F.when(F.col("l_orderkey") % 2 == 0, "T").otherwise("A")
    second = A.readings(spark, sf).filter("wqi < 60").withColumn("alert_type", kind).select(*cols)
    return rounded(alerts.combine_alerts(first, second))


@query(
    "g03_station_set_difference",
    """, seen AS (SELECT DISTINCT 'S' || lpad(CAST(2 + l_suppkey % 9 AS VARCHAR), 2, '0') AS station_code FROM lineitem)
    SELECT station_code, 'unexpected' AS side FROM seen WHERE station_code NOT IN (SELECT station_code FROM stations)
    UNION ALL SELECT station_code, 'missing' FROM stations WHERE station_code NOT IN (SELECT station_code FROM seen)""",
)
def station_set_difference(spark, sf):
    code = F.concat(F.lit("S"), F.lpad((2 + F.col("l_suppkey") % 9).cast("string"), 2, "0"))
    seen = A.table(spark, sf, "lineitem").select(code.alias("station_code"))
    return marts.station_set_difference(seen, A.stations(spark))


@query("c05_canonical_station_table", "SELECT station_code, river_name, date AS last_reading_date FROM latest")
def canonical_station_table(spark, sf):
    """Rows keyed by code and older rows keyed only by river name are merged."""
    rows = _latest_stations(spark, sf).select("station_code", "river_name", "last_reading_date")
    legacy = rows.select(
        F.col("river_name").alias("station_code"), "river_name", F.date_sub("last_reading_date", 400).alias("last_reading_date")
    )
    return marts.canonical_station_table(rows.unionByName(legacy))


_REGISTER = """, reg AS (SELECT 'ST' || CAST(s_suppkey AS VARCHAR) AS station_code, 'Sungai ' || s_name AS river_name, s_nationkey AS district FROM supplier),
  labels AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN ' st' || CAST(l_suppkey AS VARCHAR) || ' ' WHEN 3 THEN 'X' || CAST(l_suppkey AS VARCHAR) ELSE NULL END AS code,
    CASE l_linenumber % 4 WHEN 1 THEN s_name WHEN 2 THEN 'Sungai ' || s_name WHEN 3 THEN 'Weir' END AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
  resolved AS (SELECT l.*, CASE WHEN l_linenumber % 4 IN (0, 2) THEN reg.station_code WHEN l_linenumber % 4 = 3 THEN upper(code) ELSE name END AS station_code,
    CASE WHEN l_linenumber % 4 IN (0, 2) THEN reg.river_name WHEN l_linenumber % 4 = 3 THEN 'Weir (' || upper(code) || ')' ELSE name END AS river_name,
    CASE WHEN l_linenumber % 4 IN (0, 2) THEN district END AS district, l_linenumber % 4 IN (0, 2) AS is_registered
    FROM labels l JOIN reg ON reg.station_code = 'ST' || CAST(l_suppkey AS VARCHAR))
"""


def _register(spark, sf):
    """The suppliers as a register of stations."""
    return A.table(spark, sf, "supplier").select(
        F.concat(F.lit("ST"), "s_suppkey").alias("station_code"), F.concat(F.lit("Sungai "), "s_name").alias("river_name"), F.col("s_nationkey").alias("district")
    )


def _labels(spark, sf):
    """Line items with the station's code in another spelling, its name, its river or an unknown code."""
    kind, names = F.col("l_linenumber") % 4, A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    code = F.when(kind == 0, F.concat(F.lit(" st"), "l_suppkey", F.lit(" "))).when(kind == 3, F.concat(F.lit("X"), "l_suppkey"))
    name = F.when(kind == 1, F.col("s_name")).when(kind == 2, F.concat(F.lit("Sungai "), "s_name")).when(kind == 3, "Weir")
    return A.table(spark, sf, "lineitem").join(names, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", code.alias("station_code"), name.alias("station_name"))


@query(
    "b17_resolve_by_register",
    _REGISTER + "SELECT station_code, river_name, district, is_registered, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM resolved GROUP BY ALL",
)
def resolve_by_register(spark, sf):
    found = register.resolve_stations(_labels(spark, sf), _register(spark, sf))
    by = ["station_code", "river_name", "district", "is_registered"]
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


@query(
    "b19_rows_of_registered_river",
    _REGISTER + "SELECT l_orderkey, l_linenumber FROM resolved WHERE river_name = (SELECT min(river_name) FROM reg) OR station_code = (SELECT min(river_name) FROM reg)",
)
def rows_of_registered_river(spark, sf):
    river = _register(spark, sf).agg(F.min("river_name")).first()[0]
    return register.rows_of_river(_labels(spark, sf), _register(spark, sf), f" {river} ").select("l_orderkey", "l_linenumber")


@query(
    "a22_upload_check_by_register",
    _REGISTER
    + """SELECT DISTINCT upper(trim(code)) AS station_code, CASE WHEN l_linenumber % 4 = 0 THEN river_name ELSE 'Unknown River' END AS river_name, l_linenumber % 4 = 0 AS is_registered,
    CASE WHEN l_linenumber % 4 = 3 THEN 'Station code ' || upper(code) || ' is not registered; readings will use ''Unknown River''.' END AS warning
    FROM resolved WHERE code IS NOT NULL""",
)
def upload_check_by_register(spark, sf):
    return register.upload_check(_labels(spark, sf), _register(spark, sf))


@query(
    "c05_registered_without_rows",
    _REGISTER + "SELECT station_code, river_name FROM reg WHERE station_code NOT IN (SELECT station_code FROM resolved WHERE is_registered AND l_orderkey % 500 = 1)",
)
def registered_without_rows(spark, sf):
    return register.not_yet_present(_register(spark, sf), _labels(spark, sf).filter("l_orderkey % 500 = 1")).select("station_code", "river_name")
