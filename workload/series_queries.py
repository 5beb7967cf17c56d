"""Time-series operators (survey section E)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.operators import history, marts, series, splits
from workload.expressions import hist
from workload.registry import AS_OF, query, rounded

_W = "OVER (PARTITION BY station_code ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_PAST = "OVER (PARTITION BY station_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "OVER (PARTITION BY station_code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def lag_sql(n: int, x: str = "wqi") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY station_code ORDER BY date)"


def fill_sql(x: str) -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) {_PAST}, first_value({x} IGNORE NULLS) {_NEXT}, 0e0)"


@query(
    "e01_rolling",
    f"""SELECT station_code, date, round(avg(wqi) {_W}, 6) AS wqi_rolling_mean, round(coalesce(stddev_samp(wqi) {_W}, 0e0), 4) AS wqi_rolling_std FROM readings""",
)
def rolling(spark, sf):
    out = series.rolling(A.readings(spark, sf).select("station_code", "date", "wqi"))
    return out.select(
        "station_code", "date", F.round("wqi_rolling_mean", 6).alias("wqi_rolling_mean"), F.round("wqi_rolling_std", 4).alias("wqi_rolling_std")
    )


_RAW_ORDER = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "e01_rolling_raw_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date,
        round(avg(tss) OVER (PARTITION BY station_code ORDER BY {_RAW_ORDER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS tss_rolling_mean FROM measurements""",
)
def rolling_raw_rows(spark, sf):
    """All rows, several per day, in chunks: no station is ever one window group."""
    rows = A.measurements(spark, sf).select("station_code", "date", "tss", "_ord")
    placed = series.with_position(rows, ["date", "_ord"])
    out = series.chunked_window(placed, 6, lambda w: series.rolling_columns(w, "tss"), chunk_rows=1000)
    return rounded(
        out.select("_ord.l_orderkey", "_ord.l_linenumber", "_ord.l_partkey", "_ord.l_suppkey", "date", "tss_rolling_mean")
    )


@query(
    "e01_rolling_calendar",
    """SELECT station_code, date, round(avg(wqi) OVER (PARTITION BY station_code ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS wqi_rolling_mean FROM readings""",
)
def rolling_calendar(spark, sf):
    out = series.rolling_calendar(A.readings(spark, sf).select("station_code", "date", "wqi"))
    return rounded(out.select("station_code", "date", "wqi_rolling_mean"))


@query(
    "e02_lags",
    f""", l AS (SELECT station_code, date, {lag_sql(1)} AS l1, {lag_sql(7)} AS l7, {lag_sql(14)} AS l14 FROM readings)
    SELECT station_code, date, round({fill_sql('l1')}, 6) AS wqi_lag_1, round({fill_sql('l7')}, 6) AS wqi_lag_7, round({fill_sql('l14')}, 6) AS wqi_lag_14 FROM l""",
)
def lags(spark, sf):
    out = series.lags(A.readings(spark, sf).select("station_code", "date", "wqi"))
    return rounded(out.drop("wqi"))


@query(
    "e03_model_frame",
    f""", l AS (SELECT station_code, date, wqi, cod, tss, {lag_sql(1)} AS l1, {lag_sql(7)} AS l7, {lag_sql(30)} AS l30 FROM (SELECT h.*, d.wqi FROM holed_first h JOIN daily d USING (station_code, date)))
    SELECT station_code, date, round(wqi, 6) AS wqi, round({fill_sql('l1')}, 6) AS wqi_lag_1, round({fill_sql('l7')}, 6) AS wqi_lag_7, round({fill_sql('l30')}, 6) AS wqi_lag_30,
      CASE WHEN month(date) IN (10,11,12,1,2,3) THEN 1e0 ELSE 0e0 END AS monsoon_ne, CASE WHEN month(date) BETWEEN 5 AND 9 THEN 1e0 ELSE 0e0 END AS monsoon_sw,
      CASE WHEN month(date) = 4 THEN 1e0 ELSE 0e0 END AS monsoon_other, round(sin(2*pi()*(month(date)-1)/12e0), 6) + 0e0 AS month_sin, round(cos(2*pi()*(month(date)-1)/12e0), 6) + 0e0 AS month_cos,
      round({fill_sql('cod')}, 6) AS cod, round({fill_sql('tss')}, 6) AS tss, 0e0 AS absent FROM l""",
)
def model_frame(spark, sf):
    from hydrolake.operators.cleaning import dedup_first

    holes = dedup_first(A.measurements(spark, sf, with_nulls=True)).select("station_code", "date", "cod", "tss")
    rows = holes.join(A.daily_measurements(spark, sf).select("station_code", "date", "wqi"), ["station_code", "date"])
    return rounded(series.model_frame(rows, add_month=True, extra=["cod", "tss", "absent"]))


@query(
    "e04_fill_gaps",
    f"""SELECT station_code, date, round({fill_sql('x')}, 6) AS x FROM (SELECT station_code, date, CASE WHEN id % 3 = 0 THEN wqi END AS x FROM readings)""",
)
def fill_gaps(spark, sf):
    rows = A.readings(spark, sf).select("station_code", "date", F.when(F.col("id") % 3 == 0, F.col("wqi")).alias("x"))
    return rounded(series.fill_gaps(rows, ["x"]))


@query(
    "e05_latest_per_station",
    "SELECT id, station_code, river_name, date, round(wqi, 6) AS wqi, river_status, data_type, is_predicted FROM latest",
)
def latest_per_station(spark, sf):
    return rounded(history.latest_per_station(hist(spark, sf)).drop("station_name"))


@query("e05_station_table", "SELECT station_code, river_name, round(wqi, 6) AS latest_wqi, river_status, date AS last_reading_date FROM latest")
def station_table(spark, sf):
    return rounded(marts.latest_stations(hist(spark, sf)))


@query("e06_latest_of_station", "SELECT id, station_code, date, round(wqi, 6) AS wqi FROM latest WHERE river_name = 'Sungai Gombak'")
def latest_of_station(spark, sf):
    return rounded(history.latest_of_station(hist(spark, sf), "Sungai Gombak").select("id", "station_code", "date", "wqi"))


@query(
    "e07_time_series",
    "SELECT date, round(wqi, 6) AS wqi, station_code, station_name, river_name, river_status FROM hist WHERE station_code = 'S05' AND year(date) = 1999 ORDER BY date DESC LIMIT 100",
)
def time_series(spark, sf):
    return rounded(history.time_series(hist(spark, sf), station_code="S05", year=1999, limit=100))


@query(
    "e08_index_data",
    "SELECT date, station_name AS station, station_code, station_name, river_name, round(wqi, 6) AS wqi, river_status FROM hist WHERE river_name = 'Sungai Perak' ORDER BY date DESC LIMIT 500",
)
def index_data(spark, sf):
    return rounded(history.wqi_data(hist(spark, sf), river="Sungai Perak", limit=500))


_SAMPLES = """, n AS (SELECT station_code, date, wqi, row_number() OVER (PARTITION BY station_code ORDER BY date) AS rn, count(*) OVER (PARTITION BY station_code) AS total FROM readings),
  samples AS (SELECT a.station_code, a.rn - 30 AS sample_index, a.date, a.wqi AS anchor,
    (SELECT sum(b.wqi) FROM n b WHERE b.station_code = a.station_code AND b.rn BETWEEN a.rn - 29 AND a.rn) AS sum_inputs,
    (SELECT sum(b.wqi) FROM n b WHERE b.station_code = a.station_code AND b.rn BETWEEN a.rn + 1 AND a.rn + 7) AS sum_targets,
    (SELECT b.wqi FROM n b WHERE b.station_code = a.station_code AND b.rn = a.rn + 7) AS last_target
    FROM n a WHERE a.rn >= 30 AND a.rn + 7 <= a.total)
"""


@query(
    "e09_sliding_windows",
    _SAMPLES + "SELECT station_code, CAST(sample_index AS INTEGER) AS sample_index, date, round(anchor, 6) AS anchor, round(sum_inputs, 4) AS sum_inputs, round(sum_targets, 4) AS sum_targets FROM samples WHERE sample_index % 3 = 0",
)
def sliding_windows(spark, sf):
    samples = series.sliding_windows(A.readings(spark, sf), ["wqi"], 30, 7, step=3)

    def total(c, item):
        return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + item(x)), 4)

    return samples.select(
        "station_code", "sample_index", "date", F.round("anchor", 6).alias("anchor"),
        total("inputs", lambda x: x[0]).alias("sum_inputs"), total("targets", lambda x: x).alias("sum_targets"),
    )


@query(
    "e10_difference_targets",
    _SAMPLES + "SELECT station_code, CAST(sample_index AS INTEGER) AS sample_index, round(last_target - anchor, 4) + 0e0 AS total_change, round(last_target, 4) AS last_level FROM samples",
)
def difference_targets(spark, sf):
    samples = series.sliding_windows(A.readings(spark, sf), ["wqi"], 30, 7)
    steps = samples.withColumn("diffs", series.first_differences("anchor", "targets"))
    levels = steps.withColumn("levels", series.integrate_differences("anchor", "diffs"))
    change = F.aggregate("diffs", F.lit(0.0), lambda s, x: s + x)
    return rounded(
        levels.select("station_code", "sample_index", change.alias("total_change"), F.element_at("levels", -1).alias("last_level")), 4
    )


@query(
    "e11_model_input",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date DESC) AS back FROM readings)
    SELECT station_code, max(date) AS last_date, count(*) AS n, round(sum(wqi), 4) AS sum_wqi, round(max_by(wqi, -back), 6) AS newest, round(max_by(wqi, back), 6) AS oldest
    FROM r WHERE back <= 30 GROUP BY 1""",
)
def model_input(spark, sf):
    out = series.model_input(A.readings(spark, sf), ["wqi"], 30)
    value = F.transform("window", lambda r: r[0])
    return out.select(
        "station_code", "last_date", F.size("window").cast("long").alias("n"),
        F.round(F.aggregate(value, F.lit(0.0), lambda s, x: s + x), 4).alias("sum_wqi"),
        F.round(F.element_at(value, -1), 6).alias("newest"), F.round(F.element_at(value, 1), 6).alias("oldest"),
    )


@query(
    "e12_pad_history",
    """, s AS (SELECT station_code, date, wqi FROM readings WHERE station_code > 'S02' OR date >= DATE '2001-10-20'),
    f AS (SELECT station_code, min(date) AS first, min_by(wqi, date) AS wqi, count(*) AS n FROM s GROUP BY 1)
    SELECT station_code, date, round(wqi, 6) AS wqi FROM s UNION ALL
    SELECT station_code, first - CAST(k AS INTEGER), round(wqi, 6) FROM f, generate_series(1, 30) t(k) WHERE k <= 30 - n""",
)
def pad_history(spark, sf):
    # Two stations are thinned out, so that there is something to pad; the others stay whole.
    rows = A.readings(spark, sf).filter((F.col("station_code") > "S02") | (F.col("date") >= F.lit(date(2001, 10, 20))))
    return rounded(series.pad_history(rows.select("station_code", "date", "wqi"), 30))


@query("e13_station_series", "SELECT station_code, date, round(wqi, 6) AS wqi FROM readings WHERE station_code = 'S06'")
def station_series(spark, sf):
    return rounded(series.station_series(A.readings(spark, sf), "S06"))


@query("e13_default_station", "SELECT station_code, count(*) AS n_rows FROM readings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def default_station(spark, sf):
    return series.default_station(A.readings(spark, sf))


_FILL = f""", r AS (SELECT station_code, date, wqi, lead(date) OVER w AS nd, lead(wqi) OVER w AS nw FROM readings WINDOW w AS (PARTITION BY station_code ORDER BY date)),
  x AS (SELECT station_code, CAST(d AS DATE) AS day, date, wqi, nd, nw, CAST(d AS DATE) - date AS k FROM r, generate_series(r.date, greatest(r.date, least(coalesce(r.nd - 1, {AS_OF}), {AS_OF})), INTERVAL 1 DAY) t(d))
"""


@query(
    "e14_gap_fill_last",
    _FILL + "SELECT station_code, day AS date, round(wqi, 6) AS wqi, CASE WHEN k > 0 THEN 'gap_fill' ELSE 'historical' END AS data_type FROM x",
)
def gap_fill_last(spark, sf):
    return rounded(series.gap_fill(A.readings(spark, sf), A.AS_OF))


@query(
    "e14_gap_fill_linear",
    _FILL + "SELECT station_code, day AS date, round(wqi + coalesce((nw - wqi)*k/(nd - date), 0e0), 6) AS wqi, CASE WHEN k > 0 THEN 'gap_fill' ELSE 'historical' END AS data_type FROM x",
)
def gap_fill_linear(spark, sf):
    return rounded(series.gap_fill(A.readings(spark, sf), A.AS_OF, "linear"))


@query(
    "e15_gaps",
    """SELECT * FROM (SELECT station_code, lag(date) OVER (PARTITION BY station_code ORDER BY date) AS gap_after, date AS gap_before,
       CAST(date - lag(date) OVER (PARTITION BY station_code ORDER BY date) AS INTEGER) AS gap_days FROM readings) WHERE gap_days > 1""",
)
def gaps(spark, sf):
    return series.gaps(A.readings(spark, sf))


@query(
    "e16_latest_run",
    """, runs AS (SELECT CAST(id % 4 AS BIGINT) AS run_id, station_code, wqi, CASE WHEN id % 4 = 3 THEN NULL ELSE date END AS date FROM points)
    SELECT run_id, station_code, date, round(wqi, 6) AS wqi FROM runs WHERE run_id = (SELECT max(run_id) FROM runs WHERE date IS NOT NULL)""",
)
def latest_run(spark, sf):
    points = A.forecast_points(spark, sf)
    run = F.col("id") % 4
    rows = points.select(
        run.alias("run_id"), F.date_add(F.lit(date(2000, 1, 1)), run.cast("int")).alias("created_at"), "station_code", "wqi",
        F.when(run != 3, F.col("date")).alias("date"),
    )
    return rounded(history.latest_run(rows).drop("created_at"))


@query(
    "e17_time_split",
    """, c AS (SELECT station_code, date, row_number() OVER (PARTITION BY station_code ORDER BY date) AS pos, count(*) OVER (PARTITION BY station_code) AS n FROM readings),
    s AS (SELECT *, greatest(1, CAST(floor(n*0.2e0) AS BIGINT)) AS nt FROM c), v AS (SELECT *, greatest(1, CAST(floor((n - nt)*0.1e0) AS BIGINT)) AS nv FROM s)
    SELECT station_code, date, CASE WHEN pos > n - nt THEN 'test' WHEN pos > n - nt - nv THEN 'val' ELSE 'train' END AS split FROM v""",
)
def time_split(spark, sf):
    return splits.time_split(A.readings(spark, sf).select("station_code", "date"))


@query(
    "e17_chronological_split",
    """, o AS (SELECT station_code, date, row_number() OVER (ORDER BY date, station_code) AS pos, count(*) OVER () AS n FROM readings)
    SELECT station_code, date, CASE WHEN pos > n - greatest(1, CAST(floor(n*0.2e0) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM o""",
)
def chronological_split(spark, sf):
    tie = F.substring("station_code", 2, 2).cast("int")
    return splits.chronological_split(A.readings(spark, sf).select("station_code", "date"), 0.2, tie)


@query(
    "e18_trend",
    """SELECT station_code, round(max_by(wqi, date) - min_by(wqi, date), 6) AS delta, CASE WHEN max_by(wqi, date) - min_by(wqi, date) > 1 THEN 'Increasing'
       WHEN max_by(wqi, date) - min_by(wqi, date) < -1 THEN 'Decreasing' ELSE 'Stable' END AS trend FROM points GROUP BY 1""",
)
def trend(spark, sf):
    return rounded(series.trend(A.forecast_points(spark, sf)))


@query(
    "e19_persistence_forecast",
    """SELECT station_code, CAST(k AS INTEGER) AS step, max(date) + CAST(k AS INTEGER) AS date, round(max_by(wqi, date), 6) AS wqi
       FROM readings, generate_series(1, 7) t(k) GROUP BY station_code, k""",
)
def persistence_forecast(spark, sf):
    return rounded(series.persistence_forecast(A.readings(spark, sf), 7))


@query(
    "e20_heat_grid",
    """, p AS (SELECT station_code, date, dayofweek(CAST(date_trunc('year', date) AS DATE)) AS pad FROM hist)
    SELECT station_code, date, CAST(floor((dayofyear(date) - 1 + pad)/7e0) AS INTEGER) AS week_col, CAST(dayofweek(date) AS INTEGER) AS weekday_row FROM p""",
)
def heat_grid(spark, sf):
    return marts.calendar_grid(hist(spark, sf).select("station_code", "date"))


@query(
    "e21_date_series",
    f"""SELECT station_code, id, {AS_OF} - CAST(row_number() OVER (PARTITION BY station_code ORDER BY date DESC) AS INTEGER) + 1 AS date FROM readings""",
)
def date_series(spark, sf):
    undated = A.readings(spark, sf).select("station_code", "id", F.col("date").alias("position"))
    return series.date_series(undated, "position", A.AS_OF).select("station_code", "id", "date")
