"""Projections, filters and scalar functions (survey section B)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.constants import PARAMETERS
from hydrolake.functions import calendar as cal
from hydrolake.functions import rivers, wqi
from hydrolake.operators import alerts, cleaning, history, marts
from hydrolake.operators.grouped_quantiles import grouped_quantiles
from hydrolake.sources.shared import materialize
from workload.registry import AS_OF, END, ORD, WQI_SQL, band, query, rounded, si


@query(
    "b01_coerce_numeric",
    """SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k
       FROM events""",
)
def coerce_numeric(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 10 == 0, "n/a").when(F.col("event_id") % 10 == 1, "NaN").otherwise(k)
    rows = A.table(spark, sf, "events").select("event_id", text.alias("k"))
    return cleaning.coerce_numeric(rows, ["k"])


@query(
    "b02_parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""",
)
def parse_date(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(d, "yyyy/MM/dd"))
        .when(k == 3, F.date_format(d, "MM/dd/yyyy"))
        .otherwise("not a date")
    )
    return A.table(spark, sf, "orders").select("o_orderkey", cal.parse_date(text).alias("date"))


@query(
    "b03_drop_all_null",
    f"""SELECT station_code, date, count(*) AS n FROM holed WHERE NOT (cod IS NULL AND tss IS NULL) GROUP BY ALL""",
)
def drop_all_null(spark, sf):
    kept = cleaning.drop_all_null(A.measurements(spark, sf, with_nulls=True), ["cod", "tss"])
    return kept.groupBy("station_code", "date").agg(F.count("*").alias("n"))


DEDUP_COLUMNS = ["station_code", "date", *PARAMETERS]


@query("b04_dedup_first", "SELECT station_code, date, do_, bod, round(cod, 6) AS cod, an, tss, ph FROM deduped")
def dedup_first(spark, sf):
    rows = cleaning.dedup_first(A.measurements(spark, sf)).select(*DEDUP_COLUMNS)
    return rows.withColumn("cod", F.round("cod", 6))


@query(
    "b04_dedup_whole_row",
    "SELECT DISTINCT station_code, date, CAST(tss AS BIGINT) AS tss FROM measurements",
)
def dedup_whole_row(spark, sf):
    rows = A.measurements(spark, sf).select("station_code", "date", F.col("tss").cast("long").alias("tss"), "_ord")
    return cleaning.dedup_first(rows, keys=None).drop("_ord")


@query("b05_impute_median", "SELECT station_code, date, round(cod, 6) AS cod, tss FROM imputed")
def impute_median(spark, sf):
    rows = materialize(cleaning.dedup_first(A.measurements(spark, sf, with_nulls=True)), "first")
    return rounded(cleaning.impute(rows, "median").select("station_code", "date", "cod", "tss"))


@query(
    "b05_impute_mean",
    """SELECT station_code, date, round(coalesce(cod, (SELECT avg(cod) FROM holed_first)), 6) AS cod,
       round(coalesce(tss, (SELECT avg(tss) FROM holed_first)), 6) AS tss FROM holed_first""",
)
def impute_mean(spark, sf):
    rows = materialize(cleaning.dedup_first(A.measurements(spark, sf, with_nulls=True)), "first")
    return rounded(cleaning.impute(rows, "mean").select("station_code", "date", "cod", "tss"))


@query(
    "b05_impute_median_by_group",
    f"""SELECT {ORD}, round(coalesce(cod, median(cod) OVER g), 6) AS cod, round(coalesce(tss, median(tss) OVER g), 6) AS tss
    FROM holed WINDOW g AS (PARTITION BY l_orderkey)""",
)
def impute_median_by_group(spark, sf):
    """One group per order: thousands of groups of a few rows."""
    rows = A.measurements(spark, sf, with_nulls=True).withColumn("sheet", F.col("_ord.l_orderkey"))
    return rounded(cleaning.impute_by_group(rows, ["sheet"], "median", ["cod", "tss"]).select("_ord.*", "cod", "tss"))


@query(
    "b05_group_quantiles",
    """SELECT station_code, year(date) AS year, round(quantile_cont(do_, 0.9), 6) AS do_, round(quantile_cont(cod, 0.9), 6) AS cod, round(quantile_cont(tss, 0.9), 6) AS tss
    FROM holed GROUP BY ALL""",
)
def group_quantiles(spark, sf):
    """A few groups, most of them too large for one buffer of the given size."""
    rows = A.measurements(spark, sf, with_nulls=True).withColumn("year", F.year("date"))
    return rounded(grouped_quantiles(rows, ["station_code", "year"], ["do_", "cod", "tss"], 0.9, single_task_rows=50))


@query(
    "b05_impute_drop",
    "SELECT station_code, count(*) AS n FROM holed WHERE cod IS NOT NULL AND tss IS NOT NULL GROUP BY 1",
)
def impute_drop(spark, sf):
    kept = cleaning.impute(A.measurements(spark, sf, with_nulls=True), "drop")
    return kept.groupBy("station_code").agg(F.count("*").alias("n"))


def _sub_index(name: str, p: str):
    @query(name, f"SELECT {ORD}, round({si(p, p)}, 6) AS sub_index FROM holed")
    def run(spark, sf):
        rows = A.measurements(spark, sf, with_nulls=True)
        return rows.select("_ord.*", F.round(wqi.SUB_INDEX[p](p), 6).alias("sub_index"))

    return run


for _name, _p in (
    ("b06_sub_index_do", "do_"),
    ("b07_sub_index_bod", "bod"),
    ("b08_sub_index_cod", "cod"),
    ("b09_sub_index_an", "an"),
    ("b10_sub_index_tss", "tss"),
    ("b11_sub_index_ph", "ph"),
):
    _sub_index(_name, _p)


@query("b12_weighted_index", f"SELECT {ORD}, round({WQI_SQL}, 6) AS wqi, {band(WQI_SQL)} AS river_status FROM holed")
def weighted_index(spark, sf):
    rows = wqi.add_wqi(A.measurements(spark, sf, with_nulls=True))
    return rounded(rows.select("_ord.*", "wqi", "river_status"))


def _with_existing(spark, sf):
    """Some rows carry their own index; some carry no parameters at all."""
    rows = A.measurements(spark, sf)
    bare = F.col("_ord.l_linenumber") == 6
    rows = rows.withColumns({p: F.when(~bare, F.col(p)) for p in PARAMETERS})
    own = F.when(F.col("_ord.l_linenumber") % 2 == 0, (F.col("_ord.l_partkey") % 130).cast("double"))
    return rows.withColumn("wqi", own)


_BARE = (
    "SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN l_linenumber = 6 THEN NULL ELSE {p} END AS {p}" for p in PARAMETERS)
    + "), CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey % 130 AS DOUBLE) END AS own FROM measurements"
)


@query(
    "b13_prefer_existing_index",
    f""", bare AS ({_BARE}), w AS (SELECT *, coalesce(own, {WQI_SQL}) AS wqi FROM bare)
    SELECT {ORD}, round(wqi, 6) AS wqi, {band('wqi')} AS river_status FROM w""",
)
def prefer_existing(spark, sf):
    return rounded(wqi.add_wqi(_with_existing(spark, sf), "existing").select("_ord.*", "wqi", "river_status"))


@query(
    "b13_prefer_computed_index",
    f""", bare AS ({_BARE}), w AS (SELECT *, CASE WHEN l_linenumber = 6 THEN coalesce(own, 0e0) ELSE {WQI_SQL} END AS wqi FROM bare)
    SELECT {ORD}, round(wqi, 6) AS wqi, {band('wqi')} AS river_status FROM w""",
)
def prefer_computed(spark, sf):
    return rounded(wqi.add_wqi(_with_existing(spark, sf), "computed").select("_ord.*", "wqi", "river_status"))


@query(
    "b14_status_and_label",
    f"""SELECT l_orderkey, l_linenumber, {band('x')} AS status, {band('x', "'polluted'")} AS strict_status,
        CASE WHEN x IS NULL THEN 'Unknown' WHEN x >= 81 THEN 'Clean' WHEN x >= 60 THEN 'Slightly Polluted' ELSE 'Polluted' END AS label
        FROM (SELECT *, CASE WHEN l_linenumber < 7 THEN CAST(l_partkey % 101 AS DOUBLE) END AS x FROM lineitem)""",
)
def status_and_label(spark, sf):
    x = F.when(F.col("l_linenumber") < 7, (F.col("l_partkey") % 101).cast("double"))
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        wqi.status(x).alias("status"),
        wqi.status(x, null_as="polluted").alias("strict_status"),
        wqi.status_label(wqi.status(x)).alias("label"),
    )


_FREE_TEXT = "CASE l_linenumber WHEN 1 THEN ' Clean ' WHEN 2 THEN 'Slightly Polluted' WHEN 3 THEN 'MODERATE' WHEN 4 THEN 'polluted!' WHEN 5 THEN '' WHEN 6 THEN 'n/a' END"


@query(
    "b15_status_text",
    f""", t AS (SELECT l_returnflag, l_linenumber, {_FREE_TEXT} AS raw FROM lineitem)
    SELECT l_returnflag, raw, CASE WHEN lower(raw) LIKE '%clean%' THEN 'clean'
      WHEN lower(raw) LIKE '%slight%' OR lower(raw) LIKE '%moderate%' THEN 'slightly_polluted'
      WHEN lower(raw) LIKE '%pollut%' THEN 'polluted' END AS status,
      replace(lower(trim(raw)), ' ', '_') AS filter_key, count(*) AS n FROM t GROUP BY ALL""",
)
def status_text(spark, sf):
    rows = A.table(spark, sf, "lineitem").select("l_returnflag", F.expr(_FREE_TEXT).alias("raw"))
    return rows.groupBy(
        "l_returnflag", "raw", wqi.normalize_status_text("raw").alias("status"), wqi.status_key("raw").alias("filter_key")
    ).agg(F.count("*").alias("n"))


@query(
    "b16_index_proxies",
    f"""SELECT {ORD}, round(({' + '.join(f'greatest(0e0, least(100e0, 100e0 - coalesce({p}, 0e0)*5e0))' for p in PARAMETERS)})/6e0, 6) AS mean_penalty,
        CASE WHEN cod IS NULL THEN 50e0 ELSE greatest(0e0, least(100e0, round(100e0 - (bod*3e0 + cod/12e0 + tss/4e0 + an*8e0) + (do_-5e0)*2e0 + (ph-6e0)*5e0, 1))) END AS linear FROM holed""",
)
def index_proxies(spark, sf):
    rows = A.measurements(spark, sf, with_nulls=True)
    return rows.select(
        "_ord.*",
        F.round(wqi.wqi_proxy(rows, "mean_penalty"), 6).alias("mean_penalty"),
        wqi.wqi_proxy(rows, "linear").alias("linear"),
    )


# Suppliers stand in for stations with messy codes and names.
_MESSY_SQL = """, messy AS (SELECT s_suppkey,
    CASE s_suppkey % 4 WHEN 0 THEN ' s0' || CAST(1 + s_suppkey % 9 AS VARCHAR) || ' ' WHEN 1 THEN 'X' || CAST(s_suppkey % 5 AS VARCHAR) WHEN 2 THEN '' END AS code,
    CASE s_suppkey % 3 WHEN 0 THEN (SELECT river_name FROM stations st WHERE st.station_code = 'S0' || CAST(1 + s_suppkey % 7 AS VARCHAR))
      WHEN 1 THEN 'Kampung' END AS name,
    CASE s_suppkey % 5 WHEN 0 THEN 'penang' WHEN 1 THEN 'SUNGAI MUAR' WHEN 2 THEN 'JOHOR' WHEN 3 THEN '' END AS basin,
    CASE WHEN s_suppkey % 7 = 0 THEN ' Sungai Explicit ' END AS explicit FROM supplier),
  m2 AS (SELECT m.*, upper(trim(coalesce(code, ''))) AS norm, trim(coalesce(name, '')) AS label,
      trim(coalesce(nullif(name, ''), code, '')) AS any_label FROM messy m),
  m3 AS (SELECT m2.*, byc.river_name AS code_river, byn.station_code AS name_code FROM m2
      LEFT JOIN stations byc ON byc.station_code = norm LEFT JOIN stations byn ON byn.river_name = any_label),
  m4 AS (SELECT *, CASE WHEN code_river IS NOT NULL THEN code_river WHEN label LIKE 'Sungai %' THEN label
      WHEN label <> '' AND norm <> '' THEN label || ' (' || norm || ')' WHEN label = '' THEN 'Unknown River' ELSE label END AS river FROM m3)
"""


def _messy(spark, sf):
    k = F.col("s_suppkey")
    code = (
        F.when(k % 4 == 0, F.concat(F.lit(" s0"), (1 + k % 9).cast("string"), F.lit(" ")))
        .when(k % 4 == 1, F.concat(F.lit("X"), (k % 5).cast("string")))
        .when(k % 4 == 2, "")
    )
    named = rivers.river_of_station(F.concat(F.lit("S0"), (1 + k % 7).cast("string")))
    return A.table(spark, sf, "supplier").select(
        "s_suppkey",
        code.alias("code"),
        F.when(k % 3 == 0, named).when(k % 3 == 1, "Kampung").alias("name"),
        F.when(k % 5 == 0, "penang").when(k % 5 == 1, "SUNGAI MUAR").when(k % 5 == 2, "JOHOR").when(k % 5 == 3, "").alias("basin"),
        F.when(k % 7 == 0, " Sungai Explicit ").alias("explicit"),
    )


@query(
    "b17_canonical_code",
    _MESSY_SQL
    + """SELECT s_suppkey, CASE WHEN code_river IS NOT NULL THEN norm WHEN any_label = '' THEN '' WHEN name_code IS NOT NULL THEN name_code
        WHEN norm <> '' THEN norm ELSE any_label END AS station_code FROM m4""",
)
def canonical_code(spark, sf):
    return _messy(spark, sf).select("s_suppkey", rivers.canonical_code("code", "name").alias("station_code"))


@query(
    "b18_river_name",
    _MESSY_SQL
    + """SELECT s_suppkey, river AS station_river, CASE WHEN explicit IS NOT NULL THEN trim(explicit)
        WHEN basin = 'penang' THEN 'Sungai Pinang' WHEN basin = 'SUNGAI MUAR' THEN 'Sungai Muar' WHEN basin = 'JOHOR' THEN 'Sungai Johor'
        ELSE river END AS river_name FROM m4""",
)
def river_name(spark, sf):
    return _messy(spark, sf).select(
        "s_suppkey",
        rivers.river_of_station("code", "name").alias("station_river"),
        rivers.river_name("code", "name", "basin", "explicit").alias("river_name"),
    )


@query(
    "b19_matches_river",
    _MESSY_SQL
    + """SELECT s_suppkey, coalesce(trim(explicit), '') = 'Sungai Klang' OR river = 'Sungai Klang' OR label = 'Sungai Klang' OR norm = 'Sungai Klang' AS matches
        FROM m4""",
)
def matches_river(spark, sf):
    return _messy(spark, sf).select("s_suppkey", rivers.matches_river("Sungai Klang", "code", "name", "explicit").alias("matches"))


@query(
    "b20_is_canonical",
    _MESSY_SQL
    + """SELECT s_suppkey FROM m4 WHERE code_river IS NOT NULL OR trim(coalesce(explicit, '')) IN (SELECT river_name FROM stations)
        OR label IN (SELECT river_name FROM stations) OR river IN (SELECT river_name FROM stations)""",
)
def is_canonical(spark, sf):
    return _messy(spark, sf).filter(rivers.is_canonical("code", "name", "explicit")).select("s_suppkey")


@query(
    "b21_filter_readings",
    """SELECT id, station_code, date, round(wqi, 6) AS wqi FROM hist WHERE river_name = 'Sungai Klang' AND date BETWEEN DATE '1999-02-01' AND DATE '1999-11-30'
       AND river_status = 'slightly_polluted'""",
)
def filter_readings(spark, sf):
    out = history.filter_readings(
        hist(spark, sf), river="Sungai Klang", year=1999, status_is="Slightly Polluted",
        date_from=date(1999, 2, 1), date_to=date(1999, 11, 30),
    )
    return rounded(out.select("id", "station_code", "date", "wqi"))


@query("b21_stations_by_status", "SELECT station_code FROM latest WHERE wqi >= 60 AND wqi < 81")
def stations_by_status(spark, sf):
    latest = history.latest_per_station(hist(spark, sf))
    return history.stations_by_status(latest, "Slightly Polluted").select("station_code")


@query(
    "b22_filter_forecast",
    f"""SELECT id, station_code, date, round(wqi, 6) AS wqi FROM points WHERE date > {AS_OF} AND date <= {END} AND station_code = 'S03'
        AND date BETWEEN DATE '2001-01-01' AND DATE '2001-09-30' AND river_status = 'polluted'""",
)
def filter_forecast(spark, sf):
    out = history.filter_forecast(
        A.forecast_points(spark, sf), A.AS_OF, A.END, station="s03", river="Sungai Pinang", year_from=2001, year_to=2001,
        status_is="polluted", date_to=date(2001, 9, 30),
    )
    return rounded(out.select("id", "station_code", "date", "wqi"))


@query(
    "b23_forecast_envelope",
    """SELECT id, date, round(greatest(0e0, wqi - least(12e0, greatest(3e0, 0.08e0*greatest(wqi, 1e0)))), 2) AS wqi_lower,
       round(least(100e0, wqi + least(12e0, greatest(3e0, 0.08e0*greatest(wqi, 1e0)))), 2) AS wqi_upper FROM points""",
)
def forecast_envelope(spark, sf):
    return wqi.with_envelope(A.forecast_points(spark, sf)).select("id", "date", "wqi_lower", "wqi_upper")


@query(
    "b24_monsoon_flags",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (10,11,12,1,2,3) THEN 1e0 ELSE 0e0 END AS monsoon_ne,
       CASE WHEN month(o_orderdate) BETWEEN 5 AND 9 THEN 1e0 ELSE 0e0 END AS monsoon_sw,
       CASE WHEN month(o_orderdate) = 4 THEN 1e0 ELSE 0e0 END AS monsoon_other FROM orders""",
)
def monsoon_flags(spark, sf):
    rows = A.table(spark, sf, "orders").withColumns(cal.monsoon_flags("o_orderdate"))
    return rows.select("o_orderkey", "monsoon_ne", "monsoon_sw", "monsoon_other")


@query(
    "b25_month_cyclical",
    """SELECT o_orderkey, round(sin(2*pi()*(month(o_orderdate)-1)/12e0), 6) + 0e0 AS month_sin,
       round(cos(2*pi()*(month(o_orderdate)-1)/12e0), 6) + 0e0 AS month_cos FROM orders""",
)
def month_cyclical(spark, sf):
    rows = A.table(spark, sf, "orders").withColumns(cal.month_cyclical("o_orderdate"))
    return rounded(rows.select("o_orderkey", "month_sin", "month_cos"))


@query(
    "b26_seasonal_delta",
    "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (1,2,3,10,11,12) THEN -0.5e0 ELSE 0.3e0 END AS delta FROM orders",
)
def seasonal_delta(spark, sf):
    return A.table(spark, sf, "orders").select("o_orderkey", cal.seasonal_delta("o_orderdate").alias("delta"))


_STRESS = {
    "do_": "100e0*greatest(0e0, 7e0 - do_)/7e0", "bod": "bod*5e0", "cod": "cod*2e0", "an": "an*50e0", "tss": "tss/2e0",
    "ph": "abs(ph - 7e0)*20e0",
}
STRESS_SQL = {p: f"CASE WHEN {p} IS NOT NULL THEN greatest(0e0, least(100e0, {x})) END" for p, x in _STRESS.items()}


@query(
    "b27_stress_scores",
    f"SELECT {ORD}, " + ", ".join(f"round({x}, 6) AS stress_{p}" for p, x in STRESS_SQL.items()) + " FROM holed",
)
def stress_scores(spark, sf):
    rows = wqi.stress_scores(A.measurements(spark, sf, with_nulls=True))
    return rounded(rows.select("_ord.*", *[f"stress_{p}" for p in PARAMETERS]))


@query(
    "b28_station_coordinates",
    """, c AS (SELECT DISTINCT 'S' || lpad(CAST(1 + s_suppkey % 40 AS VARCHAR), 2, '0') AS station_code FROM supplier),
    o AS (SELECT station_code, CAST(('0x' || substr(md5(station_code), 1, 6)) AS BIGINT) % 7 AS slot FROM c)
    SELECT o.station_code, round(coalesce(s.latitude, 5.364e0 + [0e0, 0.02e0, -0.02e0, 0.01e0, -0.01e0, 0.03e0, -0.03e0][slot + 1]), 6) AS latitude,
      round(coalesce(s.longitude, 100.562e0 + [0e0, 0.01e0, 0.01e0, -0.02e0, -0.02e0, 0e0, 0e0][slot + 1]), 6) AS longitude
    FROM o LEFT JOIN stations s USING (station_code)""",
)
def station_coordinates(spark, sf):
    code = F.concat(F.lit("S"), F.lpad((1 + F.col("s_suppkey") % 40).cast("string"), 2, "0"))
    rows = A.table(spark, sf, "supplier").select(code.alias("station_code")).distinct()
    return rounded(marts.with_coordinates(rows).select("station_code", "latitude", "longitude"))


@query(
    "b29_points_as_readings",
    "SELECT id, station_code, river_name, date, round(wqi, 6) AS wqi, river_status, 'predicted_historical' AS data_type, TRUE AS is_predicted FROM points",
)
def points_as_readings(spark, sf):
    return rounded(history.as_reading(A.forecast_points(spark, sf)).drop("station_name"))


@query(
    "b30_range_label",
    "SELECT station_code, strftime(min(date), '%b %Y') || '–' || strftime(max(date), '%b %Y') AS label FROM readings GROUP BY 1",
)
def range_label(spark, sf):
    return A.readings(spark, sf).groupBy("station_code").agg(cal.range_label(F.min("date"), F.max("date")).alias("label"))


@query(
    "b31_to_readings",
    _MESSY_SQL
    + f""", r AS (SELECT s_suppkey, coalesce(nullif(trim(code), ''), nullif(trim(name), ''), 'S01') AS station_code,
        coalesce(nullif(trim(name), ''), code_river, nullif(trim(code), ''), 'Unknown') AS station_name,
        coalesce(s_acctbal/100e0, 0e0) AS wqi FROM m4 JOIN supplier USING (s_suppkey)),
      r2 AS (SELECT r.*, st.river_name AS byc FROM r LEFT JOIN stations st ON st.station_code = upper(r.station_code))
      SELECT DATE '2000-01-01' + CAST(s_suppkey AS INTEGER) AS date, station_code, station_name,
        CASE WHEN byc IS NOT NULL THEN byc WHEN station_name LIKE 'Sungai %' THEN station_name ELSE station_name || ' (' || upper(station_code) || ')' END AS river_name,
        round(wqi, 6) AS wqi, {band('wqi')} AS river_status FROM r2""",
)
def to_readings(spark, sf):
    extra = A.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100.0).alias("wqi"))
    rows = _messy(spark, sf).join(extra, "s_suppkey").select(
        F.col("code").alias("station_code"),
        F.col("name").alias("station_name"),
        F.date_add(F.lit(date(2000, 1, 1)), F.col("s_suppkey").cast("int")).alias("date"),
        "wqi",
    )
    return rounded(history.to_readings(rows))


@query(
    "b32_alert_messages",
    f"""SELECT id, CASE river_status WHEN 'slightly_polluted' THEN 'Monitor closely' WHEN 'polluted' THEN 'Immediate attention required' ELSE '' END AS advice,
        CASE WHEN river_status = 'slightly_polluted' THEN 'warning' ELSE 'critical' END AS severity,
        CASE river_status WHEN 'clean' THEN 'low' WHEN 'polluted' THEN 'critical' ELSE 'medium' END AS log_band,
        station_name || ' water quality is ' || CASE river_status WHEN 'slightly_polluted' THEN 'Slightly Polluted' WHEN 'polluted' THEN 'Polluted' ELSE 'Clean' END
          || ' (WQI: ' || printf('%.1f', wqi) || ') on ' || CAST(date AS VARCHAR) || '.' AS message
        FROM readings""",
)
def alert_messages(spark, sf):
    band_col = F.col("river_status")
    raw = F.when(band_col == "clean", "info").otherwise("")
    return A.readings(spark, sf).select(
        "id",
        alerts.advice(band_col).alias("advice"),
        alerts.severity_of(band_col).alias("severity"),
        alerts.normalize_severity(raw, band_col).alias("log_band"),
        alerts.reading_alert_message().alias("message"),
    )


@query("b33_harmonize_names", "SELECT id, date, round(wqi, 6) AS wqi, river_status FROM readings")
def harmonize_names(spark, sf):
    served = A.readings(spark, sf).select(
        "id", F.col("date").alias("reading_date"), F.col("wqi").alias("WQI"), F.col("river_status").alias("pollution_status")
    )
    return rounded(cleaning.harmonize(served))


@query("m01_sql_functions", "SELECT id, " + band("wqi") + " AS river_status FROM readings")
def sql_functions(spark, sf):
    wqi.register_sql_functions(spark)
    return A.readings(spark, sf).select("id", F.expr("wqi_status(wqi)").alias("river_status"))


def hist(spark, sf):
    """The historical slice every dashboard query starts from."""
    return history.historical_slice(A.readings(spark, sf), A.forecast_points(spark, sf), A.AS_OF)
