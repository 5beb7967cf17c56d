"""Sources, sinks and stored tables (survey section A)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.constants import PARAMETERS
from hydrolake.functions.rivers import river_of_station
from hydrolake.operators import cleaning, history, marts, metrics, splits
from hydrolake.operators.scaling import LinearScaler, fit_minmax
from hydrolake.sources import metadata, monitoring, sheets, sinks
from hydrolake.sources.generations import GenerationTable
from hydrolake.sources.shared import new_path
from workload.expressions import hist
from workload.registry import AS_OF, END, ORD, WQI_SQL, band, query, rounded

CSV_COLUMNS = ["date", "station_code", *PARAMETERS]
MESSY_HEADERS = {
    "date": "SMP-DAT",
    "station_code": "ID STN BARU",
    "do_": "DO mg/l",
    "bod": "BOD\nmg/l",
    "cod": "COD mg/l",
    "an": "NH3-N mg/l",
    "tss": "SS mg/l",
    "ph": "pH",
}


def _write_csv(df, name):
    path = new_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@query(
    "a01_read_csv",
    "SELECT date, station_code, do_, bod, round(cod, 6) AS cod, an, tss, ph FROM measurements",
)
def read_csv(spark, sf):
    path = _write_csv(A.measurements(spark, sf).select(*CSV_COLUMNS), "sheet")
    sheet = cleaning.coerce_numeric(monitoring.load_sheet(spark, path))
    return sheet.select("date", "station_code", "do_", "bod", F.round("cod", 6).alias("cod"), "an", "tss", "ph")


@query(
    "a02_union_of_sources",
    """SELECT station_code, count(*) AS n, count(CASE WHEN l_linenumber > 3 THEN cod END) AS n_cod, round(sum(tss), 4) AS sum_tss
       FROM measurements GROUP BY 1""",
)
def union_of_sources(spark, sf):
    rows = A.measurements(spark, sf)
    early = rows.filter("_ord.l_linenumber <= 3").select("date", "station_code", F.col("tss").alias("SS"))
    late = rows.filter("_ord.l_linenumber > 3").select(*CSV_COLUMNS)
    both = sheets.read_many(spark, [_write_csv(early, "early"), _write_csv(late, "late")])
    both = cleaning.coerce_numeric(both)
    return rounded(
        both.groupBy("station_code").agg(
            F.count("*").alias("n"), F.count("cod").alias("n_cod"), F.sum("tss").alias("sum_tss")
        ),
        4,
    )


@query(
    "a02_first_listed_source_wins",
    f"""SELECT station_code, count(*) AS n, CAST(sum(round(cod * 10000)) AS BIGINT) AS sum_cod FROM (SELECT station_code, date, CASE WHEN late > 0 THEN late_cod ELSE early_cod END AS cod FROM
      (SELECT station_code, date, count(*) FILTER (l_linenumber > 3) AS late, arg_min(cod, ({ORD})) FILTER (l_linenumber > 3) AS late_cod,
        arg_min(cod, ({ORD})) FILTER (l_linenumber <= 3) AS early_cod FROM measurements GROUP BY ALL)) GROUP BY 1""",
)
def first_listed_source_wins(spark, sf):
    # Listed against the order of their paths; each holds one row per station and day.
    rows = A.measurements(spark, sf)
    late, early = (cleaning.dedup_first(rows.filter(c)) for c in ("_ord.l_linenumber > 3", "_ord.l_linenumber <= 3"))
    sources = [_write_csv(late.select(*CSV_COLUMNS), "z-late"), _write_csv(early.select(*CSV_COLUMNS), "a-early")]
    both = cleaning.dedup_first(cleaning.coerce_numeric(sheets.read_many(spark, sources)))
    # Summed as whole numbers: a sum of doubles may round either way.
    return both.groupBy("station_code").agg(F.count("*").alias("n"), F.sum(F.round(F.col("cod") * 10000).cast("long")).alias("sum_cod"))


@query(
    "a03_one_file_per_river",
    """SELECT river_name AS stem, count(*) AS row_count FROM readings GROUP BY 1""",
)
def one_file_per_river(spark, sf):
    # The same rivers in two folders: the larger copy of each sheet must be kept.
    rows = A.readings(spark, sf).select("date", "station_code", "wqi", "river_name")
    root = new_path(spark, "rivers")
    sinks.write_by_river(rows.filter(F.col("date") <= F.lit(date(1996, 12, 31))), f"{root}/early")
    sinks.write_by_river(rows, f"{root}/full")
    chosen = monitoring.catalog_one_per_river(spark, root)
    return chosen.join(monitoring.file_row_counts(spark, root), "file_path").select("stem", "row_count")


@query("a04_normalize_headers", f"SELECT date, station_code, do_, bod, round(cod, 6) AS cod, an, tss, ph, {ORD} FROM measurements")
def normalize_headers(spark, sf):
    rows = A.measurements(spark, sf)
    messy = rows.select(
        *[F.col(c).alias(MESSY_HEADERS[c]) for c in CSV_COLUMNS], F.lit(1.0).alias("BOD INDEX"), F.col("tss").alias("TSS"), "_ord"
    )
    out = monitoring.normalize_columns(messy)
    return out.select(
        F.col("SMP-DAT").alias("date"), F.col("ID STN BARU").alias("station_code"), "do_", "bod",
        F.round("cod", 6).alias("cod"), "an", "tss", "ph", "_ord.*",
    )


@query(
    "a05_resolve_columns",
    """SELECT date, station_code, 'Loc ' || station_code AS station_name,
       CASE l_partkey % 3 WHEN 0 THEN 'Sungai Muda' WHEN 1 THEN 'Sungai Pinang' ELSE s.river_name END AS river_name,
       count(*) AS n FROM measurements JOIN stations s USING (station_code) GROUP BY ALL""",
)
def resolve_columns(spark, sf):
    basin = F.col("_ord.l_partkey") % 3
    sheet = A.measurements(spark, sf).select(
        F.date_format("date", "yyyy-MM-dd").alias("SMP-DAT"),
        F.concat(F.lit(" "), "station_code").alias("id stn baru"),
        F.concat(F.lit("Loc "), "station_code").alias("LOCATION"),
        F.when(basin == 0, "muda").when(basin == 1, "PENANG").otherwise("").alias("Sungai"),
    )
    out = monitoring.resolve_columns(monitoring.normalize_columns(sheet))
    return out.groupBy("date", "station_code", "station_name", "river_name").agg(F.count("*").alias("n"))


@query(
    "a06_missing_columns",
    "SELECT 'tss' AS missing, count(*) AS n_rows FROM measurements",
)
def missing_columns(spark, sf):
    sheet = A.measurements(spark, sf).drop("tss")
    return sheet.agg(F.count("*").alias("n_rows")).withColumn(
        "missing", F.lit(",".join(cleaning.missing_columns(sheet)))
    )


@query(
    "a07_quality_gate",
    "SELECT TRUE AS has_date, TRUE AS has_name, count(*) > 0 AS quality_ok FROM readings",
)
def quality_gate(spark, sf):
    return cleaning.quality_gate(A.readings(spark, sf))


@query(
    "a08_numeric_names",
    """SELECT 'customer' AS source, bool_and(regexp_full_match(c_name, '[0-9]+')) AS all_numeric_names FROM customer
       UNION ALL SELECT 'keys', bool_and(regexp_full_match(CAST(c_custkey AS VARCHAR), '[0-9]+')) FROM customer""",
)
def numeric_names(spark, sf):
    customers = A.table(spark, sf, "customer")
    named = customers.select(F.col("c_name").alias("station_name"))
    keyed = customers.select(F.col("c_custkey").cast("string").alias("station_name"))
    return (
        cleaning.numeric_name_check(named).withColumn("source", F.lit("customer"))
        .unionByName(cleaning.numeric_name_check(keyed).withColumn("source", F.lit("keys")))
    )


@query(
    "a09_dataset_catalog",
    """SELECT 'registered' AS origin, 1 AS n_datasets, CAST(count(*) AS BIGINT) AS total_rows FROM lineitem
       UNION ALL SELECT 'folder', 7, count(*) FROM readings""",
)
def dataset_catalog(spark, sf):
    root = new_path(spark, "uploads")
    sinks.write_by_river(A.readings(spark, sf).select("date", "station_code", "wqi", "river_name"), root)
    registry = A.table(spark, sf, "lineitem").agg(F.count("*").alias("row_count")).select(
        F.lit("base.csv").alias("name"), F.lit("registry").alias("file_path"), F.lit(0).cast("long").alias("file_size_bytes"),
        "row_count", F.lit("All").alias("river_name"), F.lit(1).alias("dataset_id"),
    )
    listed = monitoring.dataset_catalog(spark, root, registry)
    origin = F.when(F.col("dataset_id").isNotNull(), "registered").otherwise("folder")
    return listed.groupBy(origin.alias("origin")).agg(
        F.count("*").cast("int").alias("n_datasets"), F.sum("row_count").alias("total_rows")
    )


@query("a10_write_by_river", "SELECT river_name, count(*) AS n, round(sum(wqi), 4) AS sum_wqi FROM readings GROUP BY 1")
def write_by_river(spark, sf):
    path = new_path(spark, "by_river")
    sinks.write_by_river(A.readings(spark, sf).select("river_name", "station_code", "date", "wqi"), path)
    back = spark.read.schema("station_code string, date date, wqi double, river_name string").csv(path, header=True)
    return rounded(back.groupBy("river_name").agg(F.count("*").alias("n"), F.sum("wqi").alias("sum_wqi")), 4)


@query(
    "a11_export_csv",
    """SELECT river_name AS river, CASE river_status WHEN 'clean' THEN 'Clean' WHEN 'polluted' THEN 'Polluted' ELSE 'Slightly Polluted' END AS status,
       count(*) AS n FROM hist WHERE date >= DATE '1999-01-01' GROUP BY ALL""",
)
def export_csv(spark, sf):
    path = new_path(spark, "export")
    sinks.export_csv(history.filter_readings(hist(spark, sf), date_from=date(1999, 1, 1)), path)
    back = spark.read.csv(path, header=True)
    return back.groupBy(F.col("River").alias("river"), F.col("River Status").alias("status")).agg(F.count("*").alias("n"))


@query(
    "a12_training_set",
    """, n AS (SELECT count(*) AS n FROM daily)
    SELECT 'train' AS part, n - greatest(1, CAST(floor(n*0.2e0) AS BIGINT)) AS n FROM n
    UNION ALL SELECT 'test', greatest(1, CAST(floor(n*0.2e0) AS BIGINT)) FROM n UNION ALL SELECT 'full', n FROM n UNION ALL SELECT 'scaler', 7 FROM n""",
)
def training_set(spark, sf):
    path = new_path(spark, "training")
    rows = splits.chronological_split(A.daily_measurements(spark, sf).drop("_ord"))
    scaler = fit_minmax(rows, [*PARAMETERS, "wqi"])
    sinks.write_training_set(scaler.transform(rows), scaler, path)
    parts = [
        spark.read.parquet(f"{path}/{p}").agg(F.count("*").alias("n")).withColumn("part", F.lit(p))
        for p in ("train", "test", "full", "scaler")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    assert LinearScaler.from_rows(spark.read.parquet(f"{path}/scaler")) == scaler
    return out


def _stored(spark, sf):
    """Early line numbers are the stored table, the rest arrive as updates."""
    rows = A.measurements(spark, sf)
    stored = cleaning.dedup_newest(rows.filter("_ord.l_linenumber <= 4"))
    updates = rows.filter("_ord.l_linenumber > 4")
    updates = updates.withColumn("station_code", F.when(F.col("_ord.l_partkey") % 50 == 0, " ").otherwise(F.col("station_code")))
    return stored, updates


_UPSERT_SQL = f""", side AS (
    SELECT *, 0 AS side FROM measurements WHERE l_linenumber <= 4
    UNION ALL SELECT *, 1 FROM measurements WHERE l_linenumber > 4 AND l_partkey % 50 <> 0),
  merged AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, date
    ORDER BY side DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS rn FROM side) WHERE rn = 1)
"""


@query("a13_upsert", _UPSERT_SQL + "SELECT station_code, date, do_, bod, round(cod, 6) AS cod, an, tss, ph FROM merged")
def upsert(spark, sf):
    merged = history.upsert(*_stored(spark, sf)).select("station_code", "date", *PARAMETERS)
    return merged.withColumn("cod", F.round("cod", 6))


@query(
    "a13_upsert_table",
    _UPSERT_SQL + "SELECT year(date) AS year, station_code, count(*) AS n, round(sum(tss), 4) AS sum_tss FROM merged GROUP BY ALL",
)
def upsert_table(spark, sf):
    path = new_path(spark, "records")
    stored, updates = _stored(spark, sf)
    sinks.upsert_table(stored, path)
    sinks.upsert_table(updates, path)
    sinks.upsert_table(updates, path)  # a replay must change nothing
    back = spark.read.parquet(path)
    return rounded(back.groupBy("year", "station_code").agg(F.count("*").alias("n"), F.sum("tss").alias("sum_tss")), 4)


@query("a13_upsert_generations", _UPSERT_SQL + "SELECT station_code, date, do_, bod, round(cod, 6) AS cod, an, tss, ph FROM merged")
def upsert_generations(spark, sf):
    table = GenerationTable(new_path(spark, "records"), period="yyyy")
    stored, updates = _stored(spark, sf)
    table.append(stored, 0)
    early = F.col("date") <= F.lit(date(1996, 12, 31))
    table.append(updates.filter(early), 1)
    table.compact(spark)
    table.append(updates, 2)
    table.append(updates, 2)  # a replay must change nothing
    return table.read(spark).select("station_code", "date", *PARAMETERS).withColumn("cod", F.round("cod", 6))


@query("a14_replace_readings", "SELECT year(date) AS year, count(*) AS n, round(avg(wqi), 6) AS avg_wqi FROM readings GROUP BY 1")
def replace_readings(spark, sf):
    path = new_path(spark, "readings")
    sinks.replace_readings(A.readings(spark, sf), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("year").agg(F.count("*").alias("n"), F.avg("wqi").alias("avg_wqi")))


_APPEND_SQL = f""", side AS (
    SELECT *, 0 AS side FROM measurements WHERE l_linenumber <= 4
    UNION ALL SELECT *, 1 FROM measurements WHERE l_linenumber > 4 AND year(date) <= 2000),
  merged AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, date
    ORDER BY side DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS rn FROM side) WHERE rn = 1)
"""


@query("a15_append_dedup", _APPEND_SQL + "SELECT station_code, date, do_, bod, an, tss, ph FROM merged")
def append_dedup(spark, sf):
    rows = A.measurements(spark, sf).withColumn("station_name", F.lit(None).cast("string"))
    base, new = rows.filter("_ord.l_linenumber <= 4"), rows.filter("_ord.l_linenumber > 4")
    return history.append_dedup(base, new, cutoff_year=A.CUTOFF).select("station_code", "date", "do_", "bod", "an", "tss", "ph")


@query(
    "a16_append_reading",
    f""", last AS (SELECT station_code, max_by(wqi, date) AS wqi FROM readings WHERE date < {AS_OF} GROUP BY 1),
    new AS (SELECT station_code, (SELECT river_name FROM stations s WHERE s.station_code = last.station_code) AS station_name, {AS_OF} AS date, wqi,
       'simulated_live' AS source, 'simulated_live' AS data_type FROM last)
    SELECT station_code, station_name, date, round(wqi, 6) AS wqi, source, data_type FROM new
    UNION ALL SELECT station_code, station_name, date, round(wqi, 6), NULL, data_type FROM readings WHERE date <> {AS_OF}""",
)
def append_reading(spark, sf):
    base = A.readings(spark, sf)
    last = base.filter(F.col("date") < F.lit(A.AS_OF)).groupBy("station_code").agg(F.max_by("wqi", "date").alias("wqi"))
    new = last.select(
        "station_code", river_of_station("station_code").alias("station_name"), F.lit(A.AS_OF).alias("date"), "wqi"
    )
    new = history.tag_reading(new, "simulated_live")
    merged = history.append_dedup(base, new, order="id", cutoff_year=A.CUTOFF)
    return rounded(merged.select("station_code", "station_name", "date", "wqi", "source", "data_type"))


@query(
    "a17_prediction_log",
    "SELECT 'run-' || CAST(l_orderkey % 3 AS VARCHAR) AS run_id, station_code, date, round(wqi, 6) AS wqi, river_status "
    "FROM points JOIN (SELECT id, l_orderkey, station_code AS sc, date + 365 AS d FROM readings) k ON k.id = points.id AND sc = station_code AND d = date",
)
def prediction_log(spark, sf):
    points = A.forecast_points(spark, sf)
    run = F.concat(F.lit("run-"), (F.floor(F.col("id") / 8) % 3).cast("string"))
    path = new_path(spark, "log")
    history.to_log(points.withColumn("run_id", run)).write.parquet(path)
    return rounded(history.from_log(spark.read.parquet(path)).select("run_id", "station_code", "date", "wqi", "river_status"))


@query("a18_forecast_cache", "SELECT date, station_code, round(wqi, 6) AS wqi, river_status FROM points")
def forecast_cache(spark, sf):
    path = new_path(spark, "cache")
    points = A.forecast_points(spark, sf).select("date", "station_code", "station_name", "river_name", "wqi", "river_status")
    sinks.save_cache(points, path)
    return rounded(sinks.load_cache(spark, path).select("date", "station_code", "wqi", "river_status"))


_RECORDS = """, records AS (SELECT id, station_code, date, wqi, FALSE AS is_predicted FROM readings
  UNION ALL SELECT id, station_code, date, wqi, TRUE FROM points)
"""


def _records(spark, sf):
    cols = ["id", "station_code", "date", "wqi"]
    measured = A.readings(spark, sf).select(*cols, F.lit(False).alias("is_predicted"))
    return measured.unionByName(A.forecast_points(spark, sf).select(*cols, F.lit(True).alias("is_predicted")))


@query(
    "a19_scan_historical",
    _RECORDS + f"SELECT id, date, round(wqi, 6) AS wqi, is_predicted FROM records WHERE date <= {AS_OF} AND station_code = 'S02'",
)
def scan_historical(spark, sf):
    rows = history.scan_records(_records(spark, sf), "historical", A.AS_OF, station=" s02")
    return rounded(rows.select("id", "date", "wqi", "is_predicted"))


@query(
    "a19_scan_forecast",
    _RECORDS + f"SELECT id, station_code, date, round(wqi, 6) AS wqi, is_predicted FROM records WHERE date > {AS_OF} AND date <= {END}",
)
def scan_forecast(spark, sf):
    return rounded(history.scan_records(_records(spark, sf), "forecast", A.AS_OF, end=A.END))


@query(
    "a19_scan_predicted",
    _RECORDS + f"SELECT date, station_code, round(wqi, 6) AS wqi, {band('wqi')} AS river_status FROM records WHERE is_predicted AND date <= {END}",
)
def scan_predicted(spark, sf):
    rows = history.scan_records(_records(spark, sf), "predicted", A.AS_OF, end=A.END)
    unnamed = rows.withColumns({"station_name": F.lit(None).cast("string"), "river_status": F.lit(None).cast("string")})
    return rounded(history.to_forecast_points(unnamed).select("date", "station_code", "wqi", "river_status"))


@query("a20_filter_years", "SELECT id, date FROM readings WHERE year(date) BETWEEN 1997 AND 1999")
def filter_years(spark, sf):
    return history.filter_years(A.readings(spark, sf), 1997, 1999).select("id", "date")


@query(
    "a20_purge_after_cutoff",
    """, t AS (SELECT id, CASE id % 10 WHEN 0 THEN 'bad' WHEN 1 THEN NULL ELSE CAST(date AS VARCHAR) END AS date FROM readings)
    SELECT id, date FROM t WHERE try_cast(substr(date, 1, 4) AS INTEGER) IS NULL OR try_cast(substr(date, 1, 4) AS INTEGER) <= 2000""",
)
def purge_after_cutoff(spark, sf):
    text = F.when(F.col("id") % 10 == 0, "bad").when(F.col("id") % 10 != 1, F.col("date").cast("string"))
    return history.purge_after(A.readings(spark, sf).select("id", text.alias("date")), A.CUTOFF)


@query(
    "a21_remove_rows",
    """SELECT 'dataset 3' AS what, count(*) FILTER (dataset_id = 3) AS removed, count(*) FILTER (dataset_id <> 3) AS kept FROM readings
       UNION ALL SELECT 'river', count(*) FILTER (river_name = 'Sungai Perak'), count(*) FILTER (river_name <> 'Sungai Perak') FROM readings""",
)
def remove_rows(spark, sf):
    rows = A.readings(spark, sf)
    out = None
    for what, cond in (("dataset 3", F.col("dataset_id") == 3), ("river", history.same_river_label(" sungai perak "))):
        part = marts.one_row(
            history.removed_count(rows, cond), history.remove_where(rows, cond).agg(F.count("*").alias("kept"))
        ).withColumn("what", F.lit(what))
        out = part if out is None else out.unionByName(part)
    return out


_CODES = """, codes AS (SELECT DISTINCT upper(trim(' s' || lpad(CAST(1 + s_suppkey % 12 AS VARCHAR), 2, '0'))) AS station_code FROM supplier)
"""


def _uploaded(spark, sf):
    code = F.concat(F.lit(" s"), F.lpad((1 + F.col("s_suppkey") % 12).cast("string"), 2, "0"))
    return A.table(spark, sf, "supplier").select(code.alias("station_code"))


@query(
    "a22_upload_codes",
    _CODES
    + """SELECT c.station_code, coalesce(s.river_name, 'Unknown River') AS river_name, s.river_name IS NOT NULL AS is_known,
      CASE WHEN s.river_name IS NULL THEN 'Station code ' || c.station_code || ' is not registered; readings will use ''Unknown River''.' END AS warning
    FROM codes c LEFT JOIN stations s USING (station_code)""",
)
def upload_codes(spark, sf):
    return metadata.upload_codes(_uploaded(spark, sf))


@query(
    "a22_upload_summary",
    _CODES
    + """SELECT count(*) AS n_codes, count(*) FILTER (s.river_name IS NULL) AS n_unknown, 'Multiple rivers' AS river_name,
      count(*) FILTER (s.river_name IS NULL) > 0 AS rejected FROM codes c LEFT JOIN stations s USING (station_code)""",
)
def upload_summary(spark, sf):
    return metadata.upload_summary(_uploaded(spark, sf), strict=True)


@query(
    "a23_metrics_document",
    "SELECT count(*) AS n, round(avg((y_true-y_pred)*(y_true-y_pred)), 6) AS mse, round(avg(abs(y_true-y_pred)), 6) AS mae FROM predictions",
)
def metrics_document(spark, sf):
    path = new_path(spark, "metrics")
    sinks.write_metrics(metrics.regression_metrics(A.predictions(spark, sf)), path)
    return rounded(spark.read.json(path).select("n", "mse", "mae"))


@query(
    "a24_record_rows",
    f""", w AS (SELECT *, CASE WHEN l_linenumber = 5 THEN NULL ELSE {WQI_SQL} END AS w FROM measurements WHERE year(date) <= 2000)
    SELECT date, station_code, round(do_, 6) AS do_, round(bod, 6) AS bod, round(cod, 6) AS cod, CASE WHEN l_linenumber = 2 THEN NULL ELSE round(an, 6) END AS an, tss AS ss, round(ph, 6) AS ph, round(coalesce(w, 0e0), 6) AS wqi,
      {band('coalesce(w, 0e0)')} AS pollution_status, 'csv_upload:sheet.csv' AS data_source, FALSE AS is_predicted, CAST(9 AS BIGINT) AS dataset_id FROM w""",
)
def record_rows(spark, sf):
    from hydrolake.functions.wqi import add_wqi

    line = F.col("_ord.l_linenumber")
    rows = add_wqi(A.measurements(spark, sf))
    rows = rows.withColumns(
        {"wqi": F.when(line != 5, F.col("wqi")), "an": F.when(line == 2, "n/a").otherwise(F.col("an").cast("string"))}
    )
    out = history.to_record_rows(rows, 9, "csv_upload:sheet.csv", cutoff_year=A.CUTOFF).drop("station_name")
    return rounded(out)
