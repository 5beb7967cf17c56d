import json
import os
from datetime import date
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from hydrolake.operators.cleaning import coerce_numeric, missing_columns
from hydrolake.plans.preprocessing import prepare_training
from hydrolake.sources import monitoring, shared, sinks


def test_canonical_headers():
    cases = {
        "DO": "do_", "DO mg/l": "do_", "Dissolved Oxygen": "do_", "BOD\nmg/l": "bod", "BOD5": "bod", "COD mg/l": "cod",
        "NH3-N mg/l": "an", "AN": "an", "SS": "tss", "SS mg/l": "tss", "TSS mg/l": "tss", "pH": "ph", "pH (field)": "ph",
        "﻿DO": "do_", "BOD INDEX": None, "station_code": None, "LOCATION": None,
    }
    assert {h: monitoring.canonical_header(h) for h in cases} == cases


def test_messy_export_is_read(spark, tmp_path):
    text = (
        '"SMP-DAT","ID STN BARU","LOCATION","SUNGAI","DO mg/l","BOD\nmg/l","SS mg/l","NH3-N mg/l","pH","BOD INDEX","TSS"\n'
        "2023-01-13,S01,Jambatan,klang,7.9,1.5,10,0.1,7.2,90,99\n"
        "bad,S09,Muara,,n/a,2,11,0.2,7.1,91,98\n"
    )
    (tmp_path / "export.csv").write_text(text)
    sheet = coerce_numeric(monitoring.load_sheet(spark, str(tmp_path / "export.csv"), multiline=True))
    assert missing_columns(sheet) == ["cod"]
    rows = sheet.orderBy("_ord").collect()
    assert (rows[0].date, rows[0].river_name, rows[0].station_name, rows[0].bod, rows[0].tss) == (
        date(2023, 1, 13), "Sungai Klang", "Jambatan", 1.5, 10.0,
    )
    assert (rows[1].date, rows[1].do_, rows[1].river_name) == (None, None, "Muara (S09)")


def test_default_station(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,DO\n2023-01-01,5\n")
    assert monitoring.load_sheet(spark, str(tmp_path / "a.csv")).first().station_code == "S01"


def test_file_order_is_kept(spark, tmp_path):
    lines = ["date,station_code,DO"] + [f"2023-01-01,S01,{i}" for i in range(500)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    rows = monitoring.load_sheet(spark, str(tmp_path / "a.csv")).orderBy("_ord").select("do_").collect()
    assert [int(r.do_) for r in rows] == list(range(500))


def test_one_file_per_river_keeps_the_largest(spark, tmp_path):
    for folder, n in (("x", 2), ("y", 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Sungai Klang.csv").write_text("date,DO\n" + "2023-01-01,5\n" * n)
    (tmp_path / "y" / "sungai gombak.csv").write_text("date,DO\n2023-01-01,5\n")
    got = {r.stem: r.file_path for r in monitoring.catalog_one_per_river(spark, str(tmp_path)).collect()}
    assert set(got) == {"Sungai Klang", "sungai gombak"} and "/y/" in got["Sungai Klang"]


def test_folders_of_parts_are_sheets(spark, tmp_path):
    rivers = spark.createDataFrame([("Sungai Klang", 40), ("50% Sg: A/B", 3)], "river_name string, n int")
    rows = rivers.select("river_name", F.explode(F.sequence(F.lit(1), "n")).alias("do_"))
    # Two part files of a river in a partitioned table, a folder named like a file, and a plain file.
    rows.repartition(2).write.partitionBy("river_name").option("header", True).csv(str(tmp_path / "table"))
    rows.filter("do_ <= 2").repartition(2).write.option("header", True).csv(str(tmp_path / "Sungai Gombak.csv"))
    (tmp_path / "sungai klang.csv").write_text("date,DO\n2023-01-01,5\n")
    got = {r.stem: r for r in monitoring.catalog_one_per_river(spark, str(tmp_path)).collect()}
    counts = {r.file_path: r.row_count for r in monitoring.file_row_counts(spark, str(tmp_path)).collect()}
    assert {stem: counts[r.file_path] for stem, r in got.items()} == {"Sungai Klang": 40, "50% Sg: A/B": 3, "Sungai Gombak": 4}
    assert (got["Sungai Klang"].n_files, got["Sungai Gombak"].file_name) == (2, "Sungai Gombak.csv")
    out = monitoring.dataset_catalog(spark, str(tmp_path), spark.createDataFrame([], "name string, row_count long"))
    assert sorted((r["name"], r.row_count) for r in out.collect()) == [("50% Sg: A/B", 3), ("Sungai Gombak.csv", 4), ("Sungai Klang", 40), ("sungai klang.csv", 1)]


def test_staged_copy_goes_unless_the_block_fails(spark):
    rows = spark.range(3)
    with shared.staged(rows, "staged") as copy:
        assert copy.count() == 3
        kept = copy.inputFiles()
    with pytest.raises(ValueError), shared.staged(rows, "staged") as copy:
        left = copy.inputFiles()
        raise ValueError
    assert not any(os.path.exists(urlparse(f).path) for f in kept)
    assert all(os.path.exists(urlparse(f).path) for f in left)


def test_counts_of_training_set_are_observed(spark):
    schema = "station_code string, date date, do_ double, bod double, cod double, an double, tss double, ph double, _ord long"
    values = [("S01", date(2000, 1, 1 + i), 6.0 + i, 2.0, 20.0, 0.3, 30.0, 7.0, i) for i in range(10)]
    rows = spark.createDataFrame([*values, (*values[0][:-1], 99)], schema)
    made = prepare_training(rows)
    assert made.counts == {"raw": 11, "clean": 10, "imputed": 10, "train": 8, "test": 2}
    assert {r["split"]: r["count"] for r in made.rows.groupBy("split").count().collect()} == {"train": 8, "test": 2}


@pytest.mark.parametrize("method", ["minmax", "standard"])
def test_training_set_of_no_rows(spark, method):
    schema = "station_code string, date date, do_ double, bod double, cod double, an double, tss double, ph double, _ord long"
    empty = spark.createDataFrame([], schema)
    for rows in (empty, empty.filter("false"), empty.limit(0)):
        made = prepare_training(rows, method=method)
        assert made.counts == {"raw": 0, "clean": 0, "imputed": 0} and made.rows.collect() == []


def test_catalog_prefers_the_registry(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,DO\n2023-01-01,5\n2023-01-02,5\n")
    (tmp_path / "b.csv").write_text("date,DO\n2023-01-01,5\n")
    registry = spark.createDataFrame([("A.csv", 77)], "name string, row_count long")
    out = monitoring.dataset_catalog(spark, str(tmp_path), registry)
    assert {r["name"]: r.row_count for r in out.collect()} == {"A.csv": 77, "b.csv": 1}
    assert monitoring.total_rows(out).first()[0] == 78


def test_forecast_cache_needs_enough_points(spark, tmp_path):
    points = spark.range(120).select(
        F.date_add(F.lit(date(2026, 1, 1)), F.col("id").cast("int")).alias("date"), F.lit("S01").alias("station_code"),
        F.lit(70.0).alias("wqi"),
    )
    sinks.save_cache(points, str(tmp_path / "cache"))
    assert sinks.load_cache(spark, str(tmp_path / "cache")).count() == 120
    assert sinks.load_cache(spark, str(tmp_path / "cache"), min_points=121) is None
    assert sinks.load_cache(spark, str(tmp_path / "absent")) is None


def test_upsert_table_rewrites_only_touched_years(spark, tmp_path):
    path = str(tmp_path / "records")
    schema = "station_code string, date date, wqi double, _ord int"
    first = spark.createDataFrame([("S01", date(1999, 5, 1), 1.0, 1), ("S01", date(2000, 5, 1), 2.0, 1)], schema)
    sinks.upsert_table(first, path)
    untouched = sorted(p.name for p in (tmp_path / "records" / "year=1999").glob("*.parquet"))
    sinks.upsert_table(spark.createDataFrame([("S01", date(2000, 5, 1), 9.0, 1)], schema), path)
    assert sorted(p.name for p in (tmp_path / "records" / "year=1999").glob("*.parquet")) == untouched
    assert {r.wqi for r in spark.read.parquet(path).collect()} == {1.0, 9.0}


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared.new_path(spark, "x").startswith(folder or shared.shared_dir(spark))


def test_alert_sample_shape(spark, tmp_path):
    row = {"station_name": "Sungai Gombak", "date": "2026-03-16", "wqi": 61.2, "status": "Slightly Polluted", "alert_type": "Historical"}
    (tmp_path / "alerts.json").write_text(json.dumps([row]))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "alerts.json")).first().wqi == pytest.approx(61.2)


def test_sheets_to_latest_stations(spark, tmp_path):
    """The README example: two river sheets to the station table."""
    from hydrolake.operators.history import historical_slice, to_readings
    from hydrolake.operators.marts import latest_stations
    from hydrolake.plans.preprocessing import base_frame

    header = "date,station_code,DO,BOD,COD,AN,SS,pH\n"
    (tmp_path / "klang.csv").write_text(header + "2025-06-01,S01,8,0,0,0,0,7\n2025-06-02,S01,0,20,200,10,500,4\n2025-07-09,S01,8,0,0,0,0,7\n")
    (tmp_path / "gombak.csv").write_text(header + "2025-06-03,S02,8,0,0,0,,7\n2025-06-03,S02,0,20,200,10,500,4\n")
    sheet = monitoring.load_sheet(spark, str(tmp_path / "*.csv"))
    readings = to_readings(base_frame(sheet))
    hist = historical_slice(readings, None, as_of=date(2025, 6, 30))
    rows = {r.station_code: r for r in latest_stations(hist).collect()}
    assert (rows["S01"].river_name, rows["S01"].latest_wqi, rows["S01"].river_status) == ("Sungai Klang", 0.0, "polluted")
    assert rows["S01"].last_reading_date == date(2025, 6, 2)
    assert rows["S02"].river_status == "clean" and rows["S02"].latest_wqi == pytest.approx(100.0)
