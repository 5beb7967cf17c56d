import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.operators import cleaning, history, marts, quality, scaling, series, splits
from hydrolake.operators.quantiles import exact_quantiles, ordered_values

D0 = date(2000, 1, 1)


def daily(spark, lengths, start=D0):
    rows = [
        (f"S{i:02d}", start + timedelta(days=k), float((k * 7 + i * 13) % 101))
        for i, n in enumerate(lengths)
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "station_code string, date date, wqi double")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- order statistics ---------------------------------------------------------


@pytest.mark.parametrize("kind", ["spread", "heavy", "constant"])
def test_ordered_values_narrowing_is_exact(spark, kind):
    rnd = random.Random(7)
    data = {
        "spread": [rnd.gauss(0, 1) for _ in range(30_000)],
        "heavy": [float(rnd.choice([1, 1, 1, 1, 2, 3])) if rnd.random() < 0.9 else rnd.random() for _ in range(30_000)],
        "constant": [4.0] * 30_000,
    }[kind]
    df = spark.createDataFrame([(x,) for x in data], "x double").repartition(6)
    ranks = [0, 1, 7_500, 14_999, 15_000, 29_999]
    got = ordered_values(df, {"x": (F.col("x"), ranks)}, single_task_rows=500)["x"]
    assert got == [sorted(data)[r] for r in ranks]


def test_exact_quantile_both_paths(spark):
    df = spark.range(10_001).select((F.col("id") * 0.5).alias("x"), F.lit(None).cast("double").alias("none"))
    wanted = {"x": (F.col("x"), 0.3333), "none": (F.col("none"), 0.5)}
    small, large = exact_quantiles(df, wanted), exact_quantiles(df, wanted, single_task_rows=100)
    assert small["x"] == pytest.approx(large["x"]) and small["none"] is None and large["none"] is None


# --- cleaning ------------------------------------------------------------------


def test_dedup_directions_differ(spark):
    df = spark.createDataFrame([("S01", D0, 1.0, 1), ("S01", D0, 2.0, 2)], "station_code string, date date, wqi double, _ord int")
    assert cleaning.dedup_first(df).first().wqi == 1.0
    assert cleaning.dedup_newest(df).first().wqi == 2.0


def test_dedup_reduces_hot_keys_before_the_exchange(spark):
    """A key with a third of all rows is cut to one row per input partition."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id"))).alias("station_code"),
        F.lit(D0).alias("date"),
        F.col("id").alias("_ord"),
    )
    out = cleaning.dedup_first(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert out.count() == 20_001 and out.filter("station_code = 'HOT'").first()._ord == 0


def test_median_is_over_the_whole_table(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "bod double")
    assert cleaning.fit_imputer(df).values == {"bod": 2.0}
    assert cleaning.impute(df, "mean").filter("bod is null").count() == 0
    assert cleaning.impute(df, "drop").count() == 3


def test_quality_gate_and_numeric_names(spark):
    bad = spark.createDataFrame([("12", "2000-01-01"), ("7", "")], "station_name string, date string")
    assert not cleaning.quality_gate(bad).first().quality_ok
    assert cleaning.numeric_name_check(bad).first()[0]


# --- series ---------------------------------------------------------------------


def test_chunked_window_equals_one_big_window(spark):
    df = daily(spark, [500, 3, 120])
    placed = series.with_position(df, ["date"])
    chunked = series.chunked_window(placed, 6, lambda w: series.rolling_columns(w), chunk_rows=50)
    cols = ["station_code", "date", "wqi_rolling_mean", "wqi_rolling_std"]
    a = pairs(chunked.select(*cols[:2], *[F.round(c, 9).alias(c) for c in cols[2:]]), *cols)
    b = pairs(series.rolling(df).select(*cols[:2], *[F.round(c, 9).alias(c) for c in cols[2:]]), *cols)
    assert a == b
    assert pairs(placed.filter("position = 0"), "station_code") == [("S00",), ("S01",), ("S02",)]


def test_positions_of_a_hot_day_without_a_hot_task(spark):
    """A day with a third of all rows, half of them equal in all columns, is spread over the parts."""
    n = 300_000
    number = F.when(F.col("id") % 6 == 0, 0).otherwise(F.col("id"))
    station = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("S"), F.col("id") % 50))
    day = F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 365).cast("int"))
    df = spark.range(0, n, 1, 6).select(station.alias("station_code"), F.date_add(F.lit(date(2020, 1, 1)), day).alias("date"), number.alias("number"))
    sizes = [r[0] for r in series.ordered_blocks(df, ["date", F.desc("number")], 12).groupBy("_part").count().select("count").collect()]
    assert sum(sizes) == n and len(sizes) == 12 and max(sizes) <= 2 * sorted(sizes)[6]
    got = series.with_position(df, ["date", F.desc("number")], 12)
    assert got.columns == ["station_code", "date", "number", "position"]
    rank = F.row_number().over(Window.partitionBy("station_code").orderBy("date", F.desc("number"))) - 1
    assert got.exceptAll(df.withColumn("position", rank.cast("long"))).isEmpty() and got.count() == n


def test_more_rows_take_more_tasks_not_larger_ones(spark, monkeypatch):
    """No part of the order and no task of the window holds more rows, however many there are."""
    monkeypatch.setattr(series, "TASK_ROWS", 1000, raising=False)
    rows = spark.range(0, 40_000, 1, 4)
    df = rows.select(F.concat(F.lit("S0"), F.col("id") % 3).alias("station_code"), F.date_add(F.lit(D0), (F.col("id") % 50).cast("int")).alias("date"), "id", (F.col("id") % 97).cast("double").alias("wqi"))
    placed = series.with_position(df, ["date", "id"])
    out = series.chunked_window(placed, 6, lambda w: series.rolling_columns(w), chunk_rows=10)
    for sorted_, parts in ((series.ordered_blocks(df, ["date", "id"]), F.col("_part")), (out, F.spark_partition_id())):
        sizes = [r["count"] for r in sorted_.groupBy(parts.alias("p")).count().collect()]
        assert sum(sizes) == 40_000 and len(sizes) == 40 and max(sizes) <= 2 * 1000
    window = Window.partitionBy("station_code").orderBy("date", "id").rowsBetween(-6, 0)
    want = df.withColumn("wqi_rolling_mean", F.avg("wqi").over(window)).select("id", F.round("wqi_rolling_mean", 9))
    assert out.select("id", F.round("wqi_rolling_mean", 9)).exceptAll(want).isEmpty()


def test_first_rolling_deviation_is_zero_and_fill_stays_inside_station(spark):
    df = daily(spark, [3, 3])
    first = series.rolling(df).filter(F.col("date") == F.lit(D0))
    assert [r.wqi_rolling_std for r in first.collect()] == [0.0, 0.0]
    lagged = series.lags(df, "wqi", [1]).filter(F.col("date") == F.lit(D0))
    own = {r.station_code: r.wqi for r in df.filter(F.col("date") == F.lit(D0)).collect()}
    assert {r.station_code: r.wqi_lag_1 for r in lagged.collect()} == own  # backward fill, never the other station
    assert {r.wqi_lag_7 for r in series.lags(df, "wqi", [7]).collect()} == {0.0}


def test_sliding_windows_never_overlap_targets(spark):
    out = series.sliding_windows(daily(spark, [20]), ["wqi"], 5, 3)
    assert out.count() == 20 - 5 - 3 + 1
    row = out.filter("sample_index = 0").first()
    seq = [float((k * 7) % 101) for k in range(20)]
    assert [r[0] for r in row.inputs] == seq[:5] and row.targets == seq[5:8] and row.anchor == seq[4]
    back = out.select(
        series.integrate_differences("anchor", series.first_differences("anchor", "targets")).alias("y"), "targets"
    ).first()
    assert back.y == pytest.approx(back.targets)


def test_padding_and_model_input(spark):
    padded = series.pad_history(daily(spark, [3, 10]), 6)
    assert pairs(padded.groupBy("station_code").count(), "station_code", "count") == [("S00", 6), ("S01", 10)]
    assert padded.agg(F.min("date")).first()[0] == D0 - timedelta(days=3)
    assert pairs(series.model_input(padded, ["wqi"], 7), "station_code") == [("S01",)]


@pytest.mark.parametrize("method", ["locf", "linear"])
def test_gap_fill_keeps_existing_rows(spark, method):
    full = daily(spark, [40])
    holes = full.filter("dayofmonth(date) % 4 <> 0 or date = date'2000-02-09'")
    end = D0 + timedelta(days=45)
    out = series.gap_fill(holes, end, method)
    assert out.count() == 46 and out.select("date").distinct().count() == 46
    kept = out.filter("data_type = 'historical'").select("station_code", "date", "wqi")
    assert pairs(kept, "station_code", "date", "wqi") == pairs(holes, "station_code", "date", "wqi")
    assert series.gaps(out).count() == 0


def test_trend_and_persistence(spark):
    df = spark.createDataFrame(
        [("A", D0, 10.0), ("A", D0 + timedelta(days=1), 12.0), ("B", D0, 5.0), ("B", D0 + timedelta(days=1), 5.5)],
        "station_code string, date date, wqi double",
    )
    assert pairs(series.trend(df), "station_code", "trend") == [("A", "Increasing"), ("B", "Stable")]
    assert {r.wqi for r in series.persistence_forecast(df, 3).filter("station_code = 'A'").collect()} == {12.0}


# --- history ----------------------------------------------------------------------


def readings(spark, rows):
    schema = "station_code string, station_name string, river_name string, date date, wqi double, river_status string, data_type string, id long"
    return spark.createDataFrame(rows, schema)


def test_historical_slice_prefers_measurements_and_merges_labels(spark):
    d1 = D0 + timedelta(days=1)
    hist = readings(
        spark,
        [
            ("S06", None, None, D0, 50.0, "polluted", "historical", 1),
            (None, "Sungai Sarawak", None, D0, 70.0, "slightly_polluted", "historical", 2),
            ("S06", None, None, d1, 10.0, "polluted", "forecast", 3),
        ],
    )
    points = spark.createDataFrame(
        [(D0, "S06", None, 99.0), (d1, "S06", None, 90.0), (d1 + timedelta(days=1), "S06", None, 1.0)],
        "date date, station_code string, station_name string, wqi double",
    )
    out = history.historical_slice(hist, points, d1)
    assert pairs(out, "date", "wqi", "is_predicted") == [(D0, 70.0, False), (d1, 90.0, True)]


def test_upsert_is_idempotent_and_skips_bad_rows(spark):
    target = spark.createDataFrame([("S01", D0, 1.0, 1), ("S02", D0, 2.0, 1)], "station_code string, date date, wqi double, _ord int")
    updates = spark.createDataFrame(
        [("S01", D0, 5.0, 1), ("S01", D0, 6.0, 2), (" ", D0, 7.0, 1), ("S03", None, 8.0, 1)],
        "station_code string, date date, wqi double, _ord int",
    )
    once = history.upsert(target, updates)
    assert pairs(once, "station_code", "wqi") == [("S01", 6.0), ("S02", 2.0)]
    assert pairs(history.upsert(once, updates), "station_code", "wqi") == pairs(once, "station_code", "wqi")


def test_tail_keeps_the_latest_rows_ascending(spark):
    got = [r.date for r in history.tail(daily(spark, [10]), 3, ["date"]).collect()]
    assert got == [D0 + timedelta(days=k) for k in (7, 8, 9)]


def test_purge_keeps_rows_without_a_year(spark):
    df = spark.createDataFrame([("2025-01-01",), ("2026-01-01",), ("x",), (None,)], "date string")
    assert df.count() - history.purge_after(df).count() == 1


def test_invalid_modes_are_refused(spark):
    df = daily(spark, [3])
    with pytest.raises(ValueError):
        history.scan_records(df, "other", D0)
    with pytest.raises(ValueError):
        marts.compare_wide(df, ["S01", " s01 "])
    with pytest.raises(ValueError):
        series.gap_fill(df, D0, "walk")


# --- marts and checks -------------------------------------------------------------


def test_coverage_three_of_four_days(spark):
    rows = [("S01", None, None, D0 + timedelta(days=k), 1.0, "polluted", "historical", k) for k in (0, 1, 3)]
    row = marts.coverage(readings(spark, rows)).first()
    assert (row.coverage_days, row.span_days, row.coverage_pct, row.range_label) == (3, 4, 75.0, "Jan 2000–Jan 2000")


def test_alert_screen_has_a_hole_between_80_and_81(spark):
    rows = [(f"S0{k}", None, None, D0, w, None, "historical", k) for k, w in enumerate((80.0, 80.5, 81.0, 59.0), 1)]
    row = marts.alert_screen_counts(readings(spark, rows), D0).first()
    assert (row.slightly_polluted_today, row.polluted_today) == (1, 1)


def test_summary_without_rows_is_zero(spark):
    empty = readings(spark, [])
    points = spark.createDataFrame([], "date date, station_code string, station_name string, wqi double")
    alerts = spark.createDataFrame([], "is_read boolean")
    row = marts.summary(empty, alerts, points, D0).first()
    assert (row.total_stations, row.avg_wqi, row.clean_count, row.predicted_avg_wqi) == (0, 0.0, 0, 0.0)


def test_timeline_check(spark):
    ok = daily(spark, [5]).withColumn("data_type", F.lit("historical"))
    assert quality.check_timeline(ok, D0 + timedelta(days=9)).first().passed
    assert not quality.check_timeline(ok.filter(F.col("date") != F.lit(D0 + timedelta(days=2))), D0 + timedelta(days=9)).first().passed
    assert quality.check_timeline(ok, D0).first().rows_after_as_of == 4


# --- scaling and splits --------------------------------------------------------------


def test_scalers_on_constant_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (5.0, None)], "c double, x double")
    assert {r.c for r in scaling.fit_minmax(df, ["c"]).transform(df).collect()} == {0.0}
    standard = scaling.fit_standard(df, ["c", "x"])
    assert {r.c for r in standard.transform(df).collect()} == {0.0}
    assert standard.scale["x"] == pytest.approx((14 / 9) ** 0.5)
    assert scaling.varying_columns(df, ["c", "x"]) == ["x"]


def test_splits_are_exact_disjoint_and_stable(spark):
    df = daily(spark, [50, 30, 20, 11]).withColumn("label", (F.col("wqi") > 50).cast("int"))
    a = splits.random_split(df, ["station_code", "date"], 0.2, "label")
    b = splits.random_split(df.repartition(5), ["station_code", "date"], 0.2, "label")
    assert pairs(a, "station_code", "date", "split") == pairs(b, "station_code", "date", "split")
    g = splits.group_split(df, "station_code", 0.3)
    sides = g.groupBy("station_code").agg(F.countDistinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0
    assert g.filter("split = 'test'").select("station_code").distinct().count() == 2  # ceil(0.3 * 4)


def test_chronological_split_is_chronological(spark):
    df = daily(spark, [50, 50, 11])
    out = splits.chronological_split(df, 0.2)
    assert out.filter("split = 'test'").count() == int(111 * 0.2)
    last_train = out.filter("split = 'train'").agg(F.max("date")).first()[0]
    assert out.filter("split = 'test'").agg(F.min("date")).first()[0] >= last_train
    assert splits.time_split(daily(spark, [3])).filter("split = 'test'").count() == 1


def test_fold_count_rules():
    assert splits.fold_count(7, 100) == 5
    assert splits.fold_count(3, 100) == 3
    assert splits.fold_count(7, 1) == 5
    assert splits.fold_count(7, 2) == 2


def test_backward_fill_is_linear(spark):
    """Frames start at the first row: none is computed anew for every row."""
    rows = spark.range(36_000).select(F.lit("S01").alias("station_code"), F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("wqi"))
    out = series.lags(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    first = out.orderBy("date").limit(2).collect()
    assert [r["wqi_lag_1"] for r in first] == [0.0, 0.0] and out.count() == 36_000


def test_gap_fill_keeps_rows_after_the_end(spark):
    rows = spark.createDataFrame([("S01", D0 + timedelta(days=d), float(d)) for d in (0, 2, 8, 10)], "station_code string, date date, wqi double")
    out = series.gap_fill(rows, D0 + timedelta(days=3)).orderBy("date").collect()
    assert [((r["date"] - D0).days, r["data_type"][0]) for r in out] == [(0, "h"), (1, "g"), (2, "h"), (3, "g"), (8, "h"), (10, "h")]


def test_chronological_split_is_exact_when_days_repeat(spark):
    rows = spark.range(1000).select(F.lit("S01").alias("station_code"), F.date_add(F.lit(D0), (F.col("id") % 10).cast("int")).alias("date"), "id")
    assert splits.chronological_split(rows, 0.25).filter("split = 'test'").count() == 250


def test_ordered_values_are_values_of_the_column(spark):
    """Every rank, also where its share of the rows is no exact fraction."""
    rng = random.Random(5)
    values = [rng.random() * 10**rng.randrange(16) for _ in range(1201)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = list(range(0, 1201, 7))
    assert ordered_values(df, {"x": (F.col("x"), ranks)})["x"] == [sorted(values)[r] for r in ranks]
