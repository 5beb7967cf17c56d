from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.functions.wqi import add_wqi
from hydrolake.ml import classify, forecast, isolation, regress
from hydrolake.operators import metrics
from hydrolake.plans import training

D0 = date(2000, 1, 1)


@pytest.fixture(scope="module")
def separable(spark):
    """Status follows the oxygen level alone."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        band = i % 3
        do = [9.0, 5.0, 1.0][band] + rng.uniform(-0.5, 0.5)
        status = ["Clean", "slightly polluted", "polluted"][band]
        rows.append((f"S{(i // 3) % 6:02d}", D0 + timedelta(days=i), float(do), float(rng.uniform(0, 4)), status))
    return spark.createDataFrame(rows, "station_code string, date date, do_ double, bod double, river_status string").cache()


def test_forest_separates_and_survives_storage(spark, separable, tmp_path):
    model, scored = classify.train_classifier(separable, trees=10, depth=5)
    assert metrics.classification_metrics(scored).first().accuracy > 0.95
    assert scored.select("station_code").distinct().count() == 2  # whole stations in the test side
    model.save(str(tmp_path / "model"))
    again = classify.StatusClassifier.load(spark, str(tmp_path / "model"))
    assert again.features == ["do_", "bod"]
    stored = training.evaluate_classifier(spark, str(tmp_path / "model"), separable).first()
    assert stored.n == 900 and stored.accuracy > 0.95


def test_cross_validation_folds(separable):
    scores = classify.cross_validate(separable, folds=3, trees=5, depth=4)
    assert scores.count() == 3 and classify.cv_summary(scores).first().mean_accuracy > 0.95
    single = classify.cross_validate(separable.filter("station_code = 'S00'"), folds=2, trees=5, depth=4)
    assert single.agg(F.sum("n")).first()[0] == 150


def test_leaky_columns_are_not_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4)], "flow double, wqi_lag_1 double, predicted double, depth int")
    assert classify.select_features(df) == ["flow", "depth"]


def test_index_regression(spark):
    rng = np.random.default_rng(2)
    rows = [
        (f"S0{i % 3}", D0 + timedelta(days=i), *map(float, rng.uniform(0, 9, 3))) for i in range(600)
    ]
    df = add_wqi(spark.createDataFrame(rows, "station_code string, date date, do_ double, bod double, ph double"))
    _, scored = regress.train_regressor(df, trees=20, depth=8)
    row = regress.evaluate_regressor(scored).first()
    assert row.r2 > 0.8 and row.verdict in ("good", "moderate")


def test_isolation_forest_finds_the_outliers(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("S01", D0 + timedelta(days=i), float(rng.normal(70, 3)), float(rng.normal(7, 0.2))) for i in range(1000)]
    rows[17] = ("S01", D0 + timedelta(days=17), 2.0, 1.0)
    rows[400] = ("S01", D0 + timedelta(days=400), 5.0, 13.0)
    df = spark.createDataFrame(rows, "station_code string, date date, wqi double, ph double")
    model = isolation.fit(df, trees=50)
    scored = model.score(df)
    assert scored.filter("anomaly = -1").count() == 50  # contamination 5 %
    strangest = {r.date for r in scored.orderBy("score").limit(2).collect()}
    assert strangest == {D0 + timedelta(days=17), D0 + timedelta(days=400)}
    model.save(spark, str(tmp_path / "forest"))
    again = isolation.IsolationForest.load(spark, str(tmp_path / "forest")).score(df)
    assert again.join(scored.select("date", F.col("score").alias("s")), "date").filter("abs(score - s) > 1e-12").count() == 0


def test_average_path_matches_the_definition():
    assert isolation.average_path(np.array([1, 2, 3])).tolist() == pytest.approx([0.0, 1.0, 2 * (np.log(2) + np.euler_gamma) - 4 / 3])


@pytest.fixture(scope="module")
def waves(spark):
    rows = [
        (f"S0{s}", D0 + timedelta(days=k), float(60 + 10 * s + 15 * np.sin(2 * np.pi * k / 28 + s)))
        for s in range(1, 4)
        for k in range(300)
    ]
    return spark.createDataFrame(rows, "station_code string, date date, wqi double").cache()


@pytest.mark.parametrize("differences", [False, True])
def test_forecaster_beats_persistence(spark, waves, tmp_path, differences):
    model, scored = forecast.fit(waves, forecast.Settings(differences=differences, add_month=True))
    row = forecast.forecast_metrics(scored).first()
    assert row.rmse < row.baseline_rmse / 2 and forecast.metrics_per_step(scored).count() == 7
    model.save(spark, str(tmp_path / "f"))
    assert forecast.Forecaster.load(spark, str(tmp_path / "f")) == model


def test_rollout_covers_the_horizon(spark, waves):
    model, _ = forecast.fit(waves)
    start, end = D0 + timedelta(days=300), D0 + timedelta(days=339)
    out = forecast.rollout_until(model, waves, start, end)
    per = out.groupBy("station_code").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    assert {(r.n, r.a, r.b) for r in per.collect()} == {(40, start, end)}
    assert out.filter("wqi < 0 or wqi > 100 or round(wqi, 1) <> wqi").count() == 0
    truth = 60 + 10 + 15 * np.sin(2 * np.pi * 302 / 28 + 1)
    got = out.filter(f"station_code = 'S01' and date = date'{D0 + timedelta(days=302)}'").first().wqi
    assert abs(got - truth) < 5
    with pytest.raises(ValueError):
        forecast.next_days(model, waves, 31)


def test_augmentation_fills_short_series_only(spark, waves):
    short = waves.filter("station_code <> 'S02' or date < date'2000-01-11'")
    out = forecast.augment(short)
    sizes = {r.station_code: r["count"] for r in out.groupBy("station_code").count().collect()}
    assert sizes == {"S01": 300, "S02": 120, "S03": 300}
    assert out.exceptAll(forecast.augment(short.repartition(3))).isEmpty()


def test_forecast_run_writes_everything(spark, waves, tmp_path):
    model, _ = forecast.fit(waves)
    as_of = D0 + timedelta(days=299)
    run = training.run_forecast(
        model, waves, as_of, as_of + timedelta(days=1), as_of + timedelta(days=30),
        records_path=str(tmp_path / "records"), events_path=str(tmp_path / "events"),
    )
    assert run.points.count() == 90 and run.log.count() == 3
    assert spark.read.parquet(str(tmp_path / "records")).count() == 90
    assert spark.read.parquet(str(tmp_path / "events")).count() == run.alerts.count()


def test_sweep_reports_every_configuration(waves):
    axes = {"add_month": [("add_month", forecast.Settings(add_month=True))], "ridge": [("ridge", forecast.Settings(ridge=5.0))]}
    results, _ = forecast.run_sweep(waves, forecast.Settings(), axes)
    assert [r.label for r in results.collect()].__len__() == 4


def test_ridge_is_the_least_squares_of_the_library(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 0]
    y = np.column_stack([x @ [1, 2, 3, 4] + rng.normal(size=300) + 7, x @ [0, -1, 3, 1] * 3])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(3)
    weights, intercepts = forecast.ridge(forecast.moments(df, "x", "y", 4, 2), 4, 0.1)
    for h in (0, 1):
        rows = df.select(array_to_vector("x").alias("v"), F.col("y")[h].alias("l"))
        model = LinearRegression(featuresCol="v", labelCol="l", regParam=0.1, solver="normal").fit(rows)
        assert np.allclose(weights[:, h], model.coefficients.toArray(), atol=1e-9)
        assert abs(intercepts[h] - model.intercept) < 1e-9


def test_trees_draw_from_the_whole_table(spark):
    """Forty draws of 64 rows meet more rows than one pool of 2048 would hold."""
    rows = spark.range(20_000).select(F.col("id").alias("k"))
    drawn = isolation.draw(rows, 20_000, ["k"], 40, 64, 42)
    assert drawn.groupBy("tree").count().filter("count = 64").count() == 40
    assert drawn.select("k").distinct().count() > 2048


def test_one_feature_is_enough(spark):
    rows = spark.range(2_000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("wqi"))
    scored = isolation.fit(rows, key=["k"], trees=10, sample=64, features=["wqi"]).score(rows)
    assert scored.filter("anomaly = -1").count() == pytest.approx(100, abs=20)
