"""Model training, scoring, metrics and composite jobs (survey sections I and J)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.constants import PARAMETERS
from hydrolake.functions.wqi import status
from hydrolake.ml import classify, forecast, isolation, regress
from hydrolake.operators import cleaning, metrics, scaling, series, splits
from hydrolake.plans import preprocessing, training
from hydrolake.sources import monitoring, sheets
from hydrolake.sources.shared import materialize, new_path
from hydrolake.sources.sinks import write_metrics
from workload.registry import ORD, WQI_SQL, band, query, rounded
from workload.series_queries import fill_sql, lag_sql

KEEP = ["station_code", "date", *PARAMETERS, "wqi", "river_status"]


def _daily(spark, sf):
    return A.daily_measurements(spark, sf).select(*KEEP)


def _stored_daily(spark, sf):
    """Stored once, because training reads it several times."""
    return materialize(_daily(spark, sf), "daily")


@query(
    "i01_select_features",
    "SELECT 'do_,bod,cod,an,tss,ph' AS raw, 'l_quantity,l_discount' AS fallback, 'wqi,do_,bod,cod,an,tss,ph' AS anomaly, count(*) AS n_rows FROM readings",
)
def select_features(spark, sf):
    rows = _daily(spark, sf)
    other = A.table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", F.col("l_tax").alias("tax_class"), F.col("l_shipdate").alias("date")
    )
    return rows.agg(F.count("*").alias("n_rows")).withColumns(
        {
            "raw": F.lit(",".join(classify.select_features(rows))),
            "fallback": F.lit(",".join(classify.select_features(other))),
            "anomaly": F.lit(",".join(classify.anomaly_features(rows))),
        }
    )


@query(
    "i02_varying_columns",
    "SELECT 'do_,bod,cod,an,tss,ph' AS kept, count(*) AS n_rows FROM measurements",
)
def varying_columns(spark, sf):
    rows = A.measurements(spark, sf).withColumn("constant", F.lit(3.0))
    kept = scaling.varying_columns(rows, [*PARAMETERS, "constant"])
    return rows.agg(F.count("*").alias("n_rows")).withColumn("kept", F.lit(",".join(kept)))


@query(
    "i03_minmax_scaling",
    """, m AS (SELECT min(do_) AS a, max(do_) AS b, min(cod) AS c, max(cod) AS d FROM deduped)
    SELECT station_code, date, round((do_ - a)/(b - a), 6) AS do_, round((cod - c)/(d - c), 6) AS cod, 0e0 AS constant FROM deduped, m""",
)
def minmax_scaling(spark, sf):
    rows = _daily(spark, sf).withColumn("constant", F.lit(5.0))
    out = scaling.fit_minmax(rows, ["do_", "cod", "constant"]).transform(rows)
    return rounded(out.select("station_code", "date", "do_", "cod", "constant"))


@query(
    "i04_standard_scaling",
    """, m AS (SELECT avg(do_) AS a, stddev_pop(do_) AS b, avg(cod) AS c, stddev_pop(cod) AS d FROM deduped)
    SELECT station_code, date, round((do_ - a)/b, 6) + 0e0 AS do_, round((cod - c)/d, 6) + 0e0 AS cod, 0e0 AS constant FROM deduped, m""",
)
def standard_scaling(spark, sf):
    rows = _daily(spark, sf).withColumn("constant", F.lit(5.0))
    out = scaling.fit_standard(rows, ["do_", "cod", "constant"]).transform(rows)
    return rounded(out.select("station_code", "date", "do_", "cod", "constant"))


@query(
    "i05_encode_labels",
    """, t AS (SELECT CASE l_linenumber WHEN 1 THEN 'Clean' WHEN 2 THEN 'slightly polluted' WHEN 3 THEN 'POLLUTED' WHEN 4 THEN 'unknown' END AS raw FROM lineitem)
    SELECT raw AS river_status, CASE raw WHEN 'Clean' THEN 0 WHEN 'slightly polluted' THEN 1 ELSE 2 END AS label, count(*) AS n FROM t
    WHERE raw IS NOT NULL AND raw <> 'unknown' GROUP BY ALL""",
)
def encode_labels(spark, sf):
    line = F.col("l_linenumber")
    raw = F.when(line == 1, "Clean").when(line == 2, "slightly polluted").when(line == 3, "POLLUTED").when(line == 4, "unknown")
    rows = metrics.labelled(A.table(spark, sf, "lineitem").select(raw.alias("river_status")))
    return rows.groupBy("river_status", "label").agg(F.count("*").alias("n"))


@query(
    "i06_stratified_split",
    """, c AS (SELECT river_status, count(*) AS n FROM readings GROUP BY 1), t AS (SELECT *, greatest(1, CAST(floor(n*0.2e0 + 0.5e0) AS BIGINT)) AS nt FROM c)
    SELECT river_status, 'test' AS split, nt AS n FROM t UNION ALL SELECT river_status, 'train', n - nt FROM t""",
)
def stratified_split(spark, sf):
    rows = splits.random_split(_daily(spark, sf), ["station_code", "date"], 0.2, "river_status")
    return rows.groupBy("river_status", "split").agg(F.count("*").alias("n"))


@query(
    "i06_random_split",
    """, c AS (SELECT count(*) AS n FROM readings), t AS (SELECT *, greatest(1, CAST(floor(n*0.2e0 + 0.5e0) AS BIGINT)) AS nt FROM c)
    SELECT 'test' AS split, nt AS n FROM t UNION ALL SELECT 'train', n - nt FROM t""",
)
def random_split(spark, sf):
    rows = splits.random_split(_daily(spark, sf), ["station_code", "date"], 0.2)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query(
    "i07_group_split",
    """, g AS (SELECT station_code, row_number() OVER (ORDER BY (CAST(substr(station_code, 2) AS INTEGER)*5) % 11) AS pos FROM (SELECT DISTINCT station_code FROM readings))
    SELECT station_code, CASE WHEN pos <= 2 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM readings JOIN g USING (station_code) GROUP BY ALL""",
)
def group_split(spark, sf):
    order = (F.substring("station_code", 2, 2).cast("int") * 5) % 11
    rows = splits.group_split(_daily(spark, sf), "station_code", 0.2, order=order)
    return rows.groupBy("station_code", "split").agg(F.count("*").alias("n"))


@query(
    "i08_group_folds",
    "SELECT fold, n_groups FROM (VALUES (0, 1), (1, 1), (2, 2), (3, 1), (4, 2)) t(fold, n_groups) WHERE (SELECT count(DISTINCT station_code) FROM readings) = 7",
)
def group_folds(spark, sf):
    rows, _ = splits.group_folds(_daily(spark, sf), "station_code", 5)
    return rows.groupBy("fold").agg(F.countDistinct("station_code").cast("int").alias("n_groups"))


@query(
    "i08_stratified_folds",
    """, c AS (SELECT river_status, count(*) AS n FROM readings GROUP BY 1)
    SELECT river_status, CAST(k AS INTEGER) AS fold, (n*(k+1))//5 - (n*k)//5 AS n FROM c, generate_series(0, 4) t(k)""",
)
def stratified_folds(spark, sf):
    rows, _ = splits.stratified_folds(_daily(spark, sf), ["station_code", "date"], "river_status", 5)
    return rows.groupBy("river_status", "fold").agg(F.count("*").alias("n"))


@query("i08_cross_validation")
def cross_validation(spark, sf):
    return classify.cross_validate(_stored_daily(spark, sf))


@query("i09_random_forest")
def random_forest(spark, sf):
    _, scored = classify.train_classifier(_stored_daily(spark, sf))
    return rounded(metrics.classification_metrics(scored))


@query("i10_predict_labels")
def predict_labels(spark, sf):
    # Fitted on four fifths of the rows, 150 trees of depth 15; the others are labelled.
    _, scored = classify.train_classifier(_stored_daily(spark, sf).drop("station_name"))
    return scored.groupBy("river_status", "predicted_status").agg(F.count("*").alias("n"))


def _threshold_rows(spark, sf):
    """Daily rows of one group whose status is a threshold of one column: a forest must learn it without an error."""
    rows = A.daily_measurements(spark, sf).select(F.col("station_code").alias("site"), "date", *PARAMETERS)
    return materialize(rows.withColumn("river_status", F.when(F.col("an") >= 0.5, "clean").otherwise("polluted")), "threshold")


@query(
    "i08_threshold_folds",
    """, c AS (SELECT an >= 0.5 AS c, count(*) AS n FROM daily GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS fold, CAST(sum((n*(k+1))//5 - (n*k)//5) AS BIGINT) AS n, 1e0 AS accuracy FROM c, generate_series(0, 4) t(k) GROUP BY k""",
)
def threshold_folds(spark, sf):
    return classify.cross_validate(_threshold_rows(spark, sf), key=["site", "date"])


@query(
    "i09_threshold_forest",
    """, c AS (SELECT CASE WHEN an >= 0.5 THEN 'clean' ELSE 'polluted' END AS river_status, count(*) AS n FROM daily GROUP BY 1)
    SELECT river_status, river_status AS predicted_status, CAST(greatest(1, round(n*0.2e0)) AS BIGINT) AS n FROM c""",
)
def threshold_forest(spark, sf):
    _, scored = classify.train_classifier(_threshold_rows(spark, sf), key=["site", "date"])
    return scored.groupBy("river_status", "predicted_status").agg(F.count("*").alias("n"))


@query(
    "i10_threshold_labels",
    """SELECT station_code, date, CASE WHEN an >= 0.5 THEN 'clean' ELSE 'polluted' END AS predicted_status, count(*) AS n FROM measurements GROUP BY ALL""",
)
def threshold_labels(spark, sf):
    """Fitted on one row per station and day, applied to every measurement."""
    rows = metrics.labelled(_threshold_rows(spark, sf))
    model = classify.fit_forest(rows, classify.select_features(rows), key=["site", "date"])
    scored = model.predict(A.measurements(spark, sf))
    return scored.groupBy("station_code", "date", "predicted_status").agg(F.count("*").alias("n"))


@query(
    "i12_threshold_regression",
    """SELECT coalesce(CASE WHEN l_partkey % 5 <> 0 THEN station_code END, 'none') AS station_code, an >= 0.5 AS high, count(*) AS n,
      CASE WHEN an >= 0.5 THEN 80e0 ELSE 20e0 END AS y_pred FROM daily GROUP BY ALL""",
)
def threshold_regression(spark, sf):
    """An index that is a step of one column, and a fifth of the stations missing."""
    wqi = F.when(F.col("an") >= 0.5, 80.0).otherwise(20.0)
    station = F.when(F.col("_ord.l_partkey") % 5 != 0, F.col("station_code"))
    rows = A.daily_measurements(spark, sf).withColumns({"wqi": wqi, "station_code": station, "n": F.lit(1)})
    rows = materialize(rows.select("station_code", "date", *PARAMETERS, "wqi"), "steps")
    scored = regress.score_regressor(regress.fit_regressor(rows), rows)
    # Means of leaves on either side of the step; the forest's mean is off by trees that never drew the column.
    near = F.when(F.col("y_pred") >= 50, 80.0).otherwise(20.0)
    return scored.groupBy(F.coalesce("station_code", F.lit("none")).alias("station_code"), (F.col("y_true") == 80).alias("high"), near.alias("y_pred")).agg(F.count("*").alias("n"))


_CLASSES = f""", cls AS (SELECT {band('y_true')} AS t, {band('y_pred')} AS p FROM predictions),
  codes AS (SELECT CASE t WHEN 'clean' THEN 0 WHEN 'slightly_polluted' THEN 1 ELSE 2 END AS label, CASE p WHEN 'clean' THEN 0 WHEN 'slightly_polluted' THEN 1 ELSE 2 END AS prediction FROM cls),
  rep AS (SELECT c AS class, (SELECT count(*) FROM codes WHERE label = c) AS support, (SELECT count(*) FROM codes WHERE prediction = c) AS predicted,
    (SELECT count(*) FROM codes WHERE label = c AND prediction = c) AS tp FROM (VALUES (0), (1), (2)) v(c)),
  prf AS (SELECT *, tp/CAST(predicted AS DOUBLE) AS precision, tp/CAST(support AS DOUBLE) AS recall, 2e0*tp/(support + predicted) AS f1 FROM rep)
"""


def _classes(spark, sf):
    rows = A.predictions(spark, sf)
    return rows.select(
        metrics.encode_label(status("y_true")).alias("label"), metrics.encode_label(status("y_pred")).alias("prediction")
    )


@query(
    "i11_classification_metrics",
    _CLASSES
    + """SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp)/CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(sum(precision*support)/sum(support), 6) AS precision_weighted,
      round(sum(recall*support)/sum(support), 6) AS recall_weighted, round(sum(f1*support)/sum(support), 6) AS f1_weighted,
      round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM prf""",
)
def classification_metrics(spark, sf):
    return rounded(metrics.classification_metrics(_classes(spark, sf)))


@query(
    "i11_class_report",
    _CLASSES + "SELECT class, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf",
)
def class_report(spark, sf):
    return rounded(metrics.class_report(_classes(spark, sf)))


@query("i11_confusion", _CLASSES + "SELECT label, prediction, count(*) AS n FROM codes GROUP BY ALL")
def confusion(spark, sf):
    return metrics.confusion(_classes(spark, sf))


@query("i12_index_regression")
def index_regression(spark, sf):
    _, scored = regress.train_regressor(_stored_daily(spark, sf))
    return rounded(regress.evaluate_regressor(scored))


@query(
    "i13_regression_metrics",
    """SELECT count(*) AS n, round(avg((y_true-y_pred)*(y_true-y_pred)), 6) AS mse, round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))), 6) AS rmse, round(avg(abs(y_true-y_pred)), 6) AS mae,
       round(1e0 - sum((y_true-y_pred)*(y_true-y_pred))/(var_pop(y_true)*count(*)), 6) AS r2 FROM predictions""",
)
def regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(A.predictions(spark, sf)))


@query(
    "i14_regression_extras",
    """, d AS (SELECT *, sign(y_true - lag(y_true) OVER w) AS mt, sign(y_pred - lag(y_pred) OVER w) AS mp FROM predictions WINDOW w AS (PARTITION BY station_code ORDER BY date))
    SELECT round(avg(y_true), 6) AS mean_y_true, round(avg(y_pred), 6) AS mean_y_pred, round(avg(y_pred) - avg(y_true), 6) AS mean_bias, round(corr(y_true, y_pred), 6) AS pearson_r,
      round(1e0 - var_pop(y_true - y_pred)/var_pop(y_true), 6) AS explained_variance, round(100e0*avg(abs((y_true - y_pred)/y_true)) FILTER (abs(y_true) > 0.001), 6) AS mape_pct,
      round(100e0*avg(CASE WHEN abs(y_true - y_pred) <= 5 THEN 1e0 ELSE 0e0 END), 6) AS within_5_pct,
      round(count(*) FILTER (mt <> 0 AND mt = mp)/CAST(count(*) FILTER (mt <> 0) AS DOUBLE), 6) AS direction_step_accuracy, round(median(abs(y_true - y_pred)), 6) AS median_ae FROM d""",
)
def regression_extras(spark, sf):
    return rounded(metrics.regression_extras(A.predictions(spark, sf)))


@query(
    "i15_clean_class_metrics",
    """, c AS (SELECT count(*) FILTER (y_true >= 81 AND y_pred >= 81) AS tp, count(*) FILTER (y_true < 81 AND y_pred >= 81) AS fp,
       count(*) FILTER (y_true >= 81 AND y_pred < 81) AS fn, count(*) FILTER (y_true < 81 AND y_pred < 81) AS tn FROM predictions)
    SELECT tp, fp, fn, tn, round((tp + tn)/CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(tp/CAST(tp + fp AS DOUBLE), 6) AS precision_clean,
      round(tp/CAST(tp + fn AS DOUBLE), 6) AS recall_clean, round(2e0*tp/(2*tp + fp + fn), 6) AS f1_clean FROM c""",
)
def clean_class_metrics(spark, sf):
    return rounded(metrics.clean_class_metrics(A.predictions(spark, sf)))


@query(
    "i16_improvement_over_baseline",
    """, b AS (SELECT y_true, y_pred, coalesce(lag(y_true) OVER (PARTITION BY station_code ORDER BY date), y_true) AS y_b FROM predictions),
    s AS (SELECT sqrt(avg((y_true-y_pred)*(y_true-y_pred))) AS rmse, avg(abs(y_true-y_pred)) AS mae, sqrt(avg((y_true-y_b)*(y_true-y_b))) AS brmse, avg(abs(y_true-y_b)) AS bmae FROM b)
    SELECT round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(brmse, 6) AS baseline_rmse, round(bmae, 6) AS baseline_mae,
      round(100e0*(brmse - rmse)/brmse, 6) AS rmse_gain_pct, round(100e0*(bmae - mae)/bmae, 6) AS mae_gain_pct FROM s""",
)
def improvement_over_baseline(spark, sf):
    previous = F.coalesce(F.lag("y_true").over(series.by_day()), F.col("y_true"))
    return rounded(metrics.improvement_over_baseline(A.predictions(spark, sf).withColumn("y_baseline", previous)))


@query("i17_isolation_forest")
def isolation_forest(spark, sf):
    rows = _stored_daily(spark, sf)
    scored = isolation.fit(rows).score(rows)
    return scored.groupBy("anomaly_label").agg(F.count("*").alias("n"), F.round(F.avg("wqi"), 3).alias("avg_wqi"))


@query("i18_detected_anomalies")
def detected_anomalies(spark, sf):
    from hydrolake.operators.alerts import anomaly_records

    rows = _stored_daily(spark, sf)
    scored = isolation.fit(rows, contamination=0.02).score(rows.withColumn("station_name", F.lit(None).cast("string")))
    return rounded(anomaly_records(scored))


def _wqi_series(spark, sf):
    return materialize(A.readings(spark, sf).select("station_code", "date", "wqi"), "series")


@query("i19_forecaster")
def forecaster(spark, sf):
    _, scored = forecast.fit(_wqi_series(spark, sf))
    return rounded(forecast.metrics_per_step(scored))


@query("i19_forecaster_with_extras")
def forecaster_with_extras(spark, sf):
    settings = forecast.Settings(add_month=True, extra=("do_", "ph", "an"), differences=True)
    rows = materialize(_daily(spark, sf).select("station_code", "date", "wqi", *settings.extra), "series")
    _, scored = forecast.fit(rows, settings)
    return rounded(forecast.forecast_metrics(scored))


@query("i20_rollout")
def rollout(spark, sf):
    past = _wqi_series(spark, sf).filter(F.col("date") <= F.lit(A.AS_OF))
    model, _ = forecast.fit(past)
    return forecast.rollout_until(model, past, A.AS_OF + timedelta(days=1), A.END)


@query("i21_next_days")
def next_days(spark, sf):
    past = _wqi_series(spark, sf).filter(F.col("date") <= F.lit(A.AS_OF))
    model, _ = forecast.fit(past)
    return forecast.next_days(model, past, 30)


@query("i22_forecast_run")
def forecast_run(spark, sf):
    past = _wqi_series(spark, sf).filter(F.col("date") <= F.lit(A.AS_OF))
    model, _ = forecast.fit(past)
    path = new_path(spark, "records")
    run = training.run_forecast(model, past, A.AS_OF, A.AS_OF + timedelta(days=1), A.END, records_path=path)
    stored = spark.read.parquet(path).groupBy("station_code").agg(F.count("*").alias("stored_rows"))
    logged = run.log.select("station_code", "n_points")
    first = run.alerts.select("station_code", F.col("date").alias("first_alert"))
    return stored.join(logged, "station_code").join(first, "station_code", "left")


@query("i23_configuration_sweep")
def configuration_sweep(spark, sf):
    settings = forecast.Settings(extra=("do_", "ph", "an"))
    rows = materialize(_daily(spark, sf).select("station_code", "date", "wqi", *settings.extra), "series")
    results, _ = forecast.run_sweep(rows)
    return rounded(results)


@query("i24_train_all")
def train_all(spark, sf):
    trained = training.train_all(A.measurements(spark, sf, with_nulls=True), year_to=A.CUTOFF)
    path = new_path(spark, "metrics")
    write_metrics(trained.metrics, path)
    return rounded(spark.read.schema("section string, metric string, value double").json(path))


@query("i25_evaluate_stored_model")
def evaluate_stored_model(spark, sf):
    split = splits.random_split(_stored_daily(spark, sf), ["station_code", "date"])
    path = new_path(spark, "classifier")
    train = split.filter("split = 'train'")
    classify.fit_forest(metrics.labelled(train), classify.select_features(train)).save(path)
    return rounded(training.evaluate_classifier(spark, path, split.filter("split = 'test'").drop("split")))


@query(
    "i25_evaluate_stored_regressor",
    """SELECT count(*) AS n, round(avg(CASE WHEN an >= 0.5 THEN 80e0 ELSE 20e0 END), 6) AS mean_y_true, TRUE AS explains, TRUE AS near FROM daily""",
)
def evaluate_stored_regressor(spark, sf):
    """A regressor of a step of one column, stored, read again and evaluated from its folder."""
    rows = _stored_daily(spark, sf).withColumn("wqi", F.when(F.col("an") >= 0.5, 80.0).otherwise(20.0))
    path = new_path(spark, "regressor")
    regress.fit_regressor(rows, trees=60).write().save(path)
    found = training.evaluate_regressor(path, rows)
    mean = rows.agg(F.round(F.avg("wqi"), 6).alias("mean_y_true"))
    return found.select("n", (F.col("r2") > 0.8).alias("explains"), (F.col("mae") < 10).alias("near")).withColumn("mean_y_true", F.lit(mean.first()[0]))


@query("i26_model_round_trip", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM readings")
def model_round_trip(spark, sf):
    rows = _stored_daily(spark, sf)
    path = new_path(spark, "forest")
    fitted = isolation.fit(rows)
    fitted.save(spark, path)
    again = isolation.IsolationForest.load(spark, path)
    before = fitted.score(rows).select("station_code", "date", F.col("score").alias("before"))
    both = before.join(again.score(rows).select("station_code", "date", "score"), ["station_code", "date"])
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("before") - F.col("score")) > 1e-12).alias("n_different"))


# Two stations are thinned out, so that there is something to add; the others stay whole.
_SHORT = "station_code > 'S02' OR date >= DATE '2001-10-01'"


@query(
    "i27_augment",
    f"SELECT station_code, greatest(count(*), 120) AS n, round(min(0e0), 1) AS below_zero FROM readings WHERE {_SHORT} GROUP BY 1",
)
def augment(spark, sf):
    short = A.readings(spark, sf).filter(F.expr(_SHORT)).select("station_code", "date", "wqi")
    out = forecast.augment(short, min_rows=120)
    return out.groupBy("station_code").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("wqi") < 0, 1.0).otherwise(0.0)).alias("below_zero")
    )


@query("i28_enhancement_flow")
def enhancement_flow(spark, sf):
    rows = _stored_daily(spark, sf).withColumn("station_name", F.col("station_code"))
    flow = training.enhance(rows.filter(F.col("date") <= F.lit(A.AS_OF)), days=14)
    return flow.alerts.groupBy("alert_type", "severity").agg(F.count("*").alias("n"))


# --- J: composite jobs ---------------------------------------------------------------


_R7 = "OVER (PARTITION BY station_code ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(
    "j01_preprocess",
    f""", l AS (SELECT *, {lag_sql(1)} AS l1, {lag_sql(14)} AS l14, avg(wqi) {_R7} AS rm FROM cleaned),
    f AS (SELECT station_code, date, wqi, cod, rm, {fill_sql('l1')} AS f1, {fill_sql('l14')} AS f14, {band('wqi')} AS river_status FROM l),
    m AS (SELECT min(wqi) AS w0, max(wqi) AS w1, min(cod) AS c0, max(cod) AS c1, min(rm) AS r0, max(rm) AS r1, min(f1) AS a0, max(f1) AS a1, min(f14) AS b0, max(f14) AS b1 FROM f)
    SELECT station_code, date, river_status, round((wqi - w0)/(w1 - w0), 6) AS wqi, round((cod - c0)/(c1 - c0), 6) AS cod, round((rm - r0)/(r1 - r0), 6) AS wqi_rolling_mean,
      round((f1 - a0)/(a1 - a0), 6) AS wqi_lag_1, round((f14 - b0)/(b1 - b0), 6) AS wqi_lag_14 FROM f, m""",
)
def preprocess(spark, sf):
    out = preprocessing.preprocess(A.measurements(spark, sf, with_nulls=True))
    return rounded(
        out.select("station_code", "date", "river_status", "wqi", "cod", "wqi_rolling_mean", "wqi_lag_1", "wqi_lag_14")
    )


@query(
    "j02_prepare_training",
    """, n AS (SELECT count(*) AS n FROM cleaned), r AS (SELECT count(*) AS raw FROM measurements)
    SELECT 'raw' AS stage, raw AS n FROM r UNION ALL SELECT 'clean', n FROM n UNION ALL SELECT 'imputed', n FROM n
    UNION ALL SELECT 'test', greatest(1, CAST(floor(n*0.2e0) AS BIGINT)) FROM n UNION ALL SELECT 'train', n - greatest(1, CAST(floor(n*0.2e0) AS BIGINT)) FROM n""",
)
def prepare_training(spark, sf):
    made = preprocessing.prepare_training(A.measurements(spark, sf, with_nulls=True))
    stages = spark.createDataFrame([(k,) for k in ("raw", "clean", "imputed")], "stage string")
    early = stages.withColumn("n", F.when(F.col("stage") == "raw", made.counts["raw"]).when(F.col("stage") == "clean", made.counts["clean"]).otherwise(made.counts["imputed"]).cast("long"))
    return early.unionByName(made.rows.groupBy(F.col("split").alias("stage")).agg(F.count("*").alias("n")))


@query(
    "j02_scaled_training_rows",
    f""", m AS (SELECT min(wqi) AS w0, max(wqi) AS w1, min(cod) AS c0, max(cod) AS c1 FROM cleaned),
    o AS (SELECT *, row_number() OVER (ORDER BY date, station_code) AS pos, count(*) OVER () AS n FROM cleaned)
    SELECT station_code, date, round((wqi - w0)/(w1 - w0), 6) AS wqi, round((cod - c0)/(c1 - c0), 6) AS cod,
      CASE WHEN pos > n - greatest(1, CAST(floor(n*0.2e0) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM o, m""",
)
def scaled_training_rows(spark, sf):
    tie = F.substring("station_code", 2, 2).cast("int")
    made = preprocessing.prepare_training(A.measurements(spark, sf, with_nulls=True), tie=tie)
    return rounded(made.rows.select("station_code", "date", "wqi", "cod", "split"))


_UPLOAD = f""", late AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, date ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn
    FROM holed WHERE l_linenumber > 4) WHERE rn = 1),
  lm AS (SELECT median(cod) AS mc, median(tss) AS mt FROM late),
  up AS (SELECT l.* REPLACE (coalesce(cod, mc) AS cod, coalesce(tss, mt) AS tss) FROM late l, lm),
  new AS (SELECT station_code, date, {WQI_SQL} AS wqi FROM up WHERE year(date) <= 2000)
"""


@query(
    "j03_ingest_upload",
    _UPLOAD
    + """SELECT station_code, date, round(wqi, 6) AS wqi, 9 AS dataset_id FROM new
    UNION ALL SELECT station_code, date, round(wqi, 6), 1 FROM readings r WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.station_code = r.station_code AND n.date = r.date)""",
)
def ingest_upload(spark, sf):
    base = A.readings(spark, sf).select("station_code", "station_name", "river_name", "date", "wqi", "river_status")
    upload = A.measurements(spark, sf, with_nulls=True).filter("_ord.l_linenumber > 4")
    merged = preprocessing.ingest_upload(
        upload, base.withColumn("dataset_id", F.lit(1).cast("long")), new_path(spark, "records"), 9, "csv_upload:late.csv", A.CUTOFF
    )
    return rounded(merged.select("station_code", "date", "wqi", F.col("dataset_id").cast("int").alias("dataset_id")))


@query(
    "j04_rebuild_readings",
    """, a AS (SELECT *, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS dataset_id FROM measurements WHERE year(date) <= 2000)
    SELECT station_code, date, max(dataset_id) AS dataset_id FROM a GROUP BY ALL""",
)
def rebuild_readings(spark, sf):
    rows = A.measurements(spark, sf)
    sheets = [(2, rows.filter("_ord.l_linenumber > 3")), (1, rows.filter("_ord.l_linenumber <= 3"))]
    out = preprocessing.rebuild_readings(sheets, A.CUTOFF)
    return out.select("station_code", "date", F.col("dataset_id").cast("int").alias("dataset_id"))




_SHEETS = f""", dealt AS (SELECT *, l_orderkey % 12 AS dataset_id FROM holed),
  sheet AS (SELECT * EXCLUDE (rn) REPLACE (CASE WHEN dataset_id % 4 = 2 THEN NULL ELSE cod END AS cod) FROM
    (SELECT *, row_number() OVER (PARTITION BY dataset_id, station_code, date ORDER BY {ORD}) AS rn FROM dealt) WHERE rn = 1 AND dataset_id < 11),
  fitted AS (SELECT * REPLACE (coalesce(cod, median(cod) OVER g) AS cod, coalesce(tss, median(tss) OVER g) AS tss) FROM sheet WINDOW g AS (PARTITION BY dataset_id)),
  scored AS (SELECT *, CASE WHEN dataset_id % 4 = 3 THEN CAST(l_quantity AS DOUBLE) ELSE {WQI_SQL} END AS wqi
    FROM (SELECT f.*, l.l_quantity FROM fitted f JOIN lineitem l USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)) WHERE year(date) <= 2000)
"""


def _write_sheets(spark, sf):
    """Twelve datasets in four layouts: plain; export headers; other order without COD; with a supplied index."""
    root = new_path(spark, "sheets")
    rows = A.measurements(spark, sf, with_nulls=True).withColumn("dataset", F.col("_ord.l_orderkey") % 12)
    rows = cleaning.dedup(rows, ["dataset", "station_code", "date"], [F.asc("_ord")])
    plain = ["date", "station_code", "do_", "bod", "cod", "an", "tss", "ph"]
    layouts = [
        [F.col(c) for c in plain],
        [F.col("station_code").alias("ID STN BARU"), F.col("do_").alias("DO mg/l"), F.col("bod").alias("BOD mg/l"), F.col("cod").alias("COD mg/l"),
         F.col("an").alias("NH3-N mg/l"), F.col("tss").alias("SS mg/l"), F.col("ph").alias("pH"), F.lit("x, y").alias("REMARKS"), F.col("date").alias("SMP-DAT")],
        [F.col(c) for c in ("tss", "ph", "an", "station_code", "bod", "do_", "date")],
        [*[F.col(c) for c in plain], F.round(F.col("do_") * 5).alias("WQI")],
    ]
    for style, columns in enumerate(layouts):
        part = rows.filter(F.col("dataset") % 4 == style).select("dataset", *columns)
        part.write.partitionBy("dataset").option("header", True).csv(f"{root}/layout {style}")
    listed = monitoring.list_files(spark, root)
    dataset = F.regexp_extract("file_path", "dataset=([0-9]+)", 1).cast("long")
    # The registry has plain paths, without a scheme; one dataset is not registered.
    return root, listed.select(dataset.alias("dataset_id"), sheets.plain_path(F.col("file_path")).alias("file_path")).filter("dataset_id < 11")


@query(
    "j04_rebuild_registry",
    _SHEETS
    + """SELECT station_code, date, max(dataset_id) AS dataset_id, round(max_by(wqi, dataset_id), 6) AS wqi FROM scored GROUP BY ALL""",
)
def rebuild_registry(spark, sf):
    root, registry = _write_sheets(spark, sf)
    return rounded(preprocessing.rebuild_from_registry(spark, registry, root, A.CUTOFF).select("station_code", "date", "dataset_id", "wqi"))
