"""Model metrics as aggregates; results are one row, or one row per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.constants import CLEAN_MIN, STATUSES
from hydrolake.functions.wqi import status_key
from hydrolake.operators.quantiles import exact_quantiles


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(0.0)


def encode_label(c: Column | str) -> Column:
    """Position of the cleaned-up status text in the fixed class order; NULL when invalid."""
    text = status_key(F.col(c).cast("string") if isinstance(c, str) else c)
    code = F.lit(None).cast("int")
    for i, name in enumerate(STATUSES):
        code = F.when(text == name, i).otherwise(code)
    return code


def labelled(df: DataFrame, target: str = "river_status") -> DataFrame:
    """Add the numeric ``label``; rows with an invalid status are dropped."""
    return df.withColumn("label", encode_label(target)).filter(F.col("label").isNotNull())


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class that occurs on either side."""
    n = F.col("n")
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("class"), n.alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")),
    )
    totals = (
        confusion(df, label, prediction)
        .select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )
    return (
        totals.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy with weighted and macro precision, recall and F1."""

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    return class_report(df, label, prediction).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def regression_aggregates(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    err = F.col(y) - F.col(p)
    total = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when(total >= 1e-20, 1.0 - F.sum(err * err) / total).alias("r2"),
    ]


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MSE, RMSE, MAE and R2 against the mean of the evaluated rows (NULL without variance)."""
    return df.agg(*regression_aggregates(y, p))


def regression_extras(
    df: DataFrame, y: str = "y_true", p: str = "y_pred", sequence: str = "station_code", step: str = "date"
) -> DataFrame:
    """Bias, correlation, explained variance, MAPE, median error, share within 5
    points, and how often consecutive steps of a sequence move the same way.

    ``sequence``/``step`` name the bounded series whose steps are compared.
    """
    w = Window.partitionBy(sequence).orderBy(step)
    err = F.col(y) - F.col(p)
    moved = F.signum(F.col(y) - F.lag(y).over(w))
    followed = F.signum(F.col(p) - F.lag(p).over(w))
    rows = df.select(
        F.col(y).alias("y"), F.col(p).alias("p"), err.alias("err"), moved.alias("moved"), followed.alias("followed")
    )
    varies = (F.stddev_pop("y") > 1e-12) & (F.stddev_pop("p") > 1e-12)
    usable = F.abs("y") > 1e-3
    direction = F.count_if((F.col("moved") != 0) & (F.col("moved") == F.col("followed"))) / F.nullif(
        F.count_if(F.col("moved") != 0), F.lit(0)
    )
    main = rows.agg(
        F.avg("y").alias("mean_y_true"),
        F.avg("p").alias("mean_y_pred"),
        (F.avg("p") - F.avg("y")).alias("mean_bias"),
        F.when(varies, F.corr("y", "p")).alias("pearson_r"),
        F.when(F.var_pop("y") > 1e-20, 1.0 - F.var_pop("err") / F.var_pop("y")).alias("explained_variance"),
        (100.0 * F.avg(F.when(usable, F.abs(F.col("err") / F.col("y"))))).alias("mape_pct"),
        (100.0 * F.avg(F.when(F.abs("err") <= 5.0, 1.0).otherwise(0.0))).alias("within_5_pct"),
        direction.alias("direction_step_accuracy"),
    )
    median = exact_quantiles(df, {"m": (F.abs(err), 0.5)})["m"]
    return main.withColumn("median_ae", F.lit(median).cast("double"))


def clean_class_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", threshold: float = CLEAN_MIN) -> DataFrame:
    """Familiar classification numbers for 'index is at least ``threshold``'."""
    t, q = F.col(y) >= threshold, F.col(p) >= threshold
    counts = df.agg(
        F.count_if(t & q).alias("tp"),
        F.count_if(~t & q).alias("fp"),
        F.count_if(t & ~q).alias("fn"),
        F.count_if(~t & ~q).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision_clean", _ratio(tp, tp + fp))
        .withColumn("recall_clean", _ratio(tp, tp + fn))
        .withColumn(
            "f1_clean",
            _ratio(
                2.0 * F.col("precision_clean") * F.col("recall_clean"),
                F.col("precision_clean") + F.col("recall_clean"),
            ),
        )
    )


def improvement_over_baseline(
    df: DataFrame, y: str = "y_true", p: str = "y_pred", baseline: str = "y_baseline"
) -> DataFrame:
    """RMSE and MAE of model and baseline on the same rows, and the gain in percent."""
    e, b = F.col(y) - F.col(p), F.col(y) - F.col(baseline)
    scores = df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(b * b)).alias("baseline_rmse"),
        F.avg(F.abs(b)).alias("baseline_mae"),
    )

    def gain(m: str) -> Column:
        base = F.col(f"baseline_{m}")
        return F.when(base > 1e-12, 100.0 * (base - F.col(m)) / base).otherwise(0.0)

    return scores.withColumn("rmse_gain_pct", gain("rmse")).withColumn("mae_gain_pct", gain("mae"))


def verdict(metrics: DataFrame) -> DataFrame:
    """Plain-words rating of a regression row."""
    good = (F.col("rmse") < 5) & (F.col("mae") < 4)
    moderate = (F.col("rmse") < 10) & (F.col("mae") < 8)
    return metrics.withColumn(
        "verdict", F.when(good, "good").when(moderate, "moderate").otherwise("needs improvement")
    )

