"""Explainable index regression: impute, hashed one-hot station, random forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.ml.classify import LEVEL_MB, dealt, training_partitions
from hydrolake.operators.cleaning import fit_imputer, present_parameters
from hydrolake.operators.metrics import regression_metrics, verdict
from hydrolake.operators.splits import SEED, random_split


#: Hash buckets of the station; codes are not listed anywhere, so their number does not matter.
STATION_BUCKETS = 64


def most_frequent(df: DataFrame, column: str) -> str | None:
    """The value in most rows, the smallest of equally frequent ones."""
    found = df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return None if found is None else found[column]


def fit_regressor(
    train: DataFrame,
    target: str = "wqi",
    trees: int = 250,
    depth: int = 12,
    min_leaf: int = 2,
    seed: int = SEED,
    partitions: int | None = None,
) -> PipelineModel:
    """Missing numbers get the column's exact median, missing stations the most frequent one; both
    are stored with the model. Stations are hashed to one-hot features, unknown ones too."""
    numeric = present_parameters(train)
    filled = [f"{c}_filled" for c in numeric]
    values = fit_imputer(train, "median", numeric).values
    shown = [f"coalesce(cast(`{c}` as double), {float(values[c] if values[c] is not None else 0.0)!r}D) AS `{c}_filled`" for c in numeric]
    station = (most_frequent(train, "station_code") or "").replace("\\", "\\\\").replace("'", "\\'")
    shown.append(f"coalesce(station_code, '{station}') AS station_filled")
    fills = SQLTransformer(statement=f"SELECT *, {', '.join(shown)} FROM __THIS__")
    stages = [
        FeatureHasher(inputCols=["station_filled"], outputCol="station_vector", numFeatures=STATION_BUCKETS),
        VectorAssembler(inputCols=[*filled, "station_vector"], outputCol="features"),
        RandomForestRegressor(
            labelCol=target, featuresCol="features", numTrees=trees, maxDepth=depth,
            minInstancesPerNode=min_leaf, maxMemoryInMB=LEVEL_MB, cacheNodeIds=True, seed=seed,
        ),
    ]
    used = [c for c in dict.fromkeys(["station_code", "date", *numeric, target]) if c in train.columns]
    rows = dealt(train.select(*used), [c for c in ("station_code", "date") if c in used], partitions or training_partitions(train.count()))
    return Pipeline(stages=[fills, *stages]).fit(rows)


def train_regressor(
    df: DataFrame, key: Sequence[str] = ("station_code", "date"), test: float = 0.2, seed: int = SEED, **forest
) -> tuple[PipelineModel, DataFrame]:
    """Fit on 80 % of the rows; returns the model and the scored rest (``y_true``, ``y_pred``)."""
    split = random_split(df, key, test, seed=seed)
    model = fit_regressor(split.filter("split = 'train'"), seed=seed, **forest)
    return model, score_regressor(model, split.filter("split = 'test'"))


def score_regressor(model: PipelineModel, df: DataFrame, target: str = "wqi") -> DataFrame:
    return model.transform(df).select(
        "station_code", "date", F.col(target).alias("y_true"), F.col("prediction").alias("y_pred")
    )


def evaluate_regressor(scored: DataFrame) -> DataFrame:
    return verdict(regression_metrics(scored))


def load_regressor(path: str) -> PipelineModel:
    return PipelineModel.load(path)
