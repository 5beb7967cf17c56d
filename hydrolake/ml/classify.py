"""River-status classification with a distributed random forest."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.constants import LEAKY_TOKENS, PARAMETERS, STATUSES
from hydrolake.operators.metrics import classification_metrics, labelled
from hydrolake.operators.splits import SEED, fold_count, group_folds, group_split, random_split, stratified_folds
from hydrolake.sources.shared import materialize

GROUP_COLUMNS = ("station_code", "station_name", "river_name")
NON_FEATURES = {"river_status", "date", "station_code", "station", "station_name", "river_name"}
#: Rows of a partition of a training table, and partitions at least. Trees depend on how rows are dealt, so
#: the table alone decides it, not the cluster; each partition holds the statistics of all nodes of a level.
TRAIN_ROWS, LEAST_PARTITIONS = 250_000, 4
#: Memory for the statistics of the nodes that one pass over the rows splits, in a task.
LEVEL_MB = 256
NUMERIC = ("double", "float", "long", "integer", "short")


def select_features(df: DataFrame) -> list[str]:
    """Raw parameters when there are any; else numeric columns whose names do not
    hint at something derived from the target. Schema only."""
    raw = [p for p in PARAMETERS if p in df.columns]
    if raw:
        return raw
    return [
        f.name
        for f in df.schema.fields
        if f.name not in NON_FEATURES
        and f.dataType.typeName() in NUMERIC
        and not any(t in f.name.lower() for t in LEAKY_TOKENS)
    ]


def anomaly_features(df: DataFrame) -> list[str]:
    """Index and raw parameters when present, else every numeric column."""
    preferred = [c for c in ("wqi", *PARAMETERS) if c in df.columns]
    return preferred or [
        f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC and f.name not in ("date", "station_code")
    ]


def group_column(df: DataFrame) -> str | None:
    """Column that keeps a station on one side of a split; None for a single group."""
    found = next((c for c in GROUP_COLUMNS if c in df.columns), None)
    if found is None or df.select(found).distinct().limit(2).count() < 2:
        return None
    return found


def balanced_weight(counts: dict, label: str = "label") -> Column:
    """n / (classes * n_class) as an expression over the few class counts."""
    total, weight = sum(counts.values()), F.lit(1.0)
    for c, n in counts.items():
        weight = F.when(F.col(label) == c, total / (len(counts) * n)).otherwise(weight)
    return weight


def training_partitions(rows: int) -> int:
    return max(LEAST_PARTITIONS, -(-rows // TRAIN_ROWS))


def dealt(df: DataFrame, key: Sequence[str], partitions: int) -> DataFrame:
    """Rows dealt to a fixed number of partitions by a hash of ``key`` and put in its order,
    so that the same rows and seed give the same trees on every cluster."""
    columns = [c for c in df.columns if c not in key and c != "_deal"]
    marked = df.withColumn("_deal", F.xxhash64(*key))
    return marked.repartition(partitions, "_deal").sortWithinPartitions("_deal", *key, *columns).drop("_deal")


def fill_zero(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


@dataclass(frozen=True)
class StatusClassifier:
    """Fitted forest with the feature list it expects."""

    model: PipelineModel
    features: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (class position) and ``predicted_status``."""
        scored = self.model.transform(fill_zero(df, self.features))
        names = F.array(*[F.lit(s) for s in STATUSES])
        return scored.withColumn(
            "predicted_status", F.element_at(names, F.col("prediction").cast("int") + 1)
        ).drop("features", "rawPrediction", "probability")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        meta = json.dumps({"features": self.features, "classes": list(STATUSES)})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StatusClassifier:
        meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
        return cls(PipelineModel.load(f"{path}/model"), meta["features"])


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    trees: int = 150,
    depth: int = 15,
    min_leaf: int = 5,
    seed: int = SEED,
    key: Sequence[str] = ("station_code", "date"),
    partitions: int | None = None,
) -> StatusClassifier:
    """Fit on rows that carry ``label``; classes are weighted to equal shares."""
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}  # one row per class
    weighted = fill_zero(train, features).withColumn("weight", balanced_weight(counts))
    key = [c for c in key if c in weighted.columns] or list(features)
    weighted = dealt(weighted.select(*dict.fromkeys([*key, *features, "label", "weight"])), key, partitions or training_partitions(sum(counts.values())))
    forest = RandomForestClassifier(
        labelCol="label",
        featuresCol="features",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        maxMemoryInMB=LEVEL_MB,
        cacheNodeIds=True,
        seed=seed,
    )
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), forest]
    return StatusClassifier(Pipeline(stages=stages).fit(weighted), list(features))


def train_classifier(
    df: DataFrame,
    target: str = "river_status",
    test: float = 0.2,
    key: Sequence[str] = ("station_code", "date"),
    seed: int = SEED,
    **forest,
) -> tuple[StatusClassifier, DataFrame]:
    """Split (whole stations when there are several, else stratified), fit, and
    return the model with its scored test rows (``label``, ``prediction``)."""
    features = select_features(df)
    if not features:
        raise ValueError("no feature columns")
    rows = labelled(df, target)
    group = group_column(rows)
    split = group_split(rows, group, test, seed) if group else random_split(rows, key, test, "label", seed)
    model = fit_forest(split.filter("split = 'train'"), features, seed=seed, **forest)
    return model, model.predict(split.filter("split = 'test'"))


def cross_validate(
    df: DataFrame,
    target: str = "river_status",
    folds: int = 5,
    key: Sequence[str] = ("station_code", "date"),
    seed: int = SEED,
    parallelism: int = 3,
    **forest,
) -> DataFrame:
    """Accuracy per fold. Stations never straddle folds, and there are at most as
    many folds as stations or rows of the rarest class. The folded features are stored
    once, and ``parallelism`` folds are fitted at a time."""
    features = select_features(df)
    rows = labelled(df, target)
    group = group_column(rows)
    smallest = rows.groupBy("label").count().agg(F.min("count")).first()[0]
    if group:
        groups = rows.select(group).distinct().count()
        folded, k = group_folds(rows, group, fold_count(groups, smallest, folds), seed)
    else:
        folded, k = stratified_folds(rows, key, "label", folds, seed)
    spark = df.sparkSession
    kept = [c for c in dict.fromkeys([*key, *features, "label", "fold"]) if c in folded.columns]
    stored = materialize(fill_zero(folded, features).select(*kept), "folds")

    def one(i: int) -> tuple[int, int, float] | None:
        model = fit_forest(stored.filter(F.col("fold") != i), features, seed=seed, key=key, **forest)
        row = classification_metrics(model.predict(stored.filter(F.col("fold") == i))).first()
        return (i, row["n"], row["accuracy"]) if row["n"] else None

    # Folds are fitted side by side: the levels of one forest leave cores idle that another can use.
    with ThreadPool(min(parallelism, k)) as pool:
        scores = pool.map(inheritable_thread_target(spark)(one), range(k))
    return spark.createDataFrame([s for s in scores if s], "fold int, n long, accuracy double")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.coalesce(F.stddev_pop("accuracy"), F.lit(0.0)).alias("std_accuracy"),
        F.count("*").alias("folds"),
    )
