"""Multi-horizon index forecaster.

One ridge regression per horizon step, pooled over all stations, on the last
``length`` index values plus lags, season and optional raw parameters of the
newest row. Training is one pass over a stored sample table that sums products
for all steps at once; the roll-out is one vectorised pass with one row per
station, so neither depends on how many rows a station has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.constants import MODEL_LAGS, NE_MONSOON_MONTHS, STATUS_LABELS, SW_MONSOON_MONTHS
from hydrolake.functions.rivers import river_of_station
from hydrolake.functions.wqi import status
from hydrolake.operators import metrics
from hydrolake.operators.series import (
    STATION,
    by_day,
    first_differences,
    integrate_differences,
    last_rows,
    model_feature_names,
    model_frame,
    pad_history,
)
from hydrolake.operators.splits import hash52, time_split
from hydrolake.sources.shared import materialize

@dataclass(frozen=True)
class Settings:
    length: int = 30
    horizon: int = 7
    add_month: bool = False
    extra: tuple[str, ...] = ()
    differences: bool = False
    ridge: float = 0.1
    test: float = 0.2
    val: float = 0.1
    #: Rows that a station needs beyond one sample to be trained on; ``short_stations`` lists the others.
    extra_rows: int = 10

    @property
    def features(self) -> list[str]:
        return model_feature_names(self.add_month, self.extra)


@dataclass(frozen=True)
class Forecaster:
    """Weights per horizon step: ``length`` window values, then the other features of the newest row."""

    settings: Settings
    weights: list[list[float]] = field(repr=False)
    intercepts: list[float] = field(repr=False)

    def to_json(self) -> str:
        return json.dumps({"settings": asdict(self.settings), "weights": self.weights, "intercepts": self.intercepts})

    @classmethod
    def from_json(cls, text: str) -> Forecaster:
        raw = json.loads(text)
        raw["settings"]["extra"] = tuple(raw["settings"]["extra"])
        return cls(Settings(**raw["settings"]), raw["weights"], raw["intercepts"])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecaster:
        return cls.from_json(spark.read.text(path).first().value)


def short_stations(df: DataFrame, s: Settings) -> DataFrame:
    """Stations with too few rows to be trained on, and their number of rows."""
    return df.groupBy(STATION).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") < s.length + s.horizon + s.extra_rows)


def samples(df: DataFrame, s: Settings) -> DataFrame:
    """Training samples of a daily series with ``split``; those of ``short_stations`` are left out."""
    short = short_stations(df, s).select(STATION)
    kept = df.join(short, STATION, "left_anti")
    # Only the index is taken from all rows of a sample; the other features are those of its newest row.
    value = F.coalesce(F.col("wqi").cast("double"), F.lit(0.0))
    rest = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in s.features[1:]])
    w = by_day()
    windows = model_frame(kept, s.add_month, s.extra).select(
        STATION,
        "date",
        (F.row_number().over(w) - s.length).alias("sample_index"),
        value.alias("anchor"),
        F.collect_list(value).over(w.rowsBetween(-(s.length - 1), 0)).alias("walk"),
        rest.alias("rest"),
        F.collect_list(value).over(w.rowsBetween(1, s.horizon)).alias("targets"),
    )
    whole = windows.filter((F.size("walk") == s.length) & (F.size("targets") == s.horizon))
    return time_split(
        whole.select(STATION, "sample_index", "date", "anchor", "targets", F.concat("walk", "rest").alias("x")), s.test, s.val, "sample_index"
    )


#: Tasks' sums are added in as many groups before the driver adds those.
SUM_GROUPS = 64


def moments(df: DataFrame, x: str, y: str, width: int, height: int) -> np.ndarray:
    """Sums of all products of (1, x, y) over the rows: one matrix a task, added up in Spark."""
    size = 1 + width + height

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                m = np.column_stack([np.ones(len(pdf)), np.array(pdf[x].tolist()), np.array(pdf[y].tolist())])
                total += m.T @ m
        yield pd.DataFrame({"sums": [total.ravel()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum(pdf["sums"].tolist(), axis=0)]})

    parts = df.select(x, y).mapInPandas(products, "sums array<double>").withColumn("part", F.spark_partition_id() % SUM_GROUPS)
    rows = parts.groupBy("part").applyInPandas(add, "sums array<double>").collect()
    return np.sum([r["sums"] for r in rows] or [np.zeros(size * size)], axis=0).reshape(size, size)


def ridge(sums: np.ndarray, width: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (one column per target) and intercepts of ridge regressions on standardised columns.

    Features and targets are divided by their deviations; a target's penalty
    is ``penalty`` over its deviation. Constant features get no weight.
    """
    n = sums[0, 0]
    mean = sums[0] / n
    cov = sums / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    used = np.flatnonzero(dev[1 : 1 + width] > 1e-9) + 1
    weights, intercepts = np.zeros((width, len(mean) - 1 - width)), np.zeros(len(mean) - 1 - width)
    corr = cov[np.ix_(used, used)] / np.outer(dev[used], dev[used])
    for h, t in enumerate(range(1 + width, len(mean))):
        if dev[t] > 1e-12 and len(used):
            right = cov[used, t] / (dev[used] * dev[t])
            weights[used - 1, h] = np.linalg.solve(corr + penalty / dev[t] * np.eye(len(used)), right) * dev[t] / dev[used]
        intercepts[h] = mean[t] - mean[1 : 1 + width] @ weights[:, h]
    return weights, intercepts


def fit(df: DataFrame, settings: Settings = Settings()) -> tuple[Forecaster, DataFrame]:
    """Returns the model and the scored test samples (``y_true``, ``y_pred``, ``y_baseline`` arrays)."""
    table = materialize(samples(df, settings), "samples")
    target = first_differences("anchor", "targets") if settings.differences else F.col("targets")
    width = settings.length + len(settings.features) - 1
    sums = moments(table.filter("split = 'train'").select("x", target.alias("y")), "x", "y", width, settings.horizon)
    if not sums[0, 0]:
        raise ValueError("no station is long enough to train on")
    found, base = ridge(sums, width, settings.ridge)
    weights, intercepts = found.T.tolist(), base.tolist()

    def predict(w: list[float], b: float):
        products = F.zip_with("x", F.array(*map(F.lit, w)), lambda v, c: v * c)
        return F.aggregate(products, F.lit(b), lambda total, p: total + p)

    predicted = F.array(*[predict(w, b) for w, b in zip(weights, intercepts)])
    scored = table.filter("split = 'test'").select("*", F.inline(F.array(F.struct(predicted.alias("_p")))))
    predicted = F.col("_p")
    scored = scored.select(
        STATION,
        "sample_index",
        "date",
        F.col("targets").alias("y_true"),
        (integrate_differences("anchor", predicted) if settings.differences else predicted).alias("y_pred"),
        F.array_repeat("anchor", settings.horizon).alias("y_baseline"),
    )
    return Forecaster(settings, weights, intercepts), scored


def long_form(scored: DataFrame) -> DataFrame:
    """One row per sample and horizon step; ``sample`` identifies the sequence of steps."""
    steps = F.posexplode(F.arrays_zip("y_true", "y_pred", "y_baseline")).alias("step", "v")
    sample = F.concat_ws("|", STATION, "sample_index").alias("sample")
    return scored.select(STATION, sample, steps).select(STATION, "sample", "step", "v.*")


def forecast_metrics(scored: DataFrame) -> DataFrame:
    """One row: regression metrics, persistence and the gain over it, bias and correlation."""
    rows = long_form(scored)
    e, b = F.col("y_true") - F.col("y_pred"), F.col("y_true") - F.col("y_baseline")
    out = rows.agg(
        *metrics.regression_aggregates(),
        F.sqrt(F.avg(b * b)).alias("baseline_rmse"),
        F.avg(F.abs(b)).alias("baseline_mae"),
        F.corr("y_true", "y_pred").alias("pearson_r"),
        F.avg(-e).alias("mean_bias"),
    )
    return out.withColumns(
        {f"{m}_gain_pct": 100.0 * (F.col(f"baseline_{m}") - F.col(m)) / F.nullif(F.col(f"baseline_{m}"), F.lit(0.0)) for m in ("rmse", "mae")}
    )


def forecast_document(scored: DataFrame) -> dict[str, DataFrame]:
    """All metrics of scored samples, a one-row table per section."""
    rows = materialize(long_form(scored), "scored-steps")
    return {
        "forecast": forecast_metrics(scored),
        "forecast_extras": metrics.regression_extras(rows, sequence="sample", step="step"),
        "forecast_clean_class": metrics.clean_class_metrics(rows),
    }


def metrics_per_step(scored: DataFrame) -> DataFrame:
    return long_form(scored).groupBy("step").agg(*metrics.regression_aggregates())


def metrics_per_station(scored: DataFrame) -> DataFrame:
    return long_form(scored).groupBy(STATION).agg(*metrics.regression_aggregates())


# --- roll-out ------------------------------------------------------------------


def _season(days: np.ndarray, add_month: bool) -> np.ndarray:
    month = days.astype("datetime64[M]").astype(int) % 12 + 1
    ne, sw = np.isin(month, NE_MONSOON_MONTHS), np.isin(month, SW_MONSOON_MONTHS)
    columns = [ne, sw, ~(ne | sw)]
    if add_month:
        angle = 2.0 * np.pi * (month - 1.0) / 12.0
        columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns).astype(float)


def _roll(model: Forecaster, walk: list[np.ndarray], last: np.ndarray, start: np.ndarray, extras: np.ndarray, days: int):
    """Forecast ``days`` days for a batch of stations, one horizon chunk at a time.

    ``walk`` holds the recent index values of each station, newest last.
    """
    s = model.settings
    keep = s.length + max(MODEL_LAGS)
    size = np.array([len(v) for v in walk])
    values = np.zeros((len(walk), keep))
    for i, v in enumerate(walk):
        values[i, keep - min(len(v), keep):] = v[-keep:]
    w, b = np.array(model.weights).T, np.array(model.intercepts)
    out, anchor_day = [], last
    while len(out) < days:
        lagged = [np.where(size > n, values[:, -1 - n], 0.0) for n in MODEL_LAGS]
        x = np.column_stack([values[:, -s.length:], *lagged, _season(anchor_day, s.add_month), extras])
        y = x @ w + b
        if s.differences:
            y = values[:, -1:] + np.cumsum(y, axis=1)
        y = np.round(np.clip(y, 0.0, 100.0), 1)[:, : days - len(out)]
        values = np.concatenate([values, y], axis=1)[:, -keep:]
        size = size + y.shape[1]
        out.extend(y.T)
        anchor_day = start + (len(out) - 1)
    return np.column_stack(out)


def rollout(model: Forecaster, history: DataFrame, start: date | None, days: int) -> DataFrame:
    """Daily forecast of ``days`` days per station from ``start`` (or from the day
    after its last reading), clipped to 0..100, one decimal, with status.

    Only the newest rows a model needs are kept per station; each becomes one
    row, and a task rolls a whole Arrow batch of stations forward at once.
    """
    s = model.settings
    need = s.length + max(MODEL_LAGS)
    absent = {c: F.lit(0.0) for c in s.extra if c not in history.columns}
    rows = history.withColumns(absent) if absent else history
    rows = rows.select(STATION, "date", "wqi", *s.extra)
    recent = pad_history(last_rows(rows, need), s.length)
    item = F.struct("date", F.coalesce("wqi", F.lit(0.0)).alias("wqi"))
    newest = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))), F.lit(0.0)) for c in s.extra]
    tails = recent.groupBy(STATION).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda r: r["wqi"]).alias("walk"),  # at most ``need`` rows
        F.max("date").alias("last_date"),
        (F.array(*newest) if newest else F.array().cast("array<double>")).alias("extras"),
    )
    text, first = model.to_json(), None if start is None else np.datetime64(start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = Forecaster.from_json(text)
        for pdf in batches:
            if pdf.empty:
                continue
            last = pd.to_datetime(pdf["last_date"]).to_numpy().astype("datetime64[D]")
            begin = last + 1 if first is None else np.full(len(pdf), first)
            extras = np.array(pdf["extras"].tolist(), dtype=float).reshape(len(pdf), -1)
            y = _roll(fitted, pdf["walk"].tolist(), last, begin, extras, days)
            yield pd.DataFrame({STATION: pdf[STATION], "first_day": begin.astype(object), "levels": list(y)})

    rolled = tails.mapInPandas(run, f"{STATION} string, first_day date, levels array<double>")
    river = river_of_station(STATION)
    return rolled.select(STATION, "first_day", F.posexplode("levels").alias("k", "wqi")).select(
        F.date_add("first_day", F.col("k")).alias("date"),
        STATION,
        river.alias("station_name"),
        river.alias("river_name"),
        "wqi",
        status("wqi").alias("river_status"),
    )


def rollout_until(model: Forecaster, history: DataFrame, start: date, end: date) -> DataFrame:
    if end < start:
        raise ValueError("end must not be before start")
    return rollout(model, history, start, (end - start).days + 1)


def next_days(model: Forecaster, history: DataFrame, days: int) -> DataFrame:
    """Forecast table for the next 7 to 30 days of each station."""
    if not 7 <= days <= 30:
        raise ValueError("days must be in 7..30")
    label = F.col("river_status")
    for code, text in STATUS_LABELS.items():
        label = F.when(F.col("river_status") == code, text).otherwise(label)
    return rollout(model, history, None, days).select(
        STATION, "station_name", "date", F.col("wqi").alias("predicted_wqi"), label.alias("status")
    )


# --- augmentation ----------------------------------------------------------------


def augment(df: DataFrame, min_rows: int = 120, noise: float = 1.2, seed: int = 42) -> DataFrame:
    """Oversample short daily series to ``min_rows`` rows with Gaussian noise on the index.

    Deterministic: which row is repeated and its noise come from hashes of
    (station, copy number). Stations that are long enough stay as they are.
    """
    short = df.groupBy(STATION).agg(F.count("*").alias("_n")).filter(F.col("_n") < min_rows)
    few = df.join(short.select(STATION), STATION, "left_semi")
    placed = few.withColumn("_row", F.row_number().over(Window.partitionBy(STATION).orderBy("date")))
    copies = short.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.lit(min_rows) - F.col("_n")).cast("int"))))
    picked = copies.withColumn("_row", (F.pmod(F.xxhash64(STATION, "_copy", F.lit(seed)), F.col("_n")) + 1).cast("int"))
    scale = float(1 << 52)
    u1 = (hash52([STATION, "_copy"], seed + 1) + 1.0) / (scale + 1.0)
    u2 = hash52([STATION, "_copy"], seed + 2) / scale
    normal = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.lit(float(np.pi)) * u2)
    noisy = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("wqi") + noise * normal))
    extra = picked.join(placed, [STATION, "_row"]).withColumn("wqi", noisy).select(*df.columns)
    return df.unionByName(extra)


def sweep_settings(base: Settings = Settings(), raw: Sequence[str] = ("do_", "ph", "an")) -> dict[str, list[tuple[str, Settings]]]:
    """One-change-at-a-time variants of a base configuration, grouped by axis."""
    from dataclasses import replace

    return {
        "length": [("length=21", replace(base, length=21)), ("length=60", replace(base, length=60))],
        "add_month": [("add_month", replace(base, add_month=True))],
        "extra": [("extra raw parameters", replace(base, extra=tuple(raw)))],
        "differences": [("first differences", replace(base, differences=True))],
        "ridge": [("ridge=1", replace(base, ridge=1.0))],
    }


def run_sweep(df: DataFrame, base: Settings = Settings(), axes: dict | None = None) -> tuple[DataFrame, Settings]:
    """Fit every variant, combine the best value of each axis, fit that too.

    Returns the result table (best first) and the combined settings. Each score
    is one aggregate row; the loop is over configurations, never over data.
    """
    from dataclasses import replace

    axes = sweep_settings(base) if axes is None else axes
    results = []

    def score(label: str, settings: Settings) -> float:
        row = forecast_metrics(fit(df, settings)[1]).first()
        results.append((label, row.r2, row.rmse, row.mae, row.baseline_rmse, row.n))
        return float("-inf") if row.r2 is None else row.r2

    base_score = score("base", base)
    combined = base
    for axis, variants in axes.items():
        best, best_score = base, base_score
        for label, settings in variants:
            value = score(label, settings)
            if value > best_score:
                best, best_score = settings, value
        combined = replace(combined, **{axis: getattr(best, axis)})
    score("combined", combined)
    spark = df.sparkSession
    schema = "label string, r2 double, rmse double, mae double, baseline_rmse double, n long"
    from hydrolake.operators.marts import rank_experiments

    return rank_experiments(spark.createDataFrame(results, schema)), combined
