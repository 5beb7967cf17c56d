"""Cleaning: typing, validation, dedup and imputation of monitoring tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.constants import PARAMETERS
from hydrolake.operators.grouped_quantiles import grouped_quantiles
from hydrolake.operators.quantiles import exact_quantiles


def present_parameters(df: DataFrame) -> list[str]:
    return [p for p in PARAMETERS if p in df.columns]


def missing_columns(df: DataFrame, required: Sequence[str] = PARAMETERS) -> list[str]:
    """Schema-only check; an empty list means valid."""
    return [c for c in required if c not in df.columns]


def harmonize(df: DataFrame) -> DataFrame:
    """Serving names to canonical names, without touching columns that already exist."""
    renames = {"reading_date": "date", "WQI": "wqi", "pollution_status": "river_status"}
    present = {c.lower() for c in df.columns}
    todo = {old: new for old, new in renames.items() if old in df.columns and (new not in present or old.lower() == new)}
    return df.withColumnsRenamed(todo)


def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text to double; text that is no number and NaN both become NULL."""
    out = {}
    for c in cols if cols is not None else present_parameters(df):
        x = F.col(c).try_cast("double")
        out[c] = F.when(~F.isnan(x), x)
    return df.withColumns(out)


def drop_all_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="all", subset=list(cols or present_parameters(df)))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first one in ``order``.

    The rank filter lets Spark cut every input partition to one row per key
    before the exchange, so a key that holds a third of the table is reduced
    where it is read and sends one row per partition.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def dedup_first(
    df: DataFrame, keys: Sequence[str] | None = ("station_code", "date"), order: str = "_ord"
) -> DataFrame:
    """Keep-first in source order; without keys, whole-row dedup over all data columns."""
    if keys:
        return dedup(df, keys, [F.col(order).asc()])
    return df.dropDuplicates([c for c in df.columns if c != order])


def dedup_newest(
    df: DataFrame, keys: Sequence[str] = ("station_code", "date"), order: str = "_ord"
) -> DataFrame:
    return dedup(df, keys, [F.col(order).desc()])


@dataclass(frozen=True)
class Imputer:
    """Fitted replacement values, one number per column."""

    values: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.fillna({c: v for c, v in self.values.items() if v is not None})


def fit_imputer(df: DataFrame, strategy: str = "median", cols: Sequence[str] | None = None) -> Imputer:
    """Whole-table mean or exact median; the fitted numbers become plan literals,
    so applying them needs neither a join nor a second pass."""
    cols = list(cols or present_parameters(df))
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return Imputer(row.asDict())
    if strategy == "median":
        return Imputer(exact_quantiles(df, {c: (F.col(c), 0.5) for c in cols}))
    raise ValueError("strategy must be 'median' or 'mean'")


def impute(df: DataFrame, strategy: str = "median", cols: Sequence[str] | None = None) -> DataFrame:
    """``median``, ``mean`` or ``drop`` (rows with any missing parameter)."""
    cols = list(cols or present_parameters(df))
    if strategy == "drop":
        return df.dropna(subset=cols)
    return fit_imputer(df, strategy, cols).transform(df)


def impute_by_group(df: DataFrame, keys: Sequence[str], strategy: str = "median", cols: Sequence[str] | None = None) -> DataFrame:
    """Missing parameters get the exact median or the mean of their group (such as one sheet of many).

    All groups are fitted together, whatever their number and size; a column without any
    value in a group stays NULL there.
    """
    cols, keys = list(cols or present_parameters(df)), list(keys)
    if strategy == "median":
        fitted = grouped_quantiles(df, keys, cols)
    elif strategy == "mean":
        fitted = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
    else:
        raise ValueError("strategy must be 'median' or 'mean'")
    fills = fitted.select(F.struct(*keys).alias("_group"), F.struct(*cols).alias("_fill"))
    filled = {c: F.coalesce(F.col(c), F.col("_fill")[c]) for c in cols}
    return df.withColumn("_group", F.struct(*keys)).join(fills, "_group", "left").withColumns(filled).drop("_group", "_fill")


def quality_gate(df: DataFrame) -> DataFrame:
    """One row: at least one non-blank date, and at least one station name with a letter."""
    has_date = F.max(F.trim(F.col("date").cast("string")) != "")
    has_name = F.max(F.trim(F.col("station_name")).rlike("[A-Za-z]"))
    return df.agg(
        F.coalesce(has_date, F.lit(False)).alias("has_date"),
        F.coalesce(has_name, F.lit(False)).alias("has_name"),
    ).withColumn("quality_ok", F.col("has_date") & F.col("has_name"))


def numeric_name_check(df: DataFrame) -> DataFrame:
    """One row: are all non-blank station names plain numbers (a broken export)?"""
    name = F.trim(F.coalesce(F.col("station_name"), F.lit("")))
    return df.filter(name != "").agg(
        F.coalesce(F.bool_and(name.rlike("^[0-9]+$")), F.lit(True)).alias("all_numeric_names")
    )


def missing_profile(df: DataFrame, top: int | None = None) -> DataFrame:
    """Columns with missing values, most first; the first ``top`` of them if given."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    found = counts.unpivot([], cols, "column_name", "missing_count").filter("missing_count > 0")
    found = found.orderBy(F.desc("missing_count"), "column_name")
    return found if top is None else found.limit(top)
