"""Fitted column scalers and variance screening.

Parameters are fitted in one aggregate pass and become literals of the
transform expression, so scaling a table is a plain projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearScaler:
    """x -> (coalesce(x, 0) - shift) / scale per column; a zero scale divides by one."""

    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - self.shift[c]) / (self.scale[c] or 1.0)
                for c in self.shift
            }
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * (self.scale[c] or 1.0) + self.shift[c] for c in self.shift})

    def as_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(self.shift[c]), float(self.scale[c])) for c in self.shift]
        return spark.createDataFrame(rows, "column_name string, shift double, scale double")

    @classmethod
    def from_rows(cls, rows: DataFrame) -> LinearScaler:
        stored = rows.collect()  # one row per scaled column
        return cls({r.column_name: r.shift for r in stored}, {r.column_name: r.scale for r in stored})


def _filled(c: str):
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> LinearScaler:
    """Scale to 0..1; a constant column becomes 0. Without rows, values stay as they are."""
    row = df.agg(
        *[F.min(_filled(c)).alias(f"lo_{c}") for c in cols], *[F.max(_filled(c)).alias(f"hi_{c}") for c in cols]
    ).first()
    low, high = ({c: row[f"{end}_{c}"] or 0.0 for c in cols} for end in ("lo", "hi"))
    return LinearScaler(low, {c: high[c] - low[c] for c in cols})


def fit_standard(df: DataFrame, cols: Sequence[str]) -> LinearScaler:
    """Zero mean, unit population deviation. Without rows, values stay as they are."""
    row = df.agg(
        *[F.avg(_filled(c)).alias(f"m_{c}") for c in cols], *[F.stddev_pop(_filled(c)).alias(f"s_{c}") for c in cols]
    ).first()
    return LinearScaler({c: row[f"m_{c}"] or 0.0 for c in cols}, {c: row[f"s_{c}"] or 0.0 for c in cols})


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "minmax") -> LinearScaler:
    if method == "minmax":
        return fit_minmax(df, cols)
    if method == "standard":
        return fit_standard(df, cols)
    raise ValueError("method must be 'minmax' or 'standard'")


def varying_columns(df: DataFrame, cols: Sequence[str], threshold: float = 1e-5) -> list[str]:
    """Columns whose population variance exceeds the threshold."""
    row = df.agg(*[F.var_pop(_filled(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]
