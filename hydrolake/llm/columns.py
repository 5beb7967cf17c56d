"""Names of columns that only pass through an operator."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame


def apart(df: DataFrame, used: Collection[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but the ``used`` ones under numbered names, so that none clashes with an internal
    one, and a function that gives a table with those columns their own names back."""
    numbered = {c: f"_column{i}" for i, c in enumerate(df.columns) if c not in used}
    own = {new: c for c, new in numbered.items()}
    return df.toDF(*[numbered.get(c, c) for c in df.columns]), lambda out: out.toDF(*[own.get(c, c) for c in out.columns])
