"""Exact order statistics without gathering a column in one task.

``percentile()`` keeps every distinct value of its group in one aggregation
buffer. That is fine for a bounded count, so it only ends a search that has at
most ``SINGLE_TASK_ROWS`` rows left. Before that, each round narrows an open value interval
around the wanted rank: one aggregate pass sketches a bracket, a second counts
the rows below, on and inside it. Only counters and bracket ends reach the
driver, and every round shrinks the interval about ``ACCURACY``-fold, so even
10^12 rows need two rounds before the exact finish.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLE_TASK_ROWS = 1_000_000
ACCURACY = 5_000


@dataclass
class _Search:
    """Open interval (low, high) that still holds the value of one rank."""

    name: str
    rank: int  # 0-based among the rows inside
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def rows(self, x: Column) -> Column:
        keep = x.isNotNull()
        if self.low is not None:
            keep = keep & (x > self.low)
        if self.high is not None:
            keep = keep & (x < self.high)
        return keep


def ordered_values(
    df: DataFrame, wanted: dict[str, tuple[Column, list[int]]], single_task_rows: int = SINGLE_TASK_ROWS
) -> dict[str, list[float | None]]:
    """Value at each 0-based ascending rank of each named expression (NULLs do not count)."""
    if not wanted:
        return {}
    inputs = df.select(*[x.cast("double").alias(n) for n, (x, _) in wanted.items()])
    counts = inputs.agg(*[F.count(n).alias(n) for n in wanted]).first().asDict()
    searches = [
        _Search(n, rank, counts[n])
        for n, (_, ranks) in wanted.items()
        for rank in ranks
        if 0 <= rank < counts[n]
    ]
    while any(s.value is None and s.inside > single_task_rows for s in searches):
        _narrow(inputs, [s for s in searches if s.value is None and s.inside > single_task_rows])
    _finish(inputs, [s for s in searches if s.value is None])
    found = {}
    done = iter(searches)
    for n, (_, ranks) in wanted.items():
        found[n] = [next(done).value if 0 <= rank < counts[n] else None for rank in ranks]
    return found


def _narrow(inputs: DataFrame, searches: list[_Search]) -> None:
    margin = 2.0 / ACCURACY
    sketches = []
    for i, s in enumerate(searches):
        p = s.rank / max(s.inside - 1, 1)
        ends = [max(0.0, p - margin), min(1.0, p + margin)]
        sketches.append(
            F.percentile_approx(F.when(s.rows(F.col(s.name)), F.col(s.name)), ends, ACCURACY).alias(f"b{i}")
        )
    brackets = inputs.agg(*sketches).first()
    counters = []
    for i, s in enumerate(searches):
        x, (a, b) = F.col(s.name), brackets[f"b{i}"]
        keep = s.rows(x)
        counters += [
            F.count_if(keep & (x < a)).alias(f"lt{i}"),
            F.count_if(keep & (x == a)).alias(f"a{i}"),
            F.count_if(keep & (x > a) & (x < b)).alias(f"mid{i}"),
            F.count_if(keep & (x == b) & F.lit(a != b)).alias(f"b{i}"),
        ]
    seen = inputs.agg(*counters).first()
    for i, s in enumerate(searches):
        a, b = brackets[f"b{i}"]
        # Walk the five zones in value order until the rank falls into one.
        zones = [
            (seen[f"lt{i}"], None, s.low, a),
            (seen[f"a{i}"], a, None, None),
            (seen[f"mid{i}"], None, a, b),
            (seen[f"b{i}"], b, None, None),
        ]
        zones.append((s.inside - sum(z[0] for z in zones), None, b, s.high))
        for size, value, low, high in zones:
            if s.rank < size:
                s.value, s.low, s.high, s.inside = value, low, high, size
                break
            s.rank -= size


def _finish(inputs: DataFrame, searches: list[_Search]) -> None:
    if not searches:
        return
    left = inputs.select(*[F.when(s.rows(F.col(s.name)), F.col(s.name)).alias(f"v{i}") for i, s in enumerate(searches)])
    # The value itself: an interpolated one may miss it by a rounding error, and with it a row at a threshold.
    exprs = [f"percentile_disc({(s.rank + 0.5) / s.inside!r}D) WITHIN GROUP (ORDER BY v{i}) AS v{i}" for i, s in enumerate(searches)]
    row = left.agg(*map(F.expr, exprs)).first()
    for i, s in enumerate(searches):
        s.value = row[f"v{i}"]


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[Column, float]],
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> dict[str, float | None]:
    """Linearly interpolated quantile of each named expression; NULL for an empty one."""
    inputs = df.select(*[x.cast("double").alias(n) for n, (x, _) in wanted.items()])
    counts = inputs.agg(*[F.count(n).alias(n) for n in wanted]).first().asDict()
    ranks, weights = {}, {}
    for n, (_, p) in wanted.items():
        if counts[n]:
            h = (counts[n] - 1) * p
            ranks[n] = (F.col(n), [floor(h), ceil(h)])
            weights[n] = h - floor(h)
    values = ordered_values(inputs, ranks, single_task_rows)
    return {
        n: values[n][0] + weights[n] * (values[n][1] - values[n][0]) if n in values else None
        for n in wanted
    }
