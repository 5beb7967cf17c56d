"""Exact quantiles of many columns for many groups at once.

``percentile()`` keeps all distinct values of a (group, column) in one buffer. That is
right for small groups, so all groups of at most ``SINGLE_TASK_ROWS`` rows are done by
one aggregate. In larger groups every wanted rank is a search, a row of a table of
searches: an open value interval, and how many rows and which rank are left inside.
A round sketches ``GRID`` values for every search in one aggregate, which give a bracket
around the rank, and counts in a second one the rows below, on and inside it. Both are
keyed by (group, column, rank) and combined before the exchange, so a group that holds
a third of the table sends a few rows per task. A round leaves about three of
``GRID`` parts of an interval, so 10**12 rows need three rounds, whatever the number of
groups. Only whether a search is open reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.operators.quantiles import ACCURACY, SINGLE_TASK_ROWS
from hydrolake.sources.shared import materialize

GRID = 1000
#: A search: group (a struct, so that null is a key like others), column and 0-based rank.
SEARCH = ["_g", "_name", "_rank"]


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    p: float = 0.5,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """(keys, cols): the linearly interpolated quantile of each column in each group; NULL where it has no value.

    NULL and NaN are no values; NULL in a key is a group of its own. The table is read once
    to count, once for all small groups and twice per round for the large ones.
    """
    numbers = {c: F.col(c).cast("double") for c in cols}
    values = df.select(F.struct(*keys).alias("_g"), *[F.when(~F.isnan(x), x).alias(c) for c, x in numbers.items()])
    counts = materialize(values.groupBy("_g").agg(*[F.count(c).alias(c) for c in cols]), "group-counts")
    large = counts.filter(F.array_max(F.array(*cols)) > single_task_rows)
    if large.isEmpty():
        found = _small(values, cols, p)
    else:
        found = _small(values.join(large.select("_g"), "_g", "left_anti"), cols, p).unionByName(
            _large(values, large, cols, p, single_task_rows)
        )
    return found.select("_g.*", *cols)


def _small(values: DataFrame, cols: Sequence[str], p: float) -> DataFrame:
    return values.groupBy("_g").agg(*[F.percentile(c, p).alias(c) for c in cols])


def _large(values: DataFrame, large: DataFrame, cols: Sequence[str], p: float, most: int) -> DataFrame:
    at = (F.col("_n") - 1) * F.lit(p)
    wanted = large.unpivot(["_g"], list(cols), "_name", "_n").filter("_n > 0").withColumn("_at", at)
    searches = wanted.select(
        "_g", "_name", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"), F.col("_n").alias("_inside")
    )
    none = F.lit(None).cast("double")
    searches = materialize(searches.withColumns({"_left": F.col("_rank"), "_low": none, "_high": none, "_value": none}), "searches")
    rows = values.unpivot(["_g"], list(cols), "_name", "_x").filter(F.col("_x").isNotNull())
    too_many = F.col("_value").isNull() & (F.col("_inside") > most)
    while not searches.filter(too_many).isEmpty():
        narrowed = _narrowed(rows, searches.filter(too_many))
        searches = materialize(searches.filter(~too_many).unionByName(narrowed), "searches")
    # What is left inside an interval fits one task.
    rank = F.row_number().over(Window.partitionBy(*SEARCH).orderBy("_x"))
    last = _inside(rows, searches.filter(F.col("_value").isNull())).withColumn("_r", rank).filter(F.col("_r") == F.col("_left") + 1)
    done = searches.filter(F.col("_value").isNotNull()).select(*SEARCH, "_value")
    done = done.unionByName(last.select(*SEARCH, F.col("_x").alias("_value")))
    low, high = F.min_by("_value", "_rank"), F.max_by("_value", "_rank")
    one = done.join(wanted, ["_g", "_name"]).groupBy("_g", "_name").agg((low + F.first(F.col("_at") - F.floor("_at")) * (high - low)).alias("_q"))
    return one.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(c) for c in cols])


def _inside(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """The rows of each search's interval; a row belongs to as many searches as its group and column have."""
    x = F.col("_x")
    above = F.col("_low").isNull() | (x > F.col("_low"))
    return rows.join(searches, ["_g", "_name"]).filter(above & (F.col("_high").isNull() | (x < F.col("_high"))))


def _narrowed(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """The same searches with a smaller interval, or their value."""
    grid = F.percentile_approx("_x", [i / GRID for i in range(GRID + 1)], ACCURACY)
    sketched = _inside(rows, searches).groupBy(*SEARCH).agg(grid.alias("_grid"))
    part = F.floor(F.col("_left") / (F.col("_inside") - 1) * GRID).cast("int")
    bracketed = searches.join(sketched, SEARCH).withColumns(
        {"_a": F.get("_grid", F.greatest(part - 1, F.lit(0))), "_b": F.get("_grid", F.least(part + 2, F.lit(GRID)))}
    )
    bracketed = materialize(bracketed.drop("_grid"), "brackets")
    x, a, b = F.col("_x"), F.col("_a"), F.col("_b")
    zones = {"_lt": x < a, "_on_a": x == a, "_mid": (x > a) & (x < b), "_on_b": (x == b) & (a != b)}
    seen = _inside(rows, bracketed).groupBy(*SEARCH).agg(*[F.count_if(cond).alias(n) for n, cond in zones.items()])
    both = bracketed.join(seen, SEARCH)
    to_a = F.col("_lt") + F.col("_on_a")
    to_mid = to_a + F.col("_mid")
    to_b = to_mid + F.col("_on_b")
    left = F.col("_left")

    def by_zone(below, on_a, mid, on_b, above):
        """The value for the zone, in order of values, into which the rank falls."""
        return F.when(left < F.col("_lt"), below).when(left < to_a, on_a).when(left < to_mid, mid).when(left < to_b, on_b).otherwise(above)

    none = F.lit(None).cast("double")
    return both.select(
        *SEARCH,
        by_zone(F.col("_lt"), F.lit(1), F.col("_mid"), F.lit(1), F.col("_inside") - to_b).cast("long").alias("_inside"),
        by_zone(left, F.lit(0), left - to_a, F.lit(0), left - to_b).cast("long").alias("_left"),
        by_zone(F.col("_low"), none, a, none, b).alias("_low"),
        by_zone(a, none, b, none, F.col("_high")).alias("_high"),
        by_zone(none, a, none, b, none).alias("_value"),
    )
