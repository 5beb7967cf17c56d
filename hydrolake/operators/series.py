"""Per-station time series.

Contract: a *daily series* has at most one row per (station_code, date), which
``dedup_first``/``historical_slice`` guarantee after a map-side reduction. One
station then holds at most one row per calendar day (36,525 in a century), no
matter how many raw measurements it had, so a window partitioned by station
sorts a bounded group. Tables without that guarantee go through
``chunked_window``, which splits a station into fixed-size row chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from hydrolake.constants import LAG_ROWS, MODEL_LAGS, ROLLING_ROWS
from hydrolake.functions.calendar import monsoon_flags, month_cyclical
from hydrolake.sources.shared import materialize

STATION = "station_code"


def by_day(order: str = "date") -> WindowSpec:
    return Window.partitionBy(STATION).orderBy(order)


def daily_mean(df: DataFrame, value: str = "wqi") -> DataFrame:
    """Reduce any table to a daily series by averaging (partial aggregation first)."""
    return df.groupBy(STATION, "date").agg(F.avg(value).alias(value))


# --- hot series --------------------------------------------------------------


#: Most rows that one task sorts, on average; more of them take more tasks, not more memory.
TASK_ROWS = 500_000


def _partitions(df: DataFrame) -> int | None:
    """How many partitions keep ``df`` within ``TASK_ROWS`` each, or None where Spark's own number does."""
    needed = -(-df.count() // TASK_ROWS)
    return needed if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def ordered_blocks(df: DataFrame, order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """The rows in order of station and ``order``, stored with ``_part`` and ``_row`` (from 0 inside a part).

    Parts follow each other in that order and hold about equally many rows whatever the
    keys are: the place where a row was read is the last sort key, so the sampled bounds also
    cut through rows that are equal in all others. Without ``partitions`` their number grows with the rows.
    """
    partitions = partitions or _partitions(df)
    by = [F.col(STATION), *order, "_read"]
    ranged = df.withColumn("_read", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(partitions, *by) if partitions else ranged.repartitionByRange(*by)
    at = F.monotonically_increasing_id()  # the partition, then 33 bits for the row in it
    stored = materialize(ranged.sortWithinPartitions(*by).withColumn("_at", at).drop("_read"), "ordered")
    return stored.select("*", *_place())


def _place() -> list[Column]:
    return [F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row")]


def with_position(df: DataFrame, order: Sequence[Column | str], partitions: int | None = None, position: str = "position") -> DataFrame:
    """0-based row position within the station in ``order`` (columns or sort orders), without a hot task.

    Neither a station nor a day is ever sorted in one task: all rows are dealt by range, and
    a position is the row's place in its part plus the sizes of the parts before it,
    less that sum for the station's first row. Equal rows are placed in the order in which they are read.
    """
    rows = ordered_blocks(df, order, partitions)
    # One row per part.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))
    # A minimum of numbers is kept in a hash map, where one of structs would sort the part by station.
    starts = rows.groupBy(F.col(STATION).alias("_station")).agg(F.min("_at").alias("_at"))
    starts = starts.select("_station", *_place())
    starts = starts.join(offsets, "_part").select("_station", (F.col("_offset") + F.col("_row")).alias("_start"))
    placed = rows.join(offsets, "_part").join(starts, F.col("_station").eqNullSafe(F.col(STATION)))
    return placed.withColumn(position, F.col("_offset") + F.col("_row") - F.col("_start")).drop(
        "_part", "_row", "_at", "_offset", "_station", "_start"
    )


def chunked_window(
    df: DataFrame, preceding: int, columns, chunk_rows: int = 100_000
) -> DataFrame:
    """Row-frame window over a series of any length.

    Each station is cut into chunks of ``chunk_rows`` positions; the last
    ``preceding`` rows of a chunk are repeated in the next one as its run-up.
    ``columns(window)`` returns the new columns for a window ordered by
    position. Needs ``position`` from ``with_position`` and
    ``preceding <= chunk_rows``. Chunks are dealt to as many tasks as the rows need.
    """
    if preceding > chunk_rows:
        raise ValueError("preceding must not exceed chunk_rows")
    chunk = F.floor(F.col("position") / chunk_rows)
    tail = F.pmod(F.col("position"), F.lit(chunk_rows)) >= chunk_rows - preceding
    spread = df.withColumn("_own", chunk).withColumn(
        "_chunk",
        F.explode(F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))),
    )
    if partitions := _partitions(df):
        spread = spread.repartition(partitions, STATION, "_chunk")
    window = Window.partitionBy(STATION, "_chunk").orderBy("position")
    return (
        spread.withColumns(columns(window))
        .filter(F.col("_chunk") == F.col("_own"))
        .drop("_chunk", "_own")
    )


# --- rolling, lags, fill -----------------------------------------------------


def rolling_columns(window: WindowSpec, value: str = "wqi", rows: int = ROLLING_ROWS) -> dict[str, Column]:
    frame = window.rowsBetween(-(rows - 1), 0)
    return {
        f"{value}_rolling_mean": F.avg(value).over(frame),
        f"{value}_rolling_std": F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0)),
    }


def rolling(df: DataFrame, value: str = "wqi", rows: int = ROLLING_ROWS, order: str = "date") -> DataFrame:
    """Mean and sample deviation over the last ``rows`` rows (rows, not days)."""
    return df.withColumns(rolling_columns(by_day(order), value, rows))


def rolling_calendar(df: DataFrame, value: str = "wqi", days: int = ROLLING_ROWS) -> DataFrame:
    """Calendar variant of ``rolling``: the last ``days`` days, however many rows they hold."""
    window = Window.partitionBy(STATION).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    return df.withColumns(
        {
            f"{value}_rolling_mean": F.avg(value).over(window),
            f"{value}_rolling_std": F.coalesce(F.stddev_samp(value).over(window), F.lit(0.0)),
        }
    )


def lags(
    df: DataFrame,
    value: str = "wqi",
    rows: Sequence[int] = LAG_ROWS,
    order: str = "date",
    fill: bool = True,
) -> DataFrame:
    """Row lags, gaps filled forward, then backward, then 0, inside the station.

    The fill never crosses stations: a leak from one river into the next has
    no meaning, and a global fill would need one global window.
    """
    names = {f"{value}_lag_{n}": F.lag(value, n).over(by_day(order)) for n in rows}
    out = df.withColumns(names)
    return fill_gaps(out, list(names), order) if fill else out


def fill_gaps(df: DataFrame, cols: Sequence[str], order: str = "date", default: float | None = 0.0) -> DataFrame:
    """Forward fill, then backward fill, then ``default``, per station.

    Backward fill only reaches the NULLs before a station's first value, so it
    is that first value: a frame over the whole station, computed once for all
    its rows, where a frame from each row to the end is computed for each row.
    """
    past = by_day(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = by_day(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for c in cols:
        filled = F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(whole))
        out[c] = filled if default is None else F.coalesce(filled, F.lit(default))
    return df.withColumns(out)


def model_frame(
    df: DataFrame,
    add_month: bool = False,
    extra: Sequence[str] = (),
    lag_rows: Sequence[int] = MODEL_LAGS,
) -> DataFrame:
    """Forecaster inputs per row: wqi, lags, monsoon flags, optional month encoding and raw parameters."""
    out = lags(df, "wqi", lag_rows).withColumns(monsoon_flags("date"))
    if add_month:
        out = out.withColumns(month_cyclical("date"))
    absent = [c for c in extra if c not in out.columns]
    out = out.withColumns({c: F.lit(0.0) for c in absent}) if absent else out
    present = [c for c in extra if c not in absent]
    return fill_gaps(out, present) if present else out


def model_feature_names(
    add_month: bool = False, extra: Sequence[str] = (), lag_rows: Sequence[int] = MODEL_LAGS
) -> list[str]:
    names = ["wqi", *[f"wqi_lag_{n}" for n in lag_rows], "monsoon_ne", "monsoon_sw", "monsoon_other"]
    return names + (["month_sin", "month_cos"] if add_month else []) + list(extra)


# --- sliding samples -----------------------------------------------------------


def sliding_windows(
    df: DataFrame, features: Sequence[str], length: int, horizon: int, step: int = 1
) -> DataFrame:
    """One sample per start row: ``length`` input rows and the next ``horizon`` values.

    Output: station_code, sample_index (0-based, per station), date (last input
    day), inputs array<array<double>>, anchor (last input wqi), targets
    array<double>. Incomplete samples are dropped.
    """
    w = by_day()
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    value = F.coalesce(F.col("wqi").cast("double"), F.lit(0.0))
    return (
        df.withColumns(
            {
                "_row": F.row_number().over(w),
                "inputs": F.collect_list(row).over(w.rowsBetween(-(length - 1), 0)),
                "targets": F.collect_list(value).over(w.rowsBetween(1, horizon)),
                "anchor": value,
            }
        )
        .withColumn("sample_index", (F.col("_row") - length).cast("int"))
        .filter((F.size("inputs") == length) & (F.size("targets") == horizon))
        .filter(F.col("sample_index") % step == 0)
        .select(STATION, "sample_index", "date", "inputs", "anchor", "targets")
    )


def first_differences(anchor: Column | str, levels: Column | str) -> Column:
    """Differences of [anchor, level 1, ..., level H]."""
    a = F.col(anchor) if isinstance(anchor, str) else anchor
    y = F.col(levels) if isinstance(levels, str) else levels
    previous = F.concat(F.array(a), F.slice(y, 1, F.size(y) - 1))
    return F.zip_with(y, previous, lambda now, before: now - before)


def integrate_differences(anchor: Column | str, steps: Column | str) -> Column:
    """Inverse of ``first_differences``: running sum from the anchor."""
    a = F.col(anchor) if isinstance(anchor, str) else anchor
    d = F.col(steps) if isinstance(steps, str) else steps
    return F.transform(
        d, lambda _, i: a + F.aggregate(F.slice(d, 1, i + 1), F.lit(0.0), lambda s, x: s + x)
    )


def last_rows(df: DataFrame, n: int, order: str = "date") -> DataFrame:
    """Newest ``n`` rows per station; each input partition is cut to ``n`` rows per
    station before the exchange."""
    rank = F.row_number().over(Window.partitionBy(STATION).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def model_input(df: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """Per station the last ``length`` feature rows in date order; shorter stations are left out."""
    row = F.struct("date", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return (
        last_rows(df, length)
        .groupBy(STATION)
        .agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("date").alias("last_date"))
        .filter(F.size("rows") == length)
        .select(
            STATION,
            "last_date",
            F.transform("rows", lambda r: F.array(*[r[c] for c in features])).alias("window"),
        )
    )


def pad_history(df: DataFrame, length: int) -> DataFrame:
    """Stations with fewer than ``length`` rows get their earliest row repeated on the days before it."""
    first = df.groupBy(STATION).agg(
        F.min_by(F.struct(*df.columns), "date").alias("_first"), F.count("*").alias("_rows")
    )
    padding = (
        first.filter(F.col("_rows") < length)
        .withColumn("_back", F.explode(F.sequence(F.lit(1), (F.lit(length) - F.col("_rows")).cast("int"))))
        .select(F.col("_first.*"), "_back")
        .withColumn("date", F.date_sub("date", F.col("_back")))
        .drop("_back")
    )
    return df.unionByName(padding)


def station_series(df: DataFrame, station: str | None = None) -> DataFrame:
    """(station, date, wqi) rows with a valid date, optionally of one station."""
    out = df.filter(F.col("date").isNotNull()).select(STATION, "date", "wqi")
    return out.filter(F.col(STATION) == station) if station else out


def default_station(df: DataFrame) -> DataFrame:
    """One row: the station with most rows (ties: smallest code)."""
    counts = df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), STATION).limit(1)


# --- calendar ------------------------------------------------------------------


def gaps(df: DataFrame) -> DataFrame:
    """Consecutive readings of a station more than one day apart."""
    previous = F.lag("date").over(by_day())
    return (
        df.select(STATION, previous.alias("gap_after"), F.col("date").alias("gap_before"))
        .withColumn("gap_days", F.datediff("gap_before", "gap_after"))
        .filter("gap_days > 1")
    )


def gap_fill(df: DataFrame, end: date, method: str = "locf") -> DataFrame:
    """Insert the missing days of each station from its first day up to ``end`` (inclusive).

    Input: a daily series with ``wqi``. Existing rows stay as they are, those after ``end`` too
    (``data_type`` 'historical'); inserted rows are tagged 'gap_fill' and take
    the last value (``locf``) or the straight line between neighbours
    (``linear``; after the last reading the last value is kept). Deterministic
    by design. Each row expands only its own gap to the next reading, so no
    calendar is joined.
    """
    if method not in ("locf", "linear"):
        raise ValueError("method must be 'locf' or 'linear'")
    ahead = df.filter(F.col("date").isNotNull()).select(
        STATION,
        "date",
        "wqi",
        F.lead("date").over(by_day()).alias("_next_date"),
        F.lead("wqi").over(by_day()).alias("_next_wqi"),
    )
    stop = F.greatest(F.col("date"), F.least(F.coalesce(F.date_sub("_next_date", 1), F.lit(end)), F.lit(end)))
    expanded = ahead.withColumn("_day", F.explode(F.sequence(F.col("date"), stop)))
    done = F.datediff("_day", "date")
    if method == "linear":
        span = F.datediff("_next_date", "date")
        value = F.col("wqi") + F.coalesce((F.col("_next_wqi") - F.col("wqi")) * done / span, F.lit(0.0))
    else:
        value = F.col("wqi")
    inserted = done > 0
    return expanded.select(
        STATION,
        F.col("_day").alias("date"),
        F.when(inserted, value).otherwise(F.col("wqi")).alias("wqi"),
        F.when(inserted, "gap_fill").otherwise("historical").alias("data_type"),
    )


def date_series(df: DataFrame, order: str, as_of: date) -> DataFrame:
    """Date an undated series: consecutive days that end at ``as_of``."""
    placed = with_position(df, [F.desc(order)], position="_age")
    return placed.withColumn("date", F.date_sub(F.lit(as_of), F.col("_age").cast("int"))).drop("_age")


# --- summaries of a series --------------------------------------------------------


def trend(df: DataFrame, value: str = "wqi") -> DataFrame:
    """Trend label from last minus first value (more than one point either way)."""
    delta = F.max_by(value, "date") - F.min_by(value, "date")
    return (
        df.groupBy(STATION)
        .agg(delta.alias("delta"))
        .withColumn(
            "trend",
            F.when(F.col("delta") > 1.0, "Increasing").when(F.col("delta") < -1.0, "Decreasing").otherwise("Stable"),
        )
    )


def persistence_forecast(df: DataFrame, horizon: int) -> DataFrame:
    """Naive forecast: the last value repeated for the next ``horizon`` days."""
    last = df.groupBy(STATION).agg(F.max("date").alias("_last"), F.max_by("wqi", "date").alias("wqi"))
    return last.select(
        STATION, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_last", "wqi"
    ).select(STATION, "step", F.date_add("_last", F.col("step")).alias("date"), "wqi")


def trailing_baseline(df: DataFrame, n: int = 10, default: float = 75.0) -> DataFrame:
    """Mean of the last ``n`` readings per station; ``default`` where all are NULL."""
    return last_rows(df, n).groupBy(STATION).agg(F.coalesce(F.avg("wqi"), F.lit(default)).alias("baseline_wqi"))


def engineer_features(df: DataFrame, rolling_rows: int = ROLLING_ROWS, lag_rows: Sequence[int] = LAG_ROWS) -> DataFrame:
    """Rolling statistics and lags of the index on a daily series."""
    return lags(rolling(df, "wqi", rolling_rows), "wqi", lag_rows)


def numeric_feature_columns(df: DataFrame) -> list[str]:
    skip = {"date", STATION, "river_status"}
    return [f.name for f in df.schema.fields if f.name not in skip and f.dataType.typeName() in ("double", "long", "integer")]

