"""Newest reading of each station and day on a stream, by keyed state with a timer.

A day stays open until the watermark, which is the end of the newest day seen
less ``delay``, has passed its end. Until then every reading of the day may
replace the stored one, whatever batch brings it; then the timer of the key
fires, the newest reading is emitted once and its state is dropped. Readings of
a closed day are refused. What comes out therefore depends on the readings and
not on how they were cut into batches, as long as none comes after its day closed.

Each task first reduces its own Arrow batches to one row per key, so a key that holds
a third of all rows sends one row in ten thousand to its state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Written as JSON in the state, with all digits of a timestamp.
FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _newest(rows: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """The row of highest order for each key; among equal orders the greater text, so that no batching shows."""
    return rows.sort_values(["_order", "_row"], kind="stable").drop_duplicates(list(keys), keep="last")


def newest_per_day(
    rows: DataFrame,
    delay: str = "2 days",
    keys: Sequence[str] = ("station_code", "date"),
    order: str = "event_id",
    day: str = "date",
) -> DataFrame:
    """The row of highest ``order`` of each key, all columns kept, once ``day`` (one of the keys) is closed.

    Rows without a key or without ``order`` are dropped. For a stream in append mode; on a
    batch table every day counts as closed.
    """
    keys = list(keys)
    used = rows.dropna(subset=[*keys, order]).select(
        *keys,
        F.col(order).cast("long").alias("_order"),
        F.to_json(F.struct(*rows.columns), FORMAT).alias("_row"),
        F.date_add(day, 1).cast("timestamp").alias("_closes"),
    ).withColumn("_ends", F.unix_millis("_closes"))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _newest(batch, keys)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, row = state.get
            state.remove()
            yield pd.DataFrame({"_row": [row]})
            return
        # Spark drops late rows by the watermark of the batch before; this batch's may have closed the day.
        watermark = state.getCurrentWatermarkMs()
        best, closes = (state.get if state.exists else None), None
        for batch in batches:
            for order_, row, end in zip(batch["_order"], batch["_row"], batch["_ends"]):
                closes = int(end)
                if closes >= watermark and (best is None or (order_, row) > tuple(best)):
                    best = (int(order_), row)
        if closes is not None and closes < watermark:
            if best is not None:
                state.remove()
                yield pd.DataFrame({"_row": [best[1]]})
        elif best is not None:
            state.update(best)
            if closes is not None:
                state.setTimeoutTimestamp(closes)

    reduced = used.mapInPandas(reduce, used.schema)
    row_type = T.StructType([T.StructField("_row", T.StringType())])
    if rows.isStreaming:
        kept = (
            reduced.withWatermark("_closes", delay)
            .groupBy(*keys)
            .applyInPandasWithState(keep, row_type, "_order long, _row string", "append", GroupStateTimeout.EventTimeTimeout)
        )
    else:
        kept = reduced.groupBy(*keys).agg(F.max(F.struct("_order", "_row"))["_row"].alias("_row"))
    return kept.select(F.from_json("_row", rows.schema, FORMAT).alias("_row")).select("_row.*")
