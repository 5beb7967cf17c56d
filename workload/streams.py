"""Structured Streaming queries (survey section K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.functions.rivers import river_of_station
from hydrolake.functions.wqi import status
from hydrolake.sources.shared import new_path
from hydrolake.streaming import newest
from hydrolake.streaming import readings as S
from workload.registry import band, query, rounded

_STREAM = f""", sr AS (SELECT event_id, 'S0' || CAST(1 + user_id % 7 AS VARCHAR) AS station_code, ts, CAST(ts AS DATE) AS date, least(100e0, value) AS wqi FROM events),
  srs AS (SELECT sr.*, s.river_name, {band('wqi')} AS river_status FROM sr JOIN stations s USING (station_code))
"""


def _stream(spark, sf, batches=4):
    """The events as a stream of files, one per micro-batch. Files are taken by
    modification time, so queries whose result depends on lateness use one file."""
    folder = new_path(spark, "events")
    events = A.table(spark, sf, "events")
    events.repartitionByRange(batches, "ts").write.parquet(folder)
    source = S.read_stream(spark, folder, events.schema, files_per_batch=1)
    return S.with_status(A.stream_readings(source))


@query(
    "k01_stream_ingest",
    _STREAM + "SELECT event_id, station_code, river_name, date, round(wqi, 6) AS wqi, river_status FROM srs",
)
def stream_ingest(spark, sf):
    out = S.run_available(_stream(spark, sf), new_path(spark, "ingested"))
    return rounded(out.select("event_id", "station_code", "river_name", "date", "wqi", "river_status"))


def _in_order(spark, sf, batches):
    """The events as parts of equal time span, each later than the one before."""
    events = A.table(spark, sf, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * i / batches for i in range(1, batches)]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events if low is None else events.filter(F.col("ts") >= low)
        yield part if high is None else part.filter(F.col("ts") < high)


@query("k02_stream_dedup", _STREAM + "SELECT DISTINCT station_code, date FROM srs")
def stream_dedup(spark, sf):
    return S.run_available(S.dedup_stream(_stream(spark, sf, 1)), new_path(spark, "deduped")).select("station_code", "date")


@query(
    "k02_stream_newest",
    _STREAM
    + """SELECT station_code, date, max(event_id) AS event_id, round(max_by(wqi, event_id), 6) AS wqi FROM srs
    GROUP BY ALL HAVING date < (SELECT max(date) FROM srs) - 2""",
)
def stream_newest(spark, sf):
    """Days are final two days after their end; the newest event of a day is the one with the highest id.

    Each part is one micro-batch, taken in when it has been written: its files are written side by
    side, so their modification times say nothing about which of them holds the later events.
    """
    folder, path, checkpoint = (new_path(spark, x) for x in ("events", "newest", "checkpoint"))
    for part in _in_order(spark, sf, 3):
        part.write.mode("append").parquet(folder)
        arrived = S.with_status(A.stream_readings(S.read_stream(spark, folder, part.schema)))
        out = S.run_available(newest.newest_per_day(arrived, "2 days"), path, checkpoint)
    return rounded(out.select("station_code", "date", "event_id", "wqi"))


@query(
    "k03_stream_upsert",
    _STREAM + "SELECT station_code, date, max(event_id) AS event_id, round(max_by(wqi, event_id), 6) AS wqi FROM srs GROUP BY ALL",
)
def stream_upsert(spark, sf):
    records, raised = new_path(spark, "records"), new_path(spark, "alerts")
    S.start_upsert(_stream(spark, sf), records, raised, new_path(spark, "checkpoint"), compact_every=3).awaitTermination()
    assert spark.read.parquet(raised).filter("river_status = 'clean'").isEmpty()
    out = S.records_table(records).read(spark)
    return rounded(out.select("station_code", "date", F.col("_ord").alias("event_id"), "wqi"))


@query(
    "k04_daily_refresh",
    _STREAM
    + """, m AS (SELECT station_code, date, round(max_by(wqi, event_id), 6) AS wqi FROM srs WHERE CAST(substr(station_code, 3) AS INTEGER) <> 4 GROUP BY ALL),
    p AS (SELECT DISTINCT station_code, date + 2 AS date, 50e0 AS wqi FROM srs),
    u AS (SELECT station_code, date, wqi, FALSE AS is_predicted FROM m UNION ALL SELECT station_code, date, wqi, TRUE FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.station_code = p.station_code AND m.date = p.date)),
    day AS (SELECT max(date) + 1 AS as_of FROM srs)
    SELECT station_code, max(date) AS date, max_by(wqi, date) AS wqi, max_by(is_predicted, date) AS is_predicted FROM u, day WHERE date <= as_of GROUP BY 1""",
)
def daily_refresh(spark, sf):
    """Predictions are stored two days ahead; the tick brings measurements for all stations but one."""
    rows = S.with_status(A.stream_readings(A.table(spark, sf, "events")))
    as_of = rows.agg(F.date_add(F.max("date"), 1)).first()[0]
    records = new_path(spark, "records")
    wqi = F.lit(50.0)
    predicted = rows.select("station_code", F.date_add("date", 2).alias("date")).distinct().select(
        "date", "station_code", river_of_station("station_code").alias("station_name"),
        river_of_station("station_code").alias("river_name"), wqi.alias("wqi"), status(wqi).alias("river_status"),
        F.lit("predicted_historical").alias("data_type"), F.lit(True).alias("is_predicted"),
        F.lit(-1).cast("long").alias("_ord"), F.lit(-1).cast("long").alias("id"),
    )
    S.records_table(records).append(predicted, -1)
    arriving = _stream(spark, sf, 2).filter("station_code <> 'S04'")
    out = S.daily_refresh(arriving, records, new_path(spark, "checkpoint"), as_of)
    return rounded(out.select("station_code", "date", "wqi", "is_predicted"))


@query(
    "k05_stream_daily_means",
    _STREAM
    + """, lim AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM srs)
    SELECT station_code, date, round(avg(wqi), 6) AS avg_wqi, count(*) AS n FROM srs, lim GROUP BY station_code, date, wm HAVING CAST(date + 1 AS TIMESTAMP) <= wm""",
)
def stream_daily_means(spark, sf):
    return rounded(S.run_available(S.daily_means(_stream(spark, sf, 1)), new_path(spark, "means")))
