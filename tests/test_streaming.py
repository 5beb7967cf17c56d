"""The same events in different batches must give the same tables."""

import datetime
import random

from hydrolake import adapters as A
from hydrolake.sources.shared import new_path
from hydrolake.streaming import newest
from hydrolake.streaming import readings as S
from workload import QUERIES


def run_upsert(spark, sf, files, per_batch):
    folder, records = new_path(spark, "events"), new_path(spark, "records")
    events = A.table(spark, sf, "events")
    events.repartition(files).write.parquet(folder)
    stream = S.with_status(A.stream_readings(S.read_stream(spark, folder, events.schema, files_per_batch=per_batch)))
    checkpoint = new_path(spark, "checkpoint")
    S.start_upsert(stream, records, None, checkpoint).awaitTermination()
    S.start_upsert(stream, records, None, checkpoint).awaitTermination()  # nothing new: nothing changes
    return sorted(tuple(r) for r in S.records_table(records).read(spark).select("station_code", "date", "wqi", "_ord").collect())


def test_batching_does_not_change_the_table(spark, sf):
    assert run_upsert(spark, sf, 1, None) == run_upsert(spark, sf, 3, 1)


def test_replayed_batch_changes_nothing(spark, sf):
    records, alerts = new_path(spark, "records"), new_path(spark, "alerts")
    batch = S.with_status(A.stream_readings(A.table(spark, sf, "events")))
    run = S.upsert_batch(records, alerts)
    run(batch, 0)
    first = sorted(tuple(r) for r in S.records_table(records).read(spark).collect()), spark.read.parquet(alerts).count()
    run(batch, 0)
    assert first == (sorted(tuple(r) for r in S.records_table(records).read(spark).collect()), spark.read.parquet(alerts).count())


EVENTS = "station_code string, date date, event_id bigint, wqi double, ts timestamp"


def event(station, day, number, wqi=None, hour=6):
    at = datetime.datetime(2000, 1, day, hour, 30, 1, 123456)
    return (station, at.date(), number, float(number) if wqi is None else wqi, at)


def newest_of(spark, batches, delay="2 days", checkpoint=None, folder=None, out=None):
    """Runs the batches as one file each, in their order, and returns (station, day, event, index, time)."""
    folder, out = folder or new_path(spark, "events"), out or new_path(spark, "newest")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], EVENTS).schema
    stream = newest.newest_per_day(S.read_stream(spark, folder, schema, files_per_batch=1), delay)
    rows = S.run_available(stream, out, checkpoint).collect()
    return sorted((r["station_code"], r["date"].day, r["event_id"], r["wqi"], r["ts"].microsecond) for r in rows)


def test_newest_wins_in_any_batching(spark):
    rng = random.Random(1)
    events = [event(f"S0{rng.randrange(1, 4)}", 1 + i // 40, i, hour=rng.randrange(24)) for i in range(400)]
    events = [e for k in range(0, 400, 40) for e in rng.sample(events[k : k + 40], 40)]
    want = {}
    for e in events:
        if e[1].day < 10 - 2:
            key = (e[0], e[1].day)
            want[key] = max(want.get(key, (-1,)), (e[2], e[3], 123456))
    want = sorted((*k, *v) for k, v in want.items())
    for n in (1, 3, 7):
        cut = [events[i * 400 // n : (i + 1) * 400 // n] for i in range(n)]
        assert newest_of(spark, cut) == want


def test_late_days_ties_nulls_and_restarts(spark):
    first = [event("S01", 1, 5), event("S01", 1, 3), event("S02", 1, 9, wqi=1.0), event("S02", 1, 9, wqi=2.0), event(None, 1, 1), event("S03", 1, None, wqi=0.0)]
    folder, out, checkpoint = (new_path(spark, x) for x in ("events", "newest", "checkpoint"))
    args = {"folder": folder, "out": out, "checkpoint": checkpoint}
    assert newest_of(spark, [first], **args) == []  # no day is closed yet
    # An older event does not replace, a newer one of the same open day does; then day 9 closes them.
    assert newest_of(spark, [[event("S01", 1, 4), event("S02", 1, 10, wqi=7.5)], [event("S01", 9, 20)]], **args) == [
        ("S01", 1, 5, 5.0, 123456),
        ("S02", 1, 10, 7.5, 123456),
    ]
    # Day 1 is closed: a newer event of it changes nothing; day 8 is still open.
    assert len(newest_of(spark, [[event("S01", 1, 99), event("S01", 8, 98), event("S01", 15, 100)]], **args)) == 4
    assert newest_of(spark, [[]], **args)[-3:] == [("S01", 8, 98, 98.0, 123456), ("S01", 9, 20, 20.0, 123456), ("S02", 1, 10, 7.5, 123456)]


def test_a_day_that_closed_since_the_last_batch(spark):
    """The rows come after the watermark of their own batch, but not after that of the batch before."""
    assert newest_of(spark, [[event("S01", 9, 20)], [event("S01", 1, 5), event("S01", 8, 7)], [event("S01", 15, 30)]]) == [
        ("S01", 8, 7, 7.0, 123456),
        ("S01", 9, 20, 20.0, 123456),
    ]
    # A stored day is emitted as it was when it closed, once.
    batches = [[event("S01", 1, 5)], [event("S01", 9, 20)], [event("S01", 1, 99), event("S01", 2, 6)], [event("S02", 9, 21)]]
    assert newest_of(spark, batches) == [("S01", 1, 5, 5.0, 123456)]


def test_newest_of_many_files_in_any_order(spark, tmp_path):
    """A part of the events that is written as several files is in order as a whole only."""
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(hours=6 * (119 - i // 5)), i % 10, "click", float(i % 97), None) for i in range(600)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    for k in range(24):
        spark.createDataFrame(events[25 * k : 25 * k + 25], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want = {}
    for number, ts, user, _, value, _ in events:
        if ts.date() < (start + datetime.timedelta(days=29 - 2)).date():
            key = (f"S0{1 + user % 7}", ts.date())
            want[key] = max(want.get(key, (-1,)), (number, value))
    got = QUERIES["k02_stream_newest"](spark, str(tmp_path)).collect()
    assert sorted((r["station_code"], r["date"], r["event_id"], r["wqi"]) for r in got) == sorted((*k, *v) for k, v in want.items())


def test_newest_on_a_table(spark):
    rows = spark.createDataFrame([event("S01", 1, i) for i in range(30_000)] + [event("S02", 2, 1)], EVENTS)
    got = newest.newest_per_day(rows)
    assert got.columns == rows.columns and got.dtypes == rows.dtypes
    assert sorted((r["station_code"], r["event_id"]) for r in got.collect()) == [("S01", 29_999), ("S02", 1)]
