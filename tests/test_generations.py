from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hydrolake.sources.generations import GenerationTable

SCHEMA = "station_code string, date date, wqi double, _ord int"


def rows(spark, *items):
    return spark.createDataFrame([(s, date(2000, m, d), w, o) for s, m, d, w, o in items], SCHEMA)


def content(table, spark):
    return sorted((r.station_code, r.date.month, r.date.day, r.wqi) for r in table.read(spark).collect())


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_size for p in folder.rglob("*.parquet")}


def test_newest_wins_replays_and_compaction(spark, tmp_path):
    table = GenerationTable(str(tmp_path))
    assert table.read(spark) is None and table.next_generation(spark) == 0
    table.append(rows(spark, ("S01", 1, 1, 1.0, 1), ("S01", 1, 1, 2.0, 2), ("S02", 1, 1, 3.0, 1), ("S02", 3, 1, 4.0, 1), (" ", 1, 1, 9.0, 1)), 0)
    assert content(table, spark) == [("S01", 1, 1, 2.0), ("S02", 1, 1, 3.0), ("S02", 3, 1, 4.0)]
    table.append(rows(spark, ("S01", 1, 1, 5.0, 0), ("S03", 2, 1, 6.0, 0)), 1)
    want = [("S01", 1, 1, 5.0), ("S02", 1, 1, 3.0), ("S02", 3, 1, 4.0), ("S03", 2, 1, 6.0)]
    assert content(table, spark) == want and table.next_generation(spark) == 2
    for _ in range(2):
        table.compact(spark)
        assert content(table, spark) == want and all(f.startswith("level=1") for f in files(tmp_path))
    # An old batch that is run again after it was folded changes nothing.
    table.append(rows(spark, ("S01", 1, 1, 1.0, 1), ("S02", 1, 1, 3.0, 1), ("S02", 3, 1, 4.0, 1)), 0)
    assert content(table, spark) == want
    table.compact(spark)
    assert content(table, spark) == want


def test_newest_event_wins_in_any_order_of_batches(spark, tmp_path):
    batches = [rows(spark, ("S01", 1, 1, 1.0, 5)), rows(spark, ("S01", 1, 1, 2.0, 9)), rows(spark, ("S01", 1, 1, 3.0, 7))]
    for n, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 0, 2)]):
        table = GenerationTable(str(tmp_path / str(n)), by_order=True)
        for g, i in enumerate(order):
            table.append(batches[i], g)
            if g == 1:
                table.compact(spark)
        assert content(table, spark) == [("S01", 1, 1, 2.0)]


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    table = GenerationTable(str(tmp_path))
    day = F.date_add(F.lit(date(1990, 1, 1)), (F.col("id") % 3650).cast("int"))
    big = spark.range(200_000).select(F.concat(F.lit("S"), F.floor(F.col("id") / 3650)).alias("station_code"), day.alias("date"), F.rand(1).alias("wqi"), F.lit(0).alias("_ord"))
    table.append(big, 0)
    table.compact(spark)
    before = files(tmp_path)
    table.append(spark.createDataFrame([("S1", date(1995, 5, 5) + timedelta(days=i), 1.0, 0) for i in range(3)], SCHEMA), 1)
    added = {f: n for f, n in files(tmp_path).items() if f not in before}
    assert before.items() <= files(tmp_path).items() and sum(added.values()) < 10_000 < sum(before.values()) / 100
    table.compact(spark)
    after = files(tmp_path)
    # Only the month of the batch is rewritten, and what was folded is gone.
    assert {f for f in before if f not in after} == {f for f in before if "period=1995-05" in f}
    assert all("period=1995-05" in f for f in after if f not in before) and not any(f.startswith("level=0") for f in after)
    assert table.read(spark).count() == 200_000


def test_remains_of_a_failed_compaction_do_not_matter(spark, tmp_path):
    table = GenerationTable(str(tmp_path))
    table.append(rows(spark, ("S01", 1, 1, 1.0, 0)), 0)
    table._write(table._newest(spark.read.parquet(f"{tmp_path}/level=0/part=000000000000").drop("period")), f"{tmp_path}/level=1/part=left")
    table.append(rows(spark, ("S01", 1, 1, 2.0, 0)), 1)
    assert content(table, spark) == [("S01", 1, 1, 2.0)]
    table.compact(spark)
    assert content(table, spark) == [("S01", 1, 1, 2.0)] and not any("left" in f for f in files(tmp_path))


def test_empty_batches_and_new_columns(spark, tmp_path):
    table = GenerationTable(str(tmp_path))
    table.append(rows(spark), 0)
    table.compact(spark)
    assert table.read(spark) is None
    table.append(rows(spark, ("S01", 1, 1, 1.0, 0)), 1)
    table.append(rows(spark, ("S02", 1, 1, 2.0, 0)).withColumn("note", F.lit("x")), 2)
    table.compact(spark)
    assert sorted((r.station_code, r.note) for r in table.read(spark).collect()) == [("S01", None), ("S02", "x")]


@pytest.mark.parametrize("generation", [-1, 0, 10**12])
def test_generation_numbers(spark, tmp_path, generation):
    table = GenerationTable(str(tmp_path))
    table.append(rows(spark, ("S01", 1, 1, 1.0, 0)), generation)
    assert table.next_generation(spark) == generation + 1
