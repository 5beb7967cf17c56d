import random

import pytest
from pyspark.sql import functions as F

from hydrolake.operators import cleaning, grouped_quantiles as G


def median(values, p=0.5):
    values = sorted(values)
    if not values:
        return None
    h = (len(values) - 1) * p
    low = values[int(h)]
    return low + (h - int(h)) * (values[min(int(h) + 1, len(values) - 1)] - low)


def made(spark, rng):
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 == 0 else rng.choice([None, "", *map(str, range(40))])
        x = rng.choice([None, float("nan"), 0.0, -1e300, 1e-300, rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(5))])
        rows.append((g, rng.randrange(2), x, rng.lognormvariate(0, 8) if g != "3" else None, i % 7))
    return rows, spark.createDataFrame(rows, "g string, h int, x double, y double, z int").repartition(6)


@pytest.mark.parametrize("most", [G.SINGLE_TASK_ROWS, 500, 20, 1])
@pytest.mark.parametrize("p", [0.5, 0.0, 1.0, 0.37])
def test_as_sorted_lists(spark, monkeypatch, most, p):
    if most < 500 and p in (0.0, 1.0):
        pytest.skip("same path")
    monkeypatch.setattr(G, "GRID", 20)
    rows, df = made(spark, random.Random(3))
    got = {(r["g"], r["h"]): r for r in G.grouped_quantiles(df, ["g", "h"], ["x", "y", "z"], p, most).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    for key, r in got.items():
        for at, c in enumerate("xyz", 2):
            want = median([v[at] for v in rows if (v[0], v[1]) == key and v[at] is not None and v[at] == v[at]], p)
            assert r[c] == want if want is None else r[c] == pytest.approx(want, rel=1e-12)


def test_number_of_jobs_does_not_follow_the_groups(spark):
    def jobs(n):
        tracker, group = spark.sparkContext.statusTracker(), f"groups-{n}"
        spark.sparkContext.setJobGroup(group, group)
        df = spark.range(0, 40_000, 1, 4).select((F.col("id") % n).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("x"))
        assert G.grouped_quantiles(df, ["g"], ["x"]).count() == n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(10_000) <= jobs(10) + 1


def test_empty_table_and_fills(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert G.grouped_quantiles(df, ["g"], ["x"]).collect() == []
    rows = [("a", 1.0, None), ("a", None, None), ("a", 4.0, None), (None, None, 2.0), (None, 8.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fill = lambda strategy: sorted((tuple(r) for r in cleaning.impute_by_group(df, ["g"], strategy, ["x", "y"]).collect()), key=repr)
    both = [("a", 1.0, None), ("a", 2.5, None), ("a", 4.0, None), (None, 8.0, 2.0), (None, 8.0, 2.0)]
    assert fill("median") == fill("mean") == sorted(both, key=repr)
