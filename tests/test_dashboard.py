from datetime import date

import pytest
from pyspark.sql import functions as F

from hydrolake import adapters as A
from hydrolake.operators import history, marts, quality
from hydrolake.plans.dashboard import DashboardState
from hydrolake.sources.shared import materialize
from tests.test_operators import pairs
from workload import joins_aggregates


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_state_equals_the_raw_tables_in_any_batching(spark, sf, tmp_path):
    recent = F.col("date") >= F.lit(date(1999, 6, 1))
    readings, points = (materialize(t.filter(recent), "t") for t in (A.readings(spark, sf), A.forecast_points(spark, sf)))
    want = history.historical_slice(readings, points, A.AS_OF)
    columns = ["id", "station_code", "date", "wqi", "is_predicted"]
    for n, order in ((1, [0]), (3, [2, 0, 1, 0])):
        state = DashboardState(str(tmp_path / str(n)))
        for i in order:
            state.add_readings(readings.filter(F.col("id") % n == i), i)
            state.add_points(points.filter(F.col("id") % n == i), i)
            state.compact(spark)
        assert pairs(state.history(spark, A.AS_OF), *columns) == pairs(want, *columns)


def test_raw_rows_are_read_once(spark, sf, monkeypatch):
    """However many batches and tables the state is made of."""
    measurements, seen = A.measurements, spark.sparkContext.accumulator(0)

    def counted(*args, **options):
        rows = measurements(*args, **options)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(A, "measurements", counted)
    monkeypatch.setattr(joins_aggregates, "_STATES", {})
    state = joins_aggregates._state(spark, sf)
    assert state.history(spark, A.AS_OF).count() > 0 and state.forecast(spark).count() > 0
    assert seen.value == A.table(spark, sf, "lineitem").count()


def test_empty_state(spark, tmp_path):
    with pytest.raises(ValueError):
        DashboardState(str(tmp_path)).history(spark, A.AS_OF)


def test_one_pass_over_the_slice(spark, tmp_path):
    rows = [("S01", "Sungai Klang", date(1999, 1, 1), 50.0, 1), ("S02", None, date(1998, 5, 5), 90.0, 2), (" ", None, date(1999, 2, 2), 70.0, 3), ("S01", None, date(1999, 3, 3), None, 4)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "station_code string, station_name string, date date, wqi double, id long").write.parquet(path)
    hist = history.historical_slice(spark.read.parquet(path), None, A.AS_OF)
    alerts = spark.createDataFrame([(True,), (None,)], "is_read boolean")
    points = hist.limit(0).select("id", "station_code", "station_name", "river_name", "date", "wqi", "river_status")
    row = marts.summary(hist, alerts, points, A.AS_OF).first().asDict()
    assert row == {
        "total_stations": 2, "avg_wqi": 90.0, "clean_count": 1, "slightly_polluted_count": 0, "polluted_count": 1,
        "recent_alerts_count": 1, "total_records": 4, "predicted_avg_wqi": 0.0,
    }
    assert scans(marts.summary(hist, alerts, alerts.select(F.lit(None).cast("date").alias("date"), F.lit(1.0).alias("wqi")), A.AS_OF)) == 1
    cells = marts.calendar(hist, 1999)
    assert scans(cells) == scans(quality.check_filters(hist, "Sungai Klang")) == 1
    # A station without a reading in the year has its days too; blank codes are a station of their own.
    assert pairs(cells.groupBy("station_code").agg(F.count("*").alias("n"), F.count("wqi").alias("k")), "station_code", "n", "k") == [("", 365, 1), ("S01", 365, 2), ("S02", 365, 0)]
