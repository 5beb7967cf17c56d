import datetime
import math

import pytest
from pyspark.sql import functions as F

from hydrolake.constants import PARAMETERS, WQI_WEIGHTS
from hydrolake.functions import calendar as cal
from hydrolake.functions import rivers, wqi


def values(spark, fn, inputs):
    rows = [(i, None if x is None else float(x)) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, x double")
    return [r.v for r in df.select("i", fn("x").alias("v")).orderBy("i").collect()]


def test_weights_sum_to_one():
    assert sum(WQI_WEIGHTS.values()) == pytest.approx(1.0)


def test_do_curve_jumps_at_plateau(spark):
    below = -0.395 + 0.03 * 7.91**2 - 0.0002 * 7.91**3
    got = values(spark, wqi.si_do, [7.91, 7.92, 0, -1, None, float("nan")])
    assert got == [pytest.approx(below), 100.0, 0.0, None, None, None]


def test_cod_branches(spark):
    assert values(spark, wqi.si_cod, [0, 100, 150, 200, -1]) == [100.0, pytest.approx(0.33), -25.0, 0.0, None]


def test_exponential_curves(spark):
    assert values(spark, wqi.si_bod, [0, 1, 20]) == [100.0, pytest.approx(100.4 * math.exp(-0.223)), 0.0]
    assert values(spark, wqi.si_an, [0, 1, 10]) == [100.0, pytest.approx(100.5 * math.exp(-0.393)), 0.0]
    assert values(spark, wqi.si_tss, [0, 100, 500]) == [100.0, pytest.approx(97 * math.exp(-0.676) + 3), 0.0]


def test_ph_branches(spark):
    got = values(spark, wqi.si_ph, [5.4, 5.5, 7, 8.75, 9.0, 9.1, -1, None])
    assert got == [0.0, pytest.approx(60.2), 100.0, 100.0, pytest.approx(96.2), 0.0, 0.0, None]


def test_status_bands_and_null_policies(spark):
    assert values(spark, wqi.status, [81, 80.99, 60, 59.99, None]) == [
        "clean", "slightly_polluted", "slightly_polluted", "polluted", "unknown",
    ]
    assert values(spark, lambda c: wqi.status(c, "polluted"), [None, float("nan")]) == ["polluted", "polluted"]


def test_all_parameters_missing_gives_zero(spark):
    df = spark.range(1).select(*[F.lit(None).cast("double").alias(p) for p in PARAMETERS])
    row = wqi.add_wqi(df).first()
    assert (row.wqi, row.river_status) == (0.0, "polluted")


def test_existing_index_is_kept_unclipped_or_overridden(spark):
    df = spark.createDataFrame([(8.0, 150.0), (8.0, None), (None, 55.0)], "do_ double, wqi double")
    assert [round(r.wqi, 6) for r in wqi.add_wqi(df, "existing").collect()] == [150.0, 22.0, 55.0]
    assert [round(r.wqi, 6) for r in wqi.add_wqi(df, "computed").collect()] == [22.0, 22.0, 55.0]


def test_envelope(spark):
    df = spark.createDataFrame([(20.0,), (70.0,), (99.0,), (200.0,)], "wqi double")
    got = [(r.wqi_lower, r.wqi_upper) for r in wqi.with_envelope(df).collect()]
    assert got == [(17.0, 23.0), (64.4, 75.6), (91.08, 100.0), (188.0, 100.0)]


def test_station_resolution(spark):
    df = spark.createDataFrame(
        [(" s06 ", None), (None, "Sungai Sarawak"), ("X9", "Kampung"), ("", ""), (None, "s03"), ("Z1", None)],
        "code string, name string",
    )
    got = df.select(rivers.canonical_code("code", "name"), rivers.river_of_station("code", "name")).collect()
    assert [tuple(r) for r in got] == [
        ("S06", "Sungai Sarawak"), ("S06", "Sungai Sarawak"), ("X9", "Kampung (X9)"), ("", "Unknown River"),
        ("S03", "s03"), ("Z1", "Unknown River"),
    ]


def test_unparsable_dates_become_null(spark):
    df = spark.createDataFrame([("2023-01-13",), ("13/01/2023",), ("01/13/2023",), ("x",), (None,)], "d string")
    day = datetime.date(2023, 1, 13)
    assert [r[0] for r in df.select(cal.parse_date("d")).collect()] == [day, day, day, None, None]


def test_sql_functions_agree_with_columns(spark):
    wqi.register_sql_functions(spark)
    df = spark.range(0, 2200).select((F.col("id") / 10.0 - 5.0).alias("x"))
    for name, p in (("do", "do_"), ("bod", "bod"), ("cod", "cod"), ("an", "an"), ("tss", "tss"), ("ph", "ph")):
        a, b = wqi.SUB_INDEX[p]("x"), F.expr(f"sub_index_{name}(x)")
        assert df.filter(~a.eqNullSafe(b)).count() == 0
