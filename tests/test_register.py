from hydrolake.constants import RIVER_BY_CODE
from hydrolake.functions import rivers
from hydrolake.operators import register
from pyspark.sql import functions as F

REGISTER = "station_code string, river_name string, latitude double"


def resolved(spark, labels, stations):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(labels)], "id int, station_code string, station_name string, basin string").repartition(3)
    known = spark.createDataFrame(stations, REGISTER)
    out = register.resolve_stations(rows, known, basin="basin")
    assert out.columns == ["id", "station_name", "basin", "station_code", "river_name", "latitude", "is_registered"]
    return [(r.station_code, r.river_name, r.latitude, r.is_registered) for r in out.orderBy("id").collect()]


def test_ranked_keys(spark):
    stations = [("S01", "Sungai Klang", 1.0), ("S2", "Sungai Muda", 2.0), ("S08", "Sungai Muda", 8.0), (" s9 ", None, 9.0), ("", "Sungai Nowhere", 0.0), (None, "x", 0.0)]
    labels = [
        (" s01 ", "Sungai Muda", "MUDA"),  # the code comes first
        ("X1", "Sungai Klang", "MUDA"),  # then the river
        (None, "s08", None),  # the name as a code
        ("Sungai Muda", None, None),  # the code as a river: the smallest station of several
        ("X2", "Weir", "klang"),  # the basin
        ("x3", "Weir", None),
        (None, None, None),
        ("S9", None, None),
        ("x4", "Sungai Baru", ""),
    ]
    labels += labels[:1]
    want = [
        ("S01", "Sungai Klang", 1.0, True), ("S01", "Sungai Klang", 1.0, True), ("S08", "Sungai Muda", 8.0, True),
        ("S08", "Sungai Muda", 8.0, True), ("S01", "Sungai Klang", 1.0, True), ("X3", "Weir (X3)", None, False),
        ("", "Unknown River", None, False), ("S9", "Unknown River", 9.0, True), ("X4", "Sungai Baru", None, False),
    ]
    assert resolved(spark, labels, stations) == [*want, want[0]]
    assert resolved(spark, labels[5:7], []) == want[5:7]


def test_as_the_built_in_register(spark):
    """On codes and names the table of seven gives what the built-in expressions give."""
    stations = spark.createDataFrame([(c, r, 0.0) for c, r in RIVER_BY_CODE.items()], REGISTER)
    labels = [(c, n) for c in ("S03", "s05 ", "", None, "Q1") for n in ("Sungai Klang", "", None, "Jambatan", "Sungai Lain")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(labels)], "id int, station_code string, station_name string")
    built = rows.select("id", rivers.canonical_code("station_code", "station_name").alias("_c")).withColumn("_k", F.col("_c").isin(*RIVER_BY_CODE))
    got = register.resolve_stations(rows, stations).join(built, "id").orderBy("id").collect()
    assert [(r.is_registered, r.station_code if r.is_registered else None) for r in got] == [(r._k, r._c if r._k else None) for r in got]


def test_hot_label_and_large_register(spark):
    stations = spark.range(30_000).select(F.concat(F.lit("S"), "id").alias("station_code"), F.concat(F.lit("Sungai "), "id").alias("river_name"))
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "S7").otherwise(F.concat(F.lit("s"), F.col("id") % 40_000)).alias("station_code"), F.lit(None).cast("string").alias("station_name"))
    got = register.resolve_stations(rows, stations)
    assert got.count() == 60_000 and got.filter("station_code = 'S7'").count() >= 20_000
    assert got.filter(~F.col("is_registered")).count() == rows.filter("cast(substr(station_code, 2) as int) >= 30000").count()
