"""Name -> query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = PRELUDE + sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order cannot show."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else df


def si(p: str, x: str) -> str:
    """Sub-index as a SQL CASE."""
    return {
        "do_": f"CASE WHEN {x} < 0 THEN NULL WHEN {x} >= 7.92 THEN 100e0 WHEN {x} = 0 THEN 0e0 ELSE -0.395e0 + 0.030e0*{x}*{x} - 0.0002e0*{x}*{x}*{x} END",
        "bod": f"CASE WHEN {x} < 0 THEN NULL WHEN {x} = 0 THEN 100e0 WHEN {x} >= 20 THEN 0e0 ELSE 100.4e0*exp(-0.223e0*{x}) END",
        "cod": f"CASE WHEN {x} < 0 THEN NULL WHEN {x} = 0 THEN 100e0 WHEN {x} >= 200 THEN 0e0 WHEN {x} <= 100 THEN -1.33e0*{x} + 133.33e0 ELSE -0.5e0*{x} + 50e0 END",
        "an": f"CASE WHEN {x} < 0 THEN NULL WHEN {x} = 0 THEN 100e0 WHEN {x} >= 10 THEN 0e0 ELSE 100.5e0*exp(-0.393e0*{x}) END",
        "tss": f"CASE WHEN {x} < 0 THEN NULL WHEN {x} = 0 THEN 100e0 WHEN {x} >= 500 THEN 0e0 ELSE 97e0*exp(-0.00676e0*{x}) + 3e0 END",
        "ph": f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} BETWEEN 7.0 AND 8.75 THEN 100e0 WHEN {x} >= 5.5 AND {x} < 7.0 THEN 17.2e0*{x} - 34.4e0 WHEN {x} > 8.75 AND {x} <= 9.0 THEN 242e0 - 16.2e0*{x} ELSE 0e0 END",
    }[p]


WEIGHTS = {"do_": "0.22e0", "bod": "0.19e0", "cod": "0.16e0", "an": "0.15e0", "tss": "0.16e0", "ph": "0.12e0"}
WQI_SQL = (
    "greatest(0e0, least(100e0, "
    + " + ".join(f"{w}*coalesce({si(p, p)}, 0e0)" for p, w in WEIGHTS.items())
    + "))"
)


def band(x: str, null: str = "'unknown'") -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN {null} WHEN {x} >= 81 THEN 'clean' "
        f"WHEN {x} >= 60 THEN 'slightly_polluted' ELSE 'polluted' END"
    )


ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
AS_OF = "DATE '2000-06-30'"
END = "DATE '2001-12-31'"

PRELUDE = f"""
WITH stations(station_code, river_name, latitude, longitude) AS (VALUES
  ('S01','Sungai Klang',3.1390e0,101.6869e0), ('S02','Sungai Gombak',3.2330e0,101.7240e0),
  ('S03','Sungai Pinang',5.4141e0,100.3288e0), ('S04','Sungai Kulim',5.6710e0,100.5660e0),
  ('S05','Sungai Perak',4.5921e0,101.0901e0), ('S06','Sungai Sarawak',1.5533e0,110.3592e0),
  ('S07','Sungai Kinabatangan',5.5000e0,118.0000e0)),
measurements AS (
  SELECT 'S0' || CAST(1 + l_suppkey % 7 AS VARCHAR) AS station_code, CAST(l_shipdate AS DATE) AS date,
    l_quantity/5e0 AS do_, l_discount*40e0 AS bod, l_extendedprice/3000e0 AS cod, l_tax*12.5e0 AS an,
    CAST(l_orderkey % 120 AS DOUBLE) AS tss, 5.5e0 + (l_partkey % 36)/10e0 AS ph, {ORD}
  FROM lineitem),
holed AS (SELECT * REPLACE (CASE WHEN l_linenumber = 7 THEN NULL ELSE cod END AS cod,
                            CASE WHEN l_linenumber = 7 THEN NULL ELSE tss END AS tss) FROM measurements),
deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, date ORDER BY {ORD}) AS rn
  FROM measurements) WHERE rn = 1),
holed_first AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, date ORDER BY {ORD}) AS rn
  FROM holed) WHERE rn = 1),
medians AS (SELECT median(do_) AS m_do, median(bod) AS m_bod, median(cod) AS m_cod, median(an) AS m_an,
  median(tss) AS m_tss, median(ph) AS m_ph FROM holed_first),
imputed AS (SELECT h.* REPLACE (coalesce(cod, m_cod) AS cod, coalesce(tss, m_tss) AS tss) FROM holed_first h, medians),
cleaned AS (SELECT *, {WQI_SQL} AS wqi FROM imputed),
daily AS (SELECT *, {WQI_SQL} AS wqi FROM deduped),
readings AS (
  SELECT l_orderkey*8 + l_linenumber AS id, l_orderkey % 5 AS dataset_id, d.station_code,
    s.river_name AS station_name, s.river_name, date, wqi, {band('wqi')} AS river_status,
    'historical' AS data_type, l_orderkey, l_partkey
  FROM daily d JOIN stations s USING (station_code)),
moved AS (SELECT id, station_code, station_name, river_name, date + 365 AS date,
    greatest(0e0, least(100e0, wqi + (l_orderkey % 11) - 5e0)) AS wqi FROM readings),
points AS (SELECT *, {band('wqi')} AS river_status FROM moved),
hist AS (
  SELECT id, station_code, station_name, river_name, date, wqi, river_status, data_type, FALSE AS is_predicted
  FROM readings WHERE date <= {AS_OF}
  UNION ALL
  SELECT id, station_code, station_name, river_name, date, wqi, river_status, 'predicted_historical', TRUE
  FROM points p WHERE date <= {AS_OF}
    AND NOT EXISTS (SELECT 1 FROM readings r WHERE r.station_code = p.station_code AND r.date = p.date)),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date DESC, id DESC) AS rn
  FROM hist) WHERE rn = 1),
predictions AS (SELECT station_code, date, wqi AS y_true, wqi + (l_partkey % 9) - 4e0 AS y_pred FROM readings),
alerts_log AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS triggered_at,
    'S0' || CAST(1 + o_custkey % 7 AS VARCHAR) AS station_code,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'warning' WHEN '3' THEN 'warning' ELSE 'info' END AS severity,
    CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'resolved' END AS status,
    CASE o_orderkey % 3 WHEN 0 THEN 'forecast' WHEN 1 THEN 'anomaly' ELSE 'historical' END AS source,
    o_totalprice/5000e0 AS wqi_value, o_orderkey % 4 = 0 AS is_read FROM orders),
feedback AS (SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email,
    DATE '1999-01-01' + CAST(c_custkey % 700 AS INTEGER) AS created_at, c_custkey % 2 = 0 AS is_read FROM customer)
"""
