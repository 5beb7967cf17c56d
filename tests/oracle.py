"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

Command line: python -m tests.oracle [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    """Empty string when equal, else a description of the first difference."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            return f"row {g} != {w}"
    return "" if got else "EMPTY"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hydrolake")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                verdict = "" if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok  '} {time.time() - start:6.1f}s {name} {verdict}", flush=True)
    print(f"{bad} failures")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
