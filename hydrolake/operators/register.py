"""Stations resolved by a register that is a table of any size.

The register has a row per station: ``station_code``, ``river_name`` and whatever else is
to be attached (coordinates). A label is a (code, name, basin) as it occurs in the rows.
Each distinct label is looked up once: it is spread into its ranked keys (the code, the
name as a river, the name as a code, then the basin token), the keys are joined to
those of the register, and the best match is kept by one aggregate. So the register is
joined with few labels and never with the raw rows; these are joined with their labels at
the end, by a plain join that Spark broadcasts or splits as it sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.constants import UNKNOWN_RIVER
from hydrolake.functions.rivers import normalize_code


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def register_keys(register: DataFrame) -> DataFrame:
    """(kind, key, station): by which texts a station is found. Of several stations with one key the smallest code counts."""
    code, river = normalize_code("station_code"), _text(F.col("river_name"))
    # The basin token of "Sungai Klang" is KLANG.
    basin = F.upper(F.regexp_replace(river, "(?i)^sungai ", ""))
    station = F.struct(code.alias("station_code"), *[F.col(c) for c in register.columns if c != "station_code"])
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("key")) for k, x in (("code", code), ("river", river), ("basin", basin))])
    spread = register.select(F.explode(keys).alias("_k"), station.alias("station")).filter((F.col("_k.key") != "") & (F.col("station.station_code") != ""))
    return spread.groupBy("_k.kind", "_k.key").agg(F.min_by("station", "station.station_code").alias("station"))


def resolve_labels(labels: DataFrame, register: DataFrame) -> DataFrame:
    """Distinct labels (``_code``, ``_name``, ``_basin``) with ``station``: the register's row that fits best, or NULL."""
    code, name, basin = F.upper(F.col("_code")), F.col("_name"), F.upper(F.col("_basin"))
    name = F.when(name == "", F.col("_code")).otherwise(name)
    ranked = [("code", code), ("river", name), ("code", F.upper(name)), ("basin", basin)]
    wanted = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), x.alias("key")) for i, (k, x) in enumerate(ranked)])
    spread = labels.withColumn("_w", F.explode(wanted)).select("_code", "_name", "_basin", "_w.*").filter("key <> ''")
    best = spread.join(register_keys(register), ["kind", "key"]).groupBy("_code", "_name", "_basin").agg(F.min_by("station", "rank").alias("station"))
    return labels.join(best, ["_code", "_name", "_basin"], "left")


def resolve_stations(
    rows: DataFrame, register: DataFrame, code: str | None = "station_code", name: str | None = "station_name", basin: str | None = None
) -> DataFrame:
    """The rows with ``station_code`` and ``river_name`` of the register, its other columns, and ``is_registered``.

    Labels that fit no station keep their code, else their name; their river is the name if it is one,
    "name (CODE)", the name or the unknown river. Columns of that name in ``rows`` are replaced.
    """
    extra = [c for c in register.columns if c not in ("station_code", "river_name")]
    new = ["station_code", "river_name", *extra, "is_registered"]
    label = {k: _text(F.col(c)) if c else F.lit("") for k, c in (("_code", code), ("_name", name), ("_basin", basin))}
    labelled = rows.withColumns(label)
    found = resolve_labels(labelled.select(*label).distinct(), register).withColumn("_found", F.col("station").isNotNull())
    both = labelled.join(found, list(label))
    own, shown = F.upper("_code"), F.col("_name")
    river = (
        F.when(F.lower(shown).startswith("sungai "), shown)
        .when((shown != "") & (own != ""), F.concat(shown, F.lit(" ("), own, F.lit(")")))
        .otherwise(F.coalesce(F.nullif(shown, F.lit("")), F.lit(UNKNOWN_RIVER)))
    )
    return both.select(
        *[c for c in rows.columns if c not in new],
        F.coalesce("station.station_code", F.nullif(own, F.lit("")), shown).alias("station_code"),
        F.coalesce("station.river_name", river).alias("river_name"),
        *[F.col("station")[c].alias(c) for c in extra],
        F.col("_found").alias("is_registered"),
    )


def rows_of_river(rows: DataFrame, register: DataFrame, target: str, code: str = "station_code", name: str | None = "station_name") -> DataFrame:
    """Rows whose station, by the register, lies on the river ``target`` or is ``target``."""
    wanted = F.lit(target.strip())
    kept = rows.withColumn("_row", F.struct(*rows.columns)).select("_row", F.col(code).alias("_c"), (F.col(name) if name else F.lit(None).cast("string")).alias("_n"))
    known = resolve_stations(kept, register, "_c", "_n")
    return known.filter((F.col("river_name") == wanted) | (F.upper("station_code") == F.upper(wanted))).select("_row.*")


def upload_check(rows: DataFrame, register: DataFrame) -> DataFrame:
    """One row per distinct code of an upload: its river, whether it is registered, and a warning if not."""
    codes = rows.select(normalize_code("station_code").alias("station_code")).filter("station_code <> ''").distinct()
    known = resolve_stations(codes, register.select("station_code", "river_name"), "station_code", None)
    warning = F.concat(F.lit("Station code "), "station_code", F.lit(" is not registered; readings will use 'Unknown River'."))
    return known.select("station_code", "river_name", "is_registered", F.when(~F.col("is_registered"), warning).alias("warning"))


def not_yet_present(register: DataFrame, rows: DataFrame, code: str = "station_code", name: str | None = "station_name") -> DataFrame:
    """Registered stations without any row."""
    seen = resolve_stations(rows.select(*[F.col(c) for c in (code, name) if c]), register, code, name).filter("is_registered")
    upper = register.withColumn("_code", normalize_code("station_code"))
    return upper.join(seen.select(F.col("station_code").alias("_code")).distinct(), "_code", "left_anti").drop("_code")
