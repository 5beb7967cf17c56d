"""Monitoring sheets: CSV scans, header normalisation, file catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.constants import (
    BASIN_HEADERS,
    CODE_HEADERS,
    DATE_HEADERS,
    DEFAULT_STATION,
    HEADER_ALIASES,
    NAME_HEADERS,
    PARAMETERS,
    RIVER_HEADERS,
    STATUS_HEADERS,
)
from hydrolake.functions.calendar import parse_date
from hydrolake.functions.rivers import river_name
from hydrolake.operators.cleaning import dedup

ORDER = "_ord"
# Tokens that together identify an agency-export header, checked in this order.
HEADER_TOKENS = ((("nh3",), "an"), (("bod", "mg"), "bod"), (("cod", "mg"), "cod"), (("ss", "mg"), "tss"))


def source_order() -> Column:
    """Row order of a file scan: file, then split offset, then row inside the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_monitoring_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """One CSV source (file, folder or glob with a common header) as text columns
    plus ``_ord``. ``multiline`` is only for quoted line breaks inside fields or
    headers; it keeps Spark from splitting large files."""
    raw = spark.read.csv(path, header=True, multiLine=multiline, inferSchema=False)
    return raw.withColumn(ORDER, source_order())


def canonical_header(header: str) -> str | None:
    """Parameter name of a sheet header, or None when it is not a parameter."""
    low = header.replace("﻿", "").strip().lower()
    if "index" in low:
        return None
    key = low.replace("\n", "").replace("\r", "")
    for mark in (" ", "/", "."):
        key = key.replace(mark, "_")
    if key in HEADER_ALIASES:
        return HEADER_ALIASES[key]
    for tokens, name in HEADER_TOKENS:
        if all(t in key for t in tokens):
            return name
    if key.startswith("ph"):
        return "ph"
    if "do" in key and "mg" in key:
        return "do_"
    return None


def kept_columns(headers: Sequence[str]) -> dict[str, int]:
    """Name -> place of the columns that a normalised sheet keeps: of several with one name the first."""
    names, seen = {}, set()
    for i, header in enumerate(headers):
        name = canonical_header(header) or header.replace("﻿", "").replace("\r", "").strip()
        if name.lower() == "wqi":
            name = "wqi"
        if name.lower() not in seen:
            seen.add(name.lower())
            names[name] = i
    return names


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename parameter headers to their canonical names. Metadata only: the first
    of several columns with one name is kept, all others keep their header."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for name, i in kept_columns(df.columns).items()])


def first_of(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case and surrounding blanks."""
    present = {c.strip().lower(): c for c in names}
    return next((present[c.strip().lower()] for c in candidates if c.strip().lower() in present), None)


def first_header(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return first_of(df.columns, candidates)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_columns(df: DataFrame) -> DataFrame:
    """Canonical date, station_code, station_name, river_name and parameters of a normalised sheet."""

    def text(candidates: Sequence[str]) -> Column | None:
        found = first_header(df, candidates)
        return F.trim(_quoted(found).cast("string")) if found else None

    date_header = first_header(df, DATE_HEADERS)
    when = parse_date(_quoted(date_header)) if date_header else F.lit(None).cast("date")
    code = text(CODE_HEADERS)
    code = F.lit(DEFAULT_STATION) if code is None else code
    label = text(NAME_HEADERS)
    label = code if label is None else label
    river = text(RIVER_HEADERS)
    river = river_name(code, label, text(BASIN_HEADERS)) if river is None else river
    out = [when.alias("date"), code.alias("station_code"), label.alias("station_name"), river.alias("river_name")]
    out += [_quoted(p).alias(p) for p in PARAMETERS if p in df.columns]
    if "wqi" in df.columns:
        out.append(F.col("wqi"))
    status = first_header(df, STATUS_HEADERS)
    if status:
        out.append(_quoted(status).alias("river_status"))
    if ORDER in df.columns:
        out.append(F.col(ORDER))
    return df.select(*out)


def load_sheet(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return resolve_columns(normalize_columns(read_monitoring_csv(spark, path, multiline)))


def _stem(path: Column) -> Column:
    """File name without folder and extension, percent-decoded."""
    return F.url_decode(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def list_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(file_path, file_name, stem, size_bytes, modified) of a folder tree; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.url_decode(F.col("_metadata.file_name")).alias("file_name"),
        _stem(F.col("_metadata.file_path")).alias("stem"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def _sheet(path: Column) -> Column:
    """Path of the sheet that a file belongs to: the file itself, or the folder of files that a job
    has written side by side (``part-...``), so a sheet may be as large as a table."""
    return F.regexp_replace(path, r"/part-[^/]*$", "")


def list_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """``list_files`` by sheet, with ``n_files``: a folder of part files counts as one sheet, named like the folder
    (``River.csv/part-...``) or, in a partitioned table, like its value (``river_name=River/part-...``)."""
    path = F.col("file_path")
    last = F.regexp_extract(path, r"[^/]+$", 0)
    # Partition folders escape their values once more than paths do.
    value = F.url_decode(F.url_decode(F.regexp_extract(last, r"^[^=]*=(.*)$", 1)))
    in_table = (F.col("n_parts") > 0) & last.contains("=")
    sheets = list_files(spark, folder).groupBy(_sheet(path).alias("file_path")).agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.max("modified").alias("modified"),
        F.count("*").alias("n_files"),
        F.count_if(_sheet(path) != path).alias("n_parts"),
    )
    return sheets.select(
        "file_path",
        F.when(in_table, value).otherwise(F.url_decode(last)).alias("file_name"),
        F.when(in_table, value).otherwise(_stem(path)).alias("stem"),
        "size_bytes",
        "modified",
        "n_files",
    )


def catalog_one_per_river(spark: SparkSession, folder: str) -> DataFrame:
    """One sheet per river (its stem, ignoring case): the largest, then the first by path."""
    found = list_sheets(spark, folder).withColumn("_key", F.lower(F.trim("stem")))
    return dedup(found, ["_key"], [F.desc("size_bytes"), F.asc("file_path")]).drop("_key")


def file_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Data rows per sheet (no column is parsed for the count)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, header=True)
    return rows.groupBy(_sheet(F.col("_metadata.file_path")).alias("file_path")).agg(F.count("*").alias("row_count"))


def dataset_catalog(spark: SparkSession, folder: str, registry: DataFrame) -> DataFrame:
    """Registered datasets plus the unregistered sheets of the folder; the registry wins by name."""
    listed = (
        list_sheets(spark, folder)
        .join(file_row_counts(spark, folder), "file_path", "left")
        .select(
            F.col("file_name").alias("name"),
            "file_path",
            F.col("size_bytes").alias("file_size_bytes"),
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.col("stem").alias("river_name"),
        )
    )
    fresh = listed.join(
        registry.select(F.lower("name").alias("_name")), F.lower(F.col("name")) == F.col("_name"), "left_anti"
    )
    return registry.unionByName(fresh, allowMissingColumns=True)


def total_rows(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"))
