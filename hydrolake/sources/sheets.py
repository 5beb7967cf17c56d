"""Many sheets with different headers, read together.

The first line of every file is read in one job; a task stops reading after it,
however large its file is. Different headers are few, and each is resolved once into a
layout: the place of every canonical column. Then one scan reads all files by place
and every row picks its columns by the layout of its file. The number of jobs and the
size of the plan follow neither the number of files nor that of headers, and
the driver gets one row: the widest header and which columns occur at all.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.constants import (
    BASIN_HEADERS,
    CODE_HEADERS,
    DATE_HEADERS,
    DEFAULT_STATION,
    NAME_HEADERS,
    PARAMETERS,
    RIVER_HEADERS,
    STATUS_HEADERS,
)
from hydrolake.functions.calendar import parse_date
from hydrolake.functions.rivers import river_name
from hydrolake.sources.monitoring import ORDER, first_of, kept_columns, source_order
from hydrolake.sources.shared import materialize, new_path

#: Layout entries that are looked up among several headers.
LOOKED_UP = {
    "date": DATE_HEADERS, "code": CODE_HEADERS, "name": NAME_HEADERS,
    "river": RIVER_HEADERS, "basin": BASIN_HEADERS, "status": STATUS_HEADERS,
}
ENTRIES = [*LOOKED_UP, *PARAMETERS, "wqi"]
#: As the size of a split and as the cost of opening a file it puts every file into a task of its own.
WHOLE_FILE = str(1 << 40)


def layout_of(headers: Sequence[str]) -> dict[str, int | None]:
    """Place of each entry of ``ENTRIES`` in a sheet with these headers."""
    kept = kept_columns(headers)
    found = {entry: first_of(list(kept), candidates) for entry, candidates in LOOKED_UP.items()}
    return {entry: kept.get(found.get(entry, entry)) for entry in ENTRIES}


def header_lines(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """(file_path, header) of every file that is not empty; line breaks inside quotes belong to the header."""
    session = spark.newSession()  # the settings are for this scan only
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        session.conf.set(key, WHOLE_FILE)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = None
        for batch in batches:
            for path, text in zip(batch.column("file_path").to_pylist(), batch.column("value").to_pylist()):
                line = text if line is None else f"{line}\n{text}"
                if line.count('"') % 2 == 0 and line.strip("﻿ \r\n\t"):
                    header = next(csv.reader([line.lstrip("﻿")]), [])
                    yield pa.RecordBatch.from_pydict({"file_path": [path], "header": pa.array([header], pa.list_(pa.string()))})
                    return

    lines = session.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(paths)
    target = "file_path string, header array<string>"
    path = new_path(spark, "headers")
    lines.select("value", F.col("_metadata.file_path").alias("file_path")).mapInArrow(first, target).write.parquet(path)
    return spark.read.schema(target).parquet(path)


def with_layouts(files: DataFrame) -> DataFrame:
    """Add ``layout``; each distinct header is resolved once."""

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts = [layout_of(h) for h in batch.column("header").to_pylist()]
            kind = pa.struct([(e, pa.int32()) for e in ENTRIES])
            yield pa.RecordBatch.from_arrays([batch.column("header"), pa.array(layouts, kind)], names=["header", "layout"])

    places = ", ".join(f"`{e}`: int" for e in ENTRIES)
    layouts = files.select("header").distinct().mapInArrow(resolve, f"header array<string>, layout struct<{places}>")
    return files.join(layouts, "header")


def plain_path(path: Column) -> Column:
    """A path without scheme and host; the percent codes of a URI are resolved, other paths stay as they are."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    local = F.regexp_replace(path, scheme, "")
    decoded = F.coalesce(F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))), local)
    return F.when(path.rlike(scheme), decoded).otherwise(local)


def read_files(spark: SparkSession, paths: str | Sequence[str], files: DataFrame, multiline: bool = False, glob: str = "*.csv") -> DataFrame:
    """All rows of the files in ``files`` (file_path, header, layout and columns to keep) with canonical columns and ``_ord``.

    Columns that no file has are left out, as with ``load_sheet``; rows of a file without a column have NULL.
    """
    files = materialize(files, "files")
    width, *last = files.agg(F.max(F.size("header")), *[F.max(F.col("layout")[e]) for e in ENTRIES]).first()
    exists = {e for e, place in zip(ENTRIES, last) if place is not None}
    names = [f"c{i}" for i in range(width or 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    # Every file's first line is skipped, whatever it says.
    raw = reader.csv(paths, header=True, enforceSchema=True, multiLine=multiline)
    rows = raw.select(F.array(*names).alias("_fields"), F.col("_metadata.file_path").alias("file_path"), source_order().alias(ORDER))
    keep = [c for c in files.columns if c not in ("file_path", "header", "layout")]
    joined = rows.join(files.drop("header"), "file_path")

    def field(entry: str) -> Column:
        return F.get("_fields", F.col("layout")[entry])

    def text(entry: str) -> Column:
        return F.trim(field(entry))

    code = F.when(F.col("layout")["code"].isNull(), DEFAULT_STATION).otherwise(text("code"))
    named = joined.select(
        *keep,
        parse_date(field("date")).alias("date"),
        code.alias("station_code"),
        F.when(F.col("layout")["name"].isNull(), code).otherwise(text("name")).alias("station_name"),
        F.when(F.col("layout")["river"].isNotNull(), text("river")).alias("_river"),
        F.col("layout")["river"].isNotNull().alias("_has_river"),
        text("basin").alias("_basin"),
        *[field(p).alias(p) for p in (*PARAMETERS, "wqi") if p in exists],
        *([field("status").alias("river_status")] if "status" in exists else []),
        ORDER,
    )
    river = F.when(F.col("_has_river"), F.col("_river")).otherwise(river_name("station_code", "station_name", "_basin"))
    out = named.withColumn("river_name", river)
    order = [*keep, "date", "station_code", "station_name", "river_name"]
    return out.select(*order, *[c for c in named.columns if c not in (*order, "_river", "_has_river", "_basin")])


def read_sheets(spark: SparkSession, paths: str | Sequence[str], registry: DataFrame | None = None, multiline: bool = False) -> DataFrame:
    """All sheets below ``paths``; with a registry (file_path and columns to keep) only those that it names."""
    files = with_layouts(header_lines(spark, paths))
    if registry is not None:
        named = registry.withColumn("_path", plain_path(F.col("file_path"))).drop("file_path")
        files = files.withColumn("_path", plain_path(F.col("file_path"))).join(named, "_path").drop("_path")
    return read_files(spark, paths, files, multiline)


def _pattern(source: str) -> str:
    """Regular expression of the plain paths of files that a listed file, folder or glob holds."""
    if found := re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", source):
        source = unquote(source[found.end() :])
    parts = {"*": "[^/]*", "?": "[^/]"}
    return "^(.*/)?" * (not source.startswith("/")) + "".join(parts.get(c, re.escape(c)) for c in source.rstrip("/")) + "(/.*)?$"


def read_many(spark: SparkSession, sources: Sequence[str], multiline: bool = False) -> DataFrame:
    """Union of sources with different headers; each source may itself be a folder or glob.

    Rows of a source that is listed earlier come first, whatever the paths are called.
    """
    if not sources:
        raise ValueError("no sources given")
    files = with_layouts(header_lines(spark, list(sources), "*"))
    path, place = plain_path(F.col("file_path")), F.lit(None).cast("int")
    for i, source in reversed(list(enumerate(sources))):
        place = F.when(path.rlike(_pattern(source)), i).otherwise(place)
    placed = files.withColumn("_source", place)
    rows = read_files(spark, list(sources), placed, multiline, "*")
    return rows.withColumn(ORDER, F.struct(F.col("_source").alias("source"), F.col(ORDER).alias("at"))).drop("_source")
