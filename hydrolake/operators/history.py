"""The serving slice: what was measured, what was predicted, and the latest of each."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.constants import CUTOFF_YEAR, DEFAULT_STATION, FORECAST_END, POLLUTED, UNKNOWN_RIVER
from hydrolake.functions.rivers import canonical_code, matches_river, river_of_station
from hydrolake.functions.wqi import status, status_key
from hydrolake.operators.cleaning import dedup

READING_COLUMNS = (
    "station_code", "station_name", "river_name", "date", "wqi", "river_status", "data_type", "is_predicted", "id",
)


def station_key() -> Column:
    """One key per station whatever its label: the registered code when known."""
    return canonical_code("station_code", "station_name")


def as_reading(points: DataFrame) -> DataFrame:
    """Forecast point -> reading row of type ``predicted_historical``."""
    wqi = F.coalesce(F.col("wqi").cast("double"), F.lit(0.0))
    known = F.col("river_status") if "river_status" in points.columns else F.lit(None).cast("string")
    ident = F.col("id") if "id" in points.columns else F.lit(None).cast("long")
    # Code and river are computed once, in their own projections: nested, the
    # lookups would be repeated inside every expression that uses them.
    named = points.withColumn("_code", station_key()).withColumn("_river", river_of_station("_code", "station_name"))
    return named.select(
        F.col("_code").alias("station_code"),
        F.col("_river").alias("station_name"),
        F.col("_river").alias("river_name"),
        F.col("date").cast("date").alias("date"),
        wqi.alias("wqi"),
        F.coalesce(known, status(wqi)).alias("river_status"),
        F.lit("predicted_historical").alias("data_type"),
        F.lit(True).alias("is_predicted"),
        ident.alias("id"),
    )


def to_forecast_points(records: DataFrame) -> DataFrame:
    """Stored predicted record -> forecast point (the reverse of ``as_reading``)."""
    wqi = F.coalesce(F.col("wqi").cast("double"), F.lit(0.0))
    named = records.withColumn("_code", station_key()).withColumn("_river", river_of_station("_code", "station_name"))
    return named.select(
        F.col("date").cast("date").alias("date"),
        F.col("_code").alias("station_code"),
        F.col("_river").alias("station_name"),
        F.col("_river").alias("river_name"),
        wqi.alias("wqi"),
        F.coalesce(F.col("river_status"), status(wqi)).alias("river_status"),
    )


def complete_reading(df: DataFrame) -> DataFrame:
    """Add the optional reading columns a table lacks (untyped rows count as historical)."""
    defaults = {
        "station_name": F.lit(None).cast("string"),
        "river_name": F.lit(None).cast("string"),
        "river_status": status("wqi", null_as=POLLUTED),
        "data_type": F.lit("historical"),
        "id": F.lit(0).cast("long"),
    }
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def measured_until(readings: DataFrame, as_of: date) -> DataFrame:
    kind = F.lower(F.trim(F.coalesce(F.col("data_type"), F.lit("historical"))))
    return readings.filter((F.col("date") <= F.lit(as_of)) & (kind != "forecast"))


def historical_slice(readings: DataFrame, points: DataFrame | None, as_of: date, station: str | None = None) -> DataFrame:
    """Measured rows up to ``as_of`` (newest row per station and day), plus passed
    forecast points on days without a measurement.

    One exchange: both inputs are stacked with a priority and reduced by one
    keyed dedup, rather than deduplicated apart and then anti-joined. ``station``
    (a code, or a name where the code is blank) restricts both inputs before it.
    """
    measured = measured_until(complete_reading(readings), as_of).select(
        *[c for c in READING_COLUMNS if c != "is_predicted"], F.lit(False).alias("is_predicted")
    )
    measured = measured if station is None else measured.filter(station_key() == station.strip())
    stacked = measured.withColumn("_priority", F.lit(0)).withColumn("_order", -F.col("id"))
    if points is not None:
        passed = as_reading(points.filter(F.col("date") <= F.lit(as_of)))
        passed = passed if station is None else passed.filter(station_key() == station.strip())
        stacked = stacked.unionByName(
            passed.withColumn("_priority", F.lit(1)).withColumn("_order", F.col("id"))
        )
    keyed = stacked.filter(F.col("date").isNotNull()).withColumn("_key", station_key())
    return dedup(keyed, ["_key", "date"], [F.col("_priority"), F.col("_order")]).select(*READING_COLUMNS)


def latest_per_station(hist: DataFrame) -> DataFrame:
    """Newest row per station. On a slice that ends at ``as_of`` this is the row
    of that day where the station has one. ``max_by`` is partially aggregated
    before the exchange, so a hot station costs one row per partition."""
    row = F.struct(*hist.columns)
    return (
        hist.withColumn("_key", station_key())
        .filter(F.col("_key") != "")
        .groupBy("_key")
        .agg(F.max_by(row, F.struct("date", "id")).alias("_row"))
        .select("_row.*")
    )


def latest_of_station(hist: DataFrame, label: str) -> DataFrame:
    """Newest row whose display label (name, else code) is ``label``."""
    shown = F.trim(F.coalesce(F.nullif(F.col("station_name"), F.lit("")), F.col("station_code"), F.lit("")))
    return (
        hist.filter(shown == label.strip())
        .agg(F.max_by(F.struct(*hist.columns), F.struct("date", "id")).alias("_row"))
        .filter(F.col("_row").isNotNull())
        .select("_row.*")
    )


def within_year(year: int) -> Column:
    """The days of a year as a range of ``date``, which reaches the scan where year(date) does not."""
    return F.col("date").between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31)))


def tail(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows of the ascending order, still ascending (top-N, no full sort); all rows without ``n``."""
    if n is None:
        return df.orderBy(*order)
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def _serving_filter(
    df: DataFrame, station_code: str | None, station_name: str | None, river: str | None, year: int | None
) -> DataFrame:
    if river and river.strip():
        df = df.filter(matches_river(river))
    if station_code or station_name:
        keep = F.lit(False)
        if station_code:
            keep = keep | (F.col("station_code") == station_code)
        if station_name:
            keep = keep | (F.col("station_name") == station_name) | (F.col("station_code") == station_name)
        df = df.filter(keep)
    return df.filter(within_year(year)) if year is not None else df


def _display_name() -> Column:
    return F.coalesce(F.nullif(F.col("station_name"), F.lit("")), F.col("station_code"))


def _display_river() -> Column:
    return F.coalesce(F.nullif(F.col("river_name"), F.lit("")), river_of_station("station_code", "station_name"))


def time_series(
    hist: DataFrame,
    station_code: str | None = None,
    station_name: str | None = None,
    river: str | None = None,
    year: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Chart series in date order, the latest ``limit`` rows if given. A station filter keeps
    the last row per date; a river that maps to one station needs no such step,
    because a historical slice has one row per station and day."""
    out = _serving_filter(hist, station_code, station_name, river, year)
    if station_code or station_name:
        out = dedup(out, ["date"], [F.desc("station_code"), F.desc("id")])
    return tail(out, limit, ["date", "station_code"]).select(
        "date",
        "wqi",
        "station_code",
        _display_name().alias("station_name"),
        _display_river().alias("river_name"),
        "river_status",
    )


def wqi_data(
    hist: DataFrame,
    station_code: str | None = None,
    station_name: str | None = None,
    river: str | None = None,
    year: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows in date order with the status recomputed from the index, the latest ``limit`` if given."""
    out = _serving_filter(hist, station_code, station_name, river, year)
    return tail(out, limit, ["date", "station_code", "id"]).select(
        "date",
        _display_name().alias("station"),
        "station_code",
        _display_name().alias("station_name"),
        _display_river().alias("river_name"),
        "wqi",
        status(F.coalesce("wqi", F.lit(0.0)), null_as=POLLUTED).alias("river_status"),
    )


def readings_filter(
    station_name: str | None = None,
    river: str | None = None,
    year: int | None = None,
    status_is: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> Column:
    """Compound readings filter as one condition; no argument means no restriction."""
    conditions = []
    if river and river.strip():
        conditions.append(matches_river(river))
    if station_name:
        conditions.append(_display_name() == station_name)
    if year is not None:
        conditions.append(within_year(year))
    if status_is:
        wanted = status_is.strip().lower().replace(" ", "_")
        conditions.append(status(F.coalesce("wqi", F.lit(0.0)), null_as=POLLUTED) == wanted)
    if date_from:
        conditions.append(F.col("date") >= F.lit(date_from))
    if date_to:
        conditions.append(F.col("date") <= F.lit(date_to))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_readings(df: DataFrame, *args, **conditions) -> DataFrame:
    """Rows that ``readings_filter`` with the same arguments keeps."""
    return df.filter(readings_filter(*args, **conditions))


def filter_forecast(
    points: DataFrame,
    as_of: date,
    end: date = FORECAST_END,
    station: str | None = None,
    river: str | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
    status_is: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Points after ``as_of`` through ``end``, by station (code or name), river, years, status and dates."""
    first = max([d for d in [date_from, date(year_from, 1, 1) if year_from else None] if d], default=None)
    last = min([d for d in [end, date_to, date(year_to, 12, 31) if year_to else None] if d])
    out = points.filter((F.col("date") > F.lit(as_of)) & (F.col("date") <= F.lit(last)))
    if first:
        out = out.filter(F.col("date") >= F.lit(first))
    if station:
        code = F.upper(F.trim(F.coalesce("station_code", F.lit(""))))
        name = F.trim(F.coalesce("station_name", F.lit("")))
        out = out.filter((code == station.strip().upper()) | (name == station.strip()))
    if river and river.strip():
        out = out.filter(matches_river(river, river=None))
    if status_is:
        out = out.filter(
            status(F.coalesce("wqi", F.lit(0.0)), null_as=POLLUTED) == status_is.strip().lower().replace(" ", "_")
        )
    return out


def stations_by_status(latest: DataFrame, status_is: str) -> DataFrame:
    return latest.filter(status("wqi", null_as=POLLUTED) == status_key(F.lit(status_is)))


# --- stored records ----------------------------------------------------------------


def scan_records(
    df: DataFrame,
    kind: str,
    as_of: date,
    station: str | None = None,
    limit: int | None = None,
    end: date = FORECAST_END,
) -> DataFrame:
    """Stored rows up to ``as_of`` (``historical``), after it through ``end``
    (``forecast``), or every predicted row through ``end`` (``predicted``)."""
    if kind == "historical":
        out = df.filter(F.col("date") <= F.lit(as_of))
    elif kind == "forecast":
        out = df.filter((F.col("date") > F.lit(as_of)) & (F.col("date") <= F.lit(end)))
    elif kind == "predicted":
        out = df.filter(F.col("is_predicted") & (F.col("date") <= F.lit(end)))
    else:
        raise ValueError("kind must be 'historical', 'forecast' or 'predicted'")
    if station:
        out = out.filter(F.col("station_code") == station.strip().upper())
    out = out.orderBy("date", "station_code")
    return out.limit(limit) if limit is not None else out


def filter_years(df: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Rows dated inside the years; rows without a valid date are dropped."""
    if year_from is None and year_to is None:
        return df
    out = df.filter(F.col("date").isNotNull())
    if year_from is not None:
        out = out.filter(F.col("date") >= F.lit(date(year_from, 1, 1)))
    if year_to is not None:
        out = out.filter(F.col("date") <= F.lit(date(year_to, 12, 31)))
    return out


def purge_after(df: DataFrame, year: int = CUTOFF_YEAR) -> DataFrame:
    """Drop rows dated after ``year``; rows without a usable year pass."""
    if dict(df.dtypes)["date"] == "date":
        return df.filter(F.col("date").isNull() | (F.col("date") <= F.lit(date(year, 12, 31))))
    year_of = F.substring("date", 1, 4).try_cast("int")
    return df.filter(year_of.isNull() | (year_of <= year))


def remove_where(df: DataFrame, condition: Column) -> DataFrame:
    """Delete: keep the rows on which ``condition`` is false or NULL."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def removed_count(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("removed"))


def same_river_label(label: str) -> Column:
    return F.lower(F.trim(F.coalesce("river_name", F.lit("")))) == label.strip().lower()


def valid_record() -> Column:
    """Rows a store accepts: a date and a non-blank station code."""
    return F.col("date").isNotNull() & (F.trim(F.coalesce("station_code", F.lit(""))) != "")


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str] = ("date", "station_code"),
    order: str = "_ord",
    by_order: bool = False,
) -> DataFrame:
    """Insert or replace whole rows by key; among updates of one key the last wins.

    Updates beat stored rows, unless ``by_order``: then the highest ``order``
    wins wherever it is, so the result does not depend on the sequence in which
    batches arrive. Both sides are stacked and reduced by one keyed dedup: one
    exchange, cut to one row per key and partition before it.
    """
    old = target.withColumn("_side", F.lit(0))
    new = updates.filter(valid_record()).withColumn("_side", F.lit(1))
    stacked = old.unionByName(new, allowMissingColumns=True)
    newest = [F.desc(order), F.desc("_side")] if by_order else [F.desc("_side"), F.desc(order)]
    return dedup(stacked, list(keys), newest).drop("_side")


def append_dedup(base: DataFrame, new: DataFrame, order: str = "_ord", cutoff_year: int = CUTOFF_YEAR) -> DataFrame:
    """Append readings; per (station, date) the newest row wins. New rows dated
    after ``cutoff_year`` are refused."""
    stacked = base.withColumn("_side", F.lit(0)).unionByName(
        purge_after(new, cutoff_year).withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    code = F.trim(F.coalesce("station_code", F.lit("")))
    keyed = stacked.withColumn("_key", F.when(code != "", code).otherwise(station_key()))
    return dedup(keyed, ["_key", "date"], [F.desc("_side"), F.desc(order)]).drop("_key", "_side")


def tag_reading(df: DataFrame, source: str | None, data_type: str | None = None) -> DataFrame:
    """Provenance of appended readings: the type defaults to the source when that is
    a simulated one, otherwise to 'historical'."""
    kind = data_type or (source if source and source.startswith("simulated") else "historical")
    name = F.trim(F.coalesce(F.nullif(F.col("station_name"), F.lit("")), F.col("station_code")))
    return df.withColumns(
        {
            "station_name": name,
            "river_name": river_of_station("station_code", name),
            "source": F.lit(source),
            "data_type": F.lit(kind),
        }
    )


def to_readings(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Any loaded table -> readings, with code and name standing in for each other; the columns ``keep`` stay."""

    def text(c: str) -> Column:
        return F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit(None).cast("string")

    code = F.coalesce(text("station_code"), text("station_name"), F.lit(DEFAULT_STATION))
    registered = F.when(text("station_code").isNotNull(), river_of_station("station_code", None))
    named = F.when(registered != UNKNOWN_RIVER, registered)
    name = F.coalesce(text("station_name"), named, text("station_code"), F.lit("Unknown"))
    wqi = F.coalesce(F.col("wqi").try_cast("double"), F.lit(0.0))
    labelled = df.select(code.alias("station_code"), name.alias("station_name"), "date", wqi.alias("wqi"), *keep)
    return labelled.select(
        "station_code",
        "station_name",
        river_of_station("station_code", "station_name").alias("river_name"),
        "date",
        "wqi",
        status("wqi", null_as=POLLUTED).alias("river_status"),
        *keep,
    )


def to_record_rows(df: DataFrame, dataset_id: int, data_source: str, cutoff_year: int = CUTOFF_YEAR) -> DataFrame:
    """Stored-record projection: first numeric of the alternative columns, status, provenance."""

    def first_number(*names: str) -> Column:
        found = [F.col(f"`{n}`").try_cast("double") for n in names if n in df.columns]
        return F.coalesce(*[F.when(~F.isnan(x), x) for x in found]) if found else F.lit(None).cast("double")

    def text(c: str) -> Column:
        return F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")

    wqi = F.coalesce(first_number("wqi"), F.lit(0.0))
    return df.filter(F.col("date").isNotNull() & (F.col("date") <= F.lit(date(cutoff_year, 12, 31)))).select(
        F.col("date").cast("date").alias("date"),
        F.coalesce(text("station_code"), F.lit(DEFAULT_STATION)).alias("station_code"),
        F.nullif(text("station_name"), F.lit("")).alias("station_name"),
        first_number("do_").alias("do_"),
        first_number("bod").alias("bod"),
        first_number("cod").alias("cod"),
        first_number("an", "NH3-N").alias("an"),
        first_number("ss", "tss").alias("ss"),
        first_number("ph").alias("ph"),
        wqi.alias("wqi"),
        status(wqi, null_as=POLLUTED).alias("pollution_status"),
        F.lit(data_source).alias("data_source"),
        F.lit(False).alias("is_predicted"),
        F.lit(dataset_id).cast("long").alias("dataset_id"),
    )


# --- prediction log ------------------------------------------------------------------


def to_log(points: DataFrame, run: str = "run_id") -> DataFrame:
    """Nested log: one row per run and station, its points as an array in date order.

    The array stays at station grain on purpose: it is bounded by the days of
    one horizon, while a whole run is bounded by nothing.
    """
    point = F.struct("date", "station_name", "river_name", "wqi", "river_status")
    return points.groupBy(run, "station_code").agg(
        F.array_sort(F.collect_list(point)).alias("forecast"), F.count("*").alias("n_points")
    )


def from_log(log: DataFrame, run: str = "run_id") -> DataFrame:
    return log.select(run, "station_code", F.explode("forecast").alias("p")).select(run, "station_code", "p.*")


def latest_run(points: DataFrame, run: str = "run_id", created: str = "created_at") -> DataFrame:
    """Points of the newest run that has any dated point."""
    newest = points.filter(F.col("date").isNotNull()).agg(
        F.max_by(run, F.struct(created, run)).alias(run)
    )
    return points.join(newest, run, "left_semi").filter(F.col("date").isNotNull())
