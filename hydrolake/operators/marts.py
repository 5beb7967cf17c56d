"""Dashboard tables: joins, aggregates, rollups and sorted pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrolake.constants import (
    CLEAN,
    FORECAST_END,
    MAP_CENTRE,
    MAP_OFFSETS,
    MULTIPLE_RIVERS,
    NO_COVERAGE_LABEL,
    PARAMETERS,
    POLLUTED,
    SEVERITY_ORDER,
    SLIGHT,
    STATIONS,
)
from hydrolake.functions.calendar import heat_grid, range_label
from hydrolake.functions.rivers import canonical_code, is_canonical, matches_river, river_of_station
from hydrolake.functions.wqi import envelope_half_width, status, stress_score
from hydrolake.operators.cleaning import dedup
from hydrolake.operators.history import (
    filter_forecast,
    latest_per_station,
    station_key,
    tail,
    within_year,
)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side without joining them."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def station_dimension(spark) -> DataFrame:
    """The fixed seven-row register."""
    return spark.createDataFrame(
        list(STATIONS), "station_code string, river_name string, latitude double, longitude double"
    )


# --- joins ---------------------------------------------------------------------


def enrich_river(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Add the river of the register to each row. No broadcast is forced: Spark
    broadcasts the register while its size is under the configured threshold."""
    dim = stations.select(F.col("station_code"), F.col("river_name").alias("dim_river_name"))
    return df.join(dim, "station_code", "left").withColumn(
        "river_name", F.coalesce("dim_river_name", river_of_station("station_code", "station_name"))
    ).drop("dim_river_name")


def coverage(hist: DataFrame) -> DataFrame:
    """Distinct days over the inclusive span of days, per station."""
    days = F.datediff("date_to", "date_from") + 1
    return (
        hist.filter(F.col("date").isNotNull())
        .groupBy(station_key().alias("station_code"))
        .agg(
            F.countDistinct("date").alias("coverage_days"),
            F.min("date").alias("date_from"),
            F.max("date").alias("date_to"),
        )
        .filter(F.col("station_code") != "")
        .withColumn("span_days", days)
        .withColumn("coverage_pct", F.least(F.lit(100.0), F.round(100.0 * F.col("coverage_days") / F.col("span_days"), 1)))
        .withColumn("range_label", range_label("date_from", "date_to"))
    )


def latest_stations(hist: DataFrame) -> DataFrame:
    """Map table: newest reading per station."""
    rows = latest_per_station(hist).withColumn("_code", canonical_code("station_code", "station_name"))
    return rows.select(
        F.col("_code").alias("station_code"),
        river_of_station("_code", "station_name").alias("river_name"),
        F.col("wqi").alias("latest_wqi"),
        status(F.coalesce("wqi", F.lit(0.0)), null_as=POLLUTED).alias("river_status"),
        F.col("date").alias("last_reading_date"),
    )


def with_admin_coordinates(stations: DataFrame, admin: DataFrame) -> DataFrame:
    """Overlay the coordinates that the register has, found by code, else by name; own coordinates stay where it has none."""
    own = [c for c in ("latitude", "longitude") if c in stations.columns]
    table = stations.withColumnsRenamed({c: f"_own_{c}" for c in own})

    def found(key: str, tag: str) -> DataFrame:
        place = F.struct("latitude", "longitude")
        known = admin.filter(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
        return known.groupBy(F.upper(F.trim(key)).alias(f"_{tag}")).agg(F.min(place).alias(f"_at_{tag}"))

    names = [c for c in ("station_name", "river_name") if c in stations.columns and c in admin.columns]
    table = table.withColumn("_code", F.upper(F.trim("station_code"))).join(found("station_code", "code"), "_code", "left")
    matched = [F.col("_at_code")]
    for c in names[:1]:
        table = table.withColumn("_name", F.upper(F.trim(c))).join(found(c, "name"), "_name", "left")
        matched.append(F.col("_at_name"))
    for c in ("latitude", "longitude"):
        kept = [F.col(f"_own_{c}")] if c in own else []
        table = table.withColumn(c, F.coalesce(*[m[c] for m in matched], *kept))
    return table.select(*[c for c in stations.columns if c not in own], "latitude", "longitude")


def with_coverage(stations: DataFrame, cov: DataFrame) -> DataFrame:
    """Attach coverage; stations without dated readings get zeros and a label."""
    return stations.join(cov, "station_code", "left").withColumns(
        {
            "coverage_days": F.coalesce("coverage_days", F.lit(0)),
            "span_days": F.coalesce("span_days", F.lit(0)),
            "coverage_pct": F.coalesce("coverage_pct", F.lit(0.0)),
            "range_label": F.coalesce("range_label", F.lit(NO_COVERAGE_LABEL)),
        }
    )


def add_placeholders(stations: DataFrame, templates: DataFrame) -> DataFrame:
    """Registered stations that have no row yet, appended with ``data_coming_soon``."""
    missing = templates.join(stations.select("station_code"), "station_code", "left_anti")
    return stations.withColumn("data_coming_soon", F.lit(False)).unionByName(
        missing.withColumn("data_coming_soon", F.lit(True)), allowMissingColumns=True
    )


def unregistered_stations(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Distinct codes seen in readings but absent from the register."""
    code = F.trim(F.coalesce(F.nullif(F.col("station_code"), F.lit("")), F.col("station_name"), F.lit("S01")))
    seen = readings.select(code.alias("station_code")).filter("station_code <> ''").distinct()
    return seen.join(stations.select("station_code"), "station_code", "left_anti")


def with_coordinates(stations: DataFrame) -> DataFrame:
    """Known coordinates, else the map centre moved by a cyclic offset.

    The offset slot is a hash of the code, so it needs no global ranking and
    does not move when other stations appear.
    """
    dim = station_dimension(stations.sparkSession).select(
        F.col("river_name").alias("_river"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")
    )
    digest = F.conv(F.substring(F.md5("station_code"), 1, 6), 16, 10).cast("long")
    slot = (digest % len(MAP_OFFSETS)).cast("int") + 1
    lat = F.array(*[F.lit(MAP_CENTRE[0] + a) for a, _ in MAP_OFFSETS])
    lon = F.array(*[F.lit(MAP_CENTRE[1] + b) for _, b in MAP_OFFSETS])
    river = river_of_station("station_code", "station_name" if "station_name" in stations.columns else None)
    return (
        stations.withColumn("_river", river)
        .join(F.broadcast(dim), "_river", "left")  # seven fixed rows
        .withColumn("latitude", F.coalesce("_lat", F.element_at(lat, slot)))
        .withColumn("longitude", F.coalesce("_lon", F.element_at(lon, slot)))
        .drop("_river", "_lat", "_lon")
    )


def canonical_station_table(stations: DataFrame) -> DataFrame:
    """One row per registered station: rows keyed by river name are merged into
    their code, the row with the newest reading wins."""
    return dedup(
        stations.filter(is_canonical("station_code", None)).withColumn(
            "station_code", canonical_code("station_code", "river_name")
        ),
        ["station_code"],
        [F.desc_nulls_last("last_reading_date")],
    )


def calendar(hist: DataFrame, year: int, station: str | None = None) -> DataFrame:
    """Every day of ``year`` for each station, WQI where there is a reading.

    One pass over the slice: it is reduced to a row per station and day of the year, then
    to one map of at most 366 days per station, out of which the sequence of days is
    filled. A station that is asked for has its days also without any reading.
    """
    first, last = date(year, 1, 1), date(year, 12, 31)
    rows = hist.withColumn("station_code", F.upper(F.trim("station_code")))
    if station:
        rows = rows.filter(F.col("station_code") == station.strip().upper())
    inside = F.when(F.col("date").between(F.lit(first), F.lit(last)), F.col("date"))
    day = rows.groupBy("station_code", inside.alias("_day")).agg(F.max_by(F.coalesce("wqi", F.lit(0.0)), F.col("id")).alias("_wqi"))
    found = F.collect_list(F.when(F.col("_day").isNotNull(), F.struct("_day", "_wqi")))
    days = day.groupBy("station_code").agg(F.map_from_entries(found).alias("_days"))
    if station:
        asked = hist.sparkSession.range(1).select(F.lit(station.strip().upper()).alias("station_code"))
        days = asked.join(days, "station_code", "left")
    spine = days.filter(F.col("station_code").isNotNull()).select(
        "station_code", "_days", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date")
    )
    cells = spine.select("station_code", "date", F.try_element_at("_days", F.col("date")).alias("_wqi"))
    return cells.select(
        "station_code",
        "date",
        F.round("_wqi", 2).alias("wqi"),
        F.when(F.col("_wqi").isNotNull(), status("_wqi")).alias("status"),
    )


def calendar_grid(cells: DataFrame) -> DataFrame:
    """Week column and weekday row for each calendar cell."""
    return cells.withColumns(heat_grid("date"))


def distinct_codes(codes: Sequence[str]) -> list[str]:
    cleaned = [c.strip().upper() for c in codes if c and c.strip()]
    return list(dict.fromkeys(cleaned))


def compare_long(hist: DataFrame, codes: Sequence[str], year: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of each requested station, long form; the latest ``limit`` of each if given."""
    wanted = distinct_codes(codes)
    rows = hist.filter(F.col("station_code").isin(wanted))
    if year is not None:
        rows = rows.filter(within_year(year))
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("station_code").orderBy(F.desc("date"), F.desc("id")))
        rows = rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit)
    return rows.select("station_code", river_of_station("station_code").alias("river_name"), "date", "wqi", "river_status")


def compare_wide(hist: DataFrame, codes: Sequence[str], year: int | None = None, limit: int | None = None) -> DataFrame:
    """One row per date, one column per station, NULL where a station has no value."""
    wanted = distinct_codes(codes)
    if len(wanted) < 2:
        raise ValueError("compare needs at least two stations")
    return compare_long(hist, wanted, year, limit).groupBy("date").pivot("station_code", wanted).agg(F.max("wqi"))


def flag_anomalies(series: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Mark the rows whose (date, station) appears among the anomalies."""
    keys = anomalies.select("date", F.trim("station_code").alias("station_code")).distinct()
    return (
        series.join(keys.withColumn("_hit", F.lit(True)), ["date", "station_code"], "left")
        .withColumn("is_anomaly", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def dataset_rivers(registry: DataFrame, readings: DataFrame) -> DataFrame:
    """River label per dataset: its own label, else the only river of its readings, else 'Multiple rivers'."""
    river = river_of_station("station_code", "station_name")
    seen = readings.groupBy("dataset_id").agg(F.min(river).alias("_low"), F.max(river).alias("_high"))
    derived = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_low").isNotNull(), MULTIPLE_RIVERS)
    return (
        registry.join(seen, "dataset_id", "left")
        .withColumn("river_name", F.coalesce("river_name", derived))
        .drop("_low", "_high")
    )


def measured_rows(records: DataFrame) -> DataFrame:
    """One row per station and day for the parameter breakdown: measured before predicted, then newest."""
    keyed = records.withColumn("station_code", F.upper(F.trim("station_code")))
    return dedup(keyed, ["station_code", "date"], [F.asc("is_predicted"), F.desc("record_id")])


def actual_vs_predicted(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Aligned long table; rows without a date are dropped on both sides."""
    a = actual.filter(F.col("date").isNotNull()).select("station_code", "date", F.col("wqi").alias("actual_wqi"))
    p = forecast.filter(F.col("date").isNotNull()).select("station_code", "date", F.col("wqi").alias("predicted_wqi"))
    return a.join(p, ["station_code", "date"], "full")


# --- aggregates -------------------------------------------------------------------


def predicted_average(points: DataFrame, as_of: date, end: date = FORECAST_END, river: str | None = None) -> DataFrame:
    return filter_forecast(points, as_of, end, river=river).agg(
        F.coalesce(F.avg("wqi"), F.lit(0.0)).alias("predicted_avg_wqi")
    )


def summary(
    hist: DataFrame,
    alerts: DataFrame,
    points: DataFrame,
    as_of: date,
    end: date = FORECAST_END,
    river: str | None = None,
) -> DataFrame:
    """KPI row: station count, mean index and band counts over the newest row per
    station, unread alerts, and the predicted mean. Zeros when nothing matches."""
    band = status(F.coalesce("_wqi", F.lit(0.0)), null_as=POLLUTED)
    # One pass over the slice: rows per station, and its newest row among those of the river.
    newest = F.when(matches_river(river), F.struct("date", "id"))
    stations = (
        hist.withColumn("_key", station_key())
        .groupBy("_key")
        .agg(F.count("*").alias("_n"), F.max(newest).alias("_at"), F.max_by("wqi", newest).alias("_wqi"))
    )
    counted = (F.col("_key") != "") & F.col("_at").isNotNull()
    kpis = stations.agg(
        F.count_if(counted).alias("total_stations"),
        F.coalesce(F.avg(F.when(counted, F.col("_wqi"))), F.lit(0.0)).alias("avg_wqi"),
        F.count_if(counted & (band == CLEAN)).alias("clean_count"),
        F.count_if(counted & (band == SLIGHT)).alias("slightly_polluted_count"),
        F.count_if(counted & (band == POLLUTED)).alias("polluted_count"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
    )
    unread = alerts.agg(F.count_if(~F.coalesce("is_read", F.lit(False))).alias("recent_alerts_count"))
    return one_row(kpis, unread, predicted_average(points, as_of, end, river)).select(
        "total_stations", "avg_wqi", "clean_count", "slightly_polluted_count", "polluted_count",
        "recent_alerts_count", "total_records", "predicted_avg_wqi",
    )


def overview(hist: DataFrame, as_of: date, end: date = FORECAST_END) -> DataFrame:
    return hist.agg(
        F.count("*").alias("total_records"),
        F.countDistinct(F.nullif(station_key(), F.lit(""))).alias("total_stations"),
        F.min("date").alias("historical_date_from"),
    ).withColumns(
        {
            "latest_date": F.lit(as_of),
            "forecast_date_from": F.date_add(F.lit(as_of), 1),
            "forecast_date_to": F.lit(end),
        }
    )


def prediction_sanity(records: DataFrame, since: date) -> DataFrame:
    """Per station: range, mean, count of predictions and how many look unscaled (below 1)."""
    return (
        records.filter(F.col("date") >= F.lit(since))
        .groupBy("station_code")
        .agg(
            F.min("wqi").alias("min_wqi"),
            F.max("wqi").alias("max_wqi"),
            F.avg("wqi").alias("avg_wqi"),
            F.count("*").alias("total"),
            F.count_if(F.col("wqi") < 1.0).alias("suspicious_low"),
        )
    )


def available_years(hist: DataFrame) -> DataFrame:
    return hist.filter(F.col("date").isNotNull()).select(F.year("date").alias("year")).distinct().orderBy("year")


def river_names(hist: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("river_name"), F.lit("")), river_of_station("station_code", "station_name"))
    return hist.select(name.alias("river_name")).distinct().orderBy("river_name")


def station_choices(stations: DataFrame, river: str | None = None) -> DataFrame:
    """Stations offered for a river, one per key, sorted by name regardless of case."""
    key = F.trim(F.coalesce(F.nullif(F.col("station_code"), F.lit("")), F.col("station_name"), F.lit("")))
    rows = stations.withColumn("_key", key).filter("_key <> ''")
    if river and river.strip():
        rows = rows.filter(F.trim("river_name") == river.strip())
    return rows.dropDuplicates(["_key"]).drop("_key").orderBy(F.lower("station_name"), "station_code")


def filtered_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


ROLLUP_UNITS = {"monthly": "month", "yearly": "year", "daily": "day"}


def rollup_mean(df: DataFrame, grain: str, values: Sequence[str] = ("wqi",), buckets: int | None = None) -> DataFrame:
    """Mean per calendar bucket in order, the newest ``buckets`` of them if given."""
    start = F.date_trunc(ROLLUP_UNITS[grain], F.col("date")).cast("date")
    means = df.filter(F.col("date").isNotNull()).groupBy(start.alias("bucket")).agg(
        *[F.avg(v).alias(f"avg_{v}") for v in values]
    )
    return tail(means, buckets, ["bucket"])


def with_open_envelope(points: DataFrame) -> DataFrame:
    """Chart band: bounds of the point where given, else the unrounded envelope."""
    half = envelope_half_width("wqi")
    lower = F.greatest(F.lit(0.0), F.col("wqi") - half)
    upper = F.least(F.lit(100.0), F.col("wqi") + half)
    return points.filter(F.col("wqi").isNotNull()).withColumns({"wqi_lower": lower, "wqi_upper": upper})


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """Counts in a fixed order with zeros for absent severities."""
    severity = F.lower(F.coalesce("severity", F.lit("info")))
    counts = alerts.agg(*[F.count_if(severity == s).alias(s) for s in SEVERITY_ORDER])
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return counts.unpivot([], list(SEVERITY_ORDER), "severity", "n").withColumn("position", position.cast("int"))


def wqi_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("station_code").agg(
        F.count("wqi").alias("n"),
        F.round(F.avg("wqi"), 2).alias("mean"),
        F.round(F.min("wqi"), 2).alias("min"),
        F.round(F.max("wqi"), 2).alias("max"),
        F.round(F.stddev_samp("wqi"), 2).alias("std"),
    )


def alert_screen_counts(hist: DataFrame, as_of: date) -> DataFrame:
    """Band counts of one day as the alert screen shows them. Its slight band is
    60..80, so values between 80 and 81 are in neither count."""
    return hist.filter(F.col("date") == F.lit(as_of)).agg(
        F.count_if(F.col("wqi").between(60.0, 80.0)).alias("slightly_polluted_today"),
        F.count_if(F.col("wqi") < 60.0).alias("polluted_today"),
    )


def report_preview(hist: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    rows = hist
    if date_from:
        rows = rows.filter(F.col("date") >= F.lit(date_from))
    if date_to:
        rows = rows.filter(F.col("date") <= F.lit(date_to))
    return rows.agg(
        F.count("*").alias("records"),
        F.coalesce(F.avg(F.coalesce("wqi", F.lit(0.0))), F.lit(0.0)).alias("avg_wqi"),
        F.countDistinct("station_code").alias("stations"),
    )


def page_average(page: DataFrame) -> DataFrame:
    return page.agg(F.coalesce(F.avg(F.coalesce("wqi", F.lit(0.0))), F.lit(0.0)).alias("avg_wqi"))


PARAMETER_LABELS = {
    "do_": "Dissolved oxygen (DO)",
    "bod": "BOD",
    "cod": "COD",
    "an": "Ammoniacal nitrogen (AN)",
    "tss": "Suspended solids (SS)",
    "ph": "pH",
}


def contribution(rows: DataFrame) -> DataFrame:
    """Per measured row: stress score, share and raw value of each parameter, strongest first.

    The six parameters are ranked inside the row, so there is no shuffle.
    """
    present = [p for p in PARAMETERS if p in rows.columns]
    entry = [
        F.struct(
            (-stress_score(p)).alias("sort"),
            F.lit(i).alias("slot"),
            F.lit(p).alias("parameter"),
            F.lit(PARAMETER_LABELS[p]).alias("label"),
            stress_score(p).alias("score"),
            F.col(p).cast("double").alias("raw_value"),
        )
        for i, p in enumerate(present)
    ]
    ranked = F.array_sort(F.filter(F.array(*entry), lambda e: e["score"].isNotNull()))
    total = F.aggregate(F.col("_ranked"), F.lit(0.0), lambda s, e: s + e["score"])
    share = 100.0 * F.col("e.score") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total"))
    return (
        rows.withColumn("_ranked", ranked)
        .withColumn("_total", total)
        .select("station_code", "date", "wqi", "_total", F.posexplode("_ranked").alias("pos", "e"))
        .select(
            "station_code",
            "date",
            "wqi",
            (F.col("pos") + 1).alias("rank"),
            F.col("e.parameter").alias("parameter"),
            F.col("e.label").alias("label"),
            F.round("e.score", 2).alias("stress_score"),
            F.round(share, 2).alias("contribution_pct"),
            F.col("e.raw_value").alias("raw_value"),
        )
    )


def split_stats(df: DataFrame, value: str = "wqi") -> DataFrame:
    """Size and distribution (population deviation) per split."""
    return df.groupBy("split").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def split_shift(df: DataFrame, value: str = "wqi") -> DataFrame:
    """Test minus train, flagged when the mean moves by more than 3 or the deviation by more than 5."""
    train, test = (F.when(F.col("split") == s, F.col(value)) for s in ("train", "test"))
    return df.agg(
        (F.avg(test) - F.avg(train)).alias("d_mean"), (F.stddev_pop(test) - F.stddev_pop(train)).alias("d_std")
    ).withColumn("large_shift", (F.abs("d_mean") > 3) | (F.abs("d_std") > 5))


def forecast_checks(points: DataFrame, min_mean: dict[str, float], min_std: float = 2.0) -> DataFrame:
    """Per station: size, mean, sample deviation and whether the forecast looks plausible."""
    floor_of = F.lit(None).cast("double")
    for code, low in min_mean.items():
        floor_of = F.when(F.col("station_code") == code, low).otherwise(floor_of)
    return (
        points.groupBy("station_code")
        .agg(
            F.count("wqi").alias("n"),
            F.avg("wqi").alias("mean"),
            F.coalesce(F.stddev_samp("wqi"), F.lit(0.0)).alias("std"),
            F.min("wqi").alias("min"),
            F.max("wqi").alias("max"),
        )
        .withColumn("mean_ok", F.coalesce(F.col("mean") >= floor_of, F.lit(True)))
        .withColumn("std_ok", F.col("std") >= min_std)
    )


def forecast_spread(points: DataFrame, min_spread: float = 5.0) -> DataFrame:
    """Are the station means far enough apart?"""
    means = points.groupBy("station_code").agg(F.avg("wqi").alias("mean"))
    return means.agg((F.max("mean") - F.min("mean")).alias("spread"), F.count("*").alias("stations")).withColumn(
        "spread_ok", (F.col("stations") < 2) | (F.col("spread") >= min_spread)
    )


# --- sorted pages -------------------------------------------------------------------


def readings_page(
    df: DataFrame, sort_by: str = "date", descending: bool = False, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """The readings (or forecast) table in order with the status recomputed, a page of it if ``limit`` is given."""
    if sort_by not in ("date", "wqi"):
        raise ValueError("sort_by must be 'date' or 'wqi'")
    last = "wqi" if sort_by == "date" else "date"
    order = [F.desc(sort_by) if descending else F.asc(sort_by), F.asc("station_code"), F.asc(last)]
    page = df.orderBy(*order)
    page = page.offset(offset) if offset else page
    page = page if limit is None else page.limit(limit)
    return page.select(
        "station_code",
        F.coalesce(F.nullif(F.col("station_name"), F.lit("")), F.col("station_code")).alias("station_name"),
        F.coalesce(F.nullif(F.col("river_name"), F.lit("")), river_of_station("station_code", "station_name")).alias("river_name"),
        "date",
        "wqi",
        status(F.coalesce("wqi", F.lit(0.0)), null_as=POLLUTED).alias("river_status"),
        (F.coalesce("data_type", F.lit("historical")) if "data_type" in df.columns else F.lit("forecast")).alias("data_type"),
    )


def full_listing(hist: DataFrame) -> DataFrame:
    """Everything, newest first (a range-partitioned sort)."""
    return hist.select(
        "station_code",
        F.coalesce("station_name", "station_code").alias("station_name"),
        "river_name",
        "date",
        "wqi",
        status(F.coalesce("wqi", F.lit(0.0)), null_as=POLLUTED).alias("status"),
    ).orderBy(F.desc("date"), F.desc("station_name"))


def top_recent(df: DataFrame, key: str | Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` rows (a capped listing)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n)


def forecast_table(
    points: DataFrame, as_of: date, year: int, month_from: int = 1, month_to: int = 12, month: int | None = None
) -> DataFrame:
    """Forecast rows after ``as_of`` in a month range, or in one month, in date order."""
    low, high = (month, month) if month else (month_from, month_to)
    after = date(year + 1, 1, 1) if high == 12 else date(year, high + 1, 1)
    return points.filter(
        (F.col("date") > F.lit(as_of))
        & F.col("date").between(F.lit(date(year, low, 1)), F.lit(after - timedelta(days=1)))
    ).orderBy("date", "station_name")


def rank_experiments(results: DataFrame, metric: str = "r2") -> DataFrame:
    """Best first; NaN and missing scores last."""
    score = F.when(~F.isnan(metric), F.col(metric))
    return results.withColumn(metric, score).orderBy(F.desc_nulls_last(metric))


def station_set_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Stations on one side only."""
    a, e = actual.select("station_code").distinct(), expected.select("station_code").distinct()
    return a.exceptAll(e).withColumn("side", F.lit("unexpected")).unionByName(
        e.exceptAll(a).withColumn("side", F.lit("missing"))
    )

