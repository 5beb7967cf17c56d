"""Station-code and river-name resolution as Column expressions.

The register has seven rows of fixed size, so lookups are literal maps inside
the projection: no join, no shuffle, no broadcast variable.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolake.constants import (
    CODE_BY_RIVER,
    RIVER_BY_BASIN,
    RIVER_BY_CODE,
    UNKNOWN_RIVER,
)


def _col(c: Column | str | None) -> Column:
    if c is None:
        return F.lit(None).cast("string")
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict[str, str], key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def _text(c: Column | str | None) -> Column:
    return F.trim(F.coalesce(_col(c), F.lit("")))


def normalize_code(c: Column | str | None) -> Column:
    return F.upper(_text(c))


def canonical_code(code: Column | str | None, name: Column | str | None = None) -> Column:
    """Map any station label to a registered code; unknown labels pass through."""
    norm = normalize_code(code)
    label = F.trim(F.coalesce(F.nullif(_col(name), F.lit("")), _col(code), F.lit("")))
    return (
        F.when(norm.isin(*RIVER_BY_CODE), norm)
        .when(label == "", "")
        .otherwise(
            F.coalesce(
                _lookup(CODE_BY_RIVER, label),
                F.when(F.upper(label).isin(*RIVER_BY_CODE), F.upper(label)),
                F.nullif(norm, F.lit("")),
                label,
            )
        )
    )


def river_of_station(code: Column | str | None, name: Column | str | None = None) -> Column:
    norm, label = normalize_code(code), _text(name)
    return F.coalesce(
        _lookup(RIVER_BY_CODE, norm),
        F.when(label.startswith("Sungai "), label),
        F.when((label != "") & (norm != ""), F.concat(label, F.lit(" ("), norm, F.lit(")"))),
        F.nullif(label, F.lit("")),
        F.lit(UNKNOWN_RIVER),
    )


def river_of_basin(basin: Column | str | None) -> Column:
    """Basin token to river name; NULL for a blank token."""
    token = _text(basin)
    return F.when(
        token != "",
        F.coalesce(
            _lookup(RIVER_BY_BASIN, F.upper(token)),
            F.when(F.upper(token).startswith("SUNGAI "), F.initcap(token)),
            F.concat(F.lit("Sungai "), F.initcap(token)),
        ),
    )


def river_name(
    code: Column | str | None,
    name: Column | str | None = None,
    basin: Column | str | None = None,
    explicit: Column | str | None = None,
) -> Column:
    """Inference priority: explicit column, basin token, station code, station label."""
    return F.coalesce(
        F.nullif(_text(explicit), F.lit("")), river_of_basin(basin), river_of_station(code, name)
    )


def matches_river(
    target: str | None,
    code: Column | str = "station_code",
    name: Column | str | None = "station_name",
    river: Column | str | None = "river_name",
) -> Column:
    """Row belongs to ``target`` by river column, station name or code. Forecast
    points have no trusted river column: pass ``river=None`` for them."""
    wanted = (target or "").strip()
    if not wanted:
        return F.lit(True)
    return (
        (_text(river) == wanted)
        | (river_of_station(code, name) == wanted)
        | (_text(name) == wanted)
        | (normalize_code(code) == wanted)
    )


def is_canonical(
    code: Column | str = "station_code",
    name: Column | str | None = "station_name",
    river: Column | str | None = "river_name",
) -> Column:
    known = list(CODE_BY_RIVER)
    return (
        normalize_code(code).isin(*RIVER_BY_CODE)
        | _text(river).isin(known)
        | _text(name).isin(known)
        | river_of_station(code, name).isin(known)
    )
