"""Date and season expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolake.constants import (
    DRY_DELTA,
    NE_MONSOON_MONTHS,
    RAINY_DELTA,
    RAINY_MONTHS,
    SW_MONSOON_MONTHS,
)

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MMM-yyyy")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits wins; text that fits none becomes NULL (never an error)."""
    text = F.trim(_col(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def iso_date(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def monsoon_flags(c: Column | str) -> dict[str, Column]:
    """Three exclusive 0/1 flags."""
    month = F.month(_col(c))
    ne, sw = month.isin(*NE_MONSOON_MONTHS), month.isin(*SW_MONSOON_MONTHS)
    return {
        "monsoon_ne": F.when(ne, 1.0).otherwise(0.0),
        "monsoon_sw": F.when(sw, 1.0).otherwise(0.0),
        "monsoon_other": F.when(ne | sw, 0.0).otherwise(1.0),
    }


def month_cyclical(c: Column | str) -> dict[str, Column]:
    angle = 2.0 * math.pi * (F.coalesce(F.month(_col(c)), F.lit(1)).cast("double") - 1.0) / 12.0
    return {"month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def seasonal_delta(c: Column | str) -> Column:
    return F.when(F.month(_col(c)).isin(*RAINY_MONTHS), RAINY_DELTA).otherwise(DRY_DELTA)


def range_label(first: Column | str, last: Column | str) -> Column:
    """'Jan 1995–Nov 2001'."""
    return F.concat(F.date_format(_col(first), "MMM yyyy"), F.lit("–"), F.date_format(_col(last), "MMM yyyy"))


def heat_grid(c: Column | str) -> dict[str, Column]:
    """Week column and weekday row (Sunday = 0) of a year calendar."""
    d = _col(c)
    pad = F.dayofweek(F.trunc(d, "year")) - 1
    return {
        "week_col": F.floor((F.dayofyear(d) - 1 + pad) / 7).cast("int"),
        "weekday_row": (F.dayofweek(d) - 1).cast("int"),
    }
