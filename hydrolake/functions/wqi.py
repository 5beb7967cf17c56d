"""Water Quality Index as Column expressions.

All six sub-index curves stay inside whole-stage codegen; nothing here needs a
Python worker. A missing or negative concentration gives a NULL sub-index, and
a NULL sub-index adds nothing to the weighted sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.constants import (
    CLEAN,
    CLEAN_MIN,
    PARAMETERS,
    POLLUTED,
    SLIGHT,
    SLIGHT_MIN,
    STATUS_LABELS,
    UNKNOWN,
    WQI_WEIGHTS,
)


def _number(c: Column | str) -> Column:
    """The column as a double with NaN turned into NULL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def si_do(c: Column | str) -> Column:
    # The cubic stays near zero below the 7.92 mg/l plateau, then jumps to 100.
    x = _number(c)
    cubic = F.lit(-0.395) + F.lit(0.030) * x * x - F.lit(0.00020) * x * x * x
    return F.when(x >= 7.92, 100.0).when(x == 0, 0.0).when(x > 0, cubic)


def si_bod(c: Column | str) -> Column:
    x = _number(c)
    return F.when(x == 0, 100.0).when(x >= 20, 0.0).when(x > 0, 100.4 * F.exp(-0.223 * x))


def si_cod(c: Column | str) -> Column:
    # Can exceed 100 just above zero and go negative between 100 and 200.
    x = _number(c)
    return (
        F.when(x == 0, 100.0)
        .when(x >= 200, 0.0)
        .when(x > 100, -0.5 * x + 50.0)
        .when(x > 0, -1.33 * x + 133.33)
    )


def si_an(c: Column | str) -> Column:
    x = _number(c)
    return F.when(x == 0, 100.0).when(x >= 10, 0.0).when(x > 0, 100.5 * F.exp(-0.393 * x))


def si_tss(c: Column | str) -> Column:
    x = _number(c)
    return F.when(x == 0, 100.0).when(x >= 500, 0.0).when(x > 0, 97.0 * F.exp(-0.00676 * x) + 3.0)


def si_ph(c: Column | str) -> Column:
    x = _number(c)
    return (
        F.when(x.between(7.0, 8.75), 100.0)
        .when((x >= 5.5) & (x < 7.0), 17.2 * x - 34.4)
        .when((x > 8.75) & (x <= 9.0), 242.0 - 16.2 * x)
        .when(x.isNotNull(), 0.0)
    )


SUB_INDEX = {"do_": si_do, "bod": si_bod, "cod": si_cod, "an": si_an, "tss": si_tss, "ph": si_ph}


def add_sub_indices(df: DataFrame) -> DataFrame:
    """One ``si_<parameter>`` column per parameter (NULL where the parameter is absent)."""
    return df.withColumns(
        {
            f"si_{p}": SUB_INDEX[p](p) if p in df.columns else F.lit(None).cast("double")
            for p in PARAMETERS
        }
    )


def wqi_of(columns: dict[str, Column | str]) -> Column:
    """Weighted index of the given parameter columns, clipped to 0..100."""
    total = F.lit(0.0)
    for p in PARAMETERS:
        if p in columns:
            total = total + F.lit(WQI_WEIGHTS[p]) * F.coalesce(SUB_INDEX[p](columns[p]), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def computed_wqi(df: DataFrame) -> Column:
    return wqi_of({p: p for p in PARAMETERS if p in df.columns})


def status(c: Column | str, null_as: str = UNKNOWN) -> Column:
    """Status band of a WQI; NULL/NaN becomes ``null_as`` ('unknown' or 'polluted')."""
    x = _number(c)
    return (
        F.when(x.isNull(), null_as)
        .when(x >= CLEAN_MIN, CLEAN)
        .when(x >= SLIGHT_MIN, SLIGHT)
        .otherwise(POLLUTED)
    )


def status_label(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    label = F.lit(STATUS_LABELS[UNKNOWN])
    for code in (POLLUTED, SLIGHT, CLEAN):
        label = F.when(x == code, STATUS_LABELS[code]).otherwise(label)
    return label


def normalize_status_text(c: Column | str) -> Column:
    """Free-text status to a band name; text that fits no band becomes NULL."""
    s = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return (
        F.when(s.contains("clean"), CLEAN)
        .when(s.contains("slight") | s.contains("moderate"), SLIGHT)
        .when(s.contains("pollut"), POLLUTED)
    )


def status_key(c: Column | str) -> Column:
    """Filter-argument spelling: 'Slightly Polluted' -> 'slightly_polluted'."""
    s = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(s)), " ", "_")


def add_wqi(df: DataFrame, prefer: str = "existing") -> DataFrame:
    """Add ``wqi`` and ``river_status``.

    ``prefer="existing"`` keeps a supplied WQI where it is not NULL (unclipped)
    and computes the rest. ``prefer="computed"`` overrides the supplied WQI on
    every row that has at least one parameter; rows without parameters keep
    theirs, or 0.
    """
    computed = computed_wqi(df)
    present = [p for p in PARAMETERS if p in df.columns]
    has_existing = "wqi" in df.columns
    existing = _number(F.col("wqi").try_cast("double")) if has_existing else None
    if prefer == "existing":
        value = F.coalesce(existing, computed) if has_existing else computed
        return df.withColumn("wqi", value).withColumn("river_status", status("wqi"))
    if prefer == "computed":
        has_param = F.lit(False)
        for p in present:
            has_param = has_param | _number(p).isNotNull()
        fallback = F.coalesce(existing, F.lit(0.0)) if has_existing else F.lit(0.0)
        return df.withColumn("wqi", F.when(has_param, computed).otherwise(fallback)).withColumn(
            "river_status", status("wqi", null_as=POLLUTED)
        )
    raise ValueError("prefer must be 'existing' or 'computed'")


def wqi_proxy(df: DataFrame, kind: str) -> Column:
    """Named rough formulas that are never the default.

    ``'mean_penalty'``: mean over the parameters of ``100 - 5x`` clipped to 0..100.
    ``'linear'``: one linear formula clipped to 0..100, one decimal.
    """
    if kind == "mean_penalty":
        total = F.lit(0.0)
        for p in PARAMETERS:
            penalty = 100.0 - F.coalesce(_number(p), F.lit(0.0)) * 5.0
            total = total + F.greatest(F.lit(0.0), F.least(F.lit(100.0), penalty))
        return total / float(len(PARAMETERS))
    if kind == "linear":
        raw = (
            100.0
            - (F.col("bod") * 3.0 + F.col("cod") / 12.0 + F.col("tss") / 4.0 + F.col("an") * 8.0)
            + (F.col("do_") - 5.0) * 2.0
            + (F.col("ph") - 6.0) * 5.0
        )
        return F.when(raw.isNull(), 50.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 1)))
        )
    raise ValueError("kind must be 'mean_penalty' or 'linear'")


# Higher score = the parameter pulls the index down more (fixed heuristic scales).
STRESS = {
    "do_": lambda x: 100.0 * F.greatest(F.lit(0.0), 7.0 - x) / 7.0,
    "bod": lambda x: x * 5.0,
    "cod": lambda x: x * 2.0,
    "an": lambda x: x * 50.0,
    "tss": lambda x: x / 2.0,
    "ph": lambda x: F.abs(x - 7.0) * 20.0,
}


def stress_score(parameter: str, c: Column | str | None = None) -> Column:
    x = _number(parameter if c is None else c)
    return F.when(
        x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), STRESS[parameter](x)))
    )


def stress_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({f"stress_{p}": stress_score(p) for p in PARAMETERS if p in df.columns})


def envelope_half_width(c: Column | str) -> Column:
    w = F.coalesce(_number(c), F.lit(0.0))
    return F.least(F.lit(12.0), F.greatest(F.lit(3.0), 0.08 * F.greatest(w, F.lit(1.0))))


def with_envelope(df: DataFrame, wqi: str = "wqi") -> DataFrame:
    """Illustrative band around a forecast: +/-8 % (at least 3, at most 12), clipped to 0..100."""
    w = F.coalesce(_number(wqi), F.lit(0.0))
    half = envelope_half_width(wqi)
    return df.withColumns(
        {
            "wqi_lower": F.round(F.greatest(F.lit(0.0), w - half), 2),
            "wqi_upper": F.round(F.least(F.lit(100.0), w + half), 2),
        }
    )


SQL_FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION wqi_status(w DOUBLE) RETURNS STRING
       RETURN CASE WHEN w IS NULL OR isnan(w) THEN 'unknown' WHEN w >= 81D THEN 'clean'
                   WHEN w >= 60D THEN 'slightly_polluted' ELSE 'polluted' END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sub_index_do(x DOUBLE) RETURNS DOUBLE
       RETURN CASE WHEN isnan(x) THEN NULL WHEN x >= 7.92D THEN 100D WHEN x = 0D THEN 0D
                   WHEN x > 0D THEN -0.395D + 0.030D * x * x - 0.00020D * x * x * x END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sub_index_bod(x DOUBLE) RETURNS DOUBLE
       RETURN CASE WHEN isnan(x) THEN NULL WHEN x = 0D THEN 100D WHEN x >= 20D THEN 0D
                   WHEN x > 0D THEN 100.4D * exp(-0.223D * x) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sub_index_cod(x DOUBLE) RETURNS DOUBLE
       RETURN CASE WHEN isnan(x) THEN NULL WHEN x = 0D THEN 100D WHEN x >= 200D THEN 0D
                   WHEN x > 100D THEN -0.5D * x + 50D WHEN x > 0D THEN -1.33D * x + 133.33D END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sub_index_an(x DOUBLE) RETURNS DOUBLE
       RETURN CASE WHEN isnan(x) THEN NULL WHEN x = 0D THEN 100D WHEN x >= 10D THEN 0D
                   WHEN x > 0D THEN 100.5D * exp(-0.393D * x) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sub_index_tss(x DOUBLE) RETURNS DOUBLE
       RETURN CASE WHEN isnan(x) THEN NULL WHEN x = 0D THEN 100D WHEN x >= 500D THEN 0D
                   WHEN x > 0D THEN 97D * exp(-0.00676D * x) + 3D END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sub_index_ph(x DOUBLE) RETURNS DOUBLE
       RETURN CASE WHEN x IS NULL OR isnan(x) THEN NULL
                   WHEN x >= 7.0D AND x <= 8.75D THEN 100D
                   WHEN x >= 5.5D AND x < 7.0D THEN 17.2D * x - 34.4D
                   WHEN x > 8.75D AND x <= 9.0D THEN 242D - 16.2D * x ELSE 0D END""",
)


def register_sql_functions(spark: SparkSession) -> None:
    """Expose the scalar functions to ``spark.sql`` as inlined SQL functions."""
    for ddl in SQL_FUNCTIONS:
        spark.sql(ddl)
