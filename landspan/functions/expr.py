"""Column building blocks shared by every plan (no UDFs: all stay in codegen)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.params import SQFT_PER_ACRE

ColumnLike = Column | str


def c(x: ColumnLike | float | int) -> Column:
    """Name, Column or number to Column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


# --- nulls, ratios, ranges (PRJ01-PRJ06) -----------------------------------


def or_zero(x: ColumnLike) -> Column:
    """PRJ01: NULL becomes 0.0."""
    return F.coalesce(c(x), F.lit(0.0))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """PRJ02: a / b, NULL where b is 0 (never raises under ANSI)."""
    return c(a) / F.nullif(c(b).cast("double"), F.lit(0.0))


def ladder(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """PRJ03: first matching condition wins."""
    out = F.when(cases[0][0], cases[0][1])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def clamp(x: ColumnLike, lo: float | None = None, hi: float | None = None) -> Column:
    """PRJ04: keep x in [lo, hi]; NULL stays NULL."""
    out = c(x)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c(x).isNotNull(), out)


def non_negative(x: ColumnLike) -> Column:
    """At least 0; unknown counts as 0 (greatest skips NULL)."""
    return F.greatest(F.lit(0.0), c(x))


def positive(x: ColumnLike) -> Column:
    """True only for a known value above 0."""
    return F.coalesce(c(x) > 0, F.lit(False))


def blank_to_null(x: ColumnLike) -> Column:
    """Empty text counts as missing in category columns."""
    return F.nullif(F.trim(c(x)), F.lit(""))


def typed_null(type_name: str) -> Column:
    """PRJ06."""
    return F.lit(None).cast(type_name)


def round_decimal(x: ColumnLike, digits: int) -> Column:
    """PRJ05 with halves as in exact decimals: 15.05 computed as 15.049999... rounds up."""
    return F.round(F.round(c(x), 9), digits)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """PRJ05 over every double column of a result."""
    return df.select(
        [F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


# --- column lists (PRJ07-PRJ12) ---------------------------------------------


def deltas(end: str, base: str, columns: Iterable[str], suffix: str = "") -> list[Column]:
    """PRJ07: end - base per column, NULL as 0; sides are DataFrame aliases."""
    return [
        (or_zero(f"{end}.{n}") - or_zero(f"{base}.{n}")).alias(n + suffix) for n in columns
    ]


def per_metric(metrics: Iterable[str], template) -> list[Column]:
    """PRJ08: one Column per metric from a template function."""
    return [template(m).alias(m) for m in metrics]


def spread(total: ColumnLike, shares: Mapping[str, float], prefix: str) -> list[Column]:
    """PRJ09 (fixed shares): one column per key, total * share."""
    return [(c(total) * share).alias(prefix + key) for key, share in shares.items()]


def spread_map(total: ColumnLike, weights: ColumnLike) -> Column:
    """PRJ09 (weights in a map column): total split by weight / sum of weights."""
    w = c(weights)
    whole = F.aggregate(F.map_values(w), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return F.when(
        (whole > 0) & positive(total),
        F.transform_values(w, lambda _k, v: c(total) * v / whole),
    ).otherwise(F.create_map().cast("map<string,double>"))


def canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ10: rename user columns; mapping is {canonical: user column}."""
    missing = [u for u in mapping.values() if u not in df.columns]
    if missing:
        raise ValueError(f"mapped columns not found: {missing}")
    return df.withColumnsRenamed({user: canon for canon, user in mapping.items()})


def optional_join(df: DataFrame, other: DataFrame | None, on: str, columns: Mapping[str, str]) -> DataFrame:
    """PRJ12: left join an optional table; typed NULLs when it is not configured."""
    if other is None:
        return df.withColumns({n: typed_null(t) for n, t in columns.items()})
    return df.join(other.select(on, *columns), on, "left")


# --- allocation formulas (ALC01-ALC07) --------------------------------------


def applied_acres(acres: ColumnLike, dev_pct, gross_net_pct) -> Column:
    """ALC01."""
    return c(acres) * c(dev_pct) / 100.0 * c(gross_net_pct) / 100.0


def dwelling_units(acres: ColumnLike, du_per_acre: ColumnLike) -> Column:
    """ALC02."""
    return c(acres) * c(du_per_acre)


def population(units: ColumnLike, household_size: ColumnLike) -> Column:
    """ALC03."""
    return c(units) * c(household_size)


def households(units: ColumnLike, vacancy_pct: ColumnLike) -> Column:
    """ALC04."""
    return c(units) * (1.0 - c(vacancy_pct) / 100.0)


def employment(acres: ColumnLike, emp_per_acre: ColumnLike) -> Column:
    """ALC05."""
    return c(acres) * c(emp_per_acre)


def floor_area(acres: ColumnLike, far: ColumnLike) -> Column:
    """ALC06: square feet."""
    return c(acres) * SQFT_PER_ACRE * c(far)


def land_dev_category(
    du_per_acre: ColumnLike, urban: float = 10.0, compact: float = 5.0, standard: float = 1.0
) -> Column:
    """ALC07: density class; unknown density is rural."""
    d = c(du_per_acre)
    return ladder(
        [(d >= urban, "urban"), (d >= compact, "compact"), (d >= standard, "standard")], "rural"
    )


# --- scalar families (SCA01-SCA07) ------------------------------------------


def zero_pad(x: ColumnLike, width: int) -> Column:
    """Codes keep their leading zeros."""
    return F.lpad(c(x).cast("string"), width, "0")


def first_field(array_col: str, field: str) -> Column:
    """Field of the first struct of an array; NULL for an empty array."""
    return F.get(F.col(array_col), F.lit(0))[field]


def differs(a: ColumnLike, b: ColumnLike) -> Column:
    """SCA06: IS DISTINCT FROM."""
    return ~c(a).eqNullSafe(c(b))


def sigmoid(x: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-c(x)))


def sqm_to_acres(x: ColumnLike) -> Column:
    from landspan.params import SQM_PER_ACRE

    return c(x) / SQM_PER_ACRE


def nan_to_null(x: ColumnLike) -> Column:
    return F.when(~F.isnan(c(x)), c(x))
