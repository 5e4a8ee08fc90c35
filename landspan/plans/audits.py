"""Data-quality audits: each returns the violating rows; empty means passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators.allocate import SECTORS
from landspan.plans import classify as K


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


# --- AUD01 ---------------------------------------------------------------------------


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(_any([F.col(c).isNull() for c in columns]))


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def row_count_between(df: DataFrame, least: int, most: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where(~F.col("n").between(least, most))


def same_row_count(df: DataFrame, other: DataFrame) -> DataFrame:
    want = other.agg(F.count("*")).scalar()
    return df.agg(F.count("*").alias("n")).withColumn("expected", want).where("n <> expected")


# --- AUD02 ---------------------------------------------------------------------------


def between(df: DataFrame, columns: Sequence[str], least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows (column, value) outside the bounds; all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    keys = [c for c in df.columns if c not in columns]
    long = df.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.*")
    low = F.col("value") < least if least is not None else F.lit(False)
    high = F.col("value") > most if most is not None else F.lit(False)
    return long.where(low | high)


def non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return between(df, columns, least=0.0)


# --- AUD03 ---------------------------------------------------------------------------


def sums_to(df: DataFrame, total: str, parts: Sequence[str], tolerance: float) -> DataFrame:
    """A total that differs from the sum of its parts."""
    whole = reduce(lambda a, b: a + b, [X.or_zero(p) for p in parts])
    return df.withColumn("_sum", whole).where(F.abs(F.col("_sum") - X.or_zero(total)) > tolerance)


def at_most(df: DataFrame, part: str, whole: str, tolerance: float = 1e-9) -> DataFrame:
    """A part larger than its whole (acres consumed against gross acres)."""
    return df.where(F.col(part) > F.col(whole) + tolerance)


def proportions(df: DataFrame, parts: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Shares that do not add up to 1; a missing share is 0."""
    whole = reduce(lambda a, b: a + b, [X.or_zero(p) for p in parts])
    return df.withColumn("_sum", whole).where(F.abs(F.col("_sum") - 1.0) > tolerance)


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """More than one positive subtype."""
    n = reduce(lambda a, b: a + b, [F.when(F.col(c) > 0, 1).otherwise(0) for c in columns])
    return df.withColumn("_n", n).where("_n > 1")


def fiscal_identity(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    net = F.col("property_tax_revenue") + F.col("sales_tax_revenue") - F.col("service_cost_total")
    return df.where(F.abs(net - F.col("net_fiscal_impact")) > tolerance)


def sector_identity(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Sector columns against their sub-sectors; one row per violated sector."""
    checks = [
        sums_to(df, "emp_" + k, ["emp_" + s for s in subs], tolerance).select(F.lit(k).alias("sector"), "_sum")
        for k, subs in SECTORS.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), checks)


# --- AUD04 ---------------------------------------------------------------------------


def conserved(source: DataFrame, source_col: str, target: DataFrame, target_col: str, share: float) -> DataFrame:
    """Totals of two tables that differ by more than ``share``; one row or none."""
    other = target.agg(F.sum(target_col)).scalar()
    diff = F.abs(F.col("target_total") - F.col("source_total"))
    return (
        source.agg(F.sum(source_col).alias("source_total"))
        .withColumn("target_total", other)
        .where((F.col("source_total") > 0) & (diff / F.col("source_total") > share))
    )


def allocation_conserved(
    pairs: DataFrame, zones: DataFrame, zone: str, weight: str, measure: str, allocated: DataFrame, share: float
) -> DataFrame:
    """Allocated total against the total of the zones that any weighted parcel touches."""
    touched = pairs.where(X.or_zero(weight) > 0).select(zone)
    return conserved(zones.join(touched, zone, "left_semi"), measure, allocated, measure, share)


def trips_conserved(trips: DataFrame, generated: DataFrame, share: float = 0.01) -> DataFrame:
    """Outbound against inbound trips, and both with the internal ones against generation."""
    total = generated.agg(F.sum("trips_total")).scalar()
    t = trips.agg(*[F.sum(n).alias(n) for n in ("trips_outbound", "trips_inbound", "trips_internal")])
    t = t.withColumn("trips_total", total)
    o, i, n, g = (F.col(c) for c in ("trips_outbound", "trips_inbound", "trips_internal", "trips_total"))
    off = F.abs(o - i) / F.nullif(F.greatest(o, i), F.lit(0.0)) > share
    lost = [(g > 0) & (F.abs(1.0 - (side + n) / g) > share) for side in (o, i)]
    return t.where(_any([F.coalesce(c, F.lit(False)) for c in (off, *lost)]))


# --- AUD05 ---------------------------------------------------------------------------


def uncovered(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` without a partner."""
    return df.join(other.select(key), key, "left_anti")


def match_rate(df: DataFrame, other: DataFrame, key: str, most_unmatched: float) -> DataFrame:
    """One row when more than the given share of rows has no partner."""
    have = other.select(key).distinct().withColumn("_hit", F.lit(1))
    return (
        df.join(have, key, "left")
        .agg(F.count("*").alias("n"), F.count("_hit").alias("matched"))
        .withColumn("unmatched_share", X.ratio(F.col("n") - F.col("matched"), "n"))
        .where(F.col("unmatched_share") > most_unmatched)
    )


def filled_share(df: DataFrame, column: str, least: float) -> DataFrame:
    """One row when too few values are known."""
    return (
        df.agg(F.count("*").alias("n"), F.count(column).alias("known"))
        .withColumn("share", X.ratio("known", "n"))
        .where(F.col("share") < least)
    )


# --- AUD06 ---------------------------------------------------------------------------


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str], nulls: bool = True) -> DataFrame:
    known = F.col(column).isNotNull() if nulls else F.lit(True)
    return df.where(known & ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))


# Floor area that hosts the jobs of a sector.
HOSTS = {"ret": "commercial_sqft", "off": "commercial_sqft", "ind": "industrial_sqft"}


def jobs_without_floor(df: DataFrame) -> DataFrame:
    """Sector jobs on a parcel without floor area of the sector's kind."""
    return df.where(_any([(F.col("emp_" + k) > 0) & (X.or_zero(c) == 0) for k, c in HOSTS.items()]))


def jobs_on_empty_land(df: DataFrame) -> DataFrame:
    return df.where((F.col("land_development_category") == "undeveloped") & (F.col("emp") > 0))


# --- AUD07 ---------------------------------------------------------------------------

# Keys of the multi-family building types.
MULTI_FAMILY = (
    "bt__medium_density_attached_residential", "bt__medium_high_density_attached_residential",
    "bt__high_density_attached_residential", "bt__very_high_density_attached_residential",
    "bt__urban_attached_residential", "bt__urban_mid_rise_residential",
)


def tier_mismatch(df: DataFrame, form: str, expected: Column) -> DataFrame:
    """Rows whose form differs from the recomputed rule (where the rule speaks)."""
    return df.withColumn("expected", expected).where(
        F.col("expected").isNotNull() & ~F.col(form).eqNullSafe(F.col("expected"))
    )


def multi_family_codes(df: DataFrame, form: str = "built_form_key") -> DataFrame:
    """A2 and AT codes must end as an attached form."""
    two = F.substring("landuse", 1, 2)
    return outside_domain(df.where(two.isin("A2", "AT")), form, MULTI_FAMILY)


# Use codes and the one form that the code tier may give them.
CODE_AUDITS = {
    "A3_to_attsf": (["A3"], K.ATTACHED),
    "A4_to_detsf": (["A4"], K.SMALL_LOT),
    "AD_to_undeveloped": (["AD"], K.VACANT),
    "AE_to_commercial": (["AE"], K.RETAIL),
    "AF_to_industrial": (["AF"], K.INDUSTRY),
    "AG_to_agricultural": (["AG"], K.FARM),
    "AHAJ_to_civic": (["AH", "AJ"], K.CIVIC),
    "AQ_to_undeveloped": (["AQ"], K.VACANT),
    "civic_codes": (["GC", "GA", "HJ"], K.CIVIC),
    "commercial_codes": (["CA", "BA", "BF", "BC", "BB", "BE", "BD", "CG", "MS", "MU", "MP"], K.RETAIL),
    "industrial_codes": (["IA", "IG", "IB"], K.INDUSTRY),
}
FARM_ACRES, LARGE_ACRES, BARE_RATIO = 10.0, 3.0, 0.02


def form_rules() -> dict[str, Column]:
    """AUD07: for each rule whether a row violates it.

    Rows: landuse, lot_size_acres, zone, intersection_density, property_type,
    sales_lot_size_acres, units, footprint_ratio, and the forms tier0, tier1, tier2, tier3b,
    tier4 and built_form_key (null where a tier does not speak, which violates nothing).
    """
    c = F.col
    two, lot = F.substring("landuse", 1, 2), c("lot_size_acres")
    t, n = c("property_type"), X.or_zero("units")
    single = t.isin("SFR", "Single Family Residence") | t.startswith("Single Family")
    multi = t.isin("MF", "Multiple Family Residence") | t.startswith("Multiple Family")
    by_density = F.when(K.dense("intersection_density"), K.SMALL_LOT).otherwise(K.LARGE_LOT)
    homes = [K.SMALL_LOT, K.LARGE_LOT]
    farmland = c("zone").contains("A")
    by_area = X.ladder(
        [
            (lot > FARM_ACRES, K.FARM),
            ((lot > LARGE_ACRES) & farmland, K.FARM),
            (lot > K.SMALL_LOT_ACRES, K.LARGE_LOT),
            (lot > 0.01, K.SMALL_LOT),
        ]
    )
    rules = {k: two.isin(codes) & (c("tier0") != form) for k, (codes, form) in CODE_AUDITS.items()}
    rules |= {
        "A1_to_detsf": (two == "A1") & (F.coalesce(F.nullif(lot, F.lit(0.0)), F.lit(0.01)) >= K.TINY_LOT_ACRES) & (c("tier0") != by_density),
        "A2_falls_through": (two == "A2") & ~c("built_form_key").isin(list(MULTI_FAMILY)),
        "AT_to_mf": (two == "AT") & ~c("built_form_key").isin(list(MULTI_FAMILY)),
        "mf_unit_boundary": multi & (n >= 2) & (c("tier1") != F.when(n <= 4, K.ATTACHED).otherwise(K.APARTMENTS)),
        "sfr_lot_boundary": single & (c("tier1") != K.by_lot("sales_lot_size_acres")),
        "tier2_sfr_lot_bound": c("tier2").isin(homes) & ~F.coalesce(two, F.lit("")).isin("A2", "AT") & (c("tier2") != K.by_lot("lot_size_acres")),
        "tier3b_footprint_filter": (lot > LARGE_ACRES) & (X.or_zero("footprint_ratio") < BARE_RATIO) & (F.coalesce("tier3b", F.lit("")) != K.FARM),
        "tier4_area_heuristic": c("tier4") != by_area,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def form_violations(df: DataFrame) -> DataFrame:
    """AUD07: violations per rule of ``form_rules``, all in one pass over the table."""
    rules = form_rules()
    counts = df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("audit"), F.col(k).alias("violations")) for k in rules])))


def tier_priority(df: DataFrame, sold: DataFrame) -> DataFrame:
    """Retail and industry may not come from another tier where a sale decided."""
    late = df.where(
        F.col("built_form_key").isin(K.RETAIL, K.INDUSTRY) & (F.col("built_form_key_source") != "tier1")
    )
    return late.join(sold.select("apn"), "apn", "left_semi")


# --- AUD08 ---------------------------------------------------------------------------


def expected_rows(actual: DataFrame, cases: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Case table against computed rows: differing or missing cases."""
    want = cases.select(*key, *[F.col(c).alias("expected_" + c) for c in columns])
    joined = want.join(actual.select(*key, *columns, F.lit(True).alias("_found")), list(key), "left")
    return joined.where(
        F.col("_found").isNull() | _any([X.differs(c, "expected_" + c) for c in columns])
    ).drop("_found")


def run(audits: Mapping[str, DataFrame]) -> dict[str, bool]:
    """Name -> passed; at most one row per audit is read."""
    return {name: df.isEmpty() for name, df in audits.items()}
