"""Jobs by block: sector split, gap fill, control totals, county shares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators.allocate import SECTORS, SUB_SECTORS

CNS = [f"cns{i:02d}" for i in range(1, 21)]

# How each jobs code is split.  A text is the industry prefix pattern
# whose county share applies, a number is a fixed share, None takes what is left.
SPLIT_RULES: dict[str, list[tuple[str, str | float | None]]] = {
    "cns01": [("agriculture", "^11"), ("extraction", "^21"), ("construction", None)],
    "cns02": [("manufacturing", 1.0)],
    "cns03": [
        ("transport_warehousing", "^(48|49)"),
        ("utilities", "^22"),
        ("wholesale", "^42"),
        ("retail_services", None),
    ],
    "cns04": [("office_services", 1.0)],
    "cns05": [("office_services", 1.0)],
    "cns06": [("office_services", 1.0)],
    "cns07": [("office_services", 1.0)],
    "cns08": [("office_services", 1.0)],
    "cns09": [("office_services", 1.0)],
    "cns10": [("education", 1.0)],
    "cns11": [("medical_services", 1.0)],
    "cns12": [("arts_entertainment", 1.0)],
    "cns13": [("accommodation", "^721"), ("restaurant", None)],
    "cns14": [("other_services", 1.0)],
    "cns15": [("public_admin", 1.0)],
    "cns17": [("military", 1.0)],
}
GOVERNMENT = ("cns18", "cns19", "cns20")
UNCLASSIFIED = "cns16"

# Shares of government jobs, and calibrated sub-sector counts.
GOVERNMENT_SPLIT = {"education": 0.24, "medical_services": 0.37, "public_admin": 0.39}
CALIBRATED = {
    "ret": {
        "retail_services": 76395, "restaurant": 42520, "accommodation": 3827,
        "arts_entertainment": 7567, "other_services": 33330,
    },
    "off": {"office_services": 236721, "medical_services": 22745},
    "pub": {"public_admin": 16924, "education": 27361},
}


def _matches(pattern: str, code: str) -> bool:
    import re

    return re.match(pattern, code) is not None


def split_jobs(row: DataFrame, shares: Mapping[str, float], digits: int | None = None) -> DataFrame:
    """BAS27: one column emp_<sub> per sub-sector from the split rules.

    ``shares`` maps industry prefixes to their share within the code's parent.
    """
    parts: dict[str, list[Column]] = {s: [] for s in SUB_SECTORS}

    def r(c: Column) -> Column:
        return c if digits is None else X.round_decimal(c, digits)

    for code, rules in SPLIT_RULES.items():
        total = X.or_zero(F.col(code).cast("double"))
        taken = []
        for sub, spec in rules:
            if spec is None:
                left = total
                for t in taken:
                    left = left - t
                value = F.greatest(left, F.lit(0.0))
            elif isinstance(spec, str):
                share = sum(v for k, v in shares.items() if _matches(spec, k))
                value = r(total * share)
                taken.append(value)
            else:
                value = total * spec
                taken.append(value)
            parts[sub].append(value)
    out = {}
    for sub, values in parts.items():
        whole = values[0] if values else F.lit(0.0)
        for v in values[1:]:
            whole = whole + v
        out["emp_" + sub] = whole
    return row.withColumns(out)


def subs_total(prefix: str = "emp_") -> Column:
    whole = X.or_zero(prefix + SUB_SECTORS[0])
    for s in SUB_SECTORS[1:]:
        whole = whole + X.or_zero(prefix + s)
    return whole


def spread_rest(df: DataFrame, rest: Column, digits: int | None = None) -> DataFrame:
    """Add a positive rest to the sub-sectors: pro rata, or evenly where all are 0."""
    df = df.withColumn("_rest", rest).withColumn("_known", subs_total())
    even = F.lit(float(len(SUB_SECTORS)))
    u, known = F.col("_rest"), F.col("_known")

    def grown(sub: str) -> Column:
        v = X.or_zero("emp_" + sub)
        share = X.ladder(
            [((u > 0) & (known > 0), u * v / F.nullif(known, F.lit(0.0))), (u > 0, u / even)], 0.0
        )
        return X.round_decimal(v + share, digits) if digits is not None else v + share

    return df.withColumns({"emp_" + s: grown(s) for s in SUB_SECTORS}).drop("_rest", "_known")


def lodes_blocks(
    jobs: DataFrame,
    shares: Mapping[str, float],
    government: Mapping[str, float] = GOVERNMENT_SPLIT,
    year: int = 2021,
) -> DataFrame:
    """BAS20: 20 job codes to 17 sub-sectors.

    Codes are split by the rules, unclassified jobs spread over the sub-sectors, and
    government jobs given to education, health and administration.
    """
    df = jobs.select("geoid", F.col("c000").cast("double").alias("emp"), *CNS)
    df = split_jobs(df, shares, digits=1)
    for sector, subs in SECTORS.items():
        whole = X.or_zero("emp_" + subs[0])
        for s in subs[1:]:
            whole = whole + X.or_zero("emp_" + s)
        df = df.withColumn("emp_" + sector, F.col("emp_agriculture") if sector == "ag" else whole)
    df = spread_rest(df, X.or_zero(F.col(UNCLASSIFIED).cast("double")), digits=1)
    state = X.or_zero(F.col(GOVERNMENT[0]).cast("double"))
    for c in GOVERNMENT[1:]:
        state = state + X.or_zero(F.col(c).cast("double"))
    df = df.withColumns(
        {
            "emp_" + s: X.round_decimal(F.col("emp_" + s) + state * share, 1)
            for s, share in government.items()
        }
    )
    return df.withColumn("data_year", F.make_date(F.lit(year), F.lit(1), F.lit(1))).drop(*CNS)


def zone_outline(jobs: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """JOI13: outline of a job block: its own, its block group's, or the tract's first group.

    Zones have (geoid, geometry); blocks without any outline are dropped.
    """
    b = blocks.select(F.col("geoid").alias("_b"), F.col("geometry").alias("_g1"))
    g = groups.select(F.col("geoid").alias("_bg"), F.col("geometry").alias("_g2"))
    tract = groups.groupBy(F.substring("geoid", 1, 11).alias("_t")).agg(
        F.min_by("geometry", "geoid").alias("_g3")
    )
    out = (
        jobs.join(b, F.col("geoid") == F.col("_b"), "left")
        .join(g, F.substring("geoid", 1, 12) == F.col("_bg"), "left")
        .join(tract, F.substring("geoid", 1, 11) == F.col("_t"), "left")
        .withColumn("geometry", F.coalesce("_g1", "_g2", "_g3"))
    )
    return out.where("geometry IS NOT NULL").drop("_b", "_bg", "_t", "_g1", "_g2", "_g3")


def fill_gap(df: DataFrame) -> DataFrame:
    """BAS21: jobs missing from the sub-sectors (suppressed cells) are spread over them."""
    return spread_rest(df, F.col("emp") - subs_total())


def scale_to_county(
    df: DataFrame, controls: Mapping[str, float], preserve: float = 0.5
) -> DataFrame:
    """BAS22: raise sub-sectors to county control totals.

    Where the control is higher, the ``preserve`` part scales the known jobs and the
    rest follows all jobs; a sub-sector without any jobs follows all jobs.  The
    county totals arrive as one row through a scalar subquery.
    """
    named = [s for s in SUB_SECTORS if controls.get("emp_" + s, 0.0) > 0 and s != "military"]
    if not named:
        return df
    totals = df.agg(
        F.struct(
            *[X.or_zero(F.sum("emp_" + s)).alias(s) for s in named],
            X.or_zero(F.sum("emp")).alias("_all"),
        )
    ).scalar()
    df = df.withColumn("_t", totals)
    everyone = F.nullif(F.col("_t._all"), F.lit(0.0))
    out = {}
    for s in named:
        v, c, have = F.col("emp_" + s), F.lit(float(controls["emp_" + s])), F.col("_t." + s)
        spread = c * (1.0 - preserve) * F.col("emp") / everyone
        kept = v * (c * preserve / F.nullif(have, F.lit(0.0)))
        out["emp_" + s] = X.ladder(
            [
                (c <= have, v),
                (have > 0, F.when(v > 0, kept + spread).otherwise(spread)),
                (everyone.isNotNull(), c * F.col("emp") / everyone),
            ],
            v,
        )
    return df.withColumns(out).drop("_t")


def sector_totals(df: DataFrame) -> DataFrame:
    """BAS23: sector columns and the total rebuilt from the sub-sectors."""
    out = {}
    for sector, subs in SECTORS.items():
        whole = X.or_zero("emp_" + subs[0])
        for s in subs[1:]:
            whole = whole + X.or_zero("emp_" + s)
        out["emp_" + sector] = whole
    return df.withColumns(out | {"emp": subs_total()})


def fallback_fractions(df: DataFrame) -> DataFrame:
    """BAS24: one row with every sub-sector's share of its sector (0 without jobs)."""
    sums = df.agg(*[X.or_zero(F.sum("emp_" + s)).alias(s) for s in SUB_SECTORS])
    out = []
    for subs in SECTORS.values():
        whole = F.col(subs[0])
        for s in subs[1:]:
            whole = whole + F.col(s)
        out += [X.or_zero(X.ratio(s, whole)).alias(f"emp_{s}_frac") for s in subs]
    return sums.select(*out)


# --- county business patterns -----------------------------------------------------

# Two-part industry codes written as one, parents of the split codes
# with their national shares, and the codes of each sub-sector.
COMBINED_CODES = ("3133", "4445", "4849")
PARENTS: dict[str, dict[str, float]] = {
    "goods": {"11": 0.05, "21": 0.02, "23": 0.93},
    "trade": {"22": 0.02, "42": 0.10, "44": 0.54, "45": 0.28, "48": 0.04, "49": 0.02},
    "food": {"721": 0.4, "722": 0.6},
}
SUB_SECTOR_CODES = {
    "retail_services": ["44", "45"],
    "restaurant": ["722"],
    "accommodation": ["721"],
    "arts_entertainment": ["71"],
    "other_services": ["81"],
    "office_services": ["51", "52", "53", "54", "55", "56"],
    "medical_services": ["62"],
    "public_admin": ["92"],
    "education": ["61"],
    "manufacturing": ["31", "32", "33"],
    "wholesale": ["42"],
    "transport_warehousing": ["48", "49"],
    "utilities": ["22"],
    "construction": ["23"],
    "agriculture": ["11"],
    "extraction": ["21"],
}
CRITICAL = ("ind", "ret", "off")


def industry_jobs(raw: DataFrame) -> DataFrame:
    """Parent-level jobs (county, prefix, emp) from raw (county, naics, emp text).

    Codes lose dashes and blanks; suppressed or unreadable counts are dropped; only
    two- and three-digit codes and the combined codes are parents.
    """
    code = F.regexp_replace(F.trim("naics"), r"[-\s]", "")
    rows = raw.select("county", code.alias("code"), F.trim("emp").try_cast("double").alias("emp"))
    rows = rows.where((F.length("code") > 0) & F.col("emp").isNotNull())
    rows = rows.groupBy("county", "code").agg(F.max("emp").alias("emp"))
    parent = X.ladder(
        [
            (F.col("code").isin(list(COMBINED_CODES)), F.substring("code", 1, 2)),
            (F.length("code").isin(2, 3), F.col("code")),
        ]
    )
    return (
        rows.withColumn("prefix", parent)
        .where("prefix IS NOT NULL")
        .groupBy("county", "prefix")
        .agg(F.sum("emp").alias("emp"))
    )


def industry_shares(jobs: DataFrame) -> DataFrame:
    """BAS25: (county, prefix, share) within each parent; national shares without jobs."""
    spark = jobs.sparkSession
    members = spark.createDataFrame(
        [(p, c, d) for p, group in PARENTS.items() for c, d in group.items()],
        "parent string, prefix string, national double",
    )
    sums = jobs.join(members, "prefix").groupBy("county", "parent").agg(F.sum("emp").alias("whole"))
    # every county gets every member: one small row set per county
    counties = jobs.select("county").distinct()
    grid = counties.withColumn(
        "m",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("parent"), F.lit(c).alias("prefix"), F.lit(d).alias("national"))
                    for p, group in PARENTS.items()
                    for c, d in group.items()
                ]
            )
        ),
    ).select("county", "m.*")
    return (
        grid.join(sums, ["county", "parent"], "left")
        .join(jobs, ["county", "prefix"], "left")
        .select(
            "county",
            "prefix",
            F.when(X.positive("whole"), X.or_zero("emp") / F.col("whole"))
            .otherwise(F.col("national"))
            .alias("share"),
        )
    )


def county_totals(jobs: DataFrame) -> DataFrame:
    """BAS26: one row per county with emp_<sub> control totals."""

    def total(codes: list[str]) -> Column:
        return X.or_zero(F.sum(F.when(F.col("prefix").isin(codes), F.col("emp"))))

    return jobs.groupBy("county").agg(
        *[total(codes).alias("emp_" + s) for s, codes in SUB_SECTOR_CODES.items()]
    )


def missing_sectors(totals: DataFrame) -> DataFrame:
    """BAS26: counties where a critical sector has no jobs at all (empty = fine)."""
    conds = None
    for sector in CRITICAL:
        whole = F.col("emp_" + SECTORS[sector][0])
        for s in SECTORS[sector][1:]:
            whole = whole + F.col("emp_" + s)
        conds = (whole <= 0) if conds is None else conds | (whole <= 0)
    return totals.where(conds)


def government_shares(qcew: DataFrame) -> DataFrame:
    """BAS28: split of government jobs per county (own_code 1-3, level 78).

    ``qcew`` holds county, own_code, agglvl_code, industry_code, month1_emplvl text.
    Counties without government jobs are left out.
    """
    emp = F.trim("month1_emplvl").try_cast("double")
    rows = qcew.where(F.col("own_code").isin("1", "2", "3") & (F.col("agglvl_code") == "78"))

    def jobs(prefix: str) -> Column:
        return X.or_zero(F.sum(F.when(F.col("industry_code").startswith(prefix), emp)))

    sums = rows.groupBy("county").agg(
        jobs("611").alias("edu"), jobs("622").alias("med"), jobs("92").alias("pub")
    )
    whole = F.col("edu") + F.col("med") + F.col("pub")
    return sums.where(whole > 0).select(
        "county", *[(F.col(n) / whole).alias(n + "_frac") for n in ("edu", "med", "pub")]
    )


def calibrated_split(df: DataFrame) -> DataFrame:
    """BAS29: sub-sectors from positive sector totals by calibrated shares."""
    out = {}
    for sector, counts in CALIBRATED.items():
        whole = float(sum(counts.values()))
        for sub, n in counts.items():
            v = F.col("emp_" + sector)
            old = F.col("emp_" + sub) if "emp_" + sub in df.columns else X.typed_null("double")
            out["emp_" + sub] = F.when(v > 0, v * (n / whole)).otherwise(old)
    return df.withColumns(out)
