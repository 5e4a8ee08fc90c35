"""Census zones: derived measures, clamped rates, blocks with projected outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.functions import geometry as G
from landspan.params import SQM_PER_ACRE


def _sum(names: Sequence[str]) -> Column:
    whole = X.or_zero(names[0])
    for n in names[1:]:
        whole = whole + X.or_zero(n)
    return whole


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(X.ratio(part, whole) * 100.0, 2)).otherwise(0.0)


# Table cells behind each measure.
RENT_BURDEN = ["b25070_007_e", "b25070_008_e", "b25070_009_e", "b25070_010_e"]
OWNER_BURDEN = [
    "b25091_005_e", "b25091_006_e", "b25091_007_e", "b25091_011_e", "b25091_012_e", "b25091_013_e",
]
COLLEGE = ["b15003_022_e", "b15003_023_e", "b15003_024_e", "b15003_025_e"]
SMALL_LOT_DENSITY, SMALL_LOT_STEEPNESS, SMALL_LOT_DEFAULT = 8.0, 0.5, 0.40


def block_groups(acs: DataFrame, year: int = 2022) -> DataFrame:
    """BAS17: ``acs`` rows with geoid, area_m2 (NULL without outline) and the table cells."""
    detsf = X.or_zero("b25024_002_e")
    renters = _sum(RENT_BURDEN)
    hh, people = X.or_zero("b25003_001_e"), X.or_zero("b03002_001_e")
    du_mf2to4 = F.round(_sum(["b25024_004_e", "b25024_005_e"]), 1)
    du_mf5p = F.round(
        _sum(["b25024_006_e", "b25024_007_e", "b25024_008_e", "b25024_009_e"]), 1
    )
    density = X.ratio(detsf, F.col("area_m2") / SQM_PER_ACRE)
    share = F.when(
        (detsf > 0) & F.col("area_m2").isNotNull(),
        X.clamp(X.sigmoid((density - SMALL_LOT_DENSITY) * SMALL_LOT_STEEPNESS), 0.0, 1.0),
    ).otherwise(SMALL_LOT_DEFAULT)
    return acs.withColumn("_sl", share).select(
        "geoid",
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("data_year"),
        X.or_zero("b01001_001_e").alias("pop"),
        hh.alias("hh"),
        X.or_zero("b25024_001_e").alias("du"),
        F.round(detsf, 1).alias("du_detsf"),
        X.or_zero("b25024_003_e").alias("du_attsf"),
        du_mf2to4.alias("du_mf2to4"),
        du_mf5p.alias("du_mf5p"),
        F.round(du_mf2to4 + du_mf5p, 1).alias("du_mf"),
        F.round(detsf * F.col("_sl"), 1).alias("du_detsf_sl"),
        F.round(detsf * (1 - F.col("_sl")), 1).alias("du_detsf_ll"),
        X.or_zero("b25003_002_e").alias("owner_occupied"),
        X.or_zero("b25003_003_e").alias("renter_occupied"),
        X.or_zero("b19013_001_e").alias("median_income"),
        _percent(renters, X.or_zero("b25070_001_e")).alias("rent_burden_pct"),
        _percent(_sum(OWNER_BURDEN) + renters, hh).alias("cost_burden_pct"),
        people.alias("total_population"),
        _percent(people - X.or_zero("b03002_002_e"), people).alias("pct_minority"),
        _percent(_sum(COLLEGE), X.or_zero("b15003_001_e")).alias("pct_college_educated"),
    )


def planning_rates(pdb: DataFrame, year: int = 2024) -> DataFrame:
    """BAS18: rates as fractions in [0, 1]; unknown percentages stay unknown."""
    units = X.or_zero("tot_housing_units_acs_18_22")
    vacant = X.ratio(X.or_zero("tot_vacant_units_acs_18_22"), units)

    def fraction(name: str) -> Column:
        return X.clamp(F.col(name) / 100.0, 0.0, 1.0)

    return pdb.select(
        F.col("gidbg").alias("geoid"),
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("data_year"),
        F.when(units > 0, X.clamp(vacant, 0.0, 1.0)).otherwise(0.0).alias("vacancy_rate"),
        X.or_zero("tot_gq_cen_2020").alias("group_quarters_pop"),
        fraction("low_response_score").alias("low_response_score"),
        fraction("pct_renter_occp_hu_acs_18_22").alias("renter_occupied_pct"),
        fraction("pct_prs_blw_pov_lev_acs_18_22").alias("below_poverty_pct"),
    )


def blocks(counts: DataFrame, outlines: DataFrame) -> DataFrame:
    """BAS19: block counts with outlines; group quarters are not in this table (0)."""
    return counts.join(outlines.select("geoid", "ring"), "geoid", "left").select(
        "geoid",
        X.or_zero(F.col("total_population").cast("double")).alias("total_population"),
        X.or_zero(F.col("total_housing_units").cast("double")).alias("total_housing_units"),
        F.lit(0.0).alias("total_group_quarters"),
        "ring",
    )


def projected(zones: DataFrame, code: int = 3310) -> DataFrame:
    """BAS19: a copy with the projected ring and its box, for joins without reprojection."""
    ring = G.project_ring(F.col("ring"), code)
    out = zones.where("ring IS NOT NULL").withColumn("local_ring", ring)
    box = G.ring_box(F.col("local_ring"))
    return out.withColumns({n: box[n] for n in ("xmin", "ymin", "xmax", "ymax")})
