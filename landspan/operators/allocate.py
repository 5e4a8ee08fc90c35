"""Spreading zone values over parcels.

Every operator works on a pair table (source, target, overlap or weight).  Zone
totals are partial sums joined back by key, never a window over a zone, so a zone
that holds a third of all pairs is summed in all map tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.functions import geometry as G
from landspan.operators import overlay, spatial
from landspan.operators.ranking import first_per, with_group_totals
from landspan.params import SQFT_PER_ACRE, SQFT_TO_SQM, SQM_PER_ACRE


# --- area weights --------------------------------------------------------------


def factors(
    sources: DataFrame, targets: DataFrame, source_id: str, target_id: str, cell: float
) -> DataFrame:
    """GEO15: (source_id, target_id, weight = overlap / source area) of polygons of any shape."""
    own = sources.select(F.col(source_id).alias("source_id"), "ring", G.area(F.col("ring")).alias("_own")).where("_own > 0")
    targets = targets.select(F.col(target_id).alias("target_id"), "ring")
    pairs = overlay.overlaps(own, targets, ["source_id", "_own"], ["target_id"], cell)
    return pairs.select("source_id", "target_id", (F.col("overlap") / F.col("_own")).alias("weight"))


def constraint_acres(overlaps: DataFrame, key: str) -> DataFrame:
    """GEO16: acres of all constraint overlaps per parcel (``overlap`` in m2)."""
    return overlaps.groupBy(key).agg((F.sum("overlap") / SQM_PER_ACRE).alias("constraint_acres"))


def discounted_acres(acres, constrained, discount_pct: float) -> Column:
    """GEO16: acres less the discounted constraint, at least 0."""
    return X.non_negative(X.c(acres) - X.or_zero(constrained) * (discount_pct / 100.0))


def allocate(pairs: DataFrame, sources: DataFrame, source_id: str, columns: Sequence[str]) -> DataFrame:
    """ALC10: sum over sources of value * weight; ``pairs`` as from ``factors``."""
    values = sources.select(F.col(source_id).alias("source_id"), *columns)
    return (
        pairs.join(values, "source_id")
        .groupBy("target_id")
        .agg(*[F.sum(X.or_zero(n) * F.col("weight")).alias(n) for n in columns])
    )


def fill_where_null(targets: DataFrame, key: str, allocated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ALC12: allocated values only where the target has none."""
    got = allocated.select(
        F.col("target_id").alias(key), *[F.col(n).alias("_a_" + n) for n in columns]
    )
    return (
        targets.join(got, key, "left")
        .withColumns({n: F.coalesce(n, "_a_" + n) for n in columns})
        .drop(*["_a_" + n for n in columns])
    )


def by_hint(pairs: DataFrame, hints: Mapping[str, str], key: str = "target_id") -> DataFrame:
    """AGG17: columns with hint ``sum`` add value * overlap / source area, ``avg`` columns
    are overlap-weighted means.  ``pairs`` holds overlap, source_area and the columns.
    """
    aggs = []
    for name, hint in hints.items():
        if hint == "sum":
            share = F.col("overlap") / F.greatest("source_area", F.lit(1e-10))
            aggs.append(F.sum(X.or_zero(name) * share).alias(name))
        elif hint == "avg":
            aggs.append(
                X.ratio(F.sum(X.or_zero(name) * F.col("overlap")), F.sum("overlap")).alias(name)
            )
        else:
            aggs.append(F.min(name).alias(name))
    return pairs.groupBy(key).agg(*aggs)


def allocate_by_hint(
    targets: DataFrame, key: str, pairs: DataFrame, hints: Mapping[str, str]
) -> DataFrame:
    """ALC11: hint rollup, existing values kept, negatives set to 0."""
    got = by_hint(pairs, hints).withColumnsRenamed(
        {"target_id": key} | {n: "_a_" + n for n in hints}
    )
    out = targets.join(got, key, "left")
    for name in hints:
        have = F.col(name) if name in targets.columns else X.typed_null("double")
        out = out.withColumn(name, X.clamp(F.coalesce(have, F.col("_a_" + name)), 0.0))
    return out.drop(*["_a_" + n for n in hints])


def check_not_all_zero(df: DataFrame, columns: Sequence[str]) -> None:
    """ALC11: an allocation that moved nothing is an error (one-row check)."""
    sums = df.agg(*[X.or_zero(F.sum(n)).alias(n) for n in columns]).first()
    if not any(sums[n] > 0 for n in columns):
        raise ValueError(f"allocation left all of {list(columns)} at zero")


def scale_to_total(df: DataFrame, columns: Sequence[str], total: DataFrame, measure: str) -> DataFrame:
    """ALC13: scale up to a one-row control total when it exceeds the allocated sum."""
    have = df.agg(X.or_zero(F.sum(measure)).alias("have"))
    one = total.select(X.or_zero(measure).alias("want")).crossJoin(F.broadcast(have))
    scale = one.select(
        F.when((F.col("have") > 0) & (F.col("want") > F.col("have")), F.col("want") / F.col("have"))
        .otherwise(1.0)
        .alias("scale")
    ).scalar()
    df = df.withColumn("_scale", scale)
    return df.withColumns(
        {n: F.when(F.col(n) > 0, F.col(n) * F.col("_scale")).otherwise(F.col(n)) for n in columns}
    ).drop("_scale")


# --- dasymetric weights ----------------------------------------------------------


def zone_shares(pairs: DataFrame, zone: str, weights: Iterable[str]) -> DataFrame:
    """Add ``_t_<weight>``: total of each weight column in the pair's zone."""
    return with_group_totals(
        pairs, [zone], [F.sum(X.or_zero(w)).alias("_t_" + w) for w in weights]
    )


def dasymetric_population(pairs: DataFrame) -> DataFrame:
    """ALC14: block population by weight, block units by estimated units.

    ``pairs`` holds parcel_id, geoid, total_population, total_housing_units,
    pop_weight, du_estimated, vacancy_rate.  A parcel's whole weight counts in every
    block it touches.
    """
    p = zone_shares(pairs, "geoid", ["pop_weight", "du_estimated"])
    people = F.col("total_population") * X.ratio(X.or_zero("pop_weight"), "_t_pop_weight")
    units = F.col("total_housing_units") * X.ratio("du_estimated", "_t_du_estimated")
    occupied = units * (1.0 - F.coalesce("vacancy_rate", F.lit(0.05)))
    return p.groupBy("parcel_id").agg(
        F.sum(people).alias("pop"), F.sum(units).alias("du"), F.sum(occupied).alias("hh")
    )


# Employment sectors and their sub-sectors.
SECTORS = {
    "ret": ["retail_services", "restaurant", "accommodation", "arts_entertainment", "other_services"],
    "off": ["office_services", "medical_services"],
    "pub": ["public_admin", "education"],
    "ind": ["manufacturing", "wholesale", "transport_warehousing", "utilities", "construction"],
    "ag": ["agriculture", "extraction"],
}
MILITARY = "military"  # spread like the public sector
SUB_SECTORS = [s for group in SECTORS.values() for s in group] + [MILITARY]


def sector_of(sub: str) -> str:
    return next((k for k, group in SECTORS.items() if sub in group), "pub")


def employment_weights(parcels: DataFrame) -> DataFrame:
    """ALC15: one weight per sector: area * (floor area + 1) * jobs per acre * gate."""
    area = F.coalesce("area_parcel_emp", "area_parcel_acres", "area_gross_acres", "area_gross", F.lit(0.0))
    sqft = X.or_zero("commercial_sqft") + X.or_zero("industrial_sqft") + X.or_zero("other_sqft") + 1.0
    weighted = X.or_zero("emp_weight") > 0
    commercial = X.positive("commercial_sqft") | weighted
    industrial = X.positive("industrial_sqft") | weighted
    gates = {"ret": commercial, "off": commercial, "ind": industrial}

    def weight(sector: str) -> Column:
        w = X.non_negative(area * sqft * X.or_zero(f"emp_{sector}_per_acre"))
        return F.when(gates[sector], w).otherwise(0.0) if sector in gates else w

    return parcels.withColumns({"w_" + s: weight(s) for s in SECTORS})


def dasymetric_employment(pairs: DataFrame, subs: Sequence[str] = SUB_SECTORS) -> DataFrame:
    """ALC15: block jobs per sector and sub-sector by the sector weights.

    ``pairs`` holds parcel_id, geoid, the block's emp, emp_<sector>, emp_<sub> and
    the parcel's w_<sector>.  A sector without weight in a block falls back on the
    block's total weight.
    """
    names = ["w_" + s for s in SECTORS]
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    p = zone_shares(pairs.withColumn("w_all", total), "geoid", [*names, "w_all"])

    def share(sector: str) -> Column:
        base = F.when(F.col("_t_w_" + sector) > 0, F.col("_t_w_" + sector)).otherwise(F.col("_t_w_all"))
        return X.ratio("w_" + sector, base)

    # the six shares are computed once per pair, not once per sub-sector
    p = p.withColumns({"_s_" + s: share(s) for s in SECTORS} | {"_s_all": X.ratio("w_all", "_t_w_all")})
    aggs = [F.sum(F.col("emp") * F.col("_s_all")).alias("emp")]
    aggs += [F.sum(F.col("emp_" + s) * F.col("_s_" + s)).alias("emp_" + s) for s in SECTORS]
    aggs += [F.sum(F.col("emp_" + n) * F.col("_s_" + sector_of(n))).alias("emp_" + n) for n in subs]
    return p.groupBy("parcel_id").agg(*aggs)


def sector_employment(
    pairs: DataFrame, sqft_of: Mapping[str, str], estimated: str | None = None
) -> DataFrame:
    """ALC17: zone jobs per sector by the sector's floor area; no floor area, no jobs.

    ``sqft_of`` maps a sector to the floor-area column that hosts it.  With
    ``estimated`` a parcel without floor area uses that column instead.
    """
    cols = sorted(set(sqft_of.values()))
    if estimated:
        pairs = pairs.withColumns(
            {n: F.coalesce(F.nullif(F.col(n), F.lit(0.0)), F.col(estimated)) for n in cols}
        )
    p = zone_shares(pairs, "geoid", cols)
    return p.groupBy("parcel_id").agg(
        *[
            X.or_zero(F.sum(F.col("emp_" + s) * X.ratio(X.or_zero(n), "_t_" + n))).alias("emp_" + s)
            for s, n in sqft_of.items()
        ]
    )


def crosswalk(
    pairs: DataFrame,
    values: DataFrame,
    source: str,
    target: str,
    area: str,
    scalars: Sequence[str],
    labels: Sequence[str] = (),
    ratios: Sequence[str] = (),
) -> DataFrame:
    """ALC16: each source row is split over its targets by area.

    Scalars add value * share, labels come from the target's largest overlap, ratios
    are share-weighted means.
    """
    share = F.when(F.col("_whole") > 0, F.col(area) / F.col("_whole")).otherwise(1.0)
    p = with_group_totals(
        pairs.select(source, target, area), [source], [F.sum(area).alias("_whole")]
    )
    p = p.withColumn("share", share).join(values.select(source, *scalars, *labels, *ratios), source)
    # largest area first, the lowest source on a tie
    biggest = F.struct((-F.col(area)).alias("area"), F.col(source))
    aggs = [F.sum(F.col(n) * F.col("share")).alias(n) for n in scalars]
    aggs += [F.min_by(n, biggest).alias(n) for n in labels]
    aggs += [X.ratio(F.sum(F.col(n) * F.col("share")), F.sum("share")).alias(n) for n in ratios]
    return p.groupBy(target).agg(*aggs, F.min_by(source, biggest).alias(source))


# --- built forms -------------------------------------------------------------------


NO_SECTORS = "map<string,double>"


def _merged(maps: Column) -> Column:
    """One map with the sums of several, by key."""
    keys = F.array_distinct(F.flatten(F.transform(maps, lambda m: F.map_keys(m))))
    total = lambda k: F.aggregate(maps, F.lit(0.0), lambda acc, m: acc + F.coalesce(F.try_element_at(m, k), F.lit(0.0)))
    return F.map_from_arrays(keys, F.transform(keys, total))


def building_allocation(acres: Column, row_pct, bt: str = "", sectors: str | None = None) -> dict[str, Column]:
    """ALC08: everything a building type puts on ``acres``; ``bt`` prefixes its columns.

    A missing household size is 2.5 and a missing vacancy 5 percent; 0 counts as
    missing for both.  With ``sectors``, a map column of the building type's shares by
    sector, ``employment_by_sector`` splits the jobs (an empty map where there are none).
    """

    def col(name: str) -> Column:
        return F.col(bt + name)

    def known(name: str, default: float) -> Column:
        return F.coalesce(F.nullif(col(name), F.lit(0.0)), F.lit(default))

    used = acres * (1.0 - X.c(row_pct) / 100.0)
    site_m2 = used * SQFT_PER_ACRE * SQFT_TO_SQM
    units = F.when(X.positive(bt + "du_per_acre"), used * col("du_per_acre")).otherwise(0.0)
    jobs = F.when(X.positive(bt + "emp_per_acre"), used * col("emp_per_acre")).otherwise(0.0)
    people = units * known("household_size", 2.5)
    by_far = X.positive(bt + "far")
    by_units = X.positive(bt + "stories") & X.positive(bt + "footprint_per_unit") & (units > 0)
    by_cover = X.positive(bt + "building_coverage") & X.positive(bt + "stories")
    unit_m2 = units * col("footprint_per_unit")
    cover_m2 = site_m2 * (col("building_coverage") / 100.0)
    floor = X.ladder(
        [
            (by_far, site_m2 * col("far")),
            (by_units, unit_m2 * col("stories")),
            (by_cover, cover_m2 * col("stories")),
        ],
        0.0,
    )
    ground = X.ladder(
        [
            (by_far, F.when((floor > 0) & X.positive(bt + "building_coverage"), cover_m2).otherwise(0.0)),
            (by_units, unit_m2),
            (by_cover, cover_m2),
        ],
        0.0,
    )
    outdoor = F.when(
        X.positive(bt + "outdoor_water_rate"),
        (site_m2 - ground) * X.or_zero(bt + "irrigable_area_fraction") * col("outdoor_water_rate"),
    ).otherwise(0.0)
    by_sector = {}
    if sectors:
        by_sector = {"employment_by_sector": F.coalesce(X.spread_map(jobs, col(sectors)), F.create_map().cast(NO_SECTORS))}
    spaces = (
        X.or_zero(bt + "parking_spaces_per_unit") * units
        + X.or_zero(bt + "parking_spaces_per_1000sqft") * (floor / SQFT_TO_SQM / 1000.0)
    )
    return {
        "developable_acres": used,
        "row_acres": acres - used,
        "dwelling_units": units,
        "population": people,
        "households": units * (1.0 - known("vacancy_rate", 5.0) / 100.0),
        "employment": jobs,
        "floor_area_m2": floor,
        "building_footprint_m2": ground,
        "water_indoor_l": F.when(
            X.positive(bt + "indoor_water_rate"), people * col("indoor_water_rate") * 365.0
        ).otherwise(0.0),
        "water_outdoor_l": outdoor,
        "electricity_kwh": X.or_zero(floor * col("electricity_eui")),
        "gas_kwh": X.or_zero(floor * col("gas_eui")),
        "trips_per_day": X.or_zero(units * col("trip_rate_override")),
        "parking_spaces": spaces,
        "parking_area_m2": spaces * known("parking_sqft_per_space", 300.0) * SQFT_TO_SQM,
    } | by_sector


def place_type_allocation(parcels: DataFrame, mixes: DataFrame, types: DataFrame, sectors: str | None = None) -> DataFrame:
    """ALC09: parcel acres after right of way, split over the mix of building types.

    ``parcels``: parcel_id, acres, place_type.  ``mixes``: place_type, type_id,
    percentage, row_pct.  ``types``: type_id and the building type columns.  The
    breakdown is one struct per building type of the place, in type order.  With
    ``sectors`` (see ``building_allocation``) jobs by sector are summed over the types.
    """
    mixes = with_group_totals(mixes, ["place_type"], [F.sum("percentage").alias("_whole")])
    recipe = mixes.join(types, "type_id")
    rows = parcels.join(recipe, "place_type")
    row_pct = F.coalesce(F.nullif(F.col("row_pct"), F.lit(0.0)), F.lit(25.0))
    used = F.col("acres") * (1.0 - row_pct / 100.0)
    part = used * X.or_zero(X.ratio("percentage", "_whole"))
    got = building_allocation(part, F.lit(0.0), sectors=sectors)
    names = [n for n in got if n not in ("developable_acres", "row_acres", "employment_by_sector")]
    rows = rows.withColumns({"_used": used, "_part": part} | {"_o_" + n: got[n] for n in got})
    by_sector = [_merged(F.collect_list("_o_employment_by_sector")).alias("employment_by_sector")] if sectors else []
    line = F.struct(
        "type_id",
        "percentage",
        F.col("_part").alias("acres"),
        F.col("_o_dwelling_units").alias("dwelling_units"),
        F.col("_o_population").alias("population"),
        F.col("_o_employment").alias("employment"),
        F.col("_o_floor_area_m2").alias("floor_area_m2"),
    )
    return rows.groupBy("parcel_id").agg(
        F.first("_used").alias("developable_acres"),
        F.first(F.col("acres") - F.col("_used")).alias("row_acres"),
        *[F.sum("_o_" + n).alias(n) for n in names],
        F.array_sort(F.collect_list(line)).alias("breakdown"),
        *by_sector,
    )
