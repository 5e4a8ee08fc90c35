"""Parcels, sales and buildings of an assessor's office."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.functions import geometry as G
from landspan.operators import overlay, ranking, spatial
from landspan.operators.knn import few_pairs, nearest_k, nearest_of_all
from landspan.params import SQFT_PER_ACRE, SQM_PER_ACRE, SQM_TO_SQFT
from landspan.session import cut

# Category of two-character use codes, and of code beginnings.
USE_CODES = {
    "urban": ["10", "11", "12", "13", "14", "15", "16", "17", "18"],
    "industrial": ["20", "21", "22", "23", "24", "30", "31", "32", "80", "81", "82", "83", "90"],
    "agricultural": ["40", "41", "42", "43", "44", "45", "46"],
    "undeveloped": ["50", "51", "52", "53", "60", "61", "62", "63", "70", "71"],
}
VACANT_M_CODES = ("MP", "MR", "MW", "MD", "MF", "MG", "ML")
FIRST_LETTER = {
    "A": "urban", "B": "urban", "C": "urban", "D": "undeveloped", "E": "urban", "F": "agricultural",
    "G": "undeveloped", "H": "urban", "I": "industrial", "M": "urban", "W": "undeveloped",
}


def use_code_category(code: Column) -> Column:
    """Category of a numeric two-character use code, NULL if unknown."""
    two = F.substring(code, 1, 2)
    return X.ladder([(two.isin(codes), cat) for cat, codes in USE_CODES.items()])


def land_category(code: Column) -> Column:
    """BAS01: category of an assessor land-use code."""
    letters = [(F.substring(code, 1, 2).isin(list(VACANT_M_CODES)), "undeveloped")]
    letters += [(F.substring(code, 1, 1) == k, v) for k, v in FIRST_LETTER.items()]
    return F.coalesce(
        use_code_category(code),
        F.when(X.blank_to_null(code).isNull(), "undeveloped").otherwise(
            X.ladder(letters, "undeveloped")
        ),
    )


SUB_UNIT_BUFFER_M, FEW_UNITS_BUFFER_M = 5.0, 30.0


def assessor_parcels(raw: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """BAS01: one row per parcel number.

    Rows without a lot size are sub-units: they become one parcel per 8-character
    prefix, whose area is the hull of their centres grown by 5 m (a 30 m disc around
    the centre for fewer than 3), with the most frequent codes.  Other rows keep the
    largest lot per number; ``tie`` breaks equal lots.  ``x``, ``y`` are the lot's centre,
    or the centroid of the ``hull`` (a ring, null for lots) of the merged centres.

    ``raw``: apn, lotsize (sqft), landuse, zone, jurisdiction, x, y (centre, metres).
    """
    has_lot = X.positive("lotsize")
    labels = ["landuse", "zone", "jurisdiction"]
    units = raw.where(~has_lot & F.col("x").isNotNull()).withColumn(
        "prefix", F.substring("apn", 1, 8)
    )
    merged = spatial.hulls(units, ["prefix"])
    big = G.buffered_hull_area(F.col("hull"), SUB_UNIT_BUFFER_M)
    disc = F.pi() * FEW_UNITS_BUFFER_M * FEW_UNITS_BUFFER_M
    merged = merged.select(
        "prefix",
        (F.when(F.col("n") >= 3, big).otherwise(disc) / SQM_PER_ACRE).alias("lot_size_acres"),
        "hull",
        G.centroid(F.col("hull")).alias("centre"),
    ).select("*", "centre.x", "centre.y").drop("centre")
    for n in labels:
        merged = merged.join(ranking.modes(units, ["prefix"], n, n), "prefix", "left")
    merged = merged.withColumn("apn", F.concat("prefix", F.lit("0000"))).drop("prefix")
    lots = ranking.first_per(
        raw.where(has_lot), ["apn"], [F.desc("lotsize"), *[F.asc(t) for t in tie]]
    ).select("apn", (F.col("lotsize") / SQFT_PER_ACRE).alias("lot_size_acres"), *labels, "x", "y", F.lit(None).cast(G.RING).alias("hull"))
    both = lots.unionByName(merged.select(lots.columns))
    return both.withColumn("land_development_category", land_category(F.col("landuse")))


# --- sales ---------------------------------------------------------------------------


def dedupe_sales(sales: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """BAS02: the most complete, then newest sale per parcel."""
    living, built = F.col("living_area").isNotNull(), F.col("building_sf").isNotNull()
    complete = X.ladder(
        [(living & built & F.col("units").isNotNull(), 0), (living, 1), (built, 2)], 3
    )
    order = [complete.asc(), F.desc_nulls_last("year_built"), *[F.asc(t) for t in tie]]
    best = ranking.first_per(sales.where(living | built), ["apn"], order)
    return best.select(
        "apn",
        F.col("living_area").alias("actual_living_sqft"),
        F.col("building_sf").alias("actual_building_sqft"),
        "property_type",
        F.col("lot_size_acres").alias("sales_lot_size_acres"),
        "units",
    )


def building_medians(sales: DataFrame) -> DataFrame:
    """BAS03: sales and median areas per property type (blank types are 'Other')."""
    known = sales.where("living_area IS NOT NULL OR building_sf IS NOT NULL").withColumn(
        "property_type", F.coalesce(X.blank_to_null("property_type"), F.lit("Other"))
    )
    out = known.groupBy("property_type").agg(F.count("*").alias("parcel_count"))
    middle = ranking.medians(known, ["living_area", "building_sf", "lot_size_acres"], ["property_type"])
    return out.join(middle, "property_type", "left")


# --- buildings -------------------------------------------------------------------------


def combine_buildings(first: DataFrame, second: DataFrame, cell: float) -> DataFrame:
    """BAS04: all buildings of the first source and those of the second that are not
    more than half covered by one of the first; both have id, a ring or box columns, and labels.

    Second-source rows outside the first source's extent are dropped as well.
    """
    window = spatial_extent(spatial.ringed(first))
    second = second.withColumn("_w", window).where(G.boxes_meet(G.ring_box(spatial.ring_of(second)), F.col("_w"))).drop("_w")
    own = spatial.ringed(second).select("id", "ring").withColumn("_own", G.area(F.col("ring")))
    others = spatial.ringed(first).select(F.col("id").alias("_other"), "ring")
    pairs = overlay.overlaps(own, others, ["id", "_own"], ["_other"], cell)
    covered = pairs.where(F.col("overlap") > F.col("_own") * 0.5).select("id").distinct()
    return first.unionByName(second.join(covered, "id", "left_anti"), allowMissingColumns=True)


def spatial_extent(df: DataFrame) -> Column:
    """Extent of a table of rings as a scalar box."""
    b = G.ring_box(F.col("ring"))
    return df.agg(
        F.struct(
            F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"),
            F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"),
        )
    ).scalar()


# Building classes that are homes.
HOME_CLASSES = (
    "cabin", "dwelling_house", "ger", "houseboat", "stilt_house", "static_caravan", "trullo", "semi", "residential", "house",
    "apartments", "dormitory", "detached", "semidetached", "terrace", "bungalow",
)


def classify_buildings(df: DataFrame) -> DataFrame:
    """BAS05: five class categories and the footprint in square feet (from area_m2)."""
    c = F.col("class")
    category = X.ladder(
        [
            (c.isin(list(HOME_CLASSES)), "residential"),
            (c == "commercial", "commercial"),
            (c == "industrial", "industrial"),
            ((c == "mixed") | c.isNull(), "mixed"),
        ],
        "other",
    )
    return df.withColumns(
        {"class_category": category, "footprint_sqft": F.col("area_m2") * SQM_TO_SQFT}
    )


def building_stats(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    """BAS06: building measures per parcel.

    ``pairs``: apn, footprint_sqft, levels, height, bf_source, confidence,
    class_category, overlap_ratio (share of the building on the parcel).
    """
    levels = F.coalesce(F.nullif(F.col("levels"), F.lit(0)), F.lit(1))
    sqft, part, kind = F.col("footprint_sqft"), F.col("overlap_ratio"), F.col("class_category")
    mixed, several = kind == "mixed", levels > 1
    shop_m, home_m = sqft, sqft * (levels - 1)

    def total(value: Column) -> Column:
        return F.sum(X.c(value) * part)

    def floors_of(cls: str, mixed_part: Column | None = None) -> Column:
        cases = [(kind == cls, sqft * levels)]
        if mixed_part is not None:
            cases = [(mixed & several, mixed_part), (mixed, sqft * 0.5), *cases]
        return total(X.ladder(cases, 0.0))

    home = kind == "residential"
    stats = pairs.groupBy("apn").agg(
        total(sqft * levels).alias("total_footprint_sqft"),
        F.count("*").alias("building_count"),
        F.max("height").alias("max_height"),
        F.max("levels").alias("max_levels"),
        F.count_if(F.col("bf_source") == "google").alias("google_building_count"),
        F.count_if(F.col("bf_source") == "microsoft").alias("microsoft_building_count"),
        F.avg("confidence").alias("mean_confidence"),
        F.sum(F.when(home, sqft * part)).alias("residential_building_sqft"),
        F.sum(F.when(~home, sqft * part)).alias("non_residential_building_sqft"),
        F.count_if(home).alias("residential_building_count"),
        F.count_if(~home).alias("non_residential_building_count"),
        F.count_distinct(kind).alias("distinct_class_categories"),
        floors_of("commercial", shop_m).alias("commercial_sqft"),
        floors_of("residential", home_m).alias("residential_sqft"),
        floors_of("industrial").alias("industrial_sqft"),
        floors_of("other").alias("other_sqft"),
    )
    counts = [n for n in stats.columns if n.endswith("_count") or n.startswith("distinct")]
    sums = [n for n in stats.columns if n.endswith("_sqft")]
    lot = F.col("lot_size_acres") * SQFT_PER_ACRE
    return (
        parcels.join(stats, "apn", "left")
        .withColumns(
            {n: X.or_zero(n) for n in sums}
            | {n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in counts}
        )
        .withColumn(
            "footprint_ratio",
            F.when(F.col("lot_size_acres") > 0, F.col("total_footprint_sqft") / lot).otherwise(0.0),
        )
    )


def building_pairs(parcels: DataFrame, buildings: DataFrame, cell: float) -> DataFrame:
    """BAS06: parcel x building pairs with the building's share on the parcel; rings or boxes on either side.

    What is known of a building travels with its edges, so that buildings are neither
    written nor joined again; only those that reach over a line of the grid are written.
    """
    keep = [n for n in buildings.columns if n not in (*spatial.BOX, "ring")]
    own = spatial.ringed(buildings).select(*keep, "ring", G.area(F.col("ring")).alias("_own"), F.monotonically_increasing_id().alias("_building"))
    lots = spatial.ringed(parcels).select("apn", "ring")
    keys, low = ["_building", "_own", *keep], F.coalesce(~overlay.is_tall(F.col("ring"), cell), F.lit(False))
    pairs = overlay.overlaps_of_low(own.where(low), lots, keys, ["apn"], cell)
    # strips reads them twice, so they are numbered for good
    tall = cut(own.where(~low))
    if not tall.isEmpty():
        pairs = pairs.unionByName(overlay.overlaps(tall, lots, keys, ["apn"], cell))
    return pairs.select(
        "apn", *keep, (F.col("overlap") / F.col("_own")).alias("overlap_ratio")
    )


def sqft_by_type(stats: DataFrame) -> DataFrame:
    """BAS07."""
    kinds = ("residential", "commercial", "industrial", "other")
    return stats.select(
        "apn",
        "total_footprint_sqft",
        "building_count",
        "footprint_ratio",
        "lot_size_acres",
        *[X.or_zero(k + "_sqft").alias(k + "_building_sqft") for k in kinds],
        "residential_building_count",
        "non_residential_building_count",
        "max_levels",
        "land_development_category",
    )


# --- zones of parcels --------------------------------------------------------------------


def parcel_block_groups(parcels: DataFrame, zones: DataFrame, year: int, cell: float) -> DataFrame:
    """BAS10: block group (lowest id on a shared edge) and tract of the parcel centre."""
    hits = spatial.inside(parcels.select("apn", "x", "y"), zones, cell)
    return (
        hits.groupBy("l.apn")
        .agg(F.min("r.geoid").alias("block_group_geoid"))
        .select(
            "apn",
            F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("data_year"),
            "block_group_geoid",
            F.substring("block_group_geoid", 1, 11).alias("tract_geoid"),
        )
    )


def parcel_zone_overlaps(parcels: DataFrame, zones: DataFrame, cell: float, keep: Sequence[str] = ()) -> DataFrame:
    """BAS11: parcel x block-group overlaps in m2, with the zone's measures; rings or boxes on either side."""
    own = spatial.ringed(parcels).select("apn", "ring")
    pairs = overlay.overlaps(own, spatial.ringed(zones).select("geoid", "ring", *keep), ["apn"], ["geoid", *keep], cell)
    return pairs.select("apn", "geoid", F.col("overlap").alias("intersect_area_m2"), *keep)


def crosswalk_pairs(targets: DataFrame, parcels: DataFrame, cell: float) -> DataFrame:
    """BAS42: unique (parcel_id, apn) pairs with their largest overlap; rings or boxes on either side."""
    # an id may have several polygons, told apart by their rings
    own = spatial.ringed(targets).select("parcel_id", "ring").withColumn("_shape", F.xxhash64("ring"))
    own = own.dropDuplicates(["parcel_id", "_shape"])
    pairs = overlay.overlaps(own, spatial.ringed(parcels).select("apn", "ring"), ["parcel_id", "_shape"], ["apn"], cell)
    return pairs.groupBy("parcel_id", "apn").agg(F.max("overlap").alias("intersect_area_m2"))


# --- imputation from similar parcels -------------------------------------------------------


def latest_zone(zones: DataFrame) -> DataFrame:
    """SRT02: the newest block group of every parcel."""
    return ranking.first_per(zones, ["apn"], [F.desc("data_year"), F.asc("block_group_geoid")])


def sales_features(
    stats: DataFrame, zones: DataFrame, sales: DataFrame, tie: Sequence[str] = ()
) -> DataFrame:
    """BAS12: known parcels: building stats, zone and one sale with a property type."""
    sold = sales.where(X.blank_to_null("property_type").isNotNull())
    sold = ranking.first_per(sold, ["apn"], [*[F.asc(t) for t in tie], F.asc("property_type")])
    sold = sold.select(
        "apn",
        "property_type",
        F.coalesce("units", F.lit(1)).alias("units"),
        F.col("living_area").alias("living_sqft"),
        F.col("building_sf").alias("building_sqft"),
    )
    zone = latest_zone(zones).select("apn", "block_group_geoid", "tract_geoid")
    return stats.where("footprint_ratio > 0").join(zone, "apn").join(sold, "apn")


FEATURES = ("footprint_ratio", "building_count", "lot_size_acres")
WINDOW_SIGMAS, NEIGHBOURS, COUNTY_REACH_M = 3.0, 5, 5000.0


def _tier(unknown: DataFrame, known: DataFrame, keys: list[str], tier: int, near: bool) -> DataFrame:
    """Neighbours of one tier: z-scores within the keys, at most 3 sigma apart."""
    sigma = known.groupBy(*keys).agg(*[F.stddev_pop(f).alias("_s_" + f) for f in FEATURES])

    def scaled(df: DataFrame) -> DataFrame:
        out = df.join(sigma, keys)
        return out.withColumns({"z_" + f: X.or_zero(X.ratio(f, "_s_" + f)) for f in FEATURES})

    # without spread in the key a feature has to be equal
    ok = None
    for f in FEATURES:
        same = (F.col("q._s_" + f) > 0) | (F.col("q." + f) == F.col("p." + f))
        ok = same if ok is None else ok & same
    if unknown.isEmpty():
        return unknown.select("apn", F.col("apn").alias("neighbour"), F.lit(tier).alias("tier"))
    group, few = list(keys), False
    if near:
        # the key is also the 5 km cell; one side is repeated to the cells around its own
        def cell(name: str) -> Column:
            return F.floor(F.col(name) / COUNTY_REACH_M)

        def in_cells(df: DataFrame, around: bool) -> DataFrame:
            for g, n in (("_gx", "x"), ("_gy", "y")):
                df = df.withColumn(g, F.explode(F.sequence(cell(n) - 1, cell(n) + 1)) if around else cell(n))
            return df

        group += ["_gx", "_gy"]
        # few queries go to the points, else the points to them, which the pyramid needs
        few = few_pairs(in_cells(unknown.select(*keys, "x", "y"), True), in_cells(known.select(*keys, "x", "y"), False), group)
        unknown, known_z = in_cells(unknown, few), in_cells(scaled(known), not few)
        ok = ok & (
            F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")) <= COUNTY_REACH_M
        )
    else:
        known_z = scaled(known)
    square = F.lit(0.0)
    for f in FEATURES:
        z = X.or_zero(X.ratio(F.col("q." + f) - F.col("p." + f), "q._s_" + f))
        square = square + z * z
    cols = [*group, *FEATURES, *["z_" + f for f in FEATURES], *["x", "y"][: 2 * near]]
    pairs = (nearest_of_all if few else nearest_k)(
        scaled(unknown).select("apn", *cols, *["_s_" + f for f in FEATURES]),
        known_z.select(F.col("apn").alias("neighbour"), *cols),
        group, ["z_" + f for f in FEATURES], NEIGHBOURS, "apn", "neighbour", WINDOW_SIGMAS, ok,
        gap=F.sqrt(square), **({} if few else {"same": None if near else FEATURES, "small": True}),
    )
    # read twice: by the next tier and by the result; under names of their own, since a written
    # column that is only an alias of one by its name keeps what was known of that one, which unions trip over
    pairs = cut(pairs.select(F.col("apn").alias("_apn"), F.col("neighbour").alias("_neighbour")))
    return pairs.select(F.col("_apn").alias("apn"), F.col("_neighbour").alias("neighbour"), F.lit(tier).alias("tier"))


def impute_from_similar(stats: DataFrame, zones: DataFrame, known: DataFrame) -> DataFrame:
    """BAS13: type, units and areas of parcels without a sale from 5 similar parcels.

    Tiers: same block group, then same tract, then within 5 km; always the same land
    category.  A parcel that found a neighbour in one tier skips the next.
    """
    zone = latest_zone(zones).select("apn", "block_group_geoid", "tract_geoid")
    # both sides are read by every tier and round: write them once
    features = ["apn", "land_development_category", *FEATURES, "x", "y"]
    own = ["property_type", "units", "living_sqft", "building_sqft"]
    known = cut(known.select(*features, "block_group_geoid", "tract_geoid", *own))
    unknown = stats.where("footprint_ratio > 0").select(*features).join(zone, "apn")
    unknown = cut(unknown.join(known.select("apn"), "apn", "left_anti"))
    cat = "land_development_category"
    pairs = None
    for tier, (keys, near) in enumerate(
        [(["block_group_geoid", cat], False), (["tract_geoid", cat], False), ([cat], True)], start=1
    ):
        got = _tier(unknown, known, keys, tier, near)
        pairs = got if pairs is None else pairs.unionByName(got)
        unknown = cut(unknown.join(got.select("apn"), "apn", "left_anti"))
    n = known.select(F.col("apn").alias("neighbour"), *own)
    near_rows = pairs.join(n, "neighbour")
    # at most five rows per parcel
    return near_rows.groupBy("apn").agg(
        F.min("tier").alias("imputed_from_tier"),
        F.count("*").alias("neighbor_count"),
        F.expr("mode() WITHIN GROUP (ORDER BY property_type)").alias("imputed_property_type"),
        F.percentile("units", F.lit(0.5)).alias("imputed_units"),
        F.percentile("living_sqft", F.lit(0.5)).alias("imputed_living_sqft"),
        F.percentile("building_sqft", F.lit(0.5)).alias("imputed_building_sqft"),
    )


# --- areas and weights -----------------------------------------------------------------------


def authoritative_areas(stats: DataFrame, sales: DataFrame, imputed: DataFrame) -> DataFrame:
    """BAS14: residential and other floor area by the best source."""
    j = (
        stats.select("apn", "residential_building_sqft", "non_residential_building_sqft", "max_levels")
        .join(sales.select("apn", "actual_living_sqft", "actual_building_sqft"), "apn", "left")
        .join(imputed.select("apn", "imputed_living_sqft", "imputed_building_sqft"), "apn", "left")
    )
    home, other, levels = (F.col(n) for n in ("residential_building_sqft", "non_residential_building_sqft", "max_levels"))
    tall = X.positive("max_levels")
    living, built = F.col("actual_living_sqft"), F.col("actual_building_sqft")
    i_living, i_built = F.col("imputed_living_sqft"), F.col("imputed_building_sqft")
    res_cases = [
        (X.positive(home) & tall, home * levels, "overture_with_levels"),
        (X.positive(home), home, "overture_flat"),
        (X.positive(living), living, "assessor_sales"),
        (X.positive(i_living), i_living, "footprint_imputed"),
    ]
    other_cases = [
        (X.positive(other) & tall, other * levels),
        (X.positive(other), other),
        (X.positive(built) & X.positive(living), built - living),
        (X.positive(built), built),
        (X.positive(i_built) & X.positive(i_living), i_built - i_living),
        (X.positive(i_built), i_built),
    ]
    return j.select(
        "apn",
        X.ladder([(c, v) for c, v, _ in res_cases]).alias("authoritative_residential_sqft"),
        X.ladder(other_cases).alias("authoritative_non_residential_sqft"),
        X.ladder([(c, s) for c, _, s in res_cases]).alias("data_source"),
    )


def dasymetric_weights(parcels: DataFrame) -> DataFrame:
    """BAS15: population and job weights of the assembled parcel row.

    Job weights grow with intersection density: * (1 + density / 400).
    """
    lot = F.col("lot_size_acres") * SQFT_PER_ACRE
    other = (
        X.or_zero("commercial_building_sqft")
        + X.or_zero("industrial_building_sqft")
        + X.or_zero("other_building_sqft")
    )
    people = F.coalesce("authoritative_residential_sqft", X.or_zero("residential_building_sqft"), lot * 0.15)
    jobs = F.coalesce("authoritative_non_residential_sqft", F.nullif(other, F.lit(0.0)), lot * 0.1)
    return parcels.withColumns(
        {
            "pop_dasym_weight": X.non_negative(people),
            "emp_dasym_weight": X.non_negative(jobs) * (1.0 + X.or_zero("intersection_density") / 400.0),
        }
    )


def lot_size_weights(parcels: DataFrame) -> DataFrame:
    """BAS15, variant without building data: shares of the lot."""
    lot = X.or_zero(F.col("lot_size_acres") * SQFT_PER_ACRE)
    return parcels.withColumns(
        {
            "pop_dasym_weight": X.non_negative(lot * 0.15),
            "emp_dasym_weight": X.non_negative(lot * 0.1),
        }
    )


DEFAULT_VACANCY, DEFAULT_HOUSEHOLD = 0.05, 2.5


def household_size(pairs: DataFrame) -> DataFrame:
    """Overlap-weighted persons per unit of the zones a parcel touches."""
    size = X.ratio("hh", "du") * F.col("intersect_area_m2")
    return pairs.groupBy("apn").agg(
        X.ratio(F.sum(size), F.sum("intersect_area_m2")).alias("hh_size")
    )


def estimate_units(parcels: DataFrame, sizes: DataFrame, sales: DataFrame | None, tie: Sequence[str] = ()) -> DataFrame:
    """BAS16: units from the newest sale, else the model (``du_total``), else 0; weights.

    Without ``sales`` the sale step is skipped.
    """
    df = parcels.join(sizes, "apn", "left")
    if sales is None:
        df = df.withColumn("assessor_units", X.typed_null("int"))
    else:
        newest = ranking.first_per(
            sales, ["apn"], [F.desc_nulls_last("year_built"), *[F.asc(t) for t in tie]]
        ).select("apn", F.coalesce("units", F.lit(0)).alias("assessor_units"))
        df = df.join(newest, "apn", "left").withColumn(
            "assessor_units", F.coalesce("assessor_units", F.lit(0))
        )
    du = F.coalesce(F.nullif(F.col("assessor_units").cast("double"), F.lit(0.0)), "du_total", F.lit(0.0))
    df = df.withColumns(
        {
            "du": du,
            "hh_size": F.coalesce("hh_size", F.lit(DEFAULT_HOUSEHOLD)),
            "vacancy_rate": F.lit(DEFAULT_VACANCY),
        }
    )
    hh = F.col("du") * (1.0 - F.col("vacancy_rate"))
    size = F.coalesce(F.nullif(F.col("hh_size"), F.lit(0.0)), F.lit(DEFAULT_HOUSEHOLD))
    return df.withColumns(
        {"pop_dasym_weight": F.col("du") * size, "hh_dasym_weight": hh, "hh": hh}
    )
