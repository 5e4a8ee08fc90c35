"""Built-form classification in tiers, unit estimates, points of interest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators.knn import nearest_k
from landspan.params import SQFT_PER_ACRE

# Built-form keys.
SMALL_LOT = "bt__medium_density_detached_residential"
LARGE_LOT = "bt__low_density_detached_residential"
ATTACHED = "bt__medium_density_attached_residential"
APARTMENTS = "bt__high_density_attached_residential"
RETAIL = "bt__communityneighborhood_retail"
INDUSTRY = "bt__light_industrial"
FARM = "bt__agriculture"
CIVIC = "bt__publicquasi_public"
VACANT = "undeveloped"

# Use-code beginnings with a form of their own.
CODE_FORMS = {
    ATTACHED: ["A3"],
    SMALL_LOT: ["A4"],
    RETAIL: ["AE", "BA", "BB", "BC", "BD", "BE", "BF", "CA", "CG", "MP", "MS", "MU"],
    INDUSTRY: ["AF", "IA", "IB", "IG"],
    FARM: ["AG"],
    CIVIC: ["AH", "AJ", "GA", "GC", "HJ"],
    VACANT: ["AD", "AQ"],
}
DENSITY_MIDPOINT, DENSITY_STEEPNESS = 225.0, 0.04
TINY_LOT_ACRES, SMALL_LOT_ACRES = 0.08, 0.15


def dense(intersections) -> Column:
    """True where the sigmoid of intersection density is above one half."""
    d = F.coalesce(X.c(intersections), F.lit(DENSITY_MIDPOINT))
    return X.sigmoid((d - DENSITY_MIDPOINT) * DENSITY_STEEPNESS) > 0.5


def by_lot(lot) -> Column:
    return F.when(X.or_zero(lot) < SMALL_LOT_ACRES, SMALL_LOT).otherwise(LARGE_LOT)


def tier0(code, intersections) -> Column:
    """CLS01: assessor use code; A2 and AT (several units) fall through."""
    two = F.substring(X.c(code), 1, 2)
    cases = [(two == "A1", F.when(dense(intersections), SMALL_LOT).otherwise(LARGE_LOT))]
    cases += [(two.isin(codes), form) for form, codes in CODE_FORMS.items()]
    return X.ladder(cases)


def tier1(property_type, lot, units) -> Column:
    """CLS02: sale type with lot and unit bounds."""
    t, n = X.c(property_type), X.c(units)
    single = t.isin("SFR", "Single Family Residence") | t.startswith("Single Family")
    condo = t.startswith("Condo") | t.startswith("Townhouse")
    multi = t.isin("MF", "Multiple Family Residence") | t.startswith("Multiple Family")
    return X.ladder(
        [
            (single, by_lot(lot)),
            (condo, ATTACHED),
            (multi & n.between(2, 4), ATTACHED),
            (multi & (n >= 5), APARTMENTS),
        ]
    )


def tier2(building_class, levels, lot) -> Column:
    """CLS03: building class, residential split by levels and lot."""
    c = X.c(building_class)
    return X.ladder(
        [
            ((c == "residential") & (X.c(levels) >= 3), APARTMENTS),
            (c == "residential", by_lot(lot)),
            (c == "commercial", RETAIL),
            (c == "industrial", INDUSTRY),
            (c == "civic", CIVIC),
        ]
    )


TIER3_FEATURES = ("intersection_density", "lot_size_acres", "footprint_ratio")


def tier3(unknown: DataFrame, known: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """CLS04: most frequent form of the k nearest known parcels with equal keys.

    Both sides hold apn, the keys and the three features; ``known`` also
    built_form_key.  Features are divided by their standard deviation within the key.
    """
    sigma = known.groupBy(*keys).agg(*[F.stddev_pop(f).alias("_s_" + f) for f in TIER3_FEATURES])
    names = ["z_" + f for f in TIER3_FEATURES]

    def scaled(df: DataFrame, label: str) -> DataFrame:
        z = {"z_" + f: X.or_zero(X.ratio(f, "_s_" + f)) for f in TIER3_FEATURES}
        cols = [*keys, *TIER3_FEATURES, *names, *["_s_" + f for f in TIER3_FEATURES]]
        return df.join(sigma, list(keys)).withColumns(z).select(F.col("apn").alias(label), *cols)

    square = F.lit(0.0)
    for f in TIER3_FEATURES:
        z = X.or_zero(X.ratio(F.col("q." + f) - F.col("p." + f), "q._s_" + f))
        square = square + z * z
    z_known = scaled(known, "neighbour")
    # the widest gap between any two rows bounds the search
    spread = z_known.select(*names).unionByName(scaled(unknown, "apn").select(*names)).agg(
        F.greatest(*[F.max(n) - F.min(n) for n in names]).alias("w")
    )
    window = max(float(spread.first()["w"] or 0.0), 1e-9)
    pairs = nearest_k(
        scaled(unknown, "apn"), z_known, list(keys), names, k, "apn", "neighbour",
        window, gap=F.sqrt(square), same=TIER3_FEATURES,
    )
    forms = known.select(F.col("apn").alias("neighbour"), "built_form_key")
    return (
        pairs.join(forms, "neighbour")
        .groupBy("apn")
        .agg(F.expr("mode() WITHIN GROUP (ORDER BY built_form_key)").alias("built_form_key"))
    )


def tier3b(lot, footprint_ratio) -> Column:
    """CLS05: a large lot that is hardly built on is farmland."""
    return F.when((X.c(lot) > 3.0) & (X.or_zero(footprint_ratio) < 0.02), FARM)


def tier4(lot, zone, parcel_number) -> Column:
    """CLS06: lot size and zone; the smallest lots are told apart by their number."""
    a = X.c(lot)
    turn = F.pmod(X.c(parcel_number), F.lit(3))
    return X.ladder(
        [
            (a > 10.0, FARM),
            ((a > 3.0) & F.coalesce(X.c(zone).like("%A%"), F.lit(False)), FARM),
            (a > 0.4, LARGE_LOT),
            (a > SMALL_LOT_ACRES, SMALL_LOT),
            ((a > 0) & (turn == 2), APARTMENTS),
            (a > 0, ATTACHED),
        ]
    )


def resolve(tiers: Mapping[str, str]) -> list[Column]:
    """CLS07: first known form and the name of its tier; ``tiers`` in priority order."""
    source = X.ladder([(F.col(c).isNotNull(), name) for name, c in tiers.items()])
    return [
        F.coalesce(*[F.col(c) for c in tiers.values()]).alias("built_form_key"),
        source.alias("built_form_key_source"),
    ]


# Numbered building types of the area heuristic.
SFR_LARGE, SFR, TOWNHOUSE, DUPLEX, FOURPLEX, COURTYARD, FLATS, MID_RISE, HIGH_RISE = range(1, 10)
SHOPS, COMMERCIAL, OFFICE_LOW, OFFICE_HIGH, LIGHT_INDUSTRY, CIVIC_TYPE = range(10, 16)


def heuristic_form(acres, number) -> Column:
    """CLS08: building type from lot size, spread by parcel number."""
    a, n = X.or_zero(acres), X.c(number)

    def turn(m: int, picks: Mapping[int, int], rest: int) -> Column:
        return X.ladder([(F.pmod(n, F.lit(m)) == i, v) for i, v in picks.items()], rest)

    return X.ladder(
        [
            (a <= 0, SFR),
            (a > 3.0, F.when(F.pmod(n, F.lit(5)) < 3, LIGHT_INDUSTRY).otherwise(CIVIC_TYPE)),
            (a > 1.5, turn(4, {0: COMMERCIAL, 1: OFFICE_LOW, 2: SHOPS}, SFR_LARGE)),
            (a > 0.4, turn(5, {0: SHOPS}, SFR)),
            (a > 0.15, turn(7, {0: TOWNHOUSE, 1: DUPLEX}, SFR)),
            (a > 0.08, turn(3, {0: FOURPLEX, 1: COURTYARD}, FLATS)),
        ],
        turn(5, {0: MID_RISE, 1: HIGH_RISE}, FLATS),
    )


def heuristic_density(acres) -> Column:
    """CLS08: intersection density falls with lot size."""
    a = X.or_zero(acres)
    return F.when(
        a > 0, F.round(X.clamp(10.0 / F.sqrt(F.nullif(a, F.lit(0.0))), 0.5, 25.0), 2)
    ).otherwise(0.5)


def closest_form(parcels: DataFrame, forms: DataFrame) -> DataFrame:
    """CLS09: the form whose units per acre come nearest (ties: lowest id).

    The forms, a dimension, are reduced to one id per density and travel as a sorted
    array on a scalar subquery, so no row is multiplied.
    """
    table = (
        forms.groupBy(X.or_zero("du_per_acre").alias("d"))
        .agg(F.min("id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "d"))).alias("forms"))
        .scalar()
    )
    acres = F.greatest(X.or_zero("area_gross"), F.lit(0.01))
    df = parcels.withColumn("_forms", table).withColumn("_d", X.or_zero("du") / acres)
    gaps = F.transform("_forms", lambda f: F.struct(F.abs(f["d"] - F.col("_d")).alias("gap"), f["id"].alias("id")))
    return df.withColumn("built_form_key", F.array_min(gaps)["id"]).drop("_forms", "_d")


# Fixed values: (key, value, category) of points of interest, in order of precedence.
POI_TAGS = [
    ("amenity", "restaurant", "restaurants"),
    ("amenity", "fast_food", "restaurants"),
    ("amenity", "cafe", "restaurants"),
    ("amenity", "bar", "restaurants"),
    ("amenity", "pub", "restaurants"),
    ("amenity", "school", "schools"),
    ("amenity", "university", "schools"),
    ("amenity", "college", "schools"),
    ("amenity", "library", "schools"),
    ("amenity", "hospital", "hospitals"),
    ("amenity", "clinic", "hospitals"),
    ("amenity", "pharmacy", "hospitals"),
    ("amenity", "doctors", "hospitals"),
    ("leisure", "park", "parks"),
    ("leisure", "playground", "parks"),
    ("leisure", "garden", "parks"),
    ("leisure", "nature_reserve", "parks"),
    ("landuse", "recreation_ground", "parks"),
    ("amenity", "bus_station", "transit"),
    ("amenity", "ferry_terminal", "transit"),
    ("amenity", "taxi", "transit"),
    ("railway", "station", "transit"),
    ("railway", "halt", "transit"),
    ("highway", "bus_stop", "transit"),
    ("shop", "supermarket", "shopping"),
    ("shop", "convenience", "shopping"),
    ("shop", "mall", "shopping"),
    ("shop", "department_store", "shopping"),
    ("shop", "retail", "shopping"),
    ("tourism", "hotel", "lodging"),
    ("tourism", "motel", "lodging"),
    ("tourism", "hostel", "lodging"),
    ("tourism", "guest_house", "lodging"),
    ("tourism", "camp_site", "lodging"),
    ("amenity", "cinema", "entertainment"),
    ("amenity", "theatre", "entertainment"),
    ("amenity", "nightclub", "entertainment"),
    ("tourism", "museum", "entertainment"),
    ("tourism", "attraction", "entertainment"),
    ("tourism", "zoo", "entertainment"),
    ("amenity", "police", "public_services"),
    ("amenity", "fire_station", "public_services"),
    ("amenity", "post_office", "public_services"),
    ("amenity", "townhall", "public_services"),
    ("amenity", "courthouse", "public_services"),
    ("amenity", "community_centre", "public_services"),
    ("leisure", "sports_centre", "sports"),
    ("leisure", "fitness_centre", "sports"),
    ("leisure", "stadium", "sports"),
    ("leisure", "pitch", "sports"),
    ("sport", "swimming", "sports"),
    ("amenity", "place_of_worship", "places_of_worship"),
    ("amenity", "cemetery", "places_of_worship"),
]


def poi_category(pois: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """CLS10: category and deciding tag of the first matching tag, else unknown."""
    hits = [F.try_element_at("tags", F.lit(key)) == value for key, value, _ in POI_TAGS]
    out = pois.withColumns(
        {
            "category": X.ladder([(h, category) for h, (_, _, category) in zip(hits, POI_TAGS)], "unknown"),
            "subcategory": X.ladder([(h, f"{key}={value}") for h, (key, value, _) in zip(hits, POI_TAGS)], "unknown"),
        }
    )
    return out if categories is None else out.where(F.col("category").isin(list(categories)))


def non_residential(lot_sqft, buildings, coverage, levels) -> Column:
    """CLS11: coarse use of a lot that is not residential."""
    a, n, c = X.c(lot_sqft), X.or_zero(buildings), X.or_zero(coverage)
    mid = a.between(10_000, 100_000)
    return X.ladder(
        [
            ((a < 10_000) & (n == 0), "vacant"),
            (mid & (n >= 1) & (c > 0.2) & (X.or_zero(levels) >= 3), "commercial"),
            (mid & (n >= 1) & (c > 0.2), "industrial"),
            (mid & (c < 0.1), "other"),
            ((a > 1_000_000) & (c < 0.01), "agricultural"),
        ]
    )


# Short names of the residential forms, least units, and vacancy.
SINGLE_UNIT = ("detsf_sl", "detsf_ll", "attsf")
LEAST_UNITS = {"mf2to4": 2, "mf5p": 5}
SUBTYPES = ("detsf_sl", "detsf_ll", "attsf", "mf2to4", "mf5p")
VACANCY = {"detsf_sl": 0.025, "detsf_ll": 0.025, "attsf": 0.05, "mf2to4": 0.05, "mf5p": 0.08}


def dwelling_units(units, form, res_sqft, sqft_per_unit, category) -> Column:
    """CLS12: sale, then one per single-family lot, floor area, least number, 1, 0."""
    f = X.c(form)
    sized = F.round(X.ratio(res_sqft, sqft_per_unit), 0)
    cases = [(X.positive(units), X.c(units).cast("double")), (f.isin(list(SINGLE_UNIT)), F.lit(1.0))]
    for key, least in LEAST_UNITS.items():
        cases.append(((f == key) & X.positive(res_sqft), F.greatest(F.lit(float(least)), sized)))
        cases.append((f == key, F.lit(float(least))))
    cases.append((f.isNull() & X.c(category).isin("urban", "mixed_use"), F.lit(1.0)))
    return X.ladder(cases, 0.0)


def sqft_per_unit(parcels: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    """CLS13: floor area per unit from the 20 known parcels nearest in intersection
    density with the same subtype (ratio of sums), else the subtype's ratio.

    ``parcels``: apn, subtype, intersection_density; ``known`` adds res_sqft, units.
    """
    known = known.where(X.positive("res_sqft") & X.positive("units"))
    d = "intersection_density"
    span = known.select(d).unionByName(parcels.select(d)).agg((F.max(d) - F.min(d)).alias("w"))
    window = max(float(span.first()["w"] or 0.0), 1e-9)
    pairs = nearest_k(
        parcels.where(F.col(d).isNotNull()).select("apn", "subtype", d),
        known.where(F.col(d).isNotNull()).select(F.col("apn").alias("neighbour"), "subtype", d),
        ["subtype"], [d], k, "apn", "neighbour", window, same=[d],
    )
    rates = known.select(F.col("apn").alias("neighbour"), "res_sqft", "units")
    local = pairs.join(rates, "neighbour").groupBy("apn").agg(
        X.ratio(F.sum("res_sqft"), F.sum("units")).alias("_local")
    )
    county = known.groupBy("subtype").agg(
        X.ratio(F.sum("res_sqft"), F.sum("units")).alias("_county")
    )
    return (
        parcels.join(local, "apn", "left")
        .join(county, "subtype", "left")
        .withColumn("sqft_per_unit", F.coalesce("_local", "_county"))
        .drop("_local", "_county")
    )


def vacancy(form, known=None) -> Column:
    """CLS14: known rate, else by form, else 5 percent."""
    by_form = X.ladder([(X.c(form) == k, v) for k, v in VACANCY.items()], 0.05)
    return by_form if known is None else F.coalesce(X.c(known), by_form)


def households_and_people(du, rate, size) -> tuple[Column, Column]:
    """CLS14."""
    hh = X.c(du) * (1.0 - X.c(rate))
    return hh, hh * X.c(size)


def unit_subtypes(parcels: DataFrame, county: str = "county_id") -> DataFrame:
    """CLS15: units under their own subtype; unknown forms take the county's mix."""
    known = parcels.where(F.col("form").isin(list(SUBTYPES)))
    mix = known.groupBy(county).agg(
        *[X.ratio(F.sum(F.when(F.col("form") == s, F.col("du"))), F.sum("du")).alias("_m_" + s) for s in SUBTYPES]
    )
    out = {
        "du_" + s: X.ladder(
            [
                (F.col("form") == s, F.col("du")),
                (F.col("form").isin(list(SUBTYPES)), F.lit(0.0)),
                (F.col("form").isNull(), F.col("du") * X.or_zero("_m_" + s)),
            ],
            0.0,
        )
        for s in SUBTYPES
    }
    return parcels.join(mix, county, "left").withColumns(out).drop(*["_m_" + s for s in SUBTYPES])


def lot_coverage(total_sqft, lot_acres) -> Column:
    return X.ratio(total_sqft, X.c(lot_acres) * SQFT_PER_ACRE)
