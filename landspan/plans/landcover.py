"""Land use, land cover, canopy, roads and intersections per parcel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.functions import geometry as G
from landspan.operators import overlay, spatial
from landspan.operators.ranking import first_per
from landspan.params import SQM_PER_ACRE, SQM_PER_SQMI

# Fixed values: (subtype, class, category); without a class for the subtype alone.
LAND_USE_MAP = [
    ("agriculture", None, "agricultural"),
    ("aquaculture", None, "agricultural"),
    ("horticulture", None, "agricultural"),
    ("residential", None, "urban"),
    ("developed", None, "urban"),
    ("developed", "commercial", "urban"),
    ("developed", "retail", "urban"),
    ("developed", "office", "urban"),
    ("developed", "mixed_use", "urban"),
    ("education", None, "urban"),
    ("medical", None, "urban"),
    ("religious", None, "urban"),
    ("entertainment", None, "urban"),
    ("recreation", None, "urban"),
    ("golf", None, "urban"),
    ("cemetery", None, "urban"),
    ("pedestrian", None, "urban"),
    ("industrial", None, "industrial"),
    ("industrial", "quarry", "industrial"),
    ("industrial", "quarry_storage", "industrial"),
    ("industrial", "mineral_pile", "industrial"),
    ("industrial", "refinery", "industrial"),
    ("resource_extraction", None, "industrial"),
    ("resource_extraction", "quarry", "industrial"),
    ("resource_extraction", "mine", "industrial"),
    ("landfill", None, "industrial"),
    ("landfill", "landfill", "industrial"),
    ("military", None, "industrial"),
    ("transportation", None, "industrial"),
    ("transportation", "airport", "industrial"),
    ("transportation", "port", "industrial"),
    ("transportation", "railway", "industrial"),
    ("construction", None, "undeveloped"),
    ("park", None, "undeveloped"),
    ("protected", None, "undeveloped"),
    ("grass", None, "undeveloped"),
    ("managed", None, "undeveloped"),
    ("campground", None, "undeveloped"),
    ("winter_sports", None, "undeveloped"),
    ("protected", "conservation", "conservation"),
]


def land_use_table(spark) -> DataFrame:
    """The lookup as rows (subtype, class or NULL, category)."""
    return spark.createDataFrame(LAND_USE_MAP, "subtype string, class string, category string")


def lookup_category(df: DataFrame, table: DataFrame, default: str = "urban") -> DataFrame:
    """JOI06: category of (subtype, class), else of the subtype alone, else the default."""
    exact = table.where("class IS NOT NULL").select("subtype", "class", F.col("category").alias("_exact"))
    loose = table.where("class IS NULL").select("subtype", F.col("category").alias("_loose"))
    return (
        df.join(exact, ["subtype", "class"], "left")
        .join(loose, "subtype", "left")
        .withColumn("category", F.coalesce("_exact", "_loose", F.lit(default)))
        .drop("_exact", "_loose")
    )


def land_use_of_parcels(parcels: DataFrame, areas: DataFrame, table: DataFrame, cell: float) -> DataFrame:
    """BAS30: class of the smallest area holding the centre, else of the largest that meets
    the parcel; ties go to the lowest area id.

    ``areas``: id, subtype, class, and a ring or box columns, as ``parcels`` has, too.
    """
    areas = spatial.ringed(areas).select("id", "subtype", "class", "ring")
    areas = areas.withColumn("size", G.area(F.col("ring")))
    keep = ["id", "subtype", "class", "size"]
    hits = overlay.holds(parcels.select("parcel_id", "x", "y"), areas, ["parcel_id"], keep, cell)
    centre = first_per(hits, ["parcel_id"], [F.asc("size"), F.asc("id")])
    rest = spatial.ringed(parcels).select("parcel_id", "ring").join(centre.select("parcel_id"), "parcel_id", "left_anti")
    meets = overlay.meeting(rest, areas, ["parcel_id"], keep, cell)
    vote = first_per(meets, ["parcel_id"], [F.desc("size"), F.asc("id")])
    both = centre.unionByName(vote).drop("size", "id")
    return lookup_category(both, table).select("parcel_id", "subtype", "class", "category")


# Category and sealed share of land-cover classes.
COVER_CATEGORY = {
    "water": [11, 12],
    "urban": [21, 22, 23, 24],
    "natural": [31, 41, 42, 43, 51, 52, 71, 72, 73, 74],
    "agricultural": [81, 82],
    "wetland": [90, 95],
}
SEALED_SHARE = {21: 0.10, 22: 0.30, 23: 0.60, 24: 0.85, 31: 0.50}


def land_cover_stats(parcels: DataFrame, histogram: DataFrame) -> DataFrame:
    """BAS31: majority class (most pixels of the parcel, lowest class on a tie) and the
    mean sealed share; ``histogram``: parcel_id, value, pixels.
    """
    v, n = F.col("value"), F.col("pixels")
    sealed = X.ladder([(v == k, s) for k, s in SEALED_SHARE.items()], 0.0)
    stats = histogram.groupBy("parcel_id").agg(
        F.max_by("value", F.struct(n, -v)).alias("majority"),
        X.ratio(F.sum(n * sealed), F.sum(n)).alias("impervious_fraction"),
    )
    category = X.ladder([(F.col("majority").isin(c), k) for k, c in COVER_CATEGORY.items()], "unknown")
    return parcels.select("parcel_id").join(stats, "parcel_id", "left").select(
        "parcel_id",
        category.alias("land_development_category"),
        X.or_zero("impervious_fraction").alias("impervious_fraction"),
    )


def canopy(parcels: DataFrame, means: DataFrame) -> DataFrame:
    """BAS32: mean canopy percent in [0, 100]; unknown without pixels."""
    return parcels.select("parcel_id").join(means, "parcel_id", "left").select(
        "parcel_id", X.clamp("mean", 0.0, 100.0).alias("tree_canopy_fraction")
    )


# Surfaces of each kind; an unknown surface is paved.
PAVED, UNPAVED = ("paved", "asphalt", "concrete"), ("unpaved", "gravel", "dirt", "earth", "ground")


def surface_class(surface) -> Column:
    s = X.c(surface)
    return X.ladder([(s.isNull() | s.isin(list(PAVED)), "paved"), (s.isin(list(UNPAVED)), "unpaved")], "other")


def road_lengths(parcels: DataFrame, roads: DataFrame, cell: float) -> DataFrame:
    """BAS33: road metres per surface kind inside each parcel, and the paved share."""
    pairs = spatial.lengths_inside(
        roads.select("x1", "y1", "x2", "y2", surface_class("surface").alias("kind")),
        spatial.ringed(parcels).select("parcel_id", "ring"),
        cell,
    )
    kinds = ("paved", "unpaved", "other")
    sums = pairs.groupBy("r.parcel_id").agg(
        *[F.sum(F.when(F.col("l.kind") == k, F.col("length"))).alias(k) for k in kinds],
        F.sum("length").alias("total"),
    )
    acres = G.area(spatial.ring_of(parcels)) / SQM_PER_ACRE
    return parcels.withColumn("parcel_area_gross", acres).join(sums, "parcel_id", "left").select(
        "parcel_id",
        *[X.or_zero(k).alias(f"road_{k}_length_m") for k in kinds],
        X.or_zero("total").alias("road_total_length_m"),
        X.or_zero(X.ratio(X.or_zero("paved"), "total")).alias("road_impervious_fraction"),
        "parcel_area_gross",
    )


DENSITY_RADIUS_M = 402.0
DEFAULT_DENSITY = 12.5


def intersection_density(parcels: DataFrame, points: DataFrame, key: str = "parcel_id") -> DataFrame:
    """BAS08: intersections per square mile within 402 m of the parcel centre.

    One operator for drive, path and highway intersections: they differ in the lines
    that ``operators.spatial.intersections`` is given.
    """
    square_miles = math.pi * DENSITY_RADIUS_M * DENSITY_RADIUS_M / SQM_PER_SQMI
    n = spatial.count_near(parcels.select(key, "x", "y"), points, key, DENSITY_RADIUS_M)
    return n.select(key, (F.col("n") / square_miles).alias("intersection_density"))


def jurisdiction_density(parcels: DataFrame, areas: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """BAS09: intersections per square mile of each jurisdiction, copied to its parcels.

    ``areas``: jurisdiction, and a ring or box columns (one or more rows each); parcels
    without a known jurisdiction get the default.
    """
    areas = spatial.ringed(areas).select("jurisdiction", "ring")
    inside = spatial.inside(points.select("x", "y"), areas, cell)
    hits = inside.groupBy("r.jurisdiction").agg(F.count("*").alias("n"))
    sizes = areas.groupBy("jurisdiction").agg((F.sum(G.area(F.col("ring"))) / SQM_PER_SQMI).alias("square_miles"))
    density = sizes.join(hits, "jurisdiction", "left").select(
        "jurisdiction", F.round(X.or_zero(X.ratio("n", "square_miles")), 2).alias("intersection_density")
    )
    return parcels.select("parcel_id", "jurisdiction").join(density, "jurisdiction", "left").select(
        "parcel_id", F.coalesce("intersection_density", F.lit(DEFAULT_DENSITY)).alias("intersection_density")
    )


def food_index(parcels: DataFrame, shops: DataFrame, radius_m: float = 1000.0) -> DataFrame:
    """ANA19: healthy and other food shops within 1 km and their healthy share * 100.

    ``parcels`` and ``shops`` have x, y in degrees; shops carry is_healthy, is_unhealthy.
    """
    flags = ["is_healthy", "is_unhealthy"]
    one_each = shops.select("x", "y", *[F.when(F.col(f), 1).otherwise(0).cast("bigint").alias(f.replace("is_", "") + "_count") for f in flags])
    counts = spatial.totals_near_degrees(parcels, one_each, "parcel_id", ["healthy_count", "unhealthy_count"], radius_m)
    zero = F.lit(0).cast("bigint")
    both = F.col("healthy_count") + F.col("unhealthy_count")
    return parcels.select("parcel_id").join(counts, "parcel_id", "left").select(
        "parcel_id",
        F.coalesce("healthy_count", zero).alias("healthy_count"),
        F.coalesce("unhealthy_count", zero).alias("unhealthy_count"),
        (X.ratio("healthy_count", both) * 100.0).alias("mrfei"),
    )


# Tags of food shops.
HEALTHY_TAGS = [("shop", "supermarket"), ("shop", "grocery"), ("shop", "farmers_market"), ("shop", "grocer")]
UNHEALTHY_TAGS = [("shop", "convenience"), ("shop", "convenience_store"), ("amenity", "fast_food")]


def food_shops(pois: DataFrame) -> DataFrame:
    """Points of interest (x, y, tags) that sell food, with the two flags."""

    def any_of(tags) -> Column:
        hit = F.lit(False)
        for k, v in tags:
            hit = hit | F.coalesce(F.try_element_at("tags", F.lit(k)) == v, F.lit(False))
        return hit

    flagged = pois.select("x", "y", any_of(HEALTHY_TAGS).alias("is_healthy"), any_of(UNHEALTHY_TAGS).alias("is_unhealthy"))
    return flagged.where("is_healthy OR is_unhealthy")
