"""Trips between places: gravity model over an OD table or over all places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators import spatial
from landspan.session import cut

MIN_DISTANCE = 1e-10


def attraction(emp, du, emp_weight: float = 1.0, du_weight: float = 0.5):
    return F.greatest(X.or_zero(emp) * emp_weight + X.or_zero(du) * du_weight, F.lit(0.0))


def _result(zones: DataFrame, by_origin: DataFrame, by_dest: DataFrame) -> DataFrame:
    """Per-place results from origin sums (pull, own_pull, pull_km) and inbound trips."""
    has_pull = X.positive("pull")
    trips = F.col("trips")
    own = F.when(has_pull, trips * F.col("own_pull") / F.col("pull")).otherwise(trips)
    out = F.when(has_pull, trips * (F.col("pull") - F.col("own_pull")) / F.col("pull")).otherwise(0.0)
    km = F.when(has_pull, trips * F.col("pull_km") / F.col("pull")).otherwise(0.0)
    return (
        zones.join(by_origin, "parcel_id", "left")
        .join(by_dest, "parcel_id", "left")
        .select(
            "parcel_id",
            out.alias("trips_outbound"),
            X.or_zero("inbound").alias("trips_inbound"),
            own.alias("trips_internal"),
            F.when(out > 0, km / out).otherwise(0.0).alias("avg_trip_length_km"),
        )
    )


def pairs_within(places: DataFrame, reach_km: float) -> DataFrame:
    """JOI20: the OD table (origin, dest, network_distance_km) of all places at most ``reach_km`` apart, each with itself too.

    A self join on grid cells as wide as the reach, so the work follows the pairs that
    there are and not the square of the places.  ``places``: parcel_id, x, y in km.
    """
    near = spatial.near(places.select("parcel_id", "x", "y"), places.select("parcel_id", "x", "y"), reach_km)
    return near.select(F.col("l.parcel_id").alias("origin"), F.col("r.parcel_id").alias("dest"), F.col("distance").alias("network_distance_km"))


def gravity(od: DataFrame, zones: DataFrame, decay: float = 2.0) -> DataFrame:
    """TRN01 over an OD table (origin, dest, network_distance_km).

    ``zones`` holds parcel_id, trips, emp, du.  Outbound trips and lengths need
    only sums per origin (partial aggregation, so a hot origin is summed in every
    map task); the pairs are joined a second time only for the inbound trips, and
    the per-origin factor is one number per place.
    """
    # four narrow columns, read four times: written once instead of rebuilt each time
    zones = cut(zones.select("parcel_id", X.or_zero("trips").alias("trips"), "emp", "du"))
    pull_of = zones.select(
        F.col("parcel_id").alias("dest"), attraction("emp", "du").alias("attraction")
    )
    km = F.col("network_distance_km")
    pairs = od.join(pull_of, "dest").select(
        "origin",
        "dest",
        km,
        F.when(km > MIN_DISTANCE, F.col("attraction") * F.pow(km, F.lit(-decay)))
        .otherwise(0.0)
        .alias("pull"),
    )
    same = F.col("origin") == F.col("dest")
    by_origin = pairs.groupBy(F.col("origin").alias("parcel_id")).agg(
        F.sum("pull").alias("pull"),
        F.sum(F.when(same, F.col("pull")).otherwise(0.0)).alias("own_pull"),
        F.sum(F.col("pull") * km).alias("pull_km"),
    )
    factor = (
        zones.join(by_origin, "parcel_id")
        .where("pull > 0")
        .select(F.col("parcel_id").alias("origin"), (F.col("trips") / F.col("pull")).alias("per_pull"))
    )
    by_dest = (
        pairs.where(~same)
        .join(factor, "origin")
        .groupBy(F.col("dest").alias("parcel_id"))
        .agg(F.sum(F.col("pull") * F.col("per_pull")).alias("inbound"))
    )
    return _result(zones, by_origin, by_dest)


# --- all places against all places (TRN02) -------------------------------------

TILE = 1024
#: Tiles grow with the table, so that about so many are enough, up to so many rows each.
TILES, LARGEST_TILE = 64, 4096
#: Pairs that a kernel works on at a time.
PAIRS = 1 << 19


def _tiles(zones: DataFrame, tile: int) -> DataFrame:
    """Zones in tiles of ``tile`` rows or more, numbered by a hash of the id."""
    n = F.count("*")
    rows = F.least(F.greatest(n / TILES, F.lit(tile)), F.lit(max(tile, LARGEST_TILE)))
    n_tiles = zones.agg(F.greatest(F.ceil(n / rows), F.lit(1)).cast("int").alias("n")).scalar()
    return zones.withColumn("_n", n_tiles).withColumn(
        "tile", F.pmod(F.xxhash64("parcel_id"), F.col("_n").cast("bigint")).cast("int")
    )


def _pair_sums(left: DataFrame, right: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(left rows, right rows)`` on every pair of tiles.

    Every tile is sent once to each opposite tile, and a task holds two tiles (a
    few thousand rows) as numpy arrays; what leaves it are sums per row of the left
    tile, so pairs of places are never written as rows.
    """
    others = F.sequence(F.lit(0), F.col("_n") - 1)
    right = right.select([F.col(c).alias(c) for c in right.columns])  # a side of its own
    a = left.withColumn("other", F.explode(others)).withColumnRenamed("tile", "mine")
    b = right.withColumn("mine", F.explode(others)).withColumnRenamed("tile", "other")
    return (
        a.groupBy("mine", "other")
        .cogroup(b.groupBy("mine", "other"))
        .applyInPandas(kernel, schema)
    )


def gravity_all(zones: DataFrame, decay: float = 2.0, tile: int = TILE) -> DataFrame:
    """TRN02: the gravity model over straight-line distances of all places.

    ``zones`` holds parcel_id, x, y, trips, emp, du.  The work is n squared by
    definition; the data moved is n times the tiles.
    """
    zones = zones.select(
        "parcel_id", "x", "y", X.or_zero("trips").alias("trips"), "emp", "du",
        attraction("emp", "du").alias("attraction"),
    )
    tiled = _tiles(zones, tile)

    def distances(mine, others):
        """Rows of ``mine`` a few at a time, their distances to ``others`` and these to the power of -decay."""
        import numpy as np

        x, y = others.x.to_numpy()[None, :], others.y.to_numpy()[None, :]
        step = max(1, PAIRS // len(others))
        for i in range(0, len(mine), step):
            at = slice(i, i + step)
            dx, dy = mine.x.to_numpy()[at, None] - x, mine.y.to_numpy()[at, None] - y
            square = dx * dx + dy * dy
            d = np.sqrt(square)
            with np.errstate(divide="ignore"):
                pull = 1.0 / square if decay == 2.0 else d ** (-decay)
            yield at, d, np.where(d > MIN_DISTANCE, pull, 0.0)

    def from_origin(mine, others):
        import numpy as np
        import pandas as pd

        if mine.empty or others.empty:
            return pd.DataFrame({"parcel_id": [], "pull": [], "pull_km": []})
        pulls, kms = np.empty(len(mine)), np.empty(len(mine))
        for at, d, pull in distances(mine, others):
            pull *= others.attraction.to_numpy()
            pulls[at], kms[at] = pull.sum(axis=1), (pull * d).sum(axis=1)
        return pd.DataFrame({"parcel_id": mine.parcel_id, "pull": pulls, "pull_km": kms})

    cols = ["parcel_id", "x", "y", "attraction", "tile", "_n"]
    sums = _pair_sums(
        tiled.select(cols), tiled.select(cols), from_origin,
        "parcel_id bigint, pull double, pull_km double",
    )
    by_origin = sums.groupBy("parcel_id").agg(
        F.sum("pull").alias("pull"), F.lit(0.0).alias("own_pull"), F.sum("pull_km").alias("pull_km")
    )
    factor = tiled.join(by_origin, "parcel_id").select(
        "parcel_id", "x", "y", "tile", "_n",
        F.when(X.positive("pull"), F.col("trips") / F.col("pull")).otherwise(0.0).alias("per_pull"),
    )

    def to_dest(mine, others):
        import numpy as np
        import pandas as pd

        if mine.empty or others.empty:
            return pd.DataFrame({"parcel_id": [], "inbound": []})
        got = np.empty(len(mine))
        for at, _, pull in distances(mine, others):
            got[at] = pull @ others.per_pull.to_numpy()
        return pd.DataFrame({"parcel_id": mine.parcel_id, "inbound": got * mine.attraction.to_numpy()})

    inbound = _pair_sums(tiled.select(cols), factor, to_dest, "parcel_id bigint, inbound double")
    by_dest = inbound.groupBy("parcel_id").agg(F.sum("inbound").alias("inbound"))
    return _result(zones, by_origin, by_dest)
