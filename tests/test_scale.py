"""Plans and bounds that keep queries within memory and time on large tables."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from landspan.functions import geometry as G
from landspan.operators import overlay as O
from landspan.operators import spatial as S
from landspan.plans import assessor as A
from landspan.plans import ml
from landspan.plans import transport as T
from landspan.session import cut


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def squares(spark, tmp_path):
    """Two small tables of squares whose rows grow when they are dealt to cells."""
    out = []
    for name in ("a", "b"):
        rows = spark.range(40).select(F.col("id").alias(name), *[((F.col("id") % 8) * 10.0 + d).alias(n) for n, d in zip(S.BOX, (0.0, 0.0, 15.0, 15.0))])
        rows.write.parquet(f"{tmp_path}/{name}")
        out.append(S.ringed(spark.read.parquet(f"{tmp_path}/{name}")))
    return out


def test_dealt_rows_are_never_broadcast(squares):
    # their size is not known before they are dealt, so a plan's estimate of it is far too low
    a, b = squares
    pixels = a.select(F.col("xmin").alias("x"), F.col("ymin").alias("y"), F.lit(1).alias("value"))
    for df in (
        O.meeting(a, b, ["a"], ["b"], 10.0), O.overlaps(a, b, ["a"], ["b"], 10.0), O.zones(pixels, b, ["b"], 1.0),
        S.box_join(a, b, 10.0, 2), O.holds(pixels.drop("value"), b, ["x", "y"], ["b"], 10.0),
    ):
        assert "Broadcast" not in plan(df)
    assert O.meeting(a, b, ["a"], ["b"], 10.0).count() == sum(abs(i % 8 - j % 8) <= 1 for i in range(40) for j in range(40))


def test_texts_are_parsed_once(spark):
    df = spark.createDataFrame([("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((9 0, 10 0, 10 1, 9 0)))",)], "wkt string")
    ring = df.select(G.wkt_ring(F.col("wkt")).alias("r"))
    # the parts, their points, and those of a plain line
    assert ring._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") <= 4
    assert ring.select(G.area(F.col("r")).alias("a")).first()["a"] == pytest.approx(15.5)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_nearest_far_dense_and_tied(spark, monkeypatch, shift):
    # without pairs of everything within a growing reach
    monkeypatch.setattr(S, "near", None)
    rnd = random.Random(5)
    left = [(i, rnd.uniform(0, 4000) + shift * (i % 2), rnd.uniform(0, 4000)) for i in range(300)] + [(300, 50.0, 50.0), (301, None, 1.0)]
    right = [(i, float(rnd.randrange(40)) * 100, float(rnd.randrange(3)) * 100) for i in range(400)] + [(400, None, 2.0)]
    got = S.nearest(spark.createDataFrame(left, "k long, x double, y double"), spark.createDataFrame(right, "t long, x double, y double"), "k", "t", 500.0)
    best = {k: min((math.hypot(x - a, y - b), t) for t, a, b in right if a is not None) for k, x, y in left if x is not None}
    want = {k: (round(d, 6), t) for k, (d, t) in best.items()}
    assert {r["k"]: (round(r["distance"], 6), r["t"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_nearest_of_nothing(spark):
    one, none = (spark.createDataFrame(rows, "k long, x double, y double") for rows in ([(1, 2.0, 3.0)], []))
    named = lambda df: df.withColumnRenamed("k", "t")
    assert S.nearest(one, named(none), "k", "t", 5.0).count() == 0 and S.nearest(none, named(one), "k", "t", 5.0).count() == 0


def test_tiles_do_not_multiply_with_the_table(spark):
    zones = spark.range(10_000).withColumnRenamed("id", "parcel_id")
    assert T._tiles(zones, 32).agg(F.max("_n")).first()[0] == T.TILES
    assert T._tiles(zones.limit(64), 32).agg(F.max("_n")).first()[0] == 2
    assert T._tiles(zones, 9_000).agg(F.max("_n")).first()[0] == 2


def test_training_rows_are_joined_once(spark):
    ref = spark.createDataFrame([(1, 2.0), (2, 3.0)], "parcel_id long, du double")
    xw = spark.createDataFrame([(1, 7, 5.0), (2, 7, 6.0)], "parcel_id long, apn long, intersect_area_m2 double")
    parcels = spark.createDataFrame([(7, "A1", "R", None, 2.5)], "apn long, landuse string, zone string, land_development_category string, lot_size_acres double")
    out = ml.training_set(ref, xw, parcels, {}, ["du"])
    assert "Join" not in plan(out)
    row = out.first()
    assert (row["apn"], row["du"], row["lot_size_acres"], row["land_development_category"]) == (7, 3.0, 2.5, "standard")


@pytest.mark.parametrize("dense", [False, True])
def test_totals_near_degrees(spark, dense):
    rnd = random.Random(3)
    spot = lambda: (-122 + rnd.randrange(6) * 0.004, 38 + rnd.randrange(6) * 0.003) if dense else (-122 + rnd.uniform(0, 0.06), 38 + rnd.uniform(0, 0.05))
    left = [(i // 2, *spot()) for i in range(120)] + [(900, None, 38.0), (901, 10.0, 38.0)]
    right = [(*spot(), i % 2, 1) for i in range(300)] + [(None, 38.0, 1, 1)]
    a, b = spark.createDataFrame(left, "k long, x double, y double"), spark.createDataFrame(right, "x double, y double, v long, n long")
    got = S.totals_near_degrees(a, b, "k", ["v", "n"], 1000.0)
    pairs = a.crossJoin(b.withColumnsRenamed({"x": "p", "y": "q"})).where(G.haversine_m(F.col("x"), F.col("y"), F.col("p"), F.col("q")) <= 1000.0)
    want = pairs.groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cells_are_cut_by_their_pairs(spark, monkeypatch):
    # few rows but many pairs in one cell
    monkeypatch.setattr(S, "HOT_PAIRS", 100)
    a, b = (spark.range(n).select(F.col("id").alias("k"), (F.col("id") / 1000).alias("x"), F.lit(0.0).alias("y")) for n in (40, 90))
    sides = [S._spread(S.with_point_box(df), [5.0], True) for df in (a, b)]
    one, two = S._cut_hot(*sides, S.HOT_ROWS)
    parts = ["_pa", "_pb"]
    counts = one.groupBy(*parts).count().join(two.groupBy(*parts).agg(F.count("*").alias("m")), parts)
    assert counts.agg(F.sum(F.col("count") * F.col("m"))).first()[0] == 40 * 90
    assert counts.agg(F.max(F.col("count") * F.col("m"))).first()[0] < 1000
    assert S.near(a, b, 5.0).count() == 40 * 90


def test_neighbours_in_bounded_tasks(spark, monkeypatch):
    # tasks follow the rows, though these are far too few bytes for a second task
    from landspan.operators import knn

    rnd = random.Random(8)
    spots = [(i, 1, rnd.uniform(0, 8), rnd.uniform(0, 8)) for i in range(400)]
    q, p = (spark.createDataFrame(spots[i::2], f"{n} long, g long, u double, v double") for i, n in enumerate("qp"))
    monkeypatch.setattr(knn, "TASK_ROWS", 100)
    got = knn.nearest_k(q, p, ["g"], ["u", "v"], 3, "q", "p", 8.0)
    assert "REPARTITION_BY_NUM" in plan(got) and ", 18)" in plan(got)
    want = {i: [n for _, n in sorted((math.hypot(u - x, v - y), n) for n, _, x, y in spots[1::2])[:3]] for i, _, u, v in spots[::2]}
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["p"])
    assert found == want


def test_shuffles_go_with_what_is_written(spark):
    files = lambda: {f.getName() for f in _disk(spark) if f.getName().startswith("shuffle_")}
    before = files()
    kept = cut(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before
    assert sorted(r["count"] for r in kept.collect()) == [142] * 1 + [143] * 6


def _disk(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_buildings_travel_once(spark, monkeypatch):
    # rings across lines of the grid, a copy, rows of nulls; what is written is only what reaches over a line upwards
    ring = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    point = "array<struct<x:double,y:double>>"
    rows = [("a", None, ring(1.0, 1.0, 2.0, 2.0)), ("a", None, ring(1.0, 1.0, 2.0, 2.0)), (None, 2.0, ring(8.0, 3.0, 4.0, 1.0)), ("c", 3.0, ring(4.0, 7.0, 2.0, 6.0)), ("d", 4.0, None)]
    buildings = spark.createDataFrame(rows, f"kind string, levels double, ring {point}")
    lots = spark.createDataFrame([(1, ring(0.0, 0.0, 10.0, 10.0)), (2, ring(10.0, 0.0, 10.0, 10.0)), (3, ring(0.0, 10.0, 10.0, 10.0))], f"apn long, ring {point}")
    written = []
    monkeypatch.setattr(A, "cut", lambda df: written.append(df.where("ring IS NOT NULL").count()) or cut(df))
    got = A.building_pairs(lots, buildings, 10.0)
    assert written == [1]
    found = sorted((r["apn"], str(r["kind"]), r["levels"], round(r["overlap_ratio"], 9)) for r in got.collect())
    assert found == sorted([(1, "a", None, 1.0), (1, "a", None, 1.0), (1, "None", 2.0, 0.5), (2, "None", 2.0, 0.5), (1, "c", 3.0, 0.5), (3, "c", 3.0, 0.5)], key=lambda r: (r[0], r[1]))


def test_neighbours_of_small_keys_travel_once(spark, monkeypatch):
    from landspan.operators import knn

    rnd = random.Random(4)
    spot = lambda i, g: (i, g, rnd.uniform(0, 8), rnd.uniform(0, 8))
    # few of both, few queries of many points, many of both, a null key, one side only
    q = [spot(i, g) for i, g in enumerate([1] * 20 + [2] * 3 + [3] * 150 + [None, 4])]
    p = [spot(i, g) for i, g in enumerate([1] * 30 + [2] * 300 + [3] * 250 + [None, 5])]
    queries, points = (spark.createDataFrame(rows, f"{n} long, g long, u double, v double") for rows, n in ((q, "q"), (p, "p")))
    even = (F.col("q.q") + F.col("p.p")) % 2 == 0

    def near(of, among):
        found = {}
        got = knn.nearest_k(of, among, ["g"], ["u", "v"], 4, "q", "p", 2.0, even, small=True)
        for r in got.orderBy("q", "rank").collect():
            found.setdefault(r["q"], []).append(r["p"])
        return got, found

    want = {}
    for i, g, u, v in q:
        hits = sorted((math.hypot(u - x, v - y), n) for n, h, x, y in p if g is not None and h == g and abs(u - x) <= 2 and abs(v - y) <= 2 and (i + n) % 2 == 0)
        want |= {i: [n for _, n in hits[:4]]} if hits else {}
    small = queries.where("g < 3"), points.where("g < 3")
    assert "Generate" not in plan(knn.nearest_k(*small, ["g"], ["u", "v"], 4, "q", "p", 2.0, small=True))  # no copies for neighbouring cells
    for few in (0, 40, 96, 10_000):  # the pyramid alone, both, all pairs alone
        monkeypatch.setattr(knn, "FEW", few)
        assert near(queries, points)[1] == want
    monkeypatch.setattr(knn, "KEY_PAIRS", 100)  # keys in parts
    got, found = near(queries, points)
    assert found == want and "_part" in plan(got)


@pytest.mark.parametrize("few", [0, 96])
def test_imputed_from_the_county(spark, monkeypatch, few):
    # no block group or tract in common: only what is within 5 km counts, however the sides meet
    from landspan.operators import knn

    monkeypatch.setattr(knn, "FEW", few)
    rnd = random.Random(6)
    lots = [(i, "urban", rnd.uniform(0.1, 0.9), rnd.randrange(1, 5), rnd.uniform(0.1, 2), rnd.uniform(-9000, 9000), rnd.uniform(-9000, 9000)) for i in range(150)]
    stats = spark.createDataFrame(lots, "apn long, land_development_category string, footprint_ratio double, building_count long, lot_size_acres double, x double, y double")
    zones = spark.createDataFrame([(i, 2020, f"g{i}", f"t{i}") for i in range(150)], "apn long, data_year int, block_group_geoid string, tract_geoid string")
    sold = spark.createDataFrame([(i, "House", 1 + i, 10.0 * i, 20.0 * i) for i in range(120)], "apn long, property_type string, units long, living_area double, building_sf double")
    imputed = A.impute_from_similar(stats, zones, A.sales_features(stats, zones, sold))
    got = imputed.collect()
    assert imputed.select("apn", "imputed_units").count() == len(imputed.select("apn", "imputed_units").collect()) == len(got)
    sigma = [statistics.pstdev(r[c] for r in lots[:120]) for c in (2, 3, 4)]
    want = {}
    for u in lots[120:]:
        z = lambda k: [(u[c] - k[c]) / s for c, s in zip((2, 3, 4), sigma)]
        near = sorted((math.sqrt(sum(d * d for d in z(k))), k[0]) for k in lots[:120] if math.hypot(u[5] - k[5], u[6] - k[6]) <= 5000 and max(map(abs, z(k))) <= 3)
        want |= {u[0]: statistics.median(10.0 * k for _, k in near[:5])} if near else {}
    assert {r["apn"]: r["imputed_living_sqft"] for r in got} == want and {r["imputed_from_tier"] for r in got} == {3}
