"""Prepared polygons against closed forms, rasters and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landspan.functions import geometry as G
from landspan.operators import overlay as O


def star(rng, turn, cx, cy, r, k):
    """A star-shaped ring of k corners; odd ones are walked the other way."""
    a, d = np.sort(rng.uniform(0, 2 * np.pi, k)), rng.uniform(0.3, 1, k) * r
    p = [(float(cx + x), float(cy + y)) for x, y in zip(d * np.cos(a), d * np.sin(a))]
    return p[::-1] if turn else p


def stars(spark, seed, n, most, k, name):
    rng = np.random.default_rng(seed)
    rings = {i: star(rng, i % 2, *rng.uniform(0, 100, 2), rng.uniform(1, most), k) for i in range(n)}
    rows = [(i, [{"x": x, "y": y} for x, y in r]) for i, r in rings.items()]
    return rings, spark.createDataFrame(rows, f"{name} int, ring {G.RING}")


def within(x, y, ring):
    hit = np.zeros(np.shape(x), bool)
    for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
        if py != qy:
            hit ^= ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / (qy - py) + px)
    return hit


@pytest.fixture(scope="module")
def sides(spark):
    return stars(spark, 4, 30, 12, 9, "a"), stars(spark, 5, 20, 40, 15, "b")


@pytest.fixture(scope="module")
def pairs(sides):
    (_, a), (_, b) = sides
    l, r = F.col("l.ring"), F.col("r.ring")
    return a.alias("l").crossJoin(b.alias("r")).select("a", "b", G.overlap_area(l, r).alias("area"), G.rings_meet(l, r).alias("meet")).collect()


def test_closed_form_against_clipping(sides):
    (_, a), _ = sides
    box = G.box(*map(F.lit, (30.0, 20.0, 70.0, 90.0)))
    for r in a.select(G.overlap_area(F.col("ring"), G.box_ring(box)).alias("x"), F.abs(G.signed_area(G.clip_box(F.col("ring"), box))).alias("y")).collect():
        assert abs(r["x"] - r["y"]) < 1e-9


@pytest.mark.parametrize("cell", [3.0, 500.0])
def test_overlaps_do_not_depend_on_the_cell(sides, pairs, cell):
    (_, a), (_, b) = sides
    want = {(r["a"], r["b"]): r["area"] for r in pairs if r["area"] > 1e-6}
    got = {(r["a"], r["b"]): r["overlap"] for r in O.overlaps(a, b, ["a"], ["b"], cell).collect()}
    assert set(got) == set(want) and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("cell", [12.0])
def test_meeting(sides, pairs, cell):
    (_, a), (_, b) = sides
    got = [(r["a"], r["b"]) for r in O.meeting(a, b, ["a"], ["b"], cell).collect()]
    assert sorted(got) == sorted((r["a"], r["b"]) for r in pairs if r["meet"])


def ring_frame(spark, name, *rows):
    return spark.createDataFrame([(i, w) for i, w in rows], f"{name} int, wkt string").select(name, G.wkt_ring(F.col("wkt")).alias("ring"))


def square(x, y, s):
    return f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"


FRAME = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 8, 8 8, 8 2, 2 2))"
PARTS = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((20 20, 20 24, 24 24, 24 20, 20 20)))"


def test_holes_parts_and_touching_borders(spark):
    left = ring_frame(spark, "a", (1, FRAME), (2, PARTS), (3, square(10, 0, 5)), (4, None), (5, "POINT (1 1)"), (6, "POLYGON ((0 0, 1 1, 2 2, 0 0))"))
    right = ring_frame(spark, "b", (1, square(3, 3, 4)), (2, square(21, 21, 1)), (3, square(-5, -5, 5)), (4, square(15, 5, 1)), (5, square(1, 1, 8)))
    for cell in (1.0, 7.0):
        meets = {(r["a"], r["b"]) for r in O.meeting(left, right, ["a"], ["b"], cell).collect() if r["a"] < 5}
        # in the hole nothing is shared; the second part holds a square; corners touch
        assert meets == {(1, 3), (1, 5), (2, 2), (2, 3), (2, 5), (3, 4)}
        area = {(r["a"], r["b"]): round(r["overlap"], 9) for r in O.overlaps(left, right, ["a"], ["b"], cell).collect()}
        assert area == {(1, 5): 28.0, (2, 2): 1.0}


def test_union_counts_shared_area_once(spark):
    target = ring_frame(spark, "p", (1, square(0, 0, 10)), (2, square(50, 50, 1)))
    cover = ring_frame(spark, "c", (1, square(-5, -5, 10)), (2, square(3, 3, 4)), (3, square(3, 3, 4)), (4, "POLYGON ((4 0, 6 0, 6 1, 4 1, 4 0))"))
    for cell in (4.0, 64.0):
        # 25 + 16 - 4 + the unit square right of the first
        assert [(r["p"], round(r["covered"], 9)) for r in O.covered(target, cover, ["p"], cell).collect()] == [(1, 38.0)]
        assert round(O.union_area(cover, cell).first()["area"], 9) == 100 + 16 - 4 + 1
    assert O.covered(target, cover.limit(0), ["p"], 4.0).count() == 0
    assert O.union_area(cover.limit(0), 4.0).first()["area"] == 0


def test_union_of_crossing_shapes_against_a_raster(sides):
    (rings, a), (others, b) = sides
    got = [{r["a"]: r["covered"] for r in O.covered(a, b, ["a"], c).collect()} for c in (9.0, 40.0)]
    assert set(got[0]) == set(got[1]) and all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])
    n = 300
    for k in range(8):
        x, y = (np.array(v) for v in zip(*rings[k]))
        gx, gy = np.meshgrid(x.min() + (np.arange(n) + 0.5) * np.ptp(x) / n, y.min() + (np.arange(n) + 0.5) * np.ptp(y) / n)
        union = np.any([within(gx, gy, r) for r in others.values()], axis=0)
        share = (within(gx, gy, rings[k]) & union).mean()
        assert abs(share * np.ptp(x) * np.ptp(y) - got[0].get(k, 0)) < 0.003 * np.ptp(x) * np.ptp(y)


def test_zones_and_points_against_ray_casts(spark, sides):
    _, (rings, b) = sides
    pixels = spark.range(10000).selectExpr("id % 100 + 0.5e0 AS x", "floor(id / 100) + 0.5e0 AS y", "id")
    gx, gy = np.meshgrid(np.arange(100) + 0.5, np.arange(100) + 0.5)
    want = {(int(j * 100 + i), k) for k, r in rings.items() for j, i in zip(*np.nonzero(within(gx, gy, r)))}
    assert {(r["id"], r["b"]) for r in O.zones(pixels, b, ["b"], 1.0).select("id", "b").collect()} == want
    assert {(r["id"], r["b"]) for r in O.holds(pixels, b, ["id"], ["b"], 10.0).collect()} == want
    # borders are half open, and holes hold nothing
    frame = ring_frame(spark, "b", (1, "POLYGON ((0.5 0.5, 9.5 0.5, 9.5 9.5, 0.5 9.5, 0.5 0.5), (2.5 2.5, 2.5 7.5, 7.5 7.5, 7.5 2.5, 2.5 2.5))"))
    assert O.zones(pixels, frame, ["b"], 1.0).count() == O.holds(pixels, frame, ["id"], ["b"], 3.0).count() == 81 - 25


def test_zones_make_no_point_test(spark, sides):
    _, (_, b) = sides
    pixels = spark.range(100).selectExpr("id % 10 + 0.5e0 AS x", "floor(id / 10) + 0.5e0 AS y", "id")
    plan = O.zones(pixels, b, ["b"], 1.0)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert joined and not any("lambda" in line for line in joined)


def test_length_along_borders_and_through_holes(spark):
    df = ring_frame(spark, "a", (1, FRAME))
    ell = G.wkt_ring(F.lit("POLYGON ((0 0, 10 0, 10 4, 4 4, 4 10, 0 10, 0 0))"))
    r = F.col("ring")
    got = df.select(
        G.segment_length_in(G.point(-1, 5), G.point(11, 5), r),  # through the hole
        G.segment_length_in(G.point(0, 0), G.point(10, 0), r),  # lower border: inside
        G.segment_length_in(G.point(0, 10), G.point(10, 10), r),  # upper border: the next one's
        G.segment_length_in(G.point(0, -5), G.point(0, 5), r),  # left border
        G.segment_length_in(G.point(10, 0), G.point(10, 10), r),  # right border
        G.segment_length_in(G.point(0, 0), G.point(10, 10), ell),  # along what a fan of triangles would share
        G.segment_length_in(G.point(0, 0), G.point(4, 4), ell),
        G.segment_length_in(G.point(3, 3), G.point(3, 3), ell),
    ).first()
    assert [round(v, 9) for v in got] == [4.0, 10.0, 0.0, 5.0, 0.0, round(4 * 2**0.5, 9), round(4 * 2**0.5, 9), 0.0]


def test_dissolve_walks_rings(spark):
    # 4 x 4 tiles without one inside, another part elsewhere, and two tiles that touch in a corner
    tiles = [square(4 * i, 4 * j, 4) for i in range(4) for j in range(4) if (i, j) != (1, 2)] + [square(100, 0, 4)]
    df = ring_frame(spark, "a", *((1, w) for w in tiles), (2, square(0, 0, 1)), (2, square(1, 1, 1)), (3, FRAME), (None, square(0, 0, 2)))
    got = {r["a"]: (r["area"], r["perimeter"], r["rings"]) for r in O.dissolve(df, ["a"]).collect()}
    assert got == {1: (15 * 16 + 16, 64 + 16 + 16, 3), 2: (2, 8, 2), 3: (64, 64, 2), None: (4, 8, 1)}
    # tiles walked the other way cancel as well
    turned = df.withColumn("ring", F.when(F.col("ring")[0]["x"] % 8 == 0, F.reverse("ring")).otherwise(F.col("ring")))
    assert {r["a"]: (r["area"], r["rings"]) for r in O.dissolve(turned.where("a < 3"), ["a"]).collect()} == {1: (256, 3), 2: (2, 2)}
