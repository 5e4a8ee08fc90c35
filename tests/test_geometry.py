import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landspan.functions import geometry as G
from landspan.operators import spatial as S


def ring(pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def one(spark, expr, **rings):
    schema = ", ".join(f"{n} {G.RING}" for n in rings)
    return spark.createDataFrame([tuple(ring(p) for p in rings.values())], schema).select(expr.alias("v")).first()["v"]


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
L_SHAPE = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]


def test_area_and_centroid(spark):
    assert one(spark, G.area(F.col("r")), r=SQUARE) == 16
    assert one(spark, G.area(F.col("r")), r=SQUARE[::-1]) == 16
    assert one(spark, G.area(F.col("r")), r=L_SHAPE) == 7
    assert one(spark, G.area(F.col("r")), r=[(0, 0), (1, 1)]) == 0
    c = one(spark, G.centroid(F.col("r")), r=L_SHAPE)
    assert math.isclose(c["x"], (4 * 2 + 3 * 0.5) / 7) and math.isclose(c["x"], c["y"])


def test_clip_of_a_concave_ring(spark):
    window = [(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)]
    # two arms of width one half inside the window
    want = 2.5 * 0.5 + 0.5 * 2.0
    assert math.isclose(one(spark, G.overlap_area(F.col("r"), F.col("w")), r=L_SHAPE, w=window), want)
    outside = [(5, 5), (6, 5), (6, 6), (5, 6)]
    assert one(spark, G.overlap_area(F.col("r"), F.col("w")), r=L_SHAPE, w=outside) == 0


def test_point_in_concave_ring(spark):
    def at(x, y):
        return one(spark, G.point_in_ring(F.lit(x), F.lit(y), F.col("r")), r=L_SHAPE)

    assert at(0.5, 3.0) and at(3.0, 0.5)
    assert not at(3.0, 3.0) and not at(-1.0, 0.5)


def test_segment_inside(spark):
    def length(x1, y1, x2, y2):
        seg = G.segment_length_in(G.point(x1, y1), G.point(x2, y2), F.col("r"))
        return one(spark, seg, r=SQUARE)

    assert math.isclose(length(-1, 2, 6, 2), 4)
    assert math.isclose(length(1, 1, 2, 2), math.sqrt(2))
    assert math.isclose(length(-1, -1, 5, 5), 4 * math.sqrt(2))
    assert length(5, 0, 5, 4) == 0
    assert length(-2, 5, 5, 5) == 0


def test_repair_drops_degenerate_rings(spark):
    assert one(spark, G.clean_ring(F.col("r")), r=[(0, 0), (0, 0), (1, 0)]) is None
    assert len(one(spark, G.clean_ring(F.col("r")), r=[(0, 0), (0, 0), (2, 0), (2, 2)])) == 3


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-8, 8), st.integers(-8, 8)), min_size=1, max_size=14))
def test_hull_holds_all_points(spark, pts):
    hull = one(spark, G.convex_hull(F.col("r")), r=pts)
    corners = [(p["x"], p["y"]) for p in hull]
    assert set(corners) <= {(float(x), float(y)) for x, y in pts}
    n = len(corners)
    if n < 3:
        return
    for x, y in pts:
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            assert (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0


def test_projections_against_known_values(spark):
    row = spark.range(1).select(
        G.project(F.lit(-120.0), F.lit(0.0), 3310).alias("a"),
        G.project(F.lit(-96.0), F.lit(23.0), 5070).alias("b"),
        G.project(F.lit(180.0), F.lit(0.0), 6933).alias("c"),
        G.project(F.lit(180.0), F.lit(0.0), 3857).alias("d"),
    ).first()
    # projection origins, and the edge of the cylindrical maps
    assert abs(row["a"]["x"]) < 1e-6 and abs(row["a"]["y"] + 4000000) < 1e-3
    assert abs(row["b"]["x"]) < 1e-6 and abs(row["b"]["y"]) < 1e-3
    assert abs(row["c"]["x"] - 17367530.445) < 0.1 and abs(row["c"]["y"]) < 1e-6
    assert abs(row["d"]["x"] - 20037508.343) < 0.01


def test_equal_area_projection_keeps_area(spark):
    box = [(-121.0, 38.0), (-120.99, 38.0), (-120.99, 38.01), (-121.0, 38.01)]
    areas = {c: one(spark, G.area(G.project_ring(F.col("r"), c)), r=box) for c in (3310, 5070, 6933)}
    assert max(areas.values()) / min(areas.values()) - 1 < 1e-4


# --- joins -----------------------------------------------------------------------------


def boxes(spark, rng, n, most, name):
    x, y = rng.uniform(0, 100, n), rng.uniform(0, 100, n)
    w, h = rng.uniform(0, most, n), rng.uniform(0, most, n)
    data = [(i, float(x[i]), float(y[i]), float(x[i] + w[i]), float(y[i] + h[i])) for i in range(n)]
    return data, spark.createDataFrame(data, f"{name} int, xmin double, ymin double, xmax double, ymax double")


def meets(a, b):
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


def test_box_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    small, left = boxes(spark, rng, 150, 6, "a")
    # large boxes use the coarse level
    large, right = boxes(spark, rng, 60, 70, "b")
    want = sorted((p[0], q[0]) for p in small for q in large if meets(p, q))
    for hot_rows in (5, S.HOT_ROWS):
        for levels in (1, 2):
            got = S.box_join(left, right, 2.0, levels, hot_rows=hot_rows).select("l.a", "r.b").collect()
            assert sorted((r["a"], r["b"]) for r in got) == want


def test_hot_cell_is_split_and_complete(spark):
    points = spark.range(3000).select(F.col("id"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"))
    area = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "b int, xmin double, ymin double, xmax double, ymax double")
    joined = S.box_join(S.with_point_box(points), area, 10.0, hot_rows=500, points=True)
    assert joined.count() == 3000
    assert joined.select("l._pa").distinct().count() > 3


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 500, (60, 2)), rng.uniform(300, 320, (15, 2))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "k int, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "t int, x double, y double")
    got = {r["k"]: r["t"] for r in S.nearest(left, right, "k", "t", 3.0).collect()}
    want = {i: int(np.argmin(np.hypot(*(b - p).T))) for i, p in enumerate(a)}
    assert got == want


def test_union_overlap_counts_shared_area_once(spark):
    target = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "p int, xmin double, ymin double, xmax double, ymax double")
    cover = spark.createDataFrame(
        [(-5.0, -5.0, 5.0, 5.0), (3.0, 3.0, 7.0, 7.0), (3.0, 3.0, 7.0, 7.0), (4.0, 0.0, 6.0, 1.0)],
        "xmin double, ymin double, xmax double, ymax double",
    )
    # 25 + 16 - 4 + the unit square right of the first box
    assert S.union_overlap(target, cover, "p", 4.0).first()["covered"] == 38


def test_intersections_snap_and_count(spark):
    lines = spark.createDataFrame(
        [(0.0, 0.0, 100.0, 0.0), (101.0, 2.0, 200.0, 0.0), (99.0, -3.0, 100.0, 90.0)], "x1 double, y1 double, x2 double, y2 double"
    )
    got = S.intersections(lines).collect()
    assert [(r["x"], r["y"], r["degree"]) for r in got] == [(100.0, 0.0, 3)]


FRAME = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 8, 8 8, 8 2, 2 2))"
PARTS = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 5 9, 9 9, 9 5, 5 5)))"
ELL = "POLYGON ((0 0, 10 0, 10 4, 4 4, 4 10, 0 10, 0 0))"


def test_all_rings_are_read(spark):
    window, small = [(1, 1), (9, 1), (9, 9), (1, 9)], [(3, 3), (5, 3), (5, 5), (3, 5)]
    df = spark.createDataFrame([(FRAME,), (PARTS,), (ELL,)], "wkt string").select("wkt", G.wkt_ring(F.col("wkt")).alias("r"))
    ell = G.wkt_ring(F.lit(ELL))
    got = {
        r["wkt"]: tuple(round(v, 6) if isinstance(v, float) else v for v in r[1:])
        for r in df.select(
            "wkt",
            G.area(F.col("r")),
            G.point_in_ring(F.lit(5.0), F.lit(5.5), F.col("r")),
            G.overlap_area(F.col("r"), G.ring_literal(window)),
            G.overlap_area(F.col("r"), ell),
            G.overlap_area(G.ring_literal(small), F.col("r")),
            G.rings_meet(F.col("r"), G.ring_literal(small)),
            G.segment_length_in(G.point(-1, 1.5), G.point(11, 1.5), F.col("r")),
        ).collect()
    }
    assert got[FRAME] == (64.0, False, 28.0, 44.0, 0.0, False, 10.0)
    assert got[PARTS] == (17.0, True, 16.0, 1.0, 0.0, True, 0.0)
    assert got[ELL] == (64.0, False, 39.0, 64.0, 3.0, True, 10.0)


def test_hot_cells_on_both_sides(spark):
    from landspan.operators import spatial

    left = spark.range(60).selectExpr("id AS a", "id % 5 * 1e0 AS x", "1e0 AS y")
    right = spark.range(50).selectExpr("id AS b", "0e0 AS xmin", "0e0 AS ymin", "id % 4 + 0.5e0 AS xmax", "2e0 AS ymax")
    want = spatial.box_join(spatial.with_point_box(left), right, 10.0, points=True).select("a", "b")
    got = spatial.box_join(spatial.with_point_box(left), right, 10.0, points=True, hot_rows=7).select("a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 500
