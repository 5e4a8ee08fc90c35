"""Spatial joins and geometry (JOI10, JOI14-19, GEO01-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.functions import geometry as G
from landspan.operators import overlay as O
from landspan.operators import spatial as S
from landspan.operators.ranking import first_per
from landspan.params import QUARTER_MILE_M, SQM_PER_ACRE
from landspan.queries.binding import TABLES, Tables, ctes, square
from landspan.queries.registry import query, rd, rds, rounded

BOX = list(S.BOX)
MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"
OVERLAP = "(greatest(0e0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0e0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)))"
HIT = "a.x >= b.xmin AND a.x < b.xmax AND a.y >= b.ymin AND a.y < b.ymax"


def boxes(df, *keys):
    return df.select(*keys, *BOX)


@query(
    "JOI14_spatial_intersects",
    ctes("parcels", "blocks")
    + f"SELECT b.geoid, count(*) AS parcels, {rds(f'sum({OVERLAP})')} AS overlap FROM parcels a JOIN blocks b ON {MEET} GROUP BY b.geoid",
)
def intersects(t: Tables):
    pairs = S.box_join(boxes(t.parcels, "parcel_id"), boxes(t.blocks, "geoid"), 200.0, 2)
    overlap = G.box_overlap_area(S.box_of("l"), S.box_of("r"))
    return pairs.groupBy(F.col("r.geoid").alias("geoid")).agg(
        F.count("*").alias("parcels"), rd(F.sum(overlap)).alias("overlap")
    )


# Blocks with a hole in the middle: half as wide and as high.
_IN = "(b.xmax - b.xmin) / 4e0", "(b.ymax - b.ymin) / 4e0"
HOLE = f"least(a.xmax, b.xmax - {_IN[0]}) - greatest(a.xmin, b.xmin + {_IN[0]})", f"least(a.ymax, b.ymax - {_IN[1]}) - greatest(a.ymin, b.ymin + {_IN[1]})"
HOLE_OVERLAP = f"(greatest(0e0, {HOLE[0]}) * greatest(0e0, {HOLE[1]}))"
WITHIN_HOLE = f"(a.xmin > b.xmin + {_IN[0]} AND a.xmax < b.xmax - {_IN[0]} AND a.ymin > b.ymin + {_IN[1]} AND a.ymax < b.ymax - {_IN[1]})"


def frames(t: Tables):
    """geoid, box and ring of every block around its hole."""
    return framed(boxes(t.blocks, "geoid"))


def ell(df):
    """``df`` (box columns) with a ring that lacks the box's upper right quarter."""
    x, y = (F.col("xmin") + F.col("xmax")) / 2.0, (F.col("ymin") + F.col("ymax")) / 2.0
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", y), (x, y), (x, "ymax"), ("xmin", "ymax")]
    as_column = lambda v: F.col(v) if isinstance(v, str) else v
    return df.withColumn("ring", F.array(*[G.point(as_column(a), as_column(b)) for a, b in corners]))


def framed(df):
    """``df`` (box columns) with a ring around a hole half as wide and as high."""
    w, h = (F.col("xmax") - F.col("xmin")) / 4.0, (F.col("ymax") - F.col("ymin")) / 4.0
    hole = G.box(F.col("xmin") + w, F.col("ymin") + h, F.col("xmax") - w, F.col("ymax") - h)
    ring = lambda b, shell: F.struct(G.box_ring(b).alias("ring"), F.lit(shell).alias("shell"))
    return df.withColumn("ring", G.join_rings(F.array(ring(F.struct(*BOX), True), ring(hole, False))))


def middle(s: str) -> tuple[str, str]:
    return f"(({s}.xmin + {s}.xmax) / 2e0)", f"(({s}.ymin + {s}.ymax) / 2e0)"


def part_overlap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """SQL: area that two boxes (xmin, ymin, xmax, ymax) share."""
    return f"(greatest(0e0, least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]})) * greatest(0e0, least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]})))"


def ell_overlap(s: str, b: str) -> str:
    """SQL: area that the L of ``s`` shares with the box of ``b``: its lower half and its upper left quarter."""
    x, y = middle(s)
    of = (f"{b}.xmin", f"{b}.ymin", f"{b}.xmax", f"{b}.ymax")
    return f"({part_overlap((f'{s}.xmin', f'{s}.ymin', f'{s}.xmax', y), of)} + {part_overlap((f'{s}.xmin', y, x, f'{s}.ymax'), of)})"


def in_ell(p: str, s: str) -> str:
    """SQL: the point of ``p`` lies in the L of ``s``."""
    x, y = middle(s)
    return f"({p}.x >= {s}.xmin AND {p}.x < {s}.xmax AND {p}.y >= {s}.ymin AND {p}.y < {s}.ymax AND ({p}.x < {x} OR {p}.y < {y}))"


def ell_meets(s: str, b: str) -> str:
    """SQL: the L of ``s`` and the box of ``b`` share a point."""
    x, y = middle(s)
    return f"({s}.xmin <= {b}.xmax AND {b}.xmin <= {s}.xmax AND {s}.ymin <= {b}.ymax AND {b}.ymin <= {s}.ymax AND ({b}.xmin <= {x} OR {b}.ymin <= {y}))"


#: SQL: the point of ``a`` lies in the frame of ``b``.
IN_FRAME = f"({HIT} AND NOT (a.x >= b.xmin + (b.xmax - b.xmin) / 4e0 AND a.x < b.xmax - (b.xmax - b.xmin) / 4e0 AND a.y >= b.ymin + (b.ymax - b.ymin) / 4e0 AND a.y < b.ymax - (b.ymax - b.ymin) / 4e0))"


def lot_rings(t: Tables):
    return t.parcels.select("parcel_id", *BOX, G.box_ring(F.struct(*BOX)).alias("ring"))


@query(
    "JOI14_polygons_meet",
    ctes("parcels", "blocks")
    + f"SELECT b.geoid, count(*) AS parcels FROM parcels a JOIN blocks b ON {MEET} AND NOT {WITHIN_HOLE} GROUP BY b.geoid",
)
def polygons_meet(t: Tables):
    pairs = O.meeting(lot_rings(t), frames(t), ["parcel_id"], ["geoid"], 200.0)
    return pairs.groupBy("geoid").agg(F.count("*").alias("parcels"))


@query(
    "GEO02_polygon_overlap",
    ctes("parcels", "blocks")
    + f"""SELECT b.geoid, {rds(f'sum({OVERLAP} - {HOLE_OVERLAP})', 3)} AS overlap FROM parcels a JOIN blocks b ON {MEET}
    WHERE {OVERLAP} - {HOLE_OVERLAP} > 1e-6 GROUP BY b.geoid""",
)
def polygon_overlap(t: Tables):
    pairs = O.overlaps(lot_rings(t), frames(t), ["parcel_id"], ["geoid"], 200.0)
    return pairs.groupBy("geoid").agg(rd(F.sum("overlap"), 3).alias("overlap"))


@query(
    "GEO17_parse_all_rings",
    ctes("parcels")
    + f"SELECT parcel_id, {rds('(xmax - xmin) * (ymax - ymin) * 1.75e0', 3)} AS wkt_area, {rds('(xmax - xmin) * (ymax - ymin) * 1.75e0', 3)} AS json_area FROM parcels",
)
def parse_all_rings(t: Tables):
    # the lot around a hole, and the lot once more beside it
    w, h = (F.col("xmax") - F.col("xmin")) / 4.0, (F.col("ymax") - F.col("ymin")) / 4.0
    hole = G.box(F.col("xmin") + w, F.col("ymin") + h, F.col("xmax") - w, F.col("ymax") - h)
    beside = G.box(F.col("xmin") + 8 * w, F.col("ymin"), F.col("xmax") + 8 * w, F.col("ymax"))
    rings = [G.box_ring(b) for b in (F.struct(*BOX), hole, beside)]

    def text(ring, pair, between):
        return F.concat_ws(between, F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.format_string(pair, p["x"], p["y"])))

    wkt = F.format_string("MULTIPOLYGON (((%s), (%s)), ((%s)))", *[text(r, "%s %s", ", ") for r in rings])
    json = F.format_string('{"type": "MultiPolygon", "coordinates": [[[%s], [%s]], [[%s]]]}', *[text(r, "[%s, %s]", ", ") for r in rings])
    # texts cost far more than the rows they are made from: dealt over all cores
    p = t.parcels.repartition("parcel_id").select("parcel_id", wkt.alias("wkt"), json.alias("json"))
    return p.select(
        "parcel_id",
        rd(G.area(G.wkt_ring(F.col("wkt"))), 3).alias("wkt_area"),
        rd(G.area(G.geojson_ring(F.col("json"))), 3).alias("json_area"),
    )


@query(
    "JOI15_box_prefilter",
    ctes("parcels", "block_groups")
    + f"SELECT a.parcel_id, b.geoid, {rds(OVERLAP)} AS overlap FROM parcels a JOIN block_groups b ON {MEET} WHERE {OVERLAP} > 0",
)
def box_prefilter(t: Tables):
    pairs = S.box_overlaps(boxes(t.parcels, "parcel_id"), boxes(t.block_groups, "geoid"), 500.0)
    return pairs.select("l.parcel_id", "r.geoid", rd("overlap").alias("overlap"))


@query(
    "JOI16_point_in_polygon",
    ctes("parcels", "block_groups")
    + "SELECT parcel_id, geoid FROM parcels a JOIN block_groups b ON abs(a.x - b.x) + abs(a.y - b.y - 7e0) < 900e0",
)
def point_in_polygon(t: Tables):
    # diamonds around the zone centres
    x, y, r = F.col("x"), F.col("y") + 7.0, 900.0
    diamonds = t.block_groups.select(
        "geoid",
        F.array(G.point(x - r, y), G.point(x, y - r), G.point(x + r, y), G.point(x, y + r)).alias("ring"),
    )
    return S.inside(t.parcels.select("parcel_id", "x", "y"), diamonds, 500.0).select("parcel_id", "geoid")


@query(
    "JOI17_distance_within",
    ctes("parcels", "shops")
    + f"""SELECT a.parcel_id, count(*) AS n, {rds('min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))')} AS closest
    FROM parcels a JOIN shops b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {QUARTER_MILE_M}e0 * {QUARTER_MILE_M}e0 GROUP BY a.parcel_id""",
)
def distance_within(t: Tables):
    pairs = S.near(t.parcels.select("parcel_id", "x", "y"), t.shops.select("poi_id", "x", "y"), QUARTER_MILE_M)
    return pairs.groupBy("parcel_id").agg(F.count("*").alias("n"), rd(F.min("distance")).alias("closest"))


@query(
    "JOI18_nearest",
    ctes("parcels", "shops")
    + f"""SELECT parcel_id, poi_id, {rds('d')} AS distance FROM (SELECT parcel_id, poi_id, d, row_number() OVER (PARTITION BY parcel_id ORDER BY d, poi_id) AS rn
    FROM (SELECT parcel_id, poi_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM parcels a, shops b)) WHERE rn = 1""",
)
def nearest(t: Tables):
    out = S.nearest(t.parcels, t.shops, "parcel_id", "poi_id", 500.0)
    return out.select("parcel_id", "poi_id", rd("distance").alias("distance"))


PIXEL = 25.0
# 25 m pixels: every line is one pixel of a tile, its part number gives class and value
PIXELS = """SELECT l_suppkey % 8 AS tile_id, (l_orderkey % 400) * 100e0 + (l_linenumber % 4) * 25e0 + 12.5e0 AS x,
    floor(l_orderkey / 400) * 100e0 + (l_partkey % 4) * 25e0 + 12.5e0 AS y, l_partkey % 5 AS class, l_quantity AS canopy FROM lineitem"""


def pixels(t: Tables, value: str):
    ok = F.col("l_orderkey")
    return t.lineitem.select(
        (F.col("l_suppkey") % 8).alias("tile_id"),
        ((ok % 400) * 100.0 + (F.col("l_linenumber") % 4) * 25.0 + 12.5).alias("x"),
        (F.floor(ok / 400) * 100.0 + (F.col("l_partkey") % 4) * 25.0 + 12.5).alias("y"),
        (F.col("l_partkey") % 5 if value == "class" else F.col("l_quantity")).alias("value"),
    )


@query(
    "JOI19_raster_polygon",
    ctes("blocks", px=PIXELS)
    + f"SELECT b.geoid, count(*) AS pixels, {rds('avg(canopy)')} AS mean FROM px a JOIN blocks b ON {IN_FRAME} GROUP BY b.geoid",
)
def raster_polygon(t: Tables):
    pairs = O.zones(pixels(t, "canopy"), frames(t), ["geoid"], PIXEL)
    return pairs.groupBy("geoid").agg(F.count("*").alias("pixels"), rd(F.avg("value")).alias("mean"))


@query(
    "GEO13_zonal_histogram",
    ctes("parcels", px=PIXELS)
    + f"SELECT b.parcel_id, a.class AS value, count(*) AS pixels FROM px a JOIN parcels b ON abs(b.x - a.x) <= 50 AND {IN_FRAME} GROUP BY b.parcel_id, a.class",
)
def zonal_histogram(t: Tables):
    return O.zonal_histogram(pixels(t, "class"), framed(boxes(t.parcels, "parcel_id")), "parcel_id", PIXEL)


@query(
    "GEO14_zonal_mean",
    ctes("block_groups", px=PIXELS)
    + f"SELECT geoid, {rds('avg(m)')} AS mean FROM (SELECT b.geoid, tile_id, avg(canopy) AS m FROM px a JOIN block_groups b ON {IN_FRAME} GROUP BY b.geoid, tile_id) GROUP BY geoid",
)
def zonal_mean(t: Tables):
    return rounded(O.zonal_mean(pixels(t, "canopy"), framed(boxes(t.block_groups, "geoid")), "geoid", PIXEL))


# --- geometry columns ---------------------------------------------------------


def lots(t: Tables):
    """Right triangles over the parcel boxes (area = half the box)."""
    b = t.parcels.withColumn(
        "ring",
        F.array(
            G.point(F.col("xmin"), F.col("ymin")),
            G.point(F.col("xmax"), F.col("ymin")),
            G.point(F.col("xmin"), F.col("ymax")),
        ),
    )
    return b.select("parcel_id", "ring", *BOX)


@query(
    "GEO01_area_acres",
    ctes("parcels")
    + f"SELECT parcel_id, {rds(f'(xmax - xmin) * (ymax - ymin) / 2e0 / {SQM_PER_ACRE}e0', 6)} AS acres FROM parcels",
)
def area_acres(t: Tables):
    return lots(t).select("parcel_id", rd(G.acres(F.col("ring")), 6).alias("acres"))


@query(
    "GEO02_overlap_acres",
    ctes("parcels")
    + f"""SELECT parcel_id, {rds(f'w * w * 0.25e0 / {SQM_PER_ACRE}e0', 6)} AS acres, {rds('0.5e0', 6)} AS ratio
    FROM (SELECT parcel_id, xmax - xmin AS w FROM parcels)""",
)
def overlap_acres(t: Tables):
    # the triangle cut by a square window over its lower left quarter
    half = (F.col("xmax") - F.col("xmin")) / 2.0
    window = G.box(F.col("xmin"), F.col("ymin"), F.col("xmin") + half, F.col("ymin") + half)
    clipped = G.overlap_area(F.col("ring"), G.box_ring(window))
    return lots(t).select(
        "parcel_id",
        rd(clipped / SQM_PER_ACRE, 6).alias("acres"),
        rd(G.overlap_ratio(F.col("ring"), G.box_ring(window)), 6).alias("ratio"),
    )


@query(
    "GEO03_envelope_overlap",
    ctes("parcels", "buildings")
    + f"SELECT b.parcel_id, b.line, b.supplier, b.part, {rds(OVERLAP)} AS overlap FROM buildings b JOIN parcels a ON a.parcel_id = b.parcel_id",
)
def envelope_overlap(t: Tables):
    a, b = t.parcels.alias("l"), t.buildings.alias("r")
    overlap = G.box_overlap_area(S.box_of("l"), S.box_of("r"))
    return a.join(b, F.col("l.parcel_id") == F.col("r.parcel_id")).select(
        "r.parcel_id", "r.line", "r.supplier", "r.part", rd(overlap).alias("overlap")
    )


@query(
    "GEO04_clip_by_box",
    ctes("parcels")
    + """, s AS (SELECT parcel_id, xmax - xmin AS w FROM parcels)
    SELECT parcel_id, """ + rds("w * w * 0.5e0 - w * w * 0.25e0 * 0.5e0") + " AS area FROM s",
)
def clip_by_box(t: Tables):
    # left half of the triangle: a trapezium
    half = (F.col("xmax") - F.col("xmin")) / 2.0
    window = G.box(F.col("xmin"), F.col("ymin"), F.col("xmin") + half, F.col("ymax"))
    return lots(t).select("parcel_id", rd(G.area(G.clip_box(F.col("ring"), window))).alias("area"))


_LON, _LAT = "-122e0 + (o_orderkey % 400) * 0.005e0", "37e0 + (o_orderkey % 977) * 0.002e0"


@query(
    "GEO05_reproject",
    f"""SELECT parcel_id, {rds('radians(lon) * 6378137e0', 3)} AS x, {rds('ln(tan(radians(lat) / 2e0 + pi() / 4e0)) * 6378137e0', 3)} AS y
    FROM (SELECT o_orderkey AS parcel_id, {_LON} AS lon, {_LAT} AS lat FROM orders)""",
)
def reproject(t: Tables):
    p = t.orders.selectExpr("o_orderkey AS parcel_id", f"{_LON} AS lon", f"{_LAT} AS lat")
    m = G.project(F.col("lon"), F.col("lat"), 3857)
    return p.select("parcel_id", rd(m["x"], 3).alias("x"), rd(m["y"], 3).alias("y"))


@query(
    "GEO06_centroid_within",
    ctes("parcels")
    + f"SELECT parcel_id, {rds('xmin + (xmax - xmin) / 3e0')} AS cx, {rds('ymin + (ymax - ymin) / 3e0')} AS cy, true AS covers, false AS outside FROM parcels",
)
def centroid_within(t: Tables):
    c = G.centroid(F.col("ring"))
    far = (F.col("xmax") - 1.0, F.col("ymax") - 1.0)
    return lots(t).withColumn("c", c).select(
        "parcel_id",
        rd(F.col("c.x")).alias("cx"),
        rd(F.col("c.y")).alias("cy"),
        G.point_in_ring(F.col("c.x"), F.col("c.y"), F.col("ring")).alias("covers"),
        G.point_in_ring(*far, F.col("ring")).alias("outside"),
    )


@query(
    "GEO07_overlap_ratio",
    ctes("parcels", "buildings")
    + f"""SELECT b.parcel_id, b.line, b.supplier, b.part, {rds(f'least(1e0, {OVERLAP} / ((b.xmax - b.xmin) * (b.ymax - b.ymin)))')} AS ratio
    FROM buildings b JOIN parcels a ON a.parcel_id = b.parcel_id""",
)
def overlap_ratio(t: Tables):
    b = t.buildings.select("parcel_id", "line", "supplier", "part", G.box_ring(F.struct(*BOX)).alias("building"))
    p = t.parcels.select("parcel_id", G.box_ring(F.struct(*BOX)).alias("lot"))
    return b.join(p, "parcel_id").select(
        "parcel_id", "line", "supplier", "part",
        rd(G.overlap_ratio(F.col("building"), F.col("lot"))).alias("ratio"),
    )


ENDS = "SELECT floor(x / 10e0 + 0.5e0) * 10e0 AS x, floor(y / 10e0 + 0.5e0) * 10e0 AS y FROM (SELECT x1 AS x, y1 AS y FROM roads UNION ALL SELECT x2, y2 FROM roads)"


@query(
    "GEO08_intersection_points",
    ctes("roads", ends=ENDS) + "SELECT x, y, count(*) AS degree FROM ends GROUP BY x, y HAVING count(*) >= 3",
)
def intersection_points(t: Tables):
    return S.intersections(t.roads)


@query(
    "GEO09_line_length_inside",
    ctes("roads", "block_groups")
    + f"""SELECT geoid, {rds('sum(least(x2, xmax) - greatest(x1, xmin))', 3)} AS length FROM roads JOIN block_groups
    ON y1 >= ymin AND y1 < ymax AND x2 > xmin AND x1 < xmax GROUP BY geoid""",
)
def line_length_inside(t: Tables):
    # lines on the shared edge of two squares belong to the upper one
    pairs = S.lengths_inside(t.roads, boxes(t.block_groups, "geoid"), 500.0)
    return pairs.groupBy(F.col("r.geoid").alias("geoid")).agg(rd(F.sum("length"), 3).alias("length"))


_C = "(s_suppkey * 131 % 400) * 100e0 + 20e0", "(s_suppkey * 17 % 40) * 100e0 + 10e0"
_UNION = f"""SELECT s_suppkey AS id, cx - 70e0 AS xmin, cy - 40e0 AS ymin, cx + 90e0 AS xmax, cy + 60e0 AS ymax FROM
    (SELECT s_suppkey, {_C[0]} AS cx, {_C[1]} AS cy FROM supplier UNION ALL SELECT s_suppkey, {_C[0]} + 30e0, {_C[1]} + 25e0 FROM supplier)"""


def constraint_boxes(t: Tables):
    """Two overlapping constraint boxes per supplier."""
    s = t.supplier.selectExpr("s_suppkey AS id", f"{_C[0]} AS cx", f"{_C[1]} AS cy")
    s = s.unionByName(s.withColumns({"cx": F.col("cx") + 30.0, "cy": F.col("cy") + 25.0}))
    return s.selectExpr("id", "cx - 70e0 AS xmin", "cy - 40e0 AS ymin", "cx + 90e0 AS xmax", "cy + 60e0 AS ymax")


# Of each supplier's two overlapping boxes, the first becomes an L and the second a frame; a third is of no listed type.
_MX, _MY = "(xmin + xmax) / 2e0", "(ymin + ymax) / 2e0"
_WX, _WY = "(xmax - xmin) / 4e0", "(ymax - ymin) / 4e0"
_CONS = f"SELECT s_suppkey AS id, kind, cx + d * 30e0 - 70e0 AS xmin, cy + d * 25e0 - 40e0 AS ymin, cx + d * 30e0 + 90e0 AS xmax, cy + d * 25e0 + 60e0 AS ymax FROM (SELECT s_suppkey, {_C[0]} AS cx, {_C[1]} AS cy FROM supplier) s, (VALUES ('wetland', 0), ('flood', 1), ('fault', 2)) k(kind, d)"
CONS_PARTS = " UNION ALL ".join(
    f"SELECT {x0} AS xmin, {y0} AS ymin, {x1} AS xmax, {y1} AS ymax FROM con WHERE kind = '{kind}'"
    for kind, x0, y0, x1, y1 in (
        ("wetland", "xmin", "ymin", "xmax", _MY), ("wetland", "xmin", _MY, _MX, "ymax"),
        ("flood", "xmin", "ymin", "xmax", f"ymin + {_WY}"), ("flood", "xmin", f"ymax - {_WY}", "xmax", "ymax"),
        ("flood", "xmin", f"ymin + {_WY}", f"xmin + {_WX}", f"ymax - {_WY}"), ("flood", f"xmax - {_WX}", f"ymin + {_WY}", "xmax", f"ymax - {_WY}"),
    )
)
#: Area of each parcel that the union of these parts covers, by a grid of all their edges.
COVERED = """SELECT xs.parcel_id, sum((nx - x) * (ny - y)) AS covered FROM xs JOIN ys ON ys.parcel_id = xs.parcel_id
    WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM pc WHERE pc.parcel_id = xs.parcel_id AND x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny) GROUP BY xs.parcel_id"""
COVER_CTES = dict(
    con=_CONS,
    cons=CONS_PARTS,
    pc="SELECT DISTINCT a.parcel_id, greatest(a.xmin, b.xmin) AS x0, least(a.xmax, b.xmax) AS x1, greatest(a.ymin, b.ymin) AS y0, least(a.ymax, b.ymax) AS y1 FROM parcels a JOIN cons b ON a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax",
    xs="SELECT parcel_id, x, lead(x) OVER (PARTITION BY parcel_id ORDER BY x) AS nx FROM (SELECT DISTINCT parcel_id, x FROM (SELECT parcel_id, x0 AS x FROM pc UNION ALL SELECT parcel_id, x1 FROM pc))",
    ys="SELECT parcel_id, y, lead(y) OVER (PARTITION BY parcel_id ORDER BY y) AS ny FROM (SELECT DISTINCT parcel_id, y FROM (SELECT parcel_id, y0 AS y FROM pc UNION ALL SELECT parcel_id, y1 FROM pc))",
    cov=COVERED,
)


def constraint_polygons(t: Tables):
    """constraint_type and ring of every constraint polygon."""
    kind = lambda k: F.col("constraint_type") == k
    s = t.supplier.select(F.explode(F.array(*[F.struct(F.lit(k).alias("constraint_type"), F.lit(float(d)).alias("d")) for d, k in enumerate(("wetland", "flood", "fault"))])).alias("k"), F.expr(_C[0]).alias("cx"), F.expr(_C[1]).alias("cy"))
    s = s.selectExpr("k.constraint_type", "cx + k.d * 30e0 - 70e0 AS xmin", "cy + k.d * 25e0 - 40e0 AS ymin", "cx + k.d * 30e0 + 90e0 AS xmax", "cy + k.d * 25e0 + 60e0 AS ymax")
    return ell(s.where(~kind("flood"))).unionByName(framed(s.where(kind("flood")))).select("constraint_type", "ring")


@query("GEO10_polygon_union_overlap", ctes("parcels", **COVER_CTES) + f"SELECT parcel_id, {rds('covered')} AS covered FROM cov")
def polygon_union_overlap(t: Tables):
    areas = constraint_polygons(t).where("constraint_type <> 'fault'")
    return rounded(O.covered(lot_rings(t), areas, ["parcel_id"], 100.0))


@query(
    "GEO10_union_overlap",
    ctes("parcels", cons=_UNION)
    + f""", pc AS (SELECT DISTINCT a.parcel_id, greatest(a.xmin, b.xmin) AS x0, least(a.xmax, b.xmax) AS x1, greatest(a.ymin, b.ymin) AS y0, least(a.ymax, b.ymax) AS y1
      FROM parcels a JOIN cons b ON a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax),
    xs AS (SELECT parcel_id, x, lead(x) OVER (PARTITION BY parcel_id ORDER BY x) AS nx FROM (SELECT DISTINCT parcel_id, x FROM (SELECT parcel_id, x0 AS x FROM pc UNION ALL SELECT parcel_id, x1 FROM pc))),
    ys AS (SELECT parcel_id, y, lead(y) OVER (PARTITION BY parcel_id ORDER BY y) AS ny FROM (SELECT DISTINCT parcel_id, y FROM (SELECT parcel_id, y0 AS y FROM pc UNION ALL SELECT parcel_id, y1 FROM pc)))
    SELECT xs.parcel_id, {rds('sum((nx - x) * (ny - y))')} AS covered FROM xs JOIN ys ON ys.parcel_id = xs.parcel_id
    WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM pc WHERE pc.parcel_id = xs.parcel_id AND x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny) GROUP BY xs.parcel_id""",
)
def union_overlap(t: Tables):
    return rounded(S.union_overlap(boxes(t.parcels, "parcel_id"), constraint_boxes(t), "parcel_id", 200.0))


# every seventh block away from the borders is missing
_GONE = "p_partkey % 7 = 3 AND p_partkey % 100 BETWEEN 2 AND 97 AND p_partkey >= 200 AND p_partkey <= (SELECT max(p_partkey) FROM part) - 300"


@query(
    "AGG13_dissolve",
    f"SELECT count(*) * 160000e0 AS area, 1 + (SELECT count(*) FROM part WHERE {_GONE}) AS rings FROM part WHERE NOT ({_GONE})",
)
def dissolve(t: Tables):
    last = t.part.agg(F.max("p_partkey")).scalar()
    k = F.col("geoid")
    gone = (k % 7 == 3) & (k % 100).between(2, 97) & (k >= 200) & (k <= last - 300)
    tiles = boxes(t.blocks, "geoid").withColumn("ring", G.box_ring(F.struct(*BOX))).where(~gone)
    return O.dissolve(tiles.withColumn("all", F.lit(1)), ["all"]).select("area", "rings")


@query("AGG13_union_area", f"WITH b AS ({TABLES['blocks'].sql()}) SELECT {rds('count(*) * 160000e0', 2)} AS area FROM b")
def union_area(t: Tables):
    # blocks, and each once more half a block to the left, within the first ones' extent
    b = boxes(t.blocks, "geoid").withColumn("ring", G.box_ring(F.struct(*BOX)))
    inner = t.blocks.select("geoid", (F.col("xmin") + 50.0).alias("xmin"), "ymin", (F.col("xmax") - 50.0).alias("xmax"), "ymax")
    return rounded(O.union_area(b.unionByName(inner.select(*boxes(inner, "geoid").columns).withColumn("ring", G.box_ring(F.struct(*BOX)))), 1000.0), 2)


@query(
    "GEO11_hull_buffer",
    """WITH p AS (SELECT l_suppkey AS k, max(l_quantity) AS q, min(l_quantity) AS q0, max(l_linenumber) AS n, min(l_linenumber) AS n0, count(*) AS c FROM lineitem GROUP BY l_suppkey)
    SELECT k, c AS n, """ + rds("2 * (q - q0 + 1) * (n - n0 + 1) + 2 * (2 * (q - q0 + 1) + n - n0 + 1) * 5e0 + pi() * 25e0") + " AS area FROM p",
)
def hull_buffer(t: Tables):
    """Corners of each supplier's bounding box, spread over its lines."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    from landspan.operators.ranking import with_group_totals

    spread = with_group_totals(
        t.lineitem.select(F.col("l_suppkey").alias("k"), q.alias("q"), n.alias("n")),
        ["k"],
        [F.max("q").alias("q1"), F.min("q").alias("q0"), F.max("n").alias("n1"), F.min("n").alias("n0")],
    )
    # four points per line: its own point and three box corners grown by half
    pts = spread.select(
        "k",
        F.explode(
            F.array(
                G.point(F.col("q") * 2.0, F.col("n")),
                G.point(F.col("q0") * 2.0 - 1.0, F.col("n0") - 0.5),
                G.point(F.col("q1") * 2.0 + 1.0, F.col("n0") - 0.5),
                G.point(F.col("q1") * 2.0 + 1.0, F.col("n1") + 0.5),
                G.point(F.col("q0") * 2.0 - 1.0, F.col("n1") + 0.5),
            )
        ).alias("p"),
    ).select("k", "p.x", "p.y")
    out = S.hulls(pts, ["k"])
    return out.select("k", (F.col("n") / 5).cast("bigint").alias("n"), rd(G.buffered_hull_area(F.col("hull"), 5.0)).alias("area"))


@query(
    "GEO12_make_valid",
    ctes("parcels")
    + f"SELECT parcel_id, parcel_id % 5 <> 0 AS valid, {rds('CASE WHEN parcel_id % 5 <> 0 THEN (xmax - xmin) * (ymax - ymin) / 2e0 END')} AS area FROM parcels",
)
def make_valid(t: Tables):
    # every fifth ring collapses to a line; axes come flipped and points repeated
    first, second, third = F.col("ring")[0], F.col("ring")[1], F.col("ring")[2]
    broken = F.when(F.col("parcel_id") % 5 == 0, F.array(first, second, second)).otherwise(
        F.array(first, first, second, third)
    )
    clean = G.clean_ring(G.swap_axes(broken))
    return lots(t).select(
        "parcel_id", clean.isNotNull().alias("valid"), rd(G.area(clean)).alias("area")
    ).withColumn("area", F.when(F.col("valid"), F.col("area")))


@query(
    "GEO15_allocation_factors",
    ctes("block_groups", "parcels")
    + f"SELECT a.geoid AS source_id, b.parcel_id AS target_id, {rds(f'{OVERLAP} / 4000000e0', 9)} AS weight FROM block_groups a JOIN parcels b ON {MEET} WHERE {OVERLAP} > 0",
)
def allocation_factors(t: Tables):
    from landspan.operators.allocate import factors

    src = t.block_groups.select("geoid", G.box_ring(F.struct(*BOX)).alias("ring"), *BOX)
    dst = t.parcels.select("parcel_id", G.box_ring(F.struct(*BOX)).alias("ring"), *BOX)
    return factors(src, dst, "geoid", "parcel_id", 500.0).withColumn("weight", rd("weight", 9))


@query(
    "GEO16_constraint_discount",
    ctes("parcels", cons=_UNION)
    + f""", o AS (SELECT a.parcel_id, sum({OVERLAP}) / {SQM_PER_ACRE}e0 AS acres FROM parcels a JOIN cons b ON {MEET} GROUP BY a.parcel_id)
    SELECT p.parcel_id, {rds('coalesce(acres, 0e0)', 6)} AS constraint_acres, {rds('greatest(0e0, gross_acres - coalesce(acres, 0e0) * 0.5e0)', 6)} AS acres_left
    FROM parcels p LEFT JOIN o ON o.parcel_id = p.parcel_id""",
)
def constraint_discount(t: Tables):
    from landspan.operators.allocate import constraint_acres, discounted_acres

    overlaps = S.box_overlaps(boxes(t.parcels, "parcel_id"), constraint_boxes(t), 200.0)
    acres = constraint_acres(overlaps.select("l.parcel_id", "overlap"), "parcel_id")
    out = t.parcels.select("parcel_id", "gross_acres").join(acres, "parcel_id", "left")
    return out.select(
        "parcel_id",
        rd(F.coalesce("constraint_acres", F.lit(0.0)), 6).alias("constraint_acres"),
        rd(discounted_acres("gross_acres", "constraint_acres", 50.0), 6).alias("acres_left"),
    )


@query(
    "GEO17_parse_geometry",
    ctes("parcels")
    + f"SELECT parcel_id, 4 AS wkt_points, {rds('(xmax - xmin) * (ymax - ymin)')} AS wkt_area, 4 AS json_points, {rds('(xmax - xmin) * (ymax - ymin)')} AS json_area FROM parcels",
)
def parse_geometry(t: Tables):
    ring = G.box_ring(F.struct(*BOX))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    text = F.concat(
        F.lit('{"type": "Polygon", "coordinates": [['),
        F.concat_ws(", ", F.transform(closed, lambda p: F.format_string("[%s, %s]", p["x"], p["y"]))),
        F.lit("]]}"),
    )
    p = t.parcels.select("parcel_id", G.ring_wkt(ring).alias("wkt"), text.alias("json"))
    p = p.select("parcel_id", G.wkt_ring(F.col("wkt")).alias("w"), G.geojson_ring(F.col("json")).alias("j"))
    return p.select(
        "parcel_id",
        F.size("w").alias("wkt_points"),
        rd(G.area(F.col("w"))).alias("wkt_area"),
        F.size("j").alias("json_points"),
        rd(G.area(F.col("j"))).alias("json_area"),
    )


@query(
    "JOI10_anti_join_overlap",
    ctes("buildings", "parcels")
    + f"""SELECT parcel_id, line, supplier, part FROM buildings b WHERE NOT EXISTS (SELECT 1 FROM parcels a
    WHERE abs(a.x - b.x) <= 150 AND {MEET} AND {ell_overlap('b', 'a')} > 0.5e0 * 0.75e0 * (b.xmax - b.xmin) * (b.ymax - b.ymin))""",
)
def anti_join_overlap(t: Tables):
    # L-shaped buildings of which no lot holds more than half
    keys = ["parcel_id", "line", "supplier", "part"]
    b = ell(t.buildings.select(*keys, *BOX)).withColumn("own", G.area(F.col("ring")))
    pairs = O.overlaps(b, lot_rings(t).withColumnRenamed("parcel_id", "lot"), [*keys, "own"], ["lot"], 100.0)
    covered = pairs.where(F.col("overlap") > 0.5 * F.col("own")).select(*keys)
    return b.select(*keys).join(covered, keys, "left_anti")
