"""Polygon overlay on prepared edges.

A point lies in a polygon if, over the edges below it, left-to-right ones exceed
right-to-left ones.  So a polygon is the sum, with sign ``w``, of what lies above each of
its edges, whatever its shape, holes and parts; and the overlap of two polygons is the sum
over pairs of edges of ``w w'`` times what lies above both, a closed form.

``strips`` prepares polygons once, before any join: every edge is cut at the grid's lines
and dealt to the cells it runs through, and what lies below a cell comes back as flat edges
along its floor, so that a cell knows all that matters inside it.  A cell in the interior
of a polygon holds one flat edge.  Two prepared sides meet by an equi-join on the cell,
edges against edges in generated code; a large polygon is as many small rows in as many
cells, and no row ever holds a whole pair.  Sums over the cells of a pair are partial
aggregates.  Cells with very many edges on both sides are skewed join keys, which Spark's
adaptive execution splits.

Choose ``cell`` about as wide as the smaller polygons.  Rings may turn either way; their
holes turn against them, as ``geometry.join_rings`` makes them.  Rings that are null, have
fewer than 3 points or no area take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.functions import geometry as G
from landspan.session import cut

CELL = ["_cx", "_cy"]
EDGE = ["x0", "y0", "x1", "y1"]


def _floor(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def _last(v: Column, first: Column, size: float) -> Column:
    """The last cell that a stretch from cell ``first`` up to ``v`` enters."""
    return F.greatest(first, F.ceil(v / size).cast("bigint") - 1)


def _y_at(x: Column, e: str = "") -> Column:
    """Height of the edge at x; its ends are met exactly."""
    x0, y0, x1, y1 = (F.col(e + n) for n in EDGE)
    return F.when(x == x0, y0).when(x == x1, y1).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def _edges(polygons: DataFrame, keys: Sequence[str], ring: str, **more: Column) -> DataFrame:
    """One row per edge _p -> _q of every ring, with ``more`` about the ring, in generated code."""
    rings = polygons.where(F.size(ring) >= 3).select(*keys, *[c.alias(n) for n, c in more.items()], F.col(ring).alias("_ring"))
    return rings.select(*keys, *more, F.inline(F.arrays_zip("_ring", G.following(F.col("_ring")))).alias("_p", "_q"))


def _left_to_right(p: Column, q: Column) -> list[Column]:
    """x0, y0, x1, y1 of an edge, the left end first."""
    right = p["x"] <= q["x"]
    return [F.when(right, a[n]).otherwise(b[n]).alias(n + i) for a, b, i in ((p, q, "0"), (q, p, "1")) for n in "xy"]


def is_tall(ring: Column, cell: float) -> Column:
    """Whether a ring reaches over a grid line upwards."""
    low, high = (f(ring["y"]) for f in (F.array_min, F.array_max))
    return _floor(low, cell) < _floor(high, cell)


def _upright(polygons: DataFrame, keys: Sequence[str], ring: str, cell: float, turned: bool) -> DataFrame:
    """One row per edge that is not vertical; ``w`` is +1 where the ring runs to the right.

    With ``turned`` rings that run clockwise change their sign, so that +1 means that the
    polygon lies above.  ``_tall`` tells whether a ring reaches over a grid line.
    """
    tall = is_tall(F.col(ring), cell)
    turn = F.signum(G.signed_area(F.col(ring))).cast("int") if turned else F.lit(1)
    e = _edges(polygons, keys, ring, _turn=turn, _tall=tall)
    p, q = F.col("_p"), F.col("_q")
    w = F.when(p["x"] < q["x"], F.col("_turn")).otherwise(-F.col("_turn"))
    return e.where(p["x"] != q["x"]).select(*keys, "_tall", *_left_to_right(p, q), w.alias("w")).where("w <> 0")


def _pieces(edges: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """The edges cut at the grid's lines; neighbouring pieces share their ends exactly."""
    own = [*keys, "_tall", "w"]
    first = _floor(F.col("x0"), cell)
    cols = edges.withColumn("_cx", F.explode(F.sequence(first, _last(F.col("x1"), first, cell))))
    a, b = F.greatest("x0", F.col("_cx") * cell), F.least("x1", (F.col("_cx") + 1) * cell)
    cols = cols.select(*own, "_cx", a.alias("xa"), _y_at(a).alias("ya"), b.alias("xb"), _y_at(b).alias("yb")).where("xa < xb")
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    first = _floor(low, cell)
    rows = cols.withColumn("_cy", F.explode(F.sequence(first, _last(high, first, cell))))
    floor, top = F.col("_cy") * cell, (F.col("_cy") + 1) * cell
    ya, yb, xa, xb = (F.col(c) for c in ("ya", "yb", "xa", "xb"))

    def x_at(y: Column) -> Column:
        return F.least(F.greatest(xa + (xb - xa) * (y - ya) / (yb - ya), xa), xb)

    def end(x: Column, y: Column) -> tuple[Column, Column]:
        return F.when(y < floor, x_at(floor)).when(y > top, x_at(top)).otherwise(x), F.least(F.greatest(y, floor), top)

    (x0, y0), (x1, y1) = end(xa, ya), end(xb, yb)
    return rows.select(*own, *CELL, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).where("x0 < x1")


def strips(polygons: DataFrame, keys: Sequence[str], cell: float, ring: str = "ring", turned: bool = False) -> DataFrame:
    """Prepared polygons: ``keys``, cell, edge (x0 < x1) and ``w``; see the module's text.

    ``turned`` makes all ``w`` of one sign whichever way a ring runs; sums over one polygon
    need it not.  Without keys all polygons are one, whose ``w`` add up.
    """
    keys = list(keys)
    pieces = _pieces(_upright(polygons, keys, ring, cell, turned), keys, cell)
    # where the number of edges below changes along x, and by how much, per cell that the change lies in
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("w").alias("d")), F.struct(F.col("x1").alias("x"), (-F.col("w")).alias("d"))))
    steps = pieces.where("_tall").select(*keys, *CELL, ends.alias("s")).select(*keys, *CELL, "s.x", "s.d")
    steps = steps.where(F.col("x") != (F.col("_cx") + 1) * cell)
    steps = steps.groupBy(*keys, *CELL, "x").agg(F.sum("d").alias("d")).where("d <> 0")
    upward = Window.partitionBy(*keys, "_cx", "x").orderBy("_cy")
    held = steps.select(*keys, "_cx", "x", "_cy", F.sum("d").over(upward).alias("w"), F.lead("_cy").over(upward).alias("_next"))
    held = held.where("w <> 0 AND _next IS NOT NULL").withColumn("_cy", F.explode(F.sequence(F.col("_cy") + 1, F.col("_next"))))
    floor = F.col("_cy") * cell
    floors = held.select(*keys, *CELL, F.col("x").alias("x0"), floor.alias("y0"), ((F.col("_cx") + 1) * cell).alias("x1"), floor.alias("y1"), F.col("w").cast("int").alias("w"))
    return pieces.select(*keys, *CELL, *EDGE, "w").unionByName(floors)


def _meeting_edges(a: DataFrame, b: DataFrame, cell: float, keys: Sequence[str]) -> DataFrame:
    """``overlap`` by ``keys``: the sum of ``w w'`` times the area above both edges inside their cell; b's columns become ``r_*``."""
    b = b.withColumnsRenamed({n: "r_" + n for n in (*CELL, *EDGE, "w")})
    both = a.join(b.hint("merge"), (F.col("_cx") == F.col("r__cx")) & (F.col("_cy") == F.col("r__cy")) & (F.col("x0") < F.col("r_x1")) & (F.col("r_x0") < F.col("x1")))
    both = both.withColumns({"_l": F.greatest("x0", "r_x0"), "_r": F.least("x1", "r_x1")})
    l, r = F.col("_l"), F.col("_r")
    both = both.withColumns({"_fl": _y_at(l, "r_"), "_fr": _y_at(r, "r_"), "_dl": _y_at(l) - _y_at(l, "r_"), "_dr": _y_at(r) - _y_at(r, "r_")})
    dl, dr = F.col("_dl"), F.col("_dr")
    high = F.greatest(dl, dr)
    # mean of the positive part of a difference that runs from dl to dr
    over = F.when((dl >= 0) & (dr >= 0), (dl + dr) / 2).when((dl <= 0) & (dr <= 0), 0.0).otherwise(high * high / (2 * F.abs(dl - dr)))
    above = (r - l) * ((F.col("_cy") + 1) * cell - (F.col("_fl") + F.col("_fr")) / 2 - over)
    return both.groupBy(*keys).agg(F.abs(F.sum(F.col("w") * F.col("r_w") * above)).alias("overlap"))


def overlaps(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], cell: float, least: float = 1e-6) -> DataFrame:
    """GEO02 / GEO15: pairs of polygons of any shape and the area they share, above ``least``.

    Both sides hold a ``ring``; their keys have different names.
    """
    found = _meeting_edges(strips(left, left_keys, cell), strips(right, right_keys, cell), cell, [*left_keys, *right_keys])
    return found.where(F.col("overlap") > least)


def overlaps_of_low(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], cell: float, least: float = 1e-6) -> DataFrame:
    """``overlaps`` where no left polygon ``is_tall``: these are read once, since nothing of them lies below another cell."""
    edges = _pieces(_upright(left, left_keys, "ring", cell, False), left_keys, cell).drop("_tall")
    found = _meeting_edges(edges, strips(right, right_keys, cell), cell, [*left_keys, *right_keys])
    return found.where(F.col("overlap") > least)


def dissolved(areas: DataFrame, cell: float) -> DataFrame:
    """The union of polygons as prepared edges: ``w`` is +1 where it begins and -1 where it ends, upwards.

    A plane sweep in every cell: the cell is cut into slabs at the ends and crossings of
    its edges; inside a slab edges lie one above the other, and a running sum of ``w``
    tells what is covered.  Equal edges, as of copies or of neighbours that share a side,
    are summed up first.
    """
    e = strips(areas, [], cell, turned=True).groupBy(*CELL, *EDGE).agg(F.sum("w").alias("w")).where("w <> 0")
    e = cut(e)
    b = e.withColumnsRenamed({n: "r_" + n for n in (*CELL, *EDGE, "w")})
    on = (F.col("_cx") == F.col("r__cx")) & (F.col("_cy") == F.col("r__cy")) & (F.col("x0") < F.col("r_x1")) & (F.col("r_x0") < F.col("x1"))
    on = on & (F.least("y0", "y1") < F.greatest("r_y0", "r_y1")) & (F.least("r_y0", "r_y1") < F.greatest("y0", "y1"))
    on = on & (F.struct(*EDGE) < F.struct(*["r_" + n for n in EDGE]))
    l, r = F.greatest("x0", "r_x0"), F.least("x1", "r_x1")
    f, g = _y_at(l) - _y_at(l, "r_"), _y_at(r) - _y_at(r, "r_")
    crossings = e.join(b.hint("merge"), on & (f * g < 0)).select(*CELL, (l + (r - l) * f / (f - g)).alias("s0"))
    ends = e.select(*CELL, F.explode(F.array("x0", "x1")).alias("s0"))
    slabs = ends.unionByName(crossings).distinct().withColumn("s1", F.lead("s0").over(Window.partitionBy(*CELL).orderBy("s0")))
    slabs = slabs.where("s1 IS NOT NULL").withColumnsRenamed({c: "s" + c for c in CELL})
    inside = e.join(slabs.hint("merge"), (F.col("_cx") == F.col("s_cx")) & (F.col("_cy") == F.col("s_cy")) & (F.col("x0") <= F.col("s0")) & (F.col("s1") <= F.col("x1")))
    inside = inside.select(*CELL, "s0", "s1", _y_at(F.col("s0")).alias("yl"), _y_at(F.col("s1")).alias("yr"), "w")
    # edges in one place within the slab are one
    inside = inside.groupBy(*CELL, "s0", "s1", "yl", "yr").agg(F.sum("w").alias("w")).where("w <> 0")
    upward = Window.partitionBy(*CELL, "s0", "s1").orderBy(F.col("yl") + F.col("yr"), "yl")
    after = F.sum("w").over(upward.rowsBetween(Window.unboundedPreceding, 0))
    swept = inside.withColumn("_after", after).withColumn("_before", F.col("_after") - F.col("w"))
    step = (F.col("_after") != 0).cast("int") - (F.col("_before") != 0).cast("int")
    return swept.select(*CELL, F.col("s0").alias("x0"), F.col("yl").alias("y0"), F.col("s1").alias("x1"), F.col("yr").alias("y1"), step.alias("w")).where("w <> 0")


def covered(targets: DataFrame, areas: DataFrame, keys: Sequence[str], cell: float, least: float = 1e-6) -> DataFrame:
    """GEO10 / ANA01: area of each target polygon that the union of other polygons covers; overlaps count once.

    Both sides hold a ``ring``.  The union is swept once for all targets.
    """
    found = _meeting_edges(strips(targets, keys, cell), dissolved(areas, cell), cell, list(keys))
    return found.where(F.col("overlap") > least).withColumnRenamed("overlap", "covered")


def union_area(areas: DataFrame, cell: float) -> DataFrame:
    """AGG13: ``area`` of the union of polygons, one row."""
    above = (F.col("x1") - F.col("x0")) * ((F.col("_cy") + 1) * cell - (F.col("y0") + F.col("y1")) / 2)
    return dissolved(areas, cell).agg(F.coalesce(F.sum(F.col("w") * above), F.lit(0.0)).alias("area"))


# --- dissolve ------------------------------------------------------------------------


def outline_edges(polygons: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """AGG13: directed edges (px, py, qx, qy) around the union of polygons that share whole sides and do not overlap.

    Sides walked both ways cancel out, as do bridges; what is left has the area on its left.
    """
    turn = F.signum(G.signed_area(F.col(ring)))
    e = _edges(polygons, keys, ring, _turn=turn).where("_turn <> 0 AND _p <> _q")
    p, q = F.col("_p"), F.col("_q")
    one_way = F.when(p < q, F.col("_turn")).otherwise(-F.col("_turn"))
    d = e.groupBy(*keys, F.least(p, q).alias("_p"), F.greatest(p, q).alias("_q")).agg(F.sum(one_way).alias("d")).where("d <> 0")
    pick = lambda a, b, n: F.when(F.col("d") > 0, a[n]).otherwise(b[n])
    return d.select(*keys, pick(p, q, "x").alias("px"), pick(p, q, "y").alias("py"), pick(q, p, "x").alias("qx"), pick(q, p, "y").alias("qy"))


def dissolve(polygons: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """AGG13: ``area``, ``perimeter`` and number of ``rings`` (parts and holes) of each key's union of polygons that tile.

    Every edge left after cancelling points to the next one, the sharpest left turn where
    several leave a corner.  Pointers are doubled, so a ring of n edges has one name after
    log2 n rounds; no task holds a ring.
    """
    keys = list(keys)
    e = outline_edges(polygons, keys, ring)
    e = cut(e.withColumn("id", F.monotonically_increasing_id()))
    o = e.select(*[F.col(k).alias("o_" + k) for k in keys], F.col("id").alias("next"), *[F.col(c).alias("o_" + c) for c in ("px", "py", "qx", "qy")])
    same = (F.col("qx") == F.col("o_px")) & (F.col("qy") == F.col("o_py"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("o_" + k))
    ax, ay, bx, by = F.col("qx") - F.col("px"), F.col("qy") - F.col("py"), F.col("o_qx") - F.col("o_px"), F.col("o_qy") - F.col("o_py")
    left = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    walk = cut(e.join(o, same).groupBy("id").agg(F.max_by("next", F.struct(left, "next")).alias("next")).withColumn("name", F.least("id", "next")))
    while True:
        ahead = walk.select(F.col("id").alias("at"), F.col("next").alias("far"), F.col("name").alias("there"))
        after = walk.join(ahead, F.col("next") == F.col("at")).select("id", F.col("far").alias("next"), F.least("name", "there").alias("name"), (F.col("there") < F.col("name")).alias("new"))
        after = cut(after)
        if after.where("new").isEmpty():
            break
        walk = after.drop("new")
    named = e.join(walk.select("id", "name"), "id")
    area = F.sum(F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2
    length = F.sum(F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")))
    per_ring = named.groupBy(*keys, "name").agg(area.alias("area"), length.alias("perimeter"))
    return per_ring.groupBy(*keys).agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.count("*").alias("rings"))


# --- polygons that meet ------------------------------------------------------------


def _bridges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of bridged rings without direction, and how often they are walked one way more than the other (``d``)."""
    p, q = F.col("_p"), F.col("_q")
    both = edges.where("_bridged").groupBy(*keys, F.least(p, q).alias("_p"), F.greatest(p, q).alias("_q"))
    return both.agg(F.sum(F.when(p < q, 1).otherwise(-1)).alias("d"))


def _outline(polygons: DataFrame, keys: Sequence[str], cell: float, ring: str) -> DataFrame:
    """Edges of the outlines, dealt to every cell they may touch; bridges between rings are no edges."""
    e = _edges(polygons, keys, ring, _bridged=G.is_bridged(F.col(ring)))
    e = e.where("NOT _bridged").select(*keys, "_p", "_q").unionByName(_bridges(e, keys).where("d <> 0").drop("d"))
    e = e.select(*keys, *_left_to_right(F.col("_p"), F.col("_q")))
    e = e.withColumn("_cx", F.explode(F.sequence(_floor(F.col("x0"), cell), _floor(F.col("x1"), cell))))
    a, b = F.greatest("x0", F.col("_cx") * cell), F.least("x1", (F.col("_cx") + 1) * cell)
    one = F.col("x0") == F.col("x1")
    ya, yb = (F.when(one, F.col(n)).otherwise(_y_at(x)) for x, n in ((a, "y0"), (b, "y1")))
    # rows of a column are widened a little, so that rounding loses no cell
    slack = cell * 1e-9
    low, high = F.greatest(F.least(ya, yb) - slack, F.least("y0", "y1")), F.least(F.greatest(ya, yb) + slack, F.greatest("y0", "y1"))
    return e.withColumn("_cy", F.explode(F.sequence(_floor(low, cell), _floor(high, cell))))


def _corners(polygons: DataFrame, keys: Sequence[str], ring: str) -> DataFrame:
    """x, y of a corner of each of a polygon's rings: the first point, and the ends of bridges."""
    first = polygons.where(F.size(ring) >= 3).select(*keys, F.get(F.col(ring), F.lit(0)).alias("c"))
    ends = _bridges(_edges(polygons, keys, ring, _bridged=G.is_bridged(F.col(ring))), keys).where("d = 0")
    return first.unionByName(ends.select(*keys, F.explode(F.array("_p", "_q")).alias("c"))).select(*keys, "c.x", "c.y").distinct()


def holds(points: DataFrame, polygons: DataFrame, point_keys: Sequence[str], polygon_keys: Sequence[str], cell: float, ring: str = "ring") -> DataFrame:
    """JOI16: points (x, y) in prepared polygons, by the few edges of the point's own cell; half open as ``point_in_ring``."""
    p = points.select(*point_keys, F.col("x").alias("_x"), F.col("y").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    p = p.withColumns({"p_cx": _floor(F.col("_x"), cell), "p_cy": _floor(F.col("_y"), cell)})
    e = strips(polygons, polygon_keys, cell, ring)
    below = (F.col("x0") <= F.col("_x")) & (F.col("_x") < F.col("x1")) & (_y_at(F.col("_x")) <= F.col("_y"))
    hits = p.join(e.hint("merge"), (F.col("p_cx") == F.col("_cx")) & (F.col("p_cy") == F.col("_cy")) & below)
    return hits.groupBy(*point_keys, *polygon_keys).agg(F.sum("w").alias("_w")).where("_w <> 0").drop("_w")


def meeting(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], cell: float, ring: str = "ring") -> DataFrame:
    """JOI14: pairs of polygons that share a point, each once.

    Either an edge of one touches one of the other, which then meet in a cell; or one
    lies inside the other, which a corner of each of its rings tells.
    """
    left_keys, right_keys = list(left_keys), list(right_keys)
    a, b = _outline(left, left_keys, cell, ring), _outline(right, right_keys, cell, ring)
    b = b.withColumnsRenamed({n: "r_" + n for n in (*CELL, *EDGE)})
    at = lambda e, n: F.col(e + n)

    def side(e: str, f: str, n: str) -> Column:
        """On which side of edge e end n of edge f lies."""
        dx, dy = at(e, "x1") - at(e, "x0"), at(e, "y1") - at(e, "y0")
        return F.signum(dx * (at(f, "y" + n) - at(e, "y0")) - dy * (at(f, "x" + n) - at(e, "x0")))

    on = (F.col("_cx") == F.col("r__cx")) & (F.col("_cy") == F.col("r__cy")) & (F.col("x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("x1"))
    on = on & (F.least("y0", "y1") <= F.greatest("r_y0", "r_y1")) & (F.least("r_y0", "r_y1") <= F.greatest("y0", "y1"))
    touch = (side("", "r_", "0") * side("", "r_", "1") <= 0) & (side("r_", "", "0") * side("r_", "", "1") <= 0)
    found = a.join(b.hint("merge"), on & touch).select(*left_keys, *right_keys)

    both = [*left_keys, *right_keys]
    found = found.unionByName(holds(_corners(left, left_keys, ring), right, left_keys, right_keys, cell, ring).select(*both))
    found = found.unionByName(holds(_corners(right, right_keys, ring), left, right_keys, left_keys, cell, ring).select(*both))
    return found.distinct()


# --- zones of pixels -----------------------------------------------------------------

#: Columns of a block in which runs and pixels meet.
BLOCK = 64


def pixel_runs(polygons: DataFrame, keys: Sequence[str], pixel: float, ring: str = "ring") -> DataFrame:
    """Polygons as scanlines: ``row`` and the columns ``c0`` to ``c1`` whose pixel centres lie inside.

    An edge crosses the line through the centres of each row it spans; crossings in order,
    with a running sum of the edges' directions, open and close runs.  Half open as
    ``point_in_ring``: centres on a left or lower border are inside.
    """
    keys = list(keys)
    p, q = F.col("_p"), F.col("_q")
    line = lambda y: F.ceil(y / pixel - 0.5).cast("bigint")  # noqa: E731  the first row whose centres are at y or above
    e = _edges(polygons, keys, ring).where(p["y"] != q["y"]).select(
        *keys, "_p", "_q", F.explode(F.sequence(line(F.least(p["y"], q["y"])), line(F.greatest(p["y"], q["y"])))).alias("row")
    )
    y = (F.col("row") + 0.5) * pixel
    e = e.where(((p["y"] > y) != (q["y"] > y)))
    x = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
    crossed = e.groupBy(*keys, "row", x.alias("x")).agg(F.sum(F.when(p["y"] > q["y"], 1).otherwise(-1)).alias("d")).where("d <> 0")
    along = Window.partitionBy(*keys, "row").orderBy("x")
    runs = crossed.select(*keys, "row", "x", F.lead("x").over(along).alias("end"), F.sum("d").over(along).alias("_in"))
    column = lambda v: F.ceil(v / pixel - 0.5).cast("bigint")
    runs = runs.where("_in <> 0 AND end IS NOT NULL").select(*keys, "row", column(F.col("x")).alias("c0"), (column(F.col("end")) - 1).alias("c1"))
    return runs.where("c0 <= c1")


def zones(pixels: DataFrame, polygons: DataFrame, keys: Sequence[str], pixel: float, ring: str = "ring") -> DataFrame:
    """JOI19: pixels, given by their centres (x, y), with the keys of the polygons that hold them.

    Runs and pixels meet in blocks of columns of a row, by range and without any geometry.
    """
    runs = pixel_runs(polygons, keys, pixel, ring)
    runs = runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK))))
    runs = runs.withColumnRenamed("row", "_row")
    p = pixels.withColumns({"_r": _floor(F.col("y"), pixel), "_c": _floor(F.col("x"), pixel)})
    on = (F.col("_r") == F.col("_row")) & (F.floor(F.col("_c") / BLOCK) == F.col("_block")) & F.col("_c").between(F.col("c0"), F.col("c1"))
    return p.join(runs.hint("merge"), on).drop("_r", "_c", "_row", "_block", "c0", "c1")


def zonal_histogram(pixels: DataFrame, polygons: DataFrame, key: str, pixel: float) -> DataFrame:
    """GEO13: pixel centres per polygon and ``value``."""
    return zones(pixels, polygons, [key], pixel).groupBy(key, "value").agg(F.count("*").alias("pixels"))


def zonal_mean(pixels: DataFrame, polygons: DataFrame, key: str, pixel: float) -> DataFrame:
    """GEO14: mean per polygon and tile, then the mean of the tiles' means."""
    per_tile = zones(pixels, polygons, [key], pixel).groupBy(key, "tile_id").agg(F.avg("value").alias("mean"))
    return per_tile.groupBy(key).agg(F.avg("mean").alias("mean"))
