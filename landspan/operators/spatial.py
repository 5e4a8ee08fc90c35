"""Spatial joins as equi-joins on grid cells.

Both sides are spread over the grid cells their boxes touch and meet on the cell
number.  A pair that shares several cells is kept only in the cell that holds the
lower left corner of the boxes' intersection, so no ``distinct`` (and no shuffle for
it) is needed.  Large boxes live on a coarser grid level, so they are not spread
over thousands of fine cells, and a cell with very many left rows is split by salt.

The results keep the aliases ``l`` and ``r``: refer to ``l.parcel_id``, ``r.geoid``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.functions import geometry as G
from landspan.operators.ranking import first_per
from landspan.session import cut

BOX = ("xmin", "ymin", "xmax", "ymax")
HOT_ROWS = 200_000
#: Pairs of rows of a cell that meet in one part of it, and the most tasks that parts are dealt to.
HOT_PAIRS, MOST_TASKS = 1 << 24, 8_192
FEW_CELLS = 16


def box_of(alias: str) -> dict[str, Column]:
    """Box columns of one join side, usable where a box struct is."""
    return {n: F.col(f"{alias}.{n}") for n in BOX}


def ring_of(df: DataFrame) -> Column:
    """The ring of a row: its own, or the corners of its box columns."""
    return F.col("ring") if "ring" in df.columns else G.box_ring(F.struct(*BOX))


def ringed(df: DataFrame) -> DataFrame:
    """``df`` with its ``ring_of``."""
    return df.withColumn("ring", ring_of(df))


def with_ring_box(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Add the box columns of a ring column."""
    b = G.ring_box(F.col(ring))
    return df.withColumns({n: b[n] for n in BOX})


def with_point_box(df: DataFrame, reach: float = 0.0) -> DataFrame:
    """Box columns of a point (x, y), grown by ``reach`` on every side."""
    return df.withColumns(
        {
            "xmin": F.col("x") - reach,
            "ymin": F.col("y") - reach,
            "xmax": F.col("x") + reach,
            "ymax": F.col("y") + reach,
        }
    )


def _cell(v: Column, size) -> Column:
    return F.floor(v / size).cast("bigint")


def _home(sizes: list[float]) -> Column:
    """Level of a box: the first on which it touches few cells."""

    def count(size: float) -> Column:
        return (_cell(F.col("xmax"), size) - _cell(F.col("xmin"), size) + 1) * (
            _cell(F.col("ymax"), size) - _cell(F.col("ymin"), size) + 1
        )

    home = F.lit(len(sizes) - 1)
    for level in reversed(range(len(sizes) - 1)):
        home = F.when(count(sizes[level]) <= FEW_CELLS, level).otherwise(home)
    return home


def _located(df: DataFrame) -> DataFrame:
    return df.where(F.col("xmin").isNotNull() & F.col("ymin").isNotNull())


def _spread(df: DataFrame, sizes: list[float], points: bool) -> DataFrame:
    """One row per touched cell on the row's home level and on every coarser one."""
    df = _located(df).withColumn("_home", F.lit(0) if points else _home(sizes))
    if len(sizes) > 1:
        df = df.withColumn("_level", F.explode(F.sequence("_home", F.lit(len(sizes) - 1))))
        size = F.element_at(F.array(*[F.lit(float(s)) for s in sizes]), F.col("_level") + 1)
        df = df.withColumn("_size", size)
    else:
        df = df.withColumns({"_level": F.lit(0), "_size": F.lit(float(sizes[0]))})
    size = F.col("_size")
    if points:
        return df.withColumns({"_cx": _cell(F.col("xmin"), size), "_cy": _cell(F.col("ymin"), size)})
    return df.withColumn(
        "_cx", F.explode(F.sequence(_cell(F.col("xmin"), size), _cell(F.col("xmax"), size)))
    ).withColumn("_cy", F.explode(F.sequence(_cell(F.col("ymin"), size), _cell(F.col("ymax"), size))))


CELL = ["_level", "_cx", "_cy"]
COARSER = 16


def _levels_used(sides: list[DataFrame], sizes: list[float]) -> int:
    """How many of the levels any box lives on (one narrow scan of the box columns)."""
    homes = [_located(s).select(_home(sizes).alias("h")) for s in sides]
    both = homes[0] if len(homes) == 1 else homes[0].unionByName(homes[1])
    return (both.agg(F.max("h")).first()[0] or 0) + 1


def _hot_cells(a: DataFrame, b: DataFrame, hot_rows: int) -> DataFrame:
    """Cells with many rows of a side or many pairs, and into how many parts each side is cut (``_na``, ``_nb``)."""
    a, b = (side.groupBy(*CELL).agg(F.count("*").alias(n)) for side, n in ((a, "_a"), (b, "_b")))
    one = F.lit(1).cast("bigint")
    both = a.join(b, CELL, "full").select(*CELL, F.coalesce("_a", one).alias("_a"), F.coalesce("_b", one).alias("_b"))
    both = both.withColumn("_pairs", F.col("_a").cast("double") * F.col("_b")).where((F.col("_a") > hot_rows) | (F.col("_b") > hot_rows) | (F.col("_pairs") > HOT_PAIRS))

    def parts(own: str, other: str) -> Column:
        rows = F.least(F.lit(float(hot_rows)), F.greatest(F.lit(math.sqrt(HOT_PAIRS)), HOT_PAIRS / F.col(other)))
        return F.ceil(F.col(own) / rows).cast("bigint")

    return both.select(*CELL, parts("_a", "_b").alias("_na"), parts("_b", "_a").alias("_nb"))


def _cut_hot(a: DataFrame, b: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with parts ``_pa`` and ``_pb``: a left row has one part and goes to all parts of the right, and so on.

    The part follows from the row itself, so a rerun of a lost task repeats it.  Both sides
    are dealt by cell and part to as many tasks as there are parts, since the work is in the
    pairs and not in the size of the rows.
    """
    hot = cut(_hot_cells(a, b, hot_rows))
    n = hot.agg(F.sum(F.col("_na") * F.col("_nb"))).first()[0]
    if not n:
        return a, b
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n, MOST_TASKS))
    out = []
    for side, own, other in ((a, "a", "b"), (b, "b", "a")):
        h = F.xxhash64(*[n for n, t in side.dtypes if "map<" not in t])
        side = side.join(hot, CELL, "left")
        mine, theirs = (F.coalesce(F.col(f"_n{x}"), F.lit(1).cast("bigint")) for x in (own, other))
        parts = F.explode(F.sequence(F.lit(0).cast("bigint"), theirs - 1))
        side = side.withColumn(f"_p{own}", F.pmod(h, mine)).withColumn(f"_p{other}", parts).drop("_na", "_nb")
        out.append(side.repartition(tasks, *CELL, "_pa", "_pb"))
    return out[0], out[1]


def box_join(
    left: DataFrame,
    right: DataFrame,
    cell: float,
    levels: int = 1,
    how_far: Column | None = None,
    hot_rows: int = HOT_ROWS,
    points: bool = False,
) -> DataFrame:
    """JOI14 / JOI15: all pairs whose boxes meet (each once), plus ``how_far``.

    With ``levels`` > 1 boxes too large for the cell live on cells 16 times as wide;
    levels nobody lives on are dropped.  ``points`` says that left boxes are points.

    Hot cells are found by a count of each side's rows per cell: those with more than
    ``hot_rows`` rows of a side, or with more than ``HOT_PAIRS`` pairs.  Either side's rows
    of such a cell are cut into parts and meet every part of the other side.
    """
    sizes = [cell * COARSER**i for i in range(levels)]
    if levels > 1:
        sizes = sizes[: _levels_used([right] if points else [left, right], sizes)]
    a, b = _spread(left, sizes, points), _spread(right, sizes, False)
    same_cell = F.lit(True)
    if len(sizes) > 1:
        same_cell = (F.col("l._home") == F.col("l._level")) | (F.col("r._home") == F.col("r._level"))
    a, b = _cut_hot(a, b, hot_rows)
    keys = [*CELL, *[p for p in ("_pa", "_pb") if p in a.columns]]
    a, b = a.alias("l"), b.alias("r")
    l, r = box_of("l"), box_of("r")
    for n in keys:
        same_cell = same_cell & (F.col("l." + n) == F.col("r." + n))
    owner = (
        _cell(F.greatest(l["xmin"], r["xmin"]), F.col("l._size")) == F.col("l._cx")
    ) & (_cell(F.greatest(l["ymin"], r["ymin"]), F.col("l._size")) == F.col("l._cy"))
    on = same_cell & owner & G.boxes_meet(l, r)
    return a.join(b.hint("merge"), on if how_far is None else on & how_far)


def inside(points: DataFrame, areas: DataFrame, cell: float, levels: int = 2) -> DataFrame:
    """JOI16: points (x, y) in areas (a ``ring`` column, else the box itself).

    Box containment is half open (low edge in, high edge out), so that tiles of a
    plane own every point once, as the ray cast does for rings.
    """
    p = with_point_box(points)
    x, y = F.col("l.x"), F.col("l.y")
    if "ring" in areas.columns:
        a = areas if "xmin" in areas.columns else with_ring_box(areas)
        hit = G.point_in_ring(x, y, F.col("r.ring"))
    else:
        a = areas
        r = box_of("r")
        hit = (x >= r["xmin"]) & (x < r["xmax"]) & (y >= r["ymin"]) & (y < r["ymax"])
    return box_join(p, a, cell, levels, hit, points=True)


def near(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """JOI17: pairs of points at most ``radius`` apart; adds ``distance``."""
    d = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"))
    pairs = box_join(
        with_point_box(left), with_point_box(right, radius), radius, how_far=d <= radius, points=True
    )
    return pairs.withColumn("distance", d)


def near_degrees(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """JOI17 on longitude / latitude: great-circle distance at most ``radius_m``.

    The search box is widened with latitude so that no near pair is missed.
    """
    lat = radius_m / 110_574.0
    lon = lat / F.greatest(F.cos(F.radians(F.least(F.abs("y") + lat, F.lit(89.9)))), F.lit(1e-3))
    wide = right.withColumns(
        {"xmin": F.col("x") - lon, "xmax": F.col("x") + lon, "ymin": F.col("y") - lat, "ymax": F.col("y") + lat}
    )
    d = G.haversine_m(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"))
    pairs = box_join(with_point_box(left), wide, 2 * lat, 2, d <= radius_m, points=True)
    return pairs.withColumn("distance", d)


#: Cells with so few pairs of points are not divided any further.
FEW_PAIRS = 64


def totals_near_degrees(left: DataFrame, right: DataFrame, key: str, values: list[str], radius_m: float) -> DataFrame:
    """JOI17 on longitude / latitude, summed up: per ``key`` the ``values`` of all right points within ``radius_m``.

    Pairs are counted in cells that halve from round to round: where all points of two cells
    are near each other the right cell's sums stand for its points, where none are the cells
    part, and only cells on the rim of the circle go on, down to single points.  Keys with
    no near point have no row.
    """
    located = "x IS NOT NULL AND y IS NOT NULL"
    left = cut(left.select(key, "x", "y").where(located))
    # points in one place are one with the sum of their values
    sums = [F.sum(v).alias(v) for v in values]
    right = cut(right.where(located).groupBy("x", "y").agg(*sums))
    lat = radius_m / 110_574.0
    size = 2 * lat
    a, b = _cells_with_box(left, size, "a_"), _cells_with_box(right, size, "b_")
    highest = F.greatest(F.abs("b_loy"), F.abs("b_hiy"))
    lon = lat / F.greatest(F.cos(F.radians(F.least(highest + lat, F.lit(89.9)))), F.lit(1e-3))
    boxed = lambda df, p, x, y: df.withColumns({"xmin": F.col(p + "lox") - x, "xmax": F.col(p + "hix") + x, "ymin": F.col(p + "loy") - y, "ymax": F.col(p + "hiy") + y}).select(p + "cx", p + "cy", *BOX)
    a_cell, b_cell = ["a_cx", "a_cy"], ["b_cx", "b_cy"]
    rest = box_join(boxed(a, "a_", F.lit(0.0), F.lit(0.0)), boxed(b, "b_", lon, F.lit(lat)), size, 2).select(*["l." + c for c in a_cell], *["r." + c for c in b_cell])
    col = lambda p, n, axis: F.col(f"{p}_{n}{axis}")
    square = lambda degrees: F.pow(F.sin(F.radians(degrees) / 2.0), F.lit(2.0))

    def apart(gap: bool) -> Column:
        """Least or largest haversine of points of the two cells."""
        x, y = ((F.greatest(col("b", "lo", d) - col("a", "hi", d), col("a", "lo", d) - col("b", "hi", d), F.lit(0.0)) if gap else F.greatest(col("b", "hi", d) - col("a", "lo", d), col("a", "hi", d) - col("b", "lo", d))) for d in "xy")
        cosine = F.lit(1.0)
        for p in "ab":
            lo, hi = F.abs(col(p, "lo", "y")), F.abs(col(p, "hi", "y"))
            least = F.when(col(p, "lo", "y") * col(p, "hi", "y") <= 0, 0.0).otherwise(F.least(lo, hi))
            cosine = cosine * F.cos(F.radians(F.greatest(lo, hi) if gap else least))
        h = square(y) + cosine * square(x)
        # beyond half a turn the haversine falls again
        return F.when(x > 180.0, F.lit(1.0)).otherwise(h)

    limit = math.sin(radius_m / 6371008.8 / 2.0) ** 2
    place = lambda p: (col(p, "lo", "x") == col(p, "hi", "x")) & (col(p, "lo", "y") == col(p, "hi", "y"))
    single = (F.col("a_n") * F.col("b_n") <= FEW_PAIRS) | (place("a") & place("b"))
    state = F.when(apart(True) > limit * (1 + 1e-9), "none").when(apart(False) < limit * (1 - 1e-9), "all").when(single, "single").otherwise("some")
    found = None
    up = lambda n: F.floor(F.col(n) / 2).cast("bigint")
    while True:
        size /= 2
        a = _cells_with_box(left, size, "a_", F.count("*").alias("a_n"))
        b = _cells_with_box(right, size, "b_", F.count("*").alias("b_n"), *sums)
        rest = rest.withColumnsRenamed({c: "u" + c for c in (*a_cell, *b_cell)})
        pairs = a.join(rest.hint("merge"), (up("a_cx") == F.col("ua_cx")) & (up("a_cy") == F.col("ua_cy")))
        pairs = pairs.join(b.hint("merge"), (up("b_cx") == F.col("ub_cx")) & (up("b_cy") == F.col("ub_cy")))
        kept = cut(pairs.select(*a_cell, *b_cell, *values, state.alias("_state")).where("_state <> 'none'"))
        here = (_cell(F.col("x"), size) == F.col("a_cx")) & (_cell(F.col("y"), size) == F.col("a_cy"))
        whole = kept.where("_state = 'all'").groupBy(*a_cell).agg(*sums)
        hits = left.join(whole.hint("merge"), here).select(key, *values)
        ends = kept.where("_state = 'single'").select(*a_cell, *b_cell)
        points = right.withColumnsRenamed({"x": "_x", "y": "_y"}).withColumns({"_bx": _cell(F.col("_x"), size), "_by": _cell(F.col("_y"), size)})
        ends = ends.join(points.hint("merge"), (F.col("b_cx") == F.col("_bx")) & (F.col("b_cy") == F.col("_by")))
        near_by = G.haversine_m(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) <= radius_m
        hits = hits.unionByName(left.join(ends.hint("merge"), here & near_by).select(key, *values))
        found = hits if found is None else found.unionByName(hits)
        rest = kept.where("_state = 'some'").select(*a_cell, *b_cell)
        if rest.isEmpty():
            return found.groupBy(key).agg(*sums)


#: A cell of left points is settled when so few right points may be the nearest of any of its points.
FEW_TARGETS = 16
#: Right cells are so many times smaller than the left cells they are weighed against.
FINER = 8


def _cells_with_box(points: DataFrame, size: float, p: str, *more: Column) -> DataFrame:
    """Cells (``p``cx, ``p``cy) that hold points, with the tight box of their points and ``more``."""
    box = [f(c).alias(p + n + c) for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(_cell(F.col("x"), size).alias(p + "cx"), _cell(F.col("y"), size).alias(p + "cy")).agg(*box, *more)


def _may_be_nearest(px: Column, py: Column) -> Column:
    """Whether some point of the left box may be as near to the right box as to the point (px, py).

    The square distance to a point less that to a box is convex along each axis, so its
    largest value lies at the ends of the left box.  Rounding never drops a tie.
    """
    gain, scale = F.lit(0.0), F.lit(0.0)
    for axis, at in (("x", px), ("y", py)):
        lo, hi = F.col("b_lo" + axis), F.col("b_hi" + axis)
        ends = []
        for end in (F.col("a_lo" + axis), F.col("a_hi" + axis)):
            off = F.greatest(lo - end, end - hi, F.lit(0.0))
            scale = scale + (end - at) * (end - at)
            ends.append((end - at) * (end - at) - off * off)
        gain = gain + F.greatest(*ends)
    return gain >= -1e-9 * scale


def nearest(
    left: DataFrame, right: DataFrame, key: str, target: str, cell: float
) -> DataFrame:
    """JOI18 / TRN05: the nearest right point of every left point (ties: lowest target).

    Left and right points are filed in cells, which halve from round to round.  A left cell
    keeps the right cells that may hold the nearest point of any of its points: those that
    one known point does not beat everywhere.  So pairs of cells stay few however far the
    right points are and however dense either side is; once few single points are left
    (at cells of about ``cell`` or wherever that is), these are compared with each left
    point.  Right points in one place count once, with the lowest target.
    """
    left = cut(left.select(F.col(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL"))
    right = right.select(F.col(target).alias("_target"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    right = cut(first_per(right.where("x IS NOT NULL AND y IS NOT NULL"), ["x", "y"], [F.asc("_target")]))
    x, y = F.col("x"), F.col("y")
    span = left.select("x", "y").unionByName(right.select("x", "y")).agg(F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("d")).first()["d"] or 0.0
    size = float(cell)
    while size * FINER < span:
        size *= 2
    a_cell, b_cell, pivot = ["a_cx", "a_cy"], ["b_cx", "b_cy"], ["p_x", "p_y"]
    one = Window.partitionBy(*a_cell)
    far = lambda axis, at: F.greatest(*[(F.col("a_" + n + axis) - at) * (F.col("a_" + n + axis) - at) for n in ("lo", "hi")])
    kept, found = None, None
    while True:
        a = _cells_with_box(left, size, "a_")
        b = _cells_with_box(right, size / FINER, "b_", F.min(F.struct("x", "y", "_target")).alias("_rep"))
        if kept is None:
            pairs = a.crossJoin(b)
        else:
            up = lambda n: F.floor(F.col(n) / 2).cast("bigint")
            rest = kept.where("NOT _done").select(*[F.col(c).alias("u" + c) for c in (*a_cell, *b_cell)], *pivot)
            pairs = a.join(rest.hint("merge"), (up("a_cx") == F.col("ua_cx")) & (up("a_cy") == F.col("ua_cy")))
            pairs = pairs.join(b.hint("merge"), (up("b_cx") == F.col("ub_cx")) & (up("b_cy") == F.col("ub_cy")))
            pairs = pairs.where(_may_be_nearest(F.col("p_x"), F.col("p_y"))).drop(*pivot)
        reach = far("x", F.col("_rep.x")) + far("y", F.col("_rep.y"))
        pairs = pairs.withColumn("_pivot", F.min(F.struct(reach.alias("d"), F.col("_rep.x").alias("x"), F.col("_rep.y").alias("y"))).over(one))
        pairs = pairs.withColumns({"p_x": F.col("_pivot.x"), "p_y": F.col("_pivot.y")}).where(_may_be_nearest(F.col("p_x"), F.col("p_y")))
        point = (F.col("b_lox") == F.col("b_hix")) & (F.col("b_loy") == F.col("b_hiy"))
        place = (F.col("a_lox") == F.col("a_hix")) & (F.col("a_loy") == F.col("a_hiy"))
        done = F.min(point).over(one) & (place | (F.count("*").over(one) <= FEW_TARGETS))
        kept = cut(pairs.select(*a_cell, *b_cell, *pivot, "_rep", done.alias("_done")))
        state = kept.agg(F.count_if("_done").alias("done"), F.count_if(~F.col("_done")).alias("todo")).first()
        if state["done"] or found is None:
            targets = kept.where("_done").select(*a_cell, "_rep.*").select(*a_cell, F.col("x").alias("_x"), F.col("y").alias("_y"), "_target")
            hits = left.join(targets.hint("merge"), (_cell(x, size) == F.col("a_cx")) & (_cell(y, size) == F.col("a_cy")))
            hits = hits.select(F.col(key), F.col("_target").alias(target), F.hypot(x - F.col("_x"), y - F.col("_y")).alias("distance"))
            found = hits if found is None else found.unionByName(hits)
        if not state["todo"]:
            return first_per(found, [key], [F.asc("distance"), F.asc(target)])
        size /= 2


def box_overlaps(
    left: DataFrame, right: DataFrame, cell: float, levels: int = 2
) -> DataFrame:
    """GEO03 / BAS11: box pairs with their ``overlap`` area (positive only)."""
    overlap = G.box_overlap_area(box_of("l"), box_of("r"))
    return box_join(left, right, cell, levels).withColumn("overlap", overlap).where("overlap > 0")


def only_positive(pairs: DataFrame, name: str, measure: Column) -> DataFrame:
    """Add a costly measure and keep rows above 0, computing it once per row.

    A plain filter would be merged with the projection and compute it twice; the
    generator keeps the two apart.
    """
    positive = F.filter(F.array(measure), lambda m: m > 0)
    return pairs.withColumn(name, F.explode(positive))


def union_overlap(targets: DataFrame, boxes: DataFrame, key: str, cell: float) -> DataFrame:
    """GEO10 / ANA01: area of each target box covered by the union of other boxes.

    Overlaps count once.  The clipped boxes are cut at every x edge of their target
    into slabs; within a slab the y ranges are merged by a running maximum.  Window
    state spills, so no group has to fit into memory.  Equal clipped boxes are
    dropped first.
    """
    l, r = box_of("l"), box_of("r")
    pieces = (
        box_join(targets, boxes, cell, levels=2)
        .select(
            F.col("l." + key).alias(key),
            F.greatest(l["xmin"], r["xmin"]).alias("x0"),
            F.least(l["xmax"], r["xmax"]).alias("x1"),
            F.greatest(l["ymin"], r["ymin"]).alias("y0"),
            F.least(l["ymax"], r["ymax"]).alias("y1"),
        )
        .where("x1 > x0 AND y1 > y0")
        .distinct()
    )
    cuts = (
        pieces.select(key, F.explode(F.array("x0", "x1")).alias("s0"))
        .distinct()
        .withColumn("s1", F.lead("s0").over(Window.partitionBy(key).orderBy("s0")))
        .where("s1 IS NOT NULL")
        .withColumnRenamed(key, "_key")
    )
    slabs = pieces.join(
        cuts,
        (F.col(key) == F.col("_key")) & (F.col("x0") <= F.col("s0")) & (F.col("x1") >= F.col("s1")),
    )
    before = (
        Window.partitionBy(key, "s0").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    )
    top = F.max("y1").over(before)
    grown = F.greatest(F.col("y1") - F.greatest(F.col("y0"), F.coalesce(top, F.col("y0"))), F.lit(0.0))
    return (
        slabs.withColumn("_grown", grown * (F.col("s1") - F.col("s0")))
        .groupBy(key)
        .agg(F.sum("_grown").alias("covered"))
    )


# --- lines -----------------------------------------------------------------------


def intersections(lines: DataFrame, step: float = 10.0, degree: int = 3) -> DataFrame:
    """GEO08: line ends snapped to a grid; places where ``degree`` or more ends meet.

    ``lines`` holds x1, y1, x2, y2.  Counts are pre-aggregated before the shuffle.
    """
    ends = lines.select(
        F.explode(
            F.array(
                F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
                F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")),
            )
        ).alias("p")
    )
    return (
        ends.select(G.snap(F.col("p.x"), step).alias("x"), G.snap(F.col("p.y"), step).alias("y"))
        .groupBy("x", "y")
        .agg(F.count("*").alias("degree"))
        .where(F.col("degree") >= degree)
    )


def count_near(places: DataFrame, points: DataFrame, key: str, radius: float) -> DataFrame:
    """BAS08: number of points within ``radius`` of every place (0 where none)."""
    counts = near(places.select(key, "x", "y"), points.select("x", "y"), radius).groupBy(
        F.col("l." + key).alias(key)
    ).agg(F.count("*").alias("n"))
    return places.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def lengths_inside(segments: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """GEO09: pairs of segment (x1, y1, x2, y2) and convex area with the ``length`` inside."""
    s = segments.withColumns(
        {
            "xmin": F.least("x1", "x2"),
            "xmax": F.greatest("x1", "x2"),
            "ymin": F.least("y1", "y2"),
            "ymax": F.greatest("y1", "y2"),
        }
    )
    a = areas
    if "ring" not in areas.columns:
        a = areas.withColumn("ring", G.box_ring(F.struct(*BOX)))
    elif "xmin" not in areas.columns:
        a = with_ring_box(areas)
    p = G.point(F.col("l.x1"), F.col("l.y1"))
    q = G.point(F.col("l.x2"), F.col("l.y2"))
    length = G.segment_length_in(p, q, F.col("r.ring"))
    return only_positive(box_join(s, a, cell, levels=2), "length", length)


# --- groups of points ------------------------------------------------------------

HULL_ROWS = 500


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """GEO11: convex hull of the points (x, y) of every key, with the point count.

    A group is hulled in parts of about 500 points first, so no task ever holds a
    whole hot group; only the parts' corner points meet in the end.  Points between
    the lowest and highest of an x column are dropped before.
    """
    # nothing strictly between two points of the same x can be a corner
    ends = points.groupBy(*keys, "x").agg(
        F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("_n")
    )
    sizes = ends.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.ceil(F.count("*") / HULL_ROWS).cast("int").alias("_parts")
    )
    p = F.array(G.point(F.col("x"), F.col("lo")), G.point(F.col("x"), F.col("hi")))
    parts = (
        ends.join(sizes, keys)
        .withColumn("_part", F.pmod(F.xxhash64("x"), F.col("_parts").cast("bigint")))
        .groupBy(*keys, "_part")
        .agg(F.first("n").alias("n"), F.flatten(F.collect_list(p)).alias("_pts"))
        .withColumn("_pts", G.convex_hull(F.col("_pts")))
    )
    return (
        parts.groupBy(*keys)
        .agg(F.first("n").alias("n"), F.flatten(F.collect_list("_pts")).alias("_pts"))
        .select(*keys, "n", G.convex_hull(F.col("_pts")).alias("hull"))
    )
