"""Geometry as plain columns.

A ring is ``array<struct<x:double,y:double>>`` without the repeated last point; a
box is ``struct<xmin,ymin,xmax,ymax>``.  Everything is built from higher-order
functions, so it runs in the JVM next to the data; there is no geometry library
and no Python per row.

A polygon of several rings (holes, parts) is one ring too: ``join_rings`` walks the
rings in turn, shells counter-clockwise and holes clockwise, over bridges from the first
point that are walked once each way.  What bridges add to area, centroid, ray cast and
clipping cancels out, so all of these are exact for it; only ``perimeter`` counts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from landspan.params import SQM_PER_ACRE

RING = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(
        (x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias("x"),
        (y if isinstance(y, Column) else F.lit(float(y))).cast("double").alias("y"),
    )


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ring_literal(points: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def box(xmin, ymin, xmax, ymax) -> Column:
    names = ("xmin", "ymin", "xmax", "ymax")
    return F.struct(*[v.cast("double").alias(n) for v, n in zip((xmin, ymin, xmax, ymax), names)])


def box_ring(b: Column) -> Column:
    """Corners of a box, counter-clockwise."""
    return F.array(
        point(b["xmin"], b["ymin"]),
        point(b["xmax"], b["ymin"]),
        point(b["xmax"], b["ymax"]),
        point(b["xmin"], b["ymax"]),
    )


def ring_box(ring: Column) -> Column:
    """GEO03: envelope."""
    xs, ys = ring["x"], ring["y"]  # of all points
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def edges(ring: Column) -> Column:
    """Edges p -> q around the ring."""

    def pairs(r: Column) -> Column:
        following = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
        return F.zip_with(r, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    return bind(ring, pairs)


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def signed_area(ring: Column) -> Column:
    return _sum(edges(ring), _cross) / 2.0


def area(ring: Column) -> Column:
    """GEO01: shoelace; 0 for an empty or degenerate ring."""
    return bind(ring, lambda r: F.when(F.size(r) >= 3, F.abs(signed_area(r))).otherwise(0.0))


def acres(ring: Column) -> Column:
    return area(ring) / SQM_PER_ACRE


def counter_clockwise(ring: Column) -> Column:
    return bind(ring, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))


def centroid(ring: Column) -> Column:
    """GEO06: area centroid (struct x, y), the vertex mean of a degenerate ring."""

    def from_sums(t: Column) -> Column:
        ok = t["twice"] != 0
        third = F.nullif(t["twice"], F.lit(0.0)) * 3.0
        return F.struct(
            F.when(ok, t["sx"] / third).otherwise(t["mx"]).alias("x"),
            F.when(ok, t["sy"] / third).otherwise(t["my"]).alias("y"),
        )

    def sums(r: Column) -> Column:
        n = F.nullif(F.size(r), F.lit(0)).cast("double")
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("twice", "sx", "sy")])

        def add(acc: Column, e: Column) -> Column:
            c = _cross(e)
            return F.struct(
                (acc["twice"] + c).alias("twice"),
                (acc["sx"] + (e["p"]["x"] + e["q"]["x"]) * c).alias("sx"),
                (acc["sy"] + (e["p"]["y"] + e["q"]["y"]) * c).alias("sy"),
            )

        return bind(
            F.aggregate(edges(r), zero, add),
            lambda a: F.struct(
                a["twice"].alias("twice"),
                a["sx"].alias("sx"),
                a["sy"].alias("sy"),
                (_sum(r, lambda p: p["x"]) / n).alias("mx"),
                (_sum(r, lambda p: p["y"]) / n).alias("my"),
            ),
        )

    return bind(bind(ring, sums), from_sums)


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: distance(e["p"], e["q"]))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on a sphere of radius 6371008.8 m."""
    dlat, dlon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    h = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), F.lit(2.0)
    )
    return 2.0 * 6371008.8 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """GEO06: even-odd ray cast to the right."""

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.coalesce(spans & (x < at), F.lit(False))

    hits = F.aggregate(
        edges(ring), F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0)
    )
    return F.when(x.isNotNull() & y.isNotNull() & ring.isNotNull(), hits % 2 == 1)


# --- boxes ---------------------------------------------------------------------


def boxes_meet(a: Column, b: Column) -> Column:
    """JOI15: envelopes share at least a point."""
    return (
        (a["xmin"] <= b["xmax"])
        & (b["xmin"] <= a["xmax"])
        & (a["ymin"] <= b["ymax"])
        & (b["ymin"] <= a["ymax"])
    )


def box_overlap_area(a: Column, b: Column) -> Column:
    """GEO03: area of envelope ∩ envelope."""
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(b: Column) -> Column:
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])


# --- clipping ------------------------------------------------------------------


def _side(a: Column, b: Column, p: Column) -> Column:
    """Positive on the left of the directed line a -> b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _keep_left(ring: Column, a: Column, b: Column) -> Column:
    """Part of the ring on the left of the directed line a -> b."""
    sided = F.transform(
        ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), _side(a, b, p).alias("s"))
    )

    def step(e: Column) -> Column:
        p, q = e["p"], e["q"]

        def cut(t: Column) -> Column:
            return point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)

        end = point(q["x"], q["y"])
        t = p["s"] / F.nullif(p["s"] - q["s"], F.lit(0.0))
        return (
            F.when((p["s"] >= 0) & (q["s"] >= 0), F.array(end))
            .when(p["s"] >= 0, F.array(bind(t, cut)))
            .when(q["s"] >= 0, F.array(bind(t, cut), end))
            .otherwise(F.array().cast(RING))
        )

    return F.flatten(F.transform(edges(sided), step))


def clip_convex(ring: Column, window: Column) -> Column:
    """GEO02 / GEO04: ring ∩ convex counter-clockwise window, half-plane by half-plane."""
    start = F.transform(ring, lambda p: point(p["x"], p["y"]))
    return F.aggregate(edges(window), start, lambda acc, e: _keep_left(acc, e["p"], e["q"]))


def clip_box(ring: Column, b: Column) -> Column:
    """GEO04: ring ∩ box."""
    return clip_convex(ring, box_ring(b))


def _uprights(ring: Column) -> Column:
    """Edges that are not vertical, left end first, with ``w``: +1 where the ring runs to the right."""

    def turned(e: Column) -> Column:
        right = e["p"]["x"] < e["q"]["x"]
        a, b = F.when(right, e["p"]).otherwise(e["q"]), F.when(right, e["q"]).otherwise(e["p"])
        w = F.when(right, 1.0).otherwise(-1.0)
        return F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), w.alias("w"))

    return F.transform(F.filter(edges(ring), lambda e: e["p"]["x"] != e["q"]["x"]), turned)


def _y_at(e: Column, x: Column) -> Column:
    return F.when(x == e["x1"], e["y1"]).otherwise(e["y0"] + (e["y1"] - e["y0"]) * (x - e["x0"]) / (e["x1"] - e["x0"]))


def overlap_area(ring: Column, window: Column) -> Column:
    """GEO02: area of ring ∩ window, of any shapes (0 if unknown).

    A ring is the sum, with sign, of what lies above each of its edges, so the overlap is
    the sum over pairs of edges of what lies above both.
    """

    def above(e: Column, f: Column, top: Column) -> Column:
        """Signed area above both edges up to ``top``, which cancels out."""
        l, r = F.greatest(e["x0"], f["x0"]), F.least(e["x1"], f["x1"])

        def measure(s: Column) -> Column:
            dl, dr = s["el"] - s["fl"], s["er"] - s["fr"]
            high = F.greatest(dl, dr)
            over = F.when((dl >= 0) & (dr >= 0), (dl + dr) / 2.0).when((dl <= 0) & (dr <= 0), 0.0)
            over = over.otherwise(high * high / (F.abs(dl - dr) * 2.0))
            return e["w"] * f["w"] * (r - l) * (top - (s["fl"] + s["fr"]) / 2.0 - over)

        ends = F.struct(_y_at(e, l).alias("el"), _y_at(e, r).alias("er"), _y_at(f, l).alias("fl"), _y_at(f, r).alias("fr"))
        return F.when(l < r, bind(ends, measure)).otherwise(0.0)

    top = F.get(ring, F.lit(0))["y"]
    total = bind(_uprights(window), lambda fs: _sum(_uprights(ring), lambda e: _sum(fs, lambda f: above(e, f, top))))
    return F.coalesce(F.abs(total), F.lit(0.0))


def _back(es: Column) -> Column:
    return F.transform(es, lambda e: F.struct(e["q"].alias("p"), e["p"].alias("q")))


def following(ring: Column) -> Column:
    """The next point of each point."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def is_bridged(ring: Column) -> Column:
    """Whether several rings were joined: only then the first point comes again."""
    return F.array_position(F.slice(ring, 2, F.size(ring)), F.get(ring, F.lit(0))) > 0


def rings_meet(a: Column, b: Column) -> Column:
    """JOI14: the polygons share a point: an edge of one crosses or touches one of the other, or one holds the other."""

    def touch(e: Column, f: Column) -> Column:
        s1, s2 = _side(e["p"], e["q"], f["p"]), _side(e["p"], e["q"], f["q"])
        t1, t2 = _side(f["p"], f["q"], e["p"]), _side(f["p"], f["q"], e["q"])
        near = (
            (F.least(e["p"]["x"], e["q"]["x"]) <= F.greatest(f["p"]["x"], f["q"]["x"]))
            & (F.least(f["p"]["x"], f["q"]["x"]) <= F.greatest(e["p"]["x"], e["q"]["x"]))
            & (F.least(e["p"]["y"], e["q"]["y"]) <= F.greatest(f["p"]["y"], f["q"]["y"]))
            & (F.least(f["p"]["y"], f["q"]["y"]) <= F.greatest(e["p"]["y"], e["q"]["y"]))
        )
        return near & (F.signum(s1) * F.signum(s2) <= 0) & (F.signum(t1) * F.signum(t2) <= 0)

    # the edges without bridges, which are walked both ways, and a corner of each of the joined rings
    def outline(r: Column) -> Column:
        return bind(edges(r), lambda es: F.array_except(es, _back(es)))

    def held(r: Column, by: Column) -> Column:
        ends = bind(edges(r), lambda es: F.transform(F.array_intersect(es, _back(es)), lambda e: e["q"]))
        return F.exists(F.concat(F.slice(r, 1, 1), ends), lambda p: point_in_ring(p["x"], p["y"], by))

    crossing = bind(outline(b), lambda fs: F.exists(outline(a), lambda e: F.exists(fs, lambda f: touch(e, f))))
    return F.coalesce(crossing | held(a, b) | held(b, a), F.lit(False))


def overlap_ratio(ring: Column, window: Column) -> Column:
    """GEO07: overlap / own area, at most 1."""
    return bind(
        area(ring),
        lambda own: F.when(own > 0, F.least(F.lit(1.0), overlap_area(ring, window) / own)).otherwise(0.0),
    )


def segment_length_in(p: Column, q: Column, window: Column) -> Column:
    """GEO09: length of segment p -> q inside a window of any shape.

    Along the axis that the segment runs along most, every edge of the window counts, with
    sign, the part of the segment above it.  A segment on a border is inside if the window
    lies above it (or to its right), so that it belongs to one of two neighbours.
    """

    def inside(s: Column) -> Column:
        a, b = F.when(s["p"]["x"] <= s["q"]["x"], s["p"]).otherwise(s["q"]), F.when(s["p"]["x"] <= s["q"]["x"], s["q"]).otherwise(s["p"])
        own = F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))

        def part(e: Column) -> Column:
            l, r = F.greatest(a["x"], e["x0"]), F.least(b["x"], e["x1"])

            def share(d: Column) -> Column:
                mixed = F.greatest(d["l"], d["r"]) / F.abs(d["l"] - d["r"])
                return F.when((d["l"] >= 0) & (d["r"] >= 0), 1.0).when((d["l"] < 0) & (d["r"] < 0), 0.0).otherwise(mixed)

            gap = F.struct((_y_at(own, l) - _y_at(e, l)).alias("l"), (_y_at(own, r) - _y_at(e, r)).alias("r"))
            return F.when(l < r, e["w"] * (r - l) * bind(gap, share)).otherwise(0.0)

        whole = b["x"] - a["x"]
        return F.when(whole > 0, F.abs(_sum(_uprights(s["ring"]), part)) / whole * distance(a, b)).otherwise(0.0)

    flip = lambda c: point(c["y"], c["x"])
    steep = F.abs(q["y"] - p["y"]) > F.abs(q["x"] - p["x"])
    turned = F.struct(
        F.when(steep, flip(p)).otherwise(point(p["x"], p["y"])).alias("p"),
        F.when(steep, flip(q)).otherwise(point(q["x"], q["y"])).alias("q"),
        F.when(steep, swap_axes(window)).otherwise(F.transform(window, lambda c: point(c["x"], c["y"]))).alias("ring"),
    )
    return bind(turned, inside)


# --- lines, hulls, repair --------------------------------------------------------


def line_start(line: Column) -> Column:
    """GEO08."""
    return F.try_element_at(line, F.lit(1))


def line_end(line: Column) -> Column:
    return F.try_element_at(line, F.lit(-1))


def line_segments(line: Column) -> Column:
    """Segments p -> q of an open line."""
    return F.slice(edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0)))


def line_length(line: Column) -> Column:
    return _sum(line_segments(line), lambda e: distance(e["p"], e["q"]))


def snap(v: Column, step: float) -> Column:
    """GEO08: nearest multiple of step."""
    return F.floor(v / step + 0.5) * step


def swap_axes(ring: Column) -> Column:
    """GEO12 / SRC17: (lat, lon) to (lon, lat)."""
    return F.transform(ring, lambda p: point(p["y"], p["x"]))


def clean_ring(ring: Column) -> Column:
    """GEO12: drop repeated neighbours; NULL when fewer than 3 points or no area."""
    kept = F.transform(
        F.filter(edges(ring), lambda e: (e["p"]["x"] != e["q"]["x"]) | (e["p"]["y"] != e["q"]["y"])),
        lambda e: e["p"],
    )
    return bind(kept, lambda k: F.when((F.size(k) >= 3) & (area(k) > 0), counter_clockwise(k)))


def convex_hull(points: Column) -> Column:
    """GEO11: monotone chain over the sorted distinct points (counter-clockwise)."""
    ordered = F.array_sort(F.array_distinct(points))

    def chain(pts: Column) -> Column:
        def turn(acc: Column, p: Column) -> Column:
            a, b = F.try_element_at(acc, F.lit(-2)), F.try_element_at(acc, F.lit(-1))
            return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def pop(acc: Column, p: Column) -> Column:
            # drop trailing points that do not make a left turn with p
            return F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.size(acc), F.lit(1))),
                acc,
                lambda kept, _i: F.when(
                    (F.size(kept) >= 2) & (turn(kept, p) <= 0),
                    F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))),
                ).otherwise(kept),
            )

        return F.aggregate(
            pts, F.array().cast(RING), lambda acc, p: F.concat(pop(acc, p), F.array(point(p["x"], p["y"])))
        )

    lower, upper = chain(ordered), chain(F.reverse(ordered))

    def without_last(a: Column) -> Column:
        return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))

    return F.when(F.size(ordered) < 3, ordered).otherwise(
        F.concat(without_last(lower), without_last(upper))
    )


def buffered_hull_area(hull: Column, radius: float) -> Column:
    """GEO11: area of a convex ring grown by radius: A + P r + pi r^2."""
    import math

    ring_perimeter = F.when(F.size(hull) >= 2, perimeter(hull)).otherwise(0.0)
    return area(hull) + ring_perimeter * radius + math.pi * radius * radius


# --- projections -----------------------------------------------------------------

# Ellipsoid (a, flattening) and projection constants by EPSG code.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_F = 1 / 298.257222101
ALBERS = {  # code: lat1, lat2, lat0, lon0, false easting, false northing
    3310: (34.0, 40.5, 0.0, -120.0, 0.0, -4000000.0),
    5070: (29.5, 45.5, 23.0, -96.0, 0.0, 0.0),
}


def _q(sin_phi, e: float):
    """Authalic function of the ellipsoid, for Columns and for floats."""
    import math

    if isinstance(sin_phi, Column):
        ln = F.log((1.0 - sin_phi * e) / (1.0 + sin_phi * e))
    else:
        ln = math.log((1.0 - sin_phi * e) / (1.0 + sin_phi * e))
    return (sin_phi / (1.0 - sin_phi * sin_phi * e**2) - ln * (1.0 / (2.0 * e))) * (1.0 - e**2)


def _albers(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    import math

    lat1, lat2, lat0, lon0, fe, fn = ALBERS[code]
    e = math.sqrt(GRS80_F * (2 - GRS80_F))

    def m(deg: float) -> float:
        s = math.sin(math.radians(deg))
        return math.cos(math.radians(deg)) / math.sqrt(1 - e * e * s * s)

    def q_at(deg: float) -> float:
        return _q(math.sin(math.radians(deg)), e)

    n = (m(lat1) ** 2 - m(lat2) ** 2) / (q_at(lat2) - q_at(lat1))
    big_c = m(lat1) ** 2 + n * q_at(lat1)
    rho0 = WGS84_A * math.sqrt(big_c - n * q_at(lat0)) / n
    rho = F.sqrt(big_c - _q(F.sin(F.radians(lat)), e) * n) * (WGS84_A / n)
    theta = F.radians(lon - lon0) * n
    return rho * F.sin(theta) + fe, rho0 - rho * F.cos(theta) + fn


def project(lon: Column, lat: Column, code: int) -> Column:
    """GEO05: degrees to projected metres (3857, 3310, 5070 or 6933)."""
    import math

    if code == 3857:
        x = F.radians(lon) * WGS84_A
        y = F.log(F.tan(F.radians(lat) / 2.0 + math.pi / 4)) * WGS84_A
    elif code in ALBERS:
        x, y = _albers(lon, lat, code)
    elif code == 6933:
        e = math.sqrt(WGS84_F * (2 - WGS84_F))
        s = math.sin(math.radians(30.0))
        k0 = math.cos(math.radians(30.0)) / math.sqrt(1 - e * e * s * s)
        x = F.radians(lon) * (WGS84_A * k0)
        y = _q(F.sin(F.radians(lat)), e) * (WGS84_A / (2 * k0))
    else:
        raise ValueError(f"no closed form for EPSG:{code}")
    return point(x, y)


def project_ring(ring: Column, code: int) -> Column:
    return F.transform(ring, lambda p: project(p["x"], p["y"], code))


def unproject_3857(x: Column, y: Column) -> Column:
    """3857 metres back to degrees."""
    import math

    lon = F.degrees(x / WGS84_A)
    lat = F.degrees(2.0 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)
    return point(lon, lat)


# --- parsing (GEO17) ---------------------------------------------------------------

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _points(text: Column, between: str) -> Column:
    """Number pairs of a text as points."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(rf"({NUMBER}{between}{NUMBER})"), F.lit(1)),
        lambda s: bind(F.split(s, between), lambda v: point(v[0].cast("double"), v[1].cast("double"))),
    )


def _open(pts: Column) -> Column:
    """Without the closing point."""

    def without_last(p: Column) -> Column:
        closed = (F.size(p) > 1) & (F.try_element_at(p, F.lit(1)) == F.try_element_at(p, F.lit(-1)))
        return F.when(closed, F.slice(p, 1, F.size(p) - 1)).otherwise(p)

    return bind(pts, without_last)


def join_rings(rings: Column) -> Column:
    """One ring from ``array<struct<ring, shell:boolean>>``: shells counter-clockwise, holes clockwise, bridged."""

    def turned(r: Column) -> Column:
        return bind(r["ring"], lambda p: F.when((signed_area(p) < 0) == r["shell"], F.reverse(p)).otherwise(p))

    def walk(rs: Column) -> Column:
        start = F.slice(F.get(rs, F.lit(0)), 1, 1)
        return F.aggregate(
            F.slice(rs, 2, F.greatest(F.size(rs) - 1, F.lit(0))),
            F.get(rs, F.lit(0)),
            lambda acc, r: F.concat(acc, start, r, F.slice(r, 1, 1)),
        )

    def joined(all_rings: Column) -> Column:
        return F.when(
            F.size(all_rings) == 1, F.get(all_rings, F.lit(0))["ring"]
        ).otherwise(bind(F.transform(all_rings, turned), walk))

    return bind(rings, joined)


def wkt_ring(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON text as one, or the points of a line or point text."""
    parts = F.regexp_extract_all(F.regexp_replace(wkt, r"\(\s+", "("), F.lit(r"(\(+[^()]+\))"), F.lit(1))
    rings = F.transform(parts, lambda t: F.struct(_open(_points(t, r"\s+")).alias("ring"), t.startswith("((").alias("shell")))
    line = _points(F.get(parts, F.lit(0)), r"\s+")
    pts = F.when(wkt.rlike(r"(?i)POLYGON"), join_rings(F.filter(rings, lambda r: F.size(r["ring"]) > 0))).otherwise(line)
    return bind(pts, lambda p: F.when(F.size(p) > 0, p))


def ring_wkt(ring: Column) -> Column:
    """Ring to POLYGON text, closing point repeated."""
    shown = F.transform(
        F.concat(ring, F.slice(ring, 1, 1)),
        lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")),
    )
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", shown), F.lit("))"))


GEOJSON_SCHEMA = "type string, coordinates string"


def geojson_ring(geometry: Column) -> Column:
    """All rings of a GeoJSON Polygon or MultiPolygon text as one."""
    coords = F.regexp_replace(F.get_json_object(geometry, "$.coordinates"), r"\s+", "")
    parts = F.regexp_extract_all(coords, F.lit(r"(\[+[^\[\]]+\](?:,\[[^\[\]]+\])*\])"), F.lit(1))
    # a shell opens its polygon: one bracket more than a hole, and one more for the list in front
    rings = F.transform(parts, lambda t: F.struct(_open(_points(t, r"\s*,\s*")).alias("ring"), t.startswith("[[[").alias("shell")))
    pts = join_rings(F.filter(rings, lambda r: F.size(r["ring"]) > 0))
    return bind(pts, lambda p: F.when(F.size(p) > 0, p))
