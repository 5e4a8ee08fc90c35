"""Land cover, base table and comparison (BAS08-09, BAS30-41, BAS43-44, ANA19, ANA22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators import overlay as O
from landspan.operators import spatial as S
from landspan.operators.allocate import SECTORS, SUB_SECTORS
from landspan.plans import canvas as C
from landspan.plans import comparison as Q
from landspan.plans import landcover as L
from landspan.plans import modules as M
from landspan.queries.alloc import JOBS, table_sql
from landspan.queries.analysis import num, nums, same
from landspan.queries.assessor import CODES, pick, pick_sql
from landspan.queries.binding import Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded
from landspan.queries.spatial import ENDS, HIT, IN_FRAME, PIXEL, PIXELS, ell, ell_meets, framed, in_ell, lot_rings, pixels

BOX = list(S.BOX)
NODES = dict(ends=ENDS, nodes="SELECT x, y FROM ends GROUP BY x, y HAVING count(*) >= 3")


@query(
    "BAS08_intersection_density",
    ctes("parcels", "roads", **NODES) + f"SELECT parcel_id, {num('count(b.x) / (pi() * 402e0 * 402e0 / 2589988.11e0)', 'intersection_density')} FROM parcels a LEFT JOIN nodes b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 402e0 * 402e0 GROUP BY parcel_id",
)
def intersection_density(t: Tables):
    return rounded(L.intersection_density(t.parcels, S.intersections(t.roads)))


@query(
    "BAS09_jurisdiction_density",
    ctes("parcels", "block_groups", "roads", **NODES)
    + f""", a AS (SELECT county_id AS j, sum((xmax - xmin) * (ymax - ymin) * 0.75e0) / 2589988.11e0 AS sm FROM block_groups GROUP BY county_id), h AS (SELECT county_id AS j, count(*) AS n FROM nodes a JOIN block_groups b ON {IN_FRAME} GROUP BY county_id)
    SELECT parcel_id, coalesce(d, 12.5e0) AS intersection_density FROM parcels LEFT JOIN (SELECT a.j, round(coalesce(n / nullif(sm, 0e0), 0e0), 2) AS d FROM a LEFT JOIN h ON h.j = a.j) x ON x.j = county_id""",
)
def jurisdiction_density(t: Tables):
    areas = framed(t.block_groups.select(F.col("county_id").alias("jurisdiction"), *BOX))
    parcels = t.parcels.select("parcel_id", F.col("county_id").alias("jurisdiction"))
    return L.jurisdiction_density(parcels, areas, S.intersections(t.roads), 500.0)


_SUB = ["residential", "developed", "industrial", "protected", "water"]
_CLS = ["retail", "quarry", "conservation", "none"]
LU = f"SELECT geoid AS id, {pick_sql('geoid', _SUB)} AS subtype, {pick_sql('size', _CLS)} AS class, xmin, ymin, xmin + (size % 7) * 60e0 + 40e0 AS xmax, ymin + 300e0 AS ymax FROM blocks"
_LUT = " UNION ALL ".join(
    f"SELECT '{subtype}' AS subtype, {'NULL' if kind is None else repr(kind)} AS class, '{category}' AS category" for subtype, kind, category in L.LAND_USE_MAP
)


@query(
    "BAS30_land_use_class",
    ctes("parcels", "blocks", lu=LU, lut=_LUT)
    + f""", c AS (SELECT * FROM (SELECT parcel_id, b.*, row_number() OVER (PARTITION BY parcel_id ORDER BY (b.xmax - b.xmin) * (b.ymax - b.ymin), b.id) AS rn FROM parcels a JOIN lu b ON {in_ell('a', 'b')}) WHERE rn = 1),
    v AS (SELECT * FROM (SELECT parcel_id, b.*, row_number() OVER (PARTITION BY parcel_id ORDER BY (b.xmax - b.xmin) * (b.ymax - b.ymin) DESC, b.id) AS rn FROM parcels a JOIN lu b ON {ell_meets('b', 'a')} WHERE parcel_id NOT IN (SELECT parcel_id FROM c)) WHERE rn = 1),
    u AS (SELECT parcel_id, subtype, class FROM c UNION ALL SELECT parcel_id, subtype, class FROM v)
    SELECT parcel_id, u.subtype, u.class, coalesce(e.category, l.category, 'urban') AS category FROM u LEFT JOIN lut e ON e.subtype = u.subtype AND e.class = u.class LEFT JOIN lut l ON l.subtype = u.subtype AND l.class IS NULL""",
)
def land_use_class(t: Tables):
    areas = t.blocks.select(
        F.col("geoid").alias("id"), pick(F.col("geoid"), _SUB).alias("subtype"), pick(F.col("size"), _CLS).alias("class"), "xmin", "ymin",
        (F.col("xmin") + (F.col("size") % 7) * 60.0 + 40.0).alias("xmax"), (F.col("ymin") + 300.0).alias("ymax"),
    )
    return L.land_use_of_parcels(t.parcels, ell(areas), L.land_use_table(t.spark), 200.0)


COVER = [11, 21, 22, 23, 24, 31, 41, 82, 90, 7]
PX2 = PIXELS.replace("l_partkey % 5 AS class", f"([{', '.join(map(str, COVER))}])[1 + l_partkey % 10] AS class")
ZONAL = f"SELECT b.parcel_id, a.class AS value, count(*) AS n FROM px a JOIN parcels b ON abs(b.x - a.x) <= 50 AND {HIT} GROUP BY b.parcel_id, a.class"
_SHARE = "CASE value " + " ".join(f"WHEN {k} THEN {v}e0" for k, v in L.SEALED_SHARE.items()) + " ELSE 0e0 END"
_CATS = "CASE " + " ".join(f"WHEN m IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in L.COVER_CATEGORY.items()) + " ELSE 'unknown' END"


def cover_pixels(t: Tables):
    p = pixels(t, "canopy").drop("value")
    code = F.element_at(F.array(*map(F.lit, COVER)), (F.col("l_partkey") % 10 + 1).cast("int"))
    ok = F.col("l_orderkey")
    return t.lineitem.select(
        (F.col("l_suppkey") % 8).alias("tile_id"), ((ok % 400) * 100.0 + (F.col("l_linenumber") % 4) * 25.0 + 12.5).alias("x"),
        (F.floor(ok / 400) * 100.0 + (F.col("l_partkey") % 4) * 25.0 + 12.5).alias("y"), code.alias("value"),
    )


@query(
    "BAS31_land_cover_class",
    ctes("parcels", px=PX2, z=ZONAL)
    + f""", s AS (SELECT parcel_id, arg_max(value, n * 1000 - value) AS m, sum(n * ({_SHARE})) / sum(n) AS f FROM z GROUP BY parcel_id)
    SELECT p.parcel_id, {_CATS} AS land_development_category, {num('coalesce(f, 0e0)', 'impervious_fraction', 6)} FROM parcels p LEFT JOIN s ON s.parcel_id = p.parcel_id""",
)
def land_cover_class(t: Tables):
    h = O.zonal_histogram(cover_pixels(t), lot_rings(t), "parcel_id", PIXEL)
    return rounded(L.land_cover_stats(t.parcels, h), 6)


@query(
    "BAS32_tree_canopy",
    ctes("parcels", px=PIXELS)
    + f"SELECT p.parcel_id, {num('CASE WHEN m IS NOT NULL THEN least(greatest(m, 0e0), 100e0) END', 'tree_canopy_fraction')} FROM parcels p LEFT JOIN (SELECT parcel_id, avg(m) AS m FROM (SELECT b.parcel_id, tile_id, avg(canopy * 3e0) AS m FROM px a JOIN parcels b ON abs(b.x - a.x) <= 50 AND {HIT} GROUP BY b.parcel_id, tile_id) GROUP BY parcel_id) x ON x.parcel_id = p.parcel_id",
)
def tree_canopy(t: Tables):
    px = pixels(t, "canopy").withColumn("value", F.col("value") * 3.0)
    return rounded(L.canopy(t.parcels, O.zonal_mean(px, lot_rings(t), "parcel_id", PIXEL)))


@query(
    "BAS33_road_lengths",
    ctes("blocks", "roads")
    + f""", l AS (SELECT geoid, CASE WHEN surface IS NULL OR surface IN ('paved', 'asphalt', 'concrete') THEN 'paved' WHEN surface IN ('unpaved', 'gravel', 'dirt', 'earth', 'ground') THEN 'unpaved' ELSE 'other' END AS k, least(x2, r) - greatest(x1, xmin) AS len
      FROM roads JOIN (SELECT *, xmin AS l, xmax AS r, ymin AS b, (ymin + ymax) / 2e0 AS t FROM blocks UNION ALL SELECT *, xmin, (xmin + xmax) / 2e0, (ymin + ymax) / 2e0, ymax FROM blocks) q ON y1 >= q.b AND y1 < q.t AND x2 > xmin AND x1 < r), s AS (SELECT geoid, coalesce(sum(CASE WHEN k = 'paved' THEN len END), 0e0) AS p, coalesce(sum(CASE WHEN k = 'unpaved' THEN len END), 0e0) AS u, coalesce(sum(CASE WHEN k = 'other' THEN len END), 0e0) AS o, sum(len) AS t FROM l GROUP BY geoid)
    SELECT b.geoid AS parcel_id, """ + nums(road_paved_length_m="coalesce(p, 0e0)", road_unpaved_length_m="coalesce(u, 0e0)", road_other_length_m="coalesce(o, 0e0)", road_total_length_m="coalesce(t, 0e0)",
                                            road_impervious_fraction="coalesce(p / nullif(t, 0e0), 0e0)", parcel_area_gross="120000e0 / 4046.86e0") + " FROM blocks b LEFT JOIN s ON s.geoid = b.geoid",
)
def road_lengths(t: Tables):
    # L-shaped blocks; the upper edge belongs to the next one
    return rounded(L.road_lengths(ell(t.blocks.select(F.col("geoid").alias("parcel_id"), *BOX)), t.roads, 200.0))


_LL = "-122e0 + (k % 50) * 0.004e0", "38e0 + (k % 31) * 0.003e0"


def _hav(a: str, b: str) -> str:
    return f"2e0 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians({b}.y - {a}.y) / 2e0), 2) + cos(radians({a}.y)) * cos(radians({b}.y)) * pow(sin(radians({b}.x - {a}.x) / 2e0), 2))))"


@query(
    "ANA19_food_index",
    f"""WITH a AS (SELECT c_custkey AS parcel_id, {_LL[0].replace('k %', 'c_custkey * 7 %')} AS x, {_LL[1].replace('k %', 'c_custkey %')} AS y FROM customer), b AS (SELECT s_suppkey % 3 = 0 AS h, {_LL[0].replace('k %', 's_suppkey * 3 %')} + 0.0007e0 AS x, {_LL[1].replace('k %', 's_suppkey * 5 %')} + 0.0011e0 AS y FROM supplier WHERE s_suppkey % 4 <> 1),
    n AS (SELECT parcel_id, count(*) FILTER (WHERE h) AS hc, count(*) FILTER (WHERE NOT h) AS uc FROM a JOIN b ON {_hav('a', 'b')} <= 1000 GROUP BY parcel_id)
    SELECT a.parcel_id, coalesce(hc, 0) AS healthy_count, coalesce(uc, 0) AS unhealthy_count, {num('hc * 1e0 / nullif(hc + uc, 0) * 100e0', 'mrfei')} FROM a LEFT JOIN n ON n.parcel_id = a.parcel_id""",
)
def food_index(t: Tables):
    a = t.customer.selectExpr("c_custkey AS parcel_id", _LL[0].replace("k %", "c_custkey * 7 %") + " AS x", _LL[1].replace("k %", "c_custkey %") + " AS y")
    k = F.col("s_suppkey")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("shop"), F.lit("supermarket"))).when(k % 2 == 0, F.create_map(F.lit("amenity"), F.lit("fast_food"))).otherwise(F.create_map(F.lit("shop"), F.lit("convenience")))
    tags = F.when((k % 4 == 1), F.create_map(F.lit("shop"), F.lit("shoes"))).otherwise(tags)
    pois = t.supplier.select(F.expr(_LL[0].replace("k %", "s_suppkey * 3 %") + " + 0.0007e0").alias("x"), F.expr(_LL[1].replace("k %", "s_suppkey * 5 %") + " + 0.0011e0").alias("y"), tags.alias("tags"))
    return rounded(L.food_index(a, L.food_shops(pois)))


_EQ = list(M.EQUITY_DEFAULTS)


@query(
    "ANA22_acs_equity",
    ctes("parcels", "block_groups")
    + f""", c AS (SELECT o_orderkey AS parcel_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0e0 ELSE 61000e0 END AS median_income, (o_orderkey % 4) * 10e0 AS rent_burden_pct, 0e0 AS pct_minority, CASE WHEN o_orderkey % 2 = 0 THEN 25e0 END AS pct_college_educated FROM orders),
    z AS (SELECT parcel_id, b.* FROM parcels a JOIN block_groups b ON {HIT}) SELECT c.parcel_id, """
    + nums(**{n: f"coalesce(nullif(c.{n}, 0e0), nullif(z.{n}, 0e0), {d}e0)" for n, d in M.EQUITY_DEFAULTS.items()}) + " FROM c LEFT JOIN z ON z.parcel_id = c.parcel_id",
)
def acs_equity(t: Tables):
    k = F.col("o_orderkey")
    canvas = t.orders.select(
        k.alias("parcel_id"), F.when(k % 3 == 1, 0.0).when(k % 3 == 2, 61000.0).alias("median_income"), ((k % 4) * 10.0).alias("rent_burden_pct"),
        F.lit(0.0).alias("pct_minority"), F.when(k % 2 == 0, 25.0).alias("pct_college_educated"),
    )
    zones = S.inside(t.parcels.select("parcel_id", "x", "y"), t.block_groups.select(*_EQ, *BOX), 500.0)
    return rounded(M.acs_equity(canvas, zones.select("l.parcel_id", *["r." + n for n in _EQ])))


# --- the base table ---------------------------------------------------------------------

LABELS = ["Airport", "Farm Home", "Water", "Residential/Retail Mixed Use Low", "Unknown thing", " Mobile Home Park "]
CATS = ["urban", "", "industrial", "agricultural", "mixed_use", "undeveloped", None, "urban"]


def _null(n: int, v: str) -> str:
    return f"CASE WHEN o_orderkey % {n} = 0 THEN NULL ELSE {v} END"


ROW = {
    "parcel_id": "o_orderkey", "area_m2": "floor(o_totalprice / 10e0)", "county": "o_custkey % 25",
    "intersection_density": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 0e0 ELSE (o_custkey % 90) * 0.75e0 END",
    "du_total": "(o_custkey % 3) * 1e0", "du": _null(9, "(o_custkey % 13) * 1e0"), "pop": _null(8, "(o_custkey % 40) * 1e0"), "hh": _null(7, "(o_custkey % 15) * 1e0"),
    "emp": _null(6, "(o_custkey % 21) * 1e0"), "vacancy_rate": _null(4, "0.06e0"), "emp_military": "0.5e0 * (o_custkey % 2)", "emp_ag": "1e0 * (o_custkey % 3)",
}
ROW |= {"du_" + s: f"CASE WHEN o_orderkey % 10 = 3 THEN 0e0 WHEN o_orderkey % {11 + i} = 0 THEN NULL ELSE (o_custkey * {i + 2} % 5) * 0.5e0 END" for i, s in enumerate(C.SUBTYPES)}
ROW |= {f"emp_{s}": _null(5 + i, f"(o_custkey % {7 + i}) * 1e0") for i, s in enumerate(("ret", "off", "pub", "ind"))}
ROW |= {f"emp_{s}": _null(13 + i, f"(o_custkey * {i + 2} % 9) * 0.25e0") for i, s in enumerate(SUB_SECTORS) if s != "military"}
ROW |= {f"bldg_area_{s}": f"CASE WHEN o_orderkey % {3 + i % 4} = 0 THEN (o_custkey % 50) * 10e0 END" for i, s in enumerate([*C.HOME_AREAS, "mf", *C.JOB_AREAS])}
ROW |= {"residential_building_sqft": "CASE WHEN o_custkey % 4 = 0 THEN 0e0 ELSE (o_custkey % 60) * 25e0 END", "commercial_building_sqft": "CASE WHEN o_custkey % 3 = 0 THEN 0e0 ELSE (o_custkey % 30) * 20e0 END",
        "industrial_building_sqft": "(o_custkey % 7) * 15e0", "other_building_sqft": _null(12, "(o_custkey % 5) * 12e0")}
ROW |= {n: f"CASE WHEN o_orderkey % {4 + i} = 1 THEN {i + 1}.5e0 END" for i, n in enumerate(("area_parcel_res", "area_parcel_emp_ag", "area_parcel_emp", "area_parcel_mixed_use", "area_parcel_no_use", "residential_irrigated_area", "commercial_irrigated_area"))}
ROW |= {"impervious_fraction": "CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 10) * 0.05e0 END"}
_PICKS = {"land_development_category": ("o_orderkey", CATS), "assessor_use_code": ("o_custkey", CODES), "land_use": ("o_orderkey", LABELS), "built_form_key": ("o_custkey", ["", "bf1", None]), "overture_category": ("o_custkey", [None, "conservation"])}


def _arr(values) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + "]"


ROW_SQL = "SELECT " + ", ".join([f"{v} AS {k}" for k, v in ROW.items()] + [f"({_arr(vs)})[cast(1 + {k} % {len(vs)} AS int)] AS {n}" for n, (k, vs) in _PICKS.items()]) + " FROM orders"


def rows(t: Tables):
    return t.orders.select(*[F.expr(v).alias(k) for k, v in ROW.items()], *[pick(F.col(k), vs).alias(n) for n, (k, vs) in _PICKS.items()])


_USE = """CASE WHEN left({c}, 2) IN ('10','11','12','13','14','15','16','17','18') THEN 'urban' WHEN left({c}, 2) IN ('20','21','22','23','24','30','31','32','80','81','82','83','90') THEN 'industrial'
    WHEN left({c}, 2) IN ('40','41','42','43','44','45','46') THEN 'agricultural' WHEN left({c}, 2) IN ('50','51','52','53','60','61','62','63','70','71') THEN 'undeveloped' END""".replace("{c}", "coalesce(assessor_use_code, '')")
_R9 = "cast(round(cast({} AS DECIMAL(30, 9)), {}) AS DOUBLE)"


@query(
    "BAS34_canvas_geometry",
    f"""WITH r AS ({ROW_SQL}), e AS (SELECT l_orderkey AS parcel_id, max(l_quantity) AS intersection_density, 'e' || min(l_returnflag) AS built_form_key, sum(l_quantity) AS sqft FROM lineitem WHERE l_linenumber < 4 GROUP BY l_orderkey),
    g AS (SELECT *, {_R9.format('area_m2 / 4046.86e0', 4)} AS area_gross, coalesce(nullif(land_development_category, ''), {_USE}, '') AS cat FROM r)
    SELECT g.parcel_id, cat AS land_development_category, coalesce(e.built_form_key, g.built_form_key) AS built_form_key, """
    + nums(intersection_density="coalesce(e.intersection_density, g.intersection_density)", area_gross="area_gross", area_gross_acres="area_gross", area_parcel_acres="area_gross",
           area_dev_condition_acres=_R9.format("area_gross * 0.7e0", 4), area_row_acres=_R9.format("area_gross * 0.15e0", 4), sqft="sqft") + " FROM g LEFT JOIN e ON e.parcel_id = g.parcel_id",
)
def canvas_geometry(t: Tables):
    e = t.lineitem.where("l_linenumber < 4").groupBy(F.col("l_orderkey").alias("parcel_id")).agg(
        F.max("l_quantity").alias("intersection_density"), F.concat(F.lit("e"), F.min("l_returnflag")).alias("built_form_key"), F.sum("l_quantity").alias("sqft")
    )
    out = C.geometry(rows(t), e, ["intersection_density", "built_form_key", "sqft"])
    return rounded(out.select("parcel_id", "land_development_category", "built_form_key", "intersection_density", "area_gross", "area_gross_acres", "area_parcel_acres", "area_dev_condition_acres", "area_row_acres", "sqft"))


def _cal(i: int) -> str:
    return "CASE coalesce(nullif(land_development_category, ''), 'urban') " + " ".join(f"WHEN '{c}' THEN {v[i]}e0" for c, v in C.CALIBRATION.items()) + " END"


_LAB = "CASE " + " ".join(f"WHEN trim(coalesce(land_use, '')) IN ({', '.join(repr(n) for n in ns)}) THEN '{c}'" for c, ns in C.LAND_USE_LABELS.items()) + " END"
_HOMES = {s: f"coalesce(bldg_area_{s}, coalesce(du_{s}, 0e0) * coalesce({_cal(0)}, {d}e0))" for s, d in C.HOME_AREAS.items()}
_SEC = {s: f"greatest(0e0, coalesce(emp_{s}, emp * {sh}e0))" for s, sh in C.SECTOR_SHARES.items()}
_CI = {r: i for i, r in enumerate(C.CALIBRATION_COLUMNS)}
_JOBA = {s: f"coalesce(bldg_area_{s}, CASE WHEN {sq} > 0 THEN {sq} * (coalesce(emp_{s}, 0e0) / nullif({_SEC[sec]}, 0e0)) END, emp_{s} * coalesce({_cal(_CI[r])}, {d}e0))" for s, (sec, sq, r, d) in C.JOB_AREAS.items()}
_CANVAS = f"""r AS ({ROW_SQL}), g AS (SELECT *, {_R9.format('area_m2 / 4046.86e0', 4)} AS lot, coalesce(residential_building_sqft, 0e0) AS rs, coalesce(commercial_building_sqft + industrial_building_sqft + other_building_sqft, 0e0) AS ws,
    coalesce(residential_building_sqft, 0e0) + coalesce(commercial_building_sqft, 0e0) + coalesce(industrial_building_sqft, 0e0) + coalesce(other_building_sqft, 0e0) AS bs, coalesce(nullif(land_development_category, ''), {_USE}, {_LAB}, overture_category, 'urban') AS cat FROM r),
    h AS (SELECT *, coalesce(du_total, 0e0) > 0 AND rs > 0 AND cat IN ('urban', 'mixed_use') AS lived, bs > 0 AND coalesce(bs / nullif(lot * 43560e0, 0e0) >= 0.05e0, false) AS dense FROM g),
    u AS (SELECT * EXCLUDE (area_parcel_res, area_parcel_emp), CASE WHEN lived THEN lot WHEN cat IN ('industrial', 'agricultural', 'undeveloped') THEN 0e0 WHEN cat IN ('urban', 'mixed_use') AND dense THEN rs * (lot / nullif(bs, 0e0)) WHEN cat IN ('urban', 'mixed_use') THEN 0e0 ELSE area_parcel_res END AS ares,
      CASE WHEN lived THEN 0e0 WHEN dense THEN ws * (lot / nullif(bs, 0e0)) WHEN cat = 'industrial' THEN lot WHEN cat IN ('urban', 'mixed_use', 'agricultural', 'undeveloped') THEN 0e0 ELSE coalesce(area_parcel_emp, 0e0) END AS aemp FROM h)"""


def _irr(own: str, area: str, i: int, d: float) -> str:
    return f"coalesce({own}, coalesce({area}, lot) * coalesce(nullif(impervious_fraction, 0e0), {_cal(i)}, {d}e0))"


@query(
    "BAS35_canvas_attributes",
    f"WITH {_CANVAS} SELECT parcel_id, cat AS land_development_category, coalesce(nullif(built_form_key, ''), 'mixed_use') AS built_form_key, "
    + nums(**{"bldg_area_" + s: v for s, v in {**_HOMES, "mf": "coalesce(bldg_area_mf, (coalesce(du_mf2to4, 0e0) + coalesce(du_mf5p, 0e0)) * 1500e0)", **_JOBA}.items()},
           area_parcel_res="ares", area_parcel_emp="aemp", area_parcel_emp_ag="CASE WHEN cat = 'agricultural' THEN lot ELSE area_parcel_emp_ag END", area_parcel_mixed_use="CASE WHEN cat = 'mixed_use' THEN lot ELSE area_parcel_mixed_use END",
           area_parcel_no_use="CASE WHEN lived OR dense THEN 0e0 WHEN cat IN ('urban', 'mixed_use', 'undeveloped') THEN lot ELSE area_parcel_no_use END",
           residential_irrigated_area=_irr("residential_irrigated_area", "ares", 5, 0.064), commercial_irrigated_area=_irr("commercial_irrigated_area", "aemp", 6, 0.035),
           intersection_density=_R9.format(f"coalesce(nullif(intersection_density, 0e0), {_cal(7)}, 12.5e0)", 2), occupied_du=_R9.format("coalesce(du, 0e0) * (1e0 - coalesce(vacancy_rate, 0e0))", 2)) + " FROM u",
)
def canvas_attributes(t: Tables):
    raw = rows(t)
    g = raw.withColumn("area_gross", X.round_decimal(F.col("area_m2") / 4046.86, 4))
    g = g.withColumns({"area_gross_acres": F.col("area_gross"), "area_parcel_acres": F.col("area_gross")})
    out = C.attributes(g)
    keep = ["bldg_area_" + s for s in [*C.HOME_AREAS, "mf", *C.JOB_AREAS]] + ["area_parcel_res", "area_parcel_emp", "area_parcel_emp_ag", "area_parcel_mixed_use", "area_parcel_no_use", "residential_irrigated_area", "commercial_irrigated_area", "intersection_density", "occupied_du"]
    return rounded(out.select("parcel_id", "land_development_category", "built_form_key", *keep))


_BLANK = "du > 0 AND " + " AND ".join(f"coalesce(du_{s}, 0e0) = 0" for s in C.SUBTYPES)
_IMP = f"""r0 AS ({ROW_SQL}), r AS (SELECT *, CASE WHEN parcel_id % 3 = 0 THEN NULL ELSE du_detsf_sl + du_detsf_ll END AS du_detsf, CASE WHEN parcel_id % 4 = 0 THEN NULL ELSE du_mf2to4 + du_mf5p END AS du_mf FROM r0),
    a AS (SELECT county AS c, {', '.join(f'avg({n}) AS a_{n}' for n in ('pop', 'hh', 'du', 'emp', 'intersection_density'))} FROM r GROUP BY county),
    p AS (SELECT county AS c, {', '.join(f'sum(du_{s}) / nullif(sum(du), 0e0) AS p_{s}' for s in C.SUBTYPES)} FROM r WHERE du > 0 AND du_detsf_sl IS NOT NULL GROUP BY county),
    i AS (SELECT r.* EXCLUDE (pop, hh, du, emp, intersection_density, du_detsf, du_mf, {', '.join('du_' + s for s in C.SUBTYPES)}), coalesce(pop, a_pop, 0e0) AS pop, coalesce(hh, a_hh, 0e0) AS hh, coalesce(du, a_du, 0e0) AS du, coalesce(emp, a_emp, 0e0) AS emp,
      {_R9.format('coalesce(intersection_density, a_intersection_density, 12.5e0)', 2)} AS intersection_density, coalesce(du_detsf, p_detsf_sl * coalesce(du, a_du, 0e0) + p_detsf_ll * coalesce(du, a_du, 0e0), 0e0) AS du_detsf, coalesce(du_mf, p_mf2to4 * coalesce(du, a_du, 0e0) + p_mf5p * coalesce(du, a_du, 0e0), 0e0) AS du_mf,
      {', '.join(f'CASE WHEN {_BLANK} THEN coalesce(p_{s} * du, 0e0) ELSE coalesce(du_{s}, p_{s} * coalesce(du, a_du, 0e0), 0e0) END AS du_{s}' for s in C.SUBTYPES)} FROM r LEFT JOIN a ON a.c = county LEFT JOIN p ON p.c = county)"""


def imputed(t: Tables):
    k = F.col("parcel_id")
    r = rows(t).withColumns(
        {"du_detsf": F.when(k % 3 != 0, F.col("du_detsf_sl") + F.col("du_detsf_ll")), "du_mf": F.when(k % 4 != 0, F.col("du_mf2to4") + F.col("du_mf5p"))}
    )
    return C.impute(r)


_IC = ["pop", "hh", "du", "emp", "intersection_density", "du_detsf", "du_mf", *["du_" + s for s in C.SUBTYPES]]


@query("BAS36_canvas_imputation", f"WITH {_IMP} SELECT parcel_id, {', '.join(num(n, n, 6) for n in _IC)} FROM i")
def canvas_imputation(t: Tables):
    return rounded(imputed(t).select("parcel_id", *_IC), 6)


_PARTS = " + ".join("du_" + s for s in C.SUBTYPES)


@query(
    "BAS37_reconcile",
    f"WITH {_IMP}, s AS (SELECT *, CASE WHEN coalesce({_PARTS}, 0e0) = 0 THEN 1e0 ELSE du / nullif({_PARTS}, 0e0) END AS k FROM i) SELECT parcel_id, "
    + nums(**{"du_" + s: _R9.format(f"coalesce(du_{s}, 0e0) * k", 4) for s in C.SUBTYPES}, du_detsf=_R9.format("(du_detsf_sl + du_detsf_ll) * k", 4), du_mf=_R9.format("(du_mf2to4 + du_mf5p) * k", 4),
           **{"emp_" + k: " + ".join(f"coalesce(emp_{s}, 0e0)" for s in subs) for k, subs in SECTORS.items()},
           emp=" + ".join(f"coalesce(emp_{s}, 0e0)" for s in SUB_SECTORS)) + " FROM s",
)
def reconcile(t: Tables):
    out = C.reconcile(imputed(t))
    return rounded(out.select("parcel_id", *["du_" + s for s in C.SUBTYPES], "du_detsf", "du_mf", *["emp_" + k for k in SECTORS], "emp"))


def _var(i: int) -> str:
    return "CASE coalesce(land_development_category, 'urban') " + " ".join(f"WHEN '{c}' THEN {v[i]}e0" for c, v in C.VARIANT.items()) + f" ELSE {C.VARIANT_DEFAULT[i]}e0 END"


_VC = f"coalesce(land_development_category, {_USE}, {_LAB}, 'urban')"


def _var2(i: int) -> str:
    return "CASE cat " + " ".join(f"WHEN '{c}' THEN {v[i]}e0" for c, v in C.VARIANT.items()) + f" ELSE {C.VARIANT_DEFAULT[i]}e0 END"


@query(
    "BAS38_step_by_step",
    f"""WITH r AS ({ROW_SQL}), g AS (SELECT *, {_R9.format('area_m2 / 4046.86e0', 4)} AS lot, {_VC} AS cat, {', '.join(f"coalesce(bldg_area_{s}, {'du_' + s if s != 'mf' else '(du_mf2to4 + du_mf5p)'} * {_var(0)} * {f}e0) AS b_{s}" for s, f in C.HOME_FACTORS.items())},
      {', '.join(f'coalesce(bldg_area_{s}, emp_{s} * {_var(1)}) AS b_{s}' for s in C.JOB_AREAS)} FROM r),
    u AS (SELECT * EXCLUDE (area_parcel_res, area_parcel_emp), CASE WHEN cat = 'urban' THEN coalesce(area_parcel_res, lot) ELSE area_parcel_res END AS ares, CASE WHEN cat = 'industrial' THEN coalesce(area_parcel_emp, lot) ELSE area_parcel_emp END AS aemp FROM g)
    SELECT parcel_id, cat AS land_development_category, """
    + nums(area_row=_R9.format("area_m2 / 4046.86e0 * 0.15e0", 4), area_parcel_res="coalesce(ares, 0e0)", area_parcel_emp="coalesce(aemp, 0e0)", residential_irrigated_area=f"coalesce(residential_irrigated_area, coalesce(ares, lot) * {_var2(2)})",
           commercial_irrigated_area=f"coalesce(commercial_irrigated_area, coalesce(aemp, lot) * {_var2(3)})", intersection_density=_R9.format(f"coalesce(intersection_density, {_var2(4)})", 2),
           **{"bldg_area_" + s: f"coalesce(b_{s}, 0e0)" for s in [*C.HOME_FACTORS, *C.JOB_AREAS]}) + " FROM u",
)
def step_by_step(t: Tables):
    r = rows(t).withColumns({"du_mf": F.col("du_mf2to4") + F.col("du_mf5p"), "du_detsf": F.col("du_detsf_sl") + F.col("du_detsf_ll")})
    measures = {"bldg_area_" + s: 0.0 for s in [*C.HOME_FACTORS, *C.JOB_AREAS]} | {n: 0.0 for n in ("area_parcel_res", "area_parcel_emp", "du", "emp")}
    out = C.step_by_step(r, measures)
    keep = ["area_row", "area_parcel_res", "area_parcel_emp", "residential_irrigated_area", "commercial_irrigated_area", "intersection_density", *["bldg_area_" + s for s in [*C.HOME_FACTORS, *C.JOB_AREAS]]]
    return rounded(out.select("parcel_id", "land_development_category", *keep))


# --- comparison ----------------------------------------------------------------------

MET = ["population", "households", "dwelling_units_total", "employment_total", "building_sqft_total"]
CMP = dict(
    ref="SELECT o_orderkey + 100 AS parcel_id, (o_custkey % 9) * 2e0 + o_orderkey % 5 AS population, (o_custkey % 9) * 0.5e0 AS households, (o_orderkey % 9) * 1e0 AS dwelling_units_total, 0e0 - (o_custkey % 17) AS employment_total, (o_orderkey % 31) * 10e0 AS building_sqft_total FROM orders",
    j="SELECT b.*, " + ", ".join(f"r.{m} AS ref_{m}" for m in MET) + " FROM base b JOIN ref r ON r.parcel_id = b.parcel_id",
)


def _r_sql(m: str) -> str:
    w, x, y = "coalesce(nullif(gross_acres, 0e0), 1e0)", m, "ref_" + m
    k = f"FILTER (WHERE {x} IS NOT NULL)"
    s = {n: f"sum({e}) {k}" for n, e in dict(w=w, x=f"{w} * {x}", y=f"{w} * {y}", xx=f"{w} * {x} * {x}", yy=f"{w} * {y} * {y}", xy=f"{w} * {x} * {y}").items()}
    return f"({s['w']} * {s['xy']} - {s['x']} * {s['y']}) / nullif(sqrt(greatest(0e0, {s['w']} * {s['xx']} - {s['x']} * {s['x']})) * sqrt(greatest(0e0, {s['w']} * {s['yy']} - {s['y']} * {s['y']})), 0e0)"


def reference(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        (k + 100).alias("parcel_id"), ((c % 9) * 2.0 + k % 5).alias("population"), ((c % 9) * 0.5).alias("households"), ((k % 9) * 1.0).alias("dwelling_units_total"),
        (F.lit(0.0) - c % 17).alias("employment_total"), ((k % 31) * 10.0).alias("building_sqft_total"),
    )


def summary_row(t: Tables):
    computed = t.base.withColumn("pop", F.col("population"))
    w = F.coalesce(F.nullif(F.col("gross_acres"), F.lit(0.0)), F.lit(1.0))
    return Q.summary(computed, reference(t), "parcel_id", MET, w, ["households", "intersection_density"])


@query(
    "BAS39_comparison_summary",
    ctes("base", **CMP) + "SELECT " + ", ".join([num(f"(SELECT coalesce(sum({m}), 0e0) FROM ref)", "ref_" + m, 2) for m in MET] + [num(f"(SELECT coalesce(sum({m}), 0e0) FROM base)", "computed_" + m, 2) for m in MET]
    + [num(f"(SELECT {_r_sql(m)} FROM j)", "r_" + m, 6) for m in MET] + [num(f"(SELECT coalesce(sum({m} * population), 0e0) / nullif(sum(population), 0e0) FROM base)", m + "_wavg", 4) for m in ("households", "intersection_density")]),
)
def comparison_summary(t: Tables):
    out = summary_row(t)
    return out.select(*[rd(c, 6 if c.startswith("r_") else 4 if c.endswith("_wavg") else 2).alias(c) for c in out.columns])


@query(
    "BAS40_grades",
    ctes("base", **CMP) + ", l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT sum({m}) FROM ref) AS ref, (SELECT sum({m}) FROM base) AS computed, (SELECT {_r_sql(m)} FROM j) AS r" for m in MET) + ") SELECT metric, "
    + num("ref", "ref", 2) + ", " + num("computed", "computed", 2) + ", " + num("computed - ref", "diff", 2) + ", " + num("(computed - ref) / ref * 100e0", "pct_diff", 4) + ", " + num("r", "r", 6)
    + ", CASE WHEN r IS NULL THEN 'N/A' WHEN r >= 0.7e0 THEN 'GOOD' WHEN r >= 0.5e0 THEN 'OK' WHEN r >= 0.3e0 THEN 'WARN' WHEN r >= 0.1e0 THEN 'POOR' ELSE 'FAIL' END AS status FROM l",
)
def grades(t: Tables):
    out = Q.grade(summary_row(t), MET)
    digits = {"ref": 2, "computed": 2, "diff": 2, "pct_diff": 4, "r": 6}
    return out.select("metric", *[rd(n, d).alias(n) for n, d in digits.items()], "status")


@query(
    "BAS41_coverage",
    ctes("parcels") + "SELECT coalesce(status, 'NULL') AS status, count(*) AS total, count(intersection_density) AS density, " + num("count(intersection_density) * 1e0 / count(*)", "density_share", 6)
    + ", count(*) FILTER (WHERE gross_acres > 2) AS large, " + num("count(*) FILTER (WHERE gross_acres > 2) * 1e0 / count(*)", "large_share", 6) + " FROM parcels GROUP BY 1",
)
def coverage(t: Tables):
    out = Q.coverage(t.parcels, {"density": F.col("intersection_density").isNotNull(), "large": F.col("gross_acres") > 2}, "status")
    return rounded(out, 6)


@query("BAS43_rename_view", "SELECT o_orderkey AS geography_id, " + num("o_totalprice * 4046.86e0", "area_gross", 2) + ", o_custkey AS pop, 0e0 AS pop_groupquarter FROM orders")
def rename_view(t: Tables):
    out = Q.rename_view(t.orders, {"geography_id": "o_orderkey", "area_gross": ("o_totalprice", 4046.86), "pop": "o_custkey"}, {"pop_groupquarter": 0.0})
    return out.withColumn("area_gross", rd("area_gross", 2))


COMP = {"built_form_id": "p_size", "dwelling_unit_density": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 20) * 0.5e0 END", "employment_density": "(p_partkey % 9) * 1e0", "gross_net_ratio": "CASE WHEN p_size % 7 = 0 THEN 0e0 ELSE 0.75e0 END",
        "building_sqft_total": "CASE WHEN p_size % 5 = 0 THEN 0e0 ELSE p_retailprice * 20e0 END", "residential_irrigated_sqft": "CASE WHEN p_size % 3 = 0 THEN 0e0 ELSE p_retailprice END", "retail_services_density": "(p_size % 2) * 1.5e0", "education_density": "(p_partkey % 4) * 1e0"}


@query(
    "BAS44_built_form_profiles",
    f"WITH c AS ({table_sql(COMP, 'part')}), m AS (SELECT built_form_id, " + ", ".join(f"avg(coalesce({n}, 0e0)) AS {n}" for n in list(COMP)[1:]) + " FROM c GROUP BY built_form_id), k AS (SELECT *, CASE WHEN gross_net_ratio > 0 THEN gross_net_ratio ELSE 1e0 END AS g FROM m) SELECT built_form_id, "
    + nums(du_per_acre="dwelling_unit_density * g", emp_per_acre="employment_density * g", far="greatest(CASE WHEN building_sqft_total > 0 THEN building_sqft_total / 43560e0 / g ELSE 0.3e0 END, 0.1e0)",
           building_coverage="least(CASE WHEN building_sqft_total > 0 THEN building_sqft_total * 100e0 / 43560e0 ELSE 25e0 END, 100e0)", outdoor_water_rate="CASE WHEN residential_irrigated_sqft > 0 THEN residential_irrigated_sqft * 0.01e0 ELSE 300e0 END",
           retail="CASE WHEN retail_services_density > 0 THEN retail_services_density * g END", education="CASE WHEN education_density > 0 THEN education_density * g END") + " FROM k",
)
def built_form_profiles(t: Tables):
    out = Q.built_form_profiles(t.part.selectExpr(*[f"{v} AS {k}" for k, v in COMP.items()]), ["retail_services", "education"])
    jobs = F.col("jobs_by_sector")
    return rounded(
        out.select(
            "built_form_id", "du_per_acre", "emp_per_acre", "far", "building_coverage", "outdoor_water_rate",
            F.try_element_at(jobs, F.lit("retail_services")).alias("retail"), F.try_element_at(jobs, F.lit("education")).alias("education"),
        )
    )
