"""Parcels, sales, buildings and classification (BAS01-07, BAS10-16, BAS42, CLS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators import spatial as S
from landspan.operators.spatial import BOX
from landspan.plans import assessor as P
from landspan.plans import classify as K
from landspan.queries.analysis import num, nums, same
from landspan.queries.binding import Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded
from landspan.queries.spatial import HOLE_OVERLAP, MEET, OVERLAP, ell, ell_overlap, framed
from landspan.session import cut

CODES = ["10X", "A1A", "MP0", "MX1", "D00", "45", "Z9", "I1", "", "20A", "AE0", "A30", "AG1", "AH2", "A2B", "AQ0"]


def pick_sql(key: str, values) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[cast(1 + ({key}) % {len(values)} AS int)]"


def pick(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


RAW_PARCELS = f"""SELECT lpad(cast(l_orderkey AS varchar), 8, '0') || lpad(cast(l_linenumber AS varchar), 4, '0') AS apn, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 0e0 ELSE l_quantity * 500e0 END AS lotsize,
    {pick_sql('l_suppkey', CODES)} AS landuse, 'Z' || cast(l_suppkey % 3 AS varchar) AS zone, 'J' || cast(l_partkey % 4 AS varchar) AS jurisdiction, l_partkey, l_suppkey,
    (l_orderkey % 400) * 100e0 + (l_linenumber % 2) * 30e0 AS x, floor(l_orderkey / 400) * 100e0 + (l_partkey % 2) * 40e0 AS y FROM lineitem"""


def raw_parcels(t: Tables):
    ok, ln, pk, sk = (F.col(n) for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return t.lineitem.select(
        F.concat(X.zero_pad(ok, 8), X.zero_pad(ln, 4)).alias("apn"),
        F.when(pk % 3 == 1, 0.0).when(pk % 3 == 2, F.col("l_quantity") * 500.0).alias("lotsize"),
        pick(sk, CODES).alias("landuse"), F.concat(F.lit("Z"), (sk % 3).cast("string")).alias("zone"), F.concat(F.lit("J"), (pk % 4).cast("string")).alias("jurisdiction"),
        "l_partkey", "l_suppkey", ((ok % 400) * 100.0 + (ln % 2) * 30.0).alias("x"), (F.floor(ok / 400) * 100.0 + (pk % 2) * 40.0).alias("y"),
    )


def _mode_cte(n: str) -> str:
    return f"m_{n} AS (SELECT prefix, {n} FROM (SELECT prefix, {n}, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, {n}) AS rn FROM su GROUP BY prefix, {n}) WHERE rn = 1)"


_CAT = """CASE WHEN left(landuse, 2) IN ('10','11','12','13','14','15','16','17','18') THEN 'urban' WHEN left(landuse, 2) IN ('20','21','22','23','24','30','31','32','80','81','82','83','90') THEN 'industrial'
    WHEN left(landuse, 2) IN ('40','41','42','43','44','45','46') THEN 'agricultural' WHEN left(landuse, 2) IN ('50','51','52','53','60','61','62','63','70','71') THEN 'undeveloped' WHEN landuse IS NULL OR trim(landuse) = '' THEN 'undeveloped'
    WHEN left(landuse, 2) IN ('MP','MR','MW','MD','MF','MG','ML') THEN 'undeveloped' WHEN left(landuse, 1) IN ('A','B','C','E','H','M') THEN 'urban' WHEN left(landuse, 1) = 'F' THEN 'agricultural' WHEN left(landuse, 1) = 'I' THEN 'industrial' ELSE 'undeveloped' END"""


@query(
    "BAS01_assessor_parcels",
    f"""WITH r AS ({RAW_PARCELS}), su AS (SELECT *, left(apn, 8) AS prefix FROM r WHERE lotsize IS NULL OR lotsize <= 0), {_mode_cte('landuse')}, {_mode_cte('zone')}, {_mode_cte('jurisdiction')},
    h AS (SELECT prefix, sum(n) AS n, count(*) AS c, max(x) - min(x) AS w, max(y) - min(y) AS h, avg(x) AS x, avg(y) AS y FROM (SELECT prefix, x, y, count(*) AS n FROM su GROUP BY prefix, x, y) GROUP BY prefix),
    hp AS (SELECT *, CASE WHEN c = 4 THEN w * h WHEN c = 3 THEN w * h / 2 ELSE 0e0 END AS a, CASE WHEN c = 4 THEN 2 * (w + h) WHEN c = 3 THEN w + h + sqrt(w * w + h * h) ELSE 2 * sqrt(w * w + h * h) END AS p FROM h),
    u AS (SELECT hp.prefix || '0000' AS apn, CASE WHEN n >= 3 THEN a + p * 5e0 + pi() * 25e0 ELSE pi() * 900e0 END / 4046.86e0 AS lot_size_acres, landuse, zone, jurisdiction, x, y, c AS corners FROM hp LEFT JOIN m_landuse USING (prefix) LEFT JOIN m_zone USING (prefix) LEFT JOIN m_jurisdiction USING (prefix)
      UNION ALL SELECT apn, lotsize / 43560e0, landuse, zone, jurisdiction, x, y, NULL FROM (SELECT *, row_number() OVER (PARTITION BY apn ORDER BY lotsize DESC, l_partkey, l_suppkey) AS rn FROM r WHERE lotsize > 0) WHERE rn = 1)
    SELECT apn, {num('lot_size_acres', 'lot_size_acres', 6)}, landuse, zone, jurisdiction, {num('x', 'x', 6)}, {num('y', 'y', 6)}, corners::INTEGER AS corners, {_CAT} AS land_development_category FROM u""",
)
def assessor_parcels(t: Tables):
    out = P.assessor_parcels(raw_parcels(t), ["l_partkey", "l_suppkey"])
    corners = F.when(F.col("hull").isNotNull(), F.size("hull"))
    return rounded(out.withColumn("corners", corners).drop("hull"), 6)


SALE_DEDUP = """SELECT apn, living_area AS actual_living_sqft, building_sf AS actual_building_sqft, property_type, lot_size_acres AS sales_lot_size_acres, units FROM (SELECT *, row_number() OVER (PARTITION BY apn ORDER BY
    CASE WHEN living_area IS NOT NULL AND building_sf IS NOT NULL AND units IS NOT NULL THEN 0 WHEN living_area IS NOT NULL THEN 1 WHEN building_sf IS NOT NULL THEN 2 ELSE 3 END, year_built DESC NULLS LAST, sale_id) AS rn
    FROM sales WHERE living_area IS NOT NULL OR building_sf IS NOT NULL) WHERE rn = 1"""


@query("BAS02_sales_dedup", ctes("sales", sd=SALE_DEDUP) + f"SELECT apn, property_type, units, {same('actual_living_sqft actual_building_sqft sales_lot_size_acres')} FROM sd")
def sales_dedup(t: Tables):
    return rounded(P.dedupe_sales(t.sales, ["sale_id"]))


@query(
    "BAS03_building_medians",
    ctes("sales") + "SELECT property_type, count(*) AS parcel_count, " + nums(**{f"median_{n}": f"quantile_cont({n}, 0.5)" for n in ("living_area", "building_sf", "lot_size_acres")})
    + " FROM (SELECT * EXCLUDE (property_type), coalesce(nullif(trim(property_type), ''), 'Other') AS property_type FROM sales WHERE living_area IS NOT NULL OR building_sf IS NOT NULL) GROUP BY property_type",
)
def building_medians(t: Tables):
    return rounded(P.building_medians(t.sales))


ID = "concat_ws('-', parcel_id, line, supplier, part)"


@query(
    "BAS04_combine_buildings",
    ctes("buildings", f=f"SELECT {ID} AS id, xmin, ymin, xmax, ymax FROM buildings WHERE bf_source IS NULL", s=f"SELECT {ID} AS id, xmin + 3e0 AS xmin, ymin, xmax + 3e0 AS xmax, ymax FROM buildings WHERE bf_source IS NOT NULL")
    + f""", e AS (SELECT min(xmin) AS a, min(ymin) AS b, max(xmax) AS c, max(ymax) AS d FROM f)
    SELECT id, 'first' AS origin FROM f UNION ALL SELECT id, 'second' FROM s a, e WHERE a.xmin <= c AND a.xmax >= e.a AND a.ymin <= d AND a.ymax >= e.b
    AND NOT EXISTS (SELECT 1 FROM f b WHERE abs(a.xmin - b.xmin) < 50 AND {MEET} AND {ell_overlap('a', 'b')} > 0.5e0 * 0.75e0 * (a.xmax - a.xmin) * (a.ymax - a.ymin))""",
)
def combine_buildings(t: Tables):
    b = t.buildings.withColumn("id", F.expr(ID))
    first = b.where("bf_source IS NULL").select("id", F.lit("first").alias("origin"), *BOX)
    second = b.where("bf_source IS NOT NULL").select("id", F.lit("second").alias("origin"), (F.col("xmin") + 3.0).alias("xmin"), "ymin", (F.col("xmax") + 3.0).alias("xmax"), "ymax")
    # boxes in the first source, L-shapes in the second
    return P.combine_buildings(first.withColumn("ring", S.ring_of(first)), ell(second), 50.0).select("id", "origin")


CLS = "CASE WHEN class IN ('house', 'apartments') THEN 'residential' WHEN class = 'retail' THEN 'other' WHEN class IS NULL THEN 'mixed' ELSE 'other' END"
# offices count as commercial and warehouses as industrial buildings here
CLASS_MAP = {"office": "commercial", "warehouse": "industrial"}
CLS_SQL = "CASE WHEN class IN ('house', 'apartments') THEN 'residential' WHEN class = 'office' THEN 'commercial' WHEN class = 'warehouse' THEN 'industrial' WHEN class IS NULL THEN 'mixed' ELSE 'other' END"


def classified(t: Tables):
    b = t.buildings.withColumn("class", F.expr("CASE class WHEN 'office' THEN 'commercial' WHEN 'warehouse' THEN 'industrial' ELSE class END"))
    return P.classify_buildings(b.withColumn("area_m2", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))))


@query("BAS05_building_class", ctes("buildings") + f"SELECT {ID} AS id, {CLS_SQL} AS class_category, {num('(xmax - xmin) * (ymax - ymin) * 10.7639e0', 'footprint_sqft')} FROM buildings")
def building_class(t: Tables):
    return classified(t).select(F.expr(ID).alias("id"), "class_category", rd("footprint_sqft").alias("footprint_sqft"))


LOTS = "SELECT parcel_id AS apn, parcel_id, xmin, ymin, xmax, ymax, x, y, gross_acres AS lot_size_acres, CASE WHEN county_id % 4 = 0 THEN 'mixed_use' WHEN county_id % 4 = 1 THEN 'industrial' ELSE 'urban' END AS land_development_category FROM parcels"


def lots(t: Tables):
    return t.parcels.select(
        F.col("parcel_id").alias("apn"), *BOX, "x", "y", F.col("gross_acres").alias("lot_size_acres"),
        F.when(F.col("county_id") % 4 == 0, "mixed_use").when(F.col("county_id") % 4 == 1, "industrial").otherwise("urban").alias("land_development_category"),
    )


_L = "coalesce(nullif(levels, 0), 1)"


def _floors(cls: str, mixed: str | None = None) -> str:
    m = f"WHEN class_category = 'mixed' AND {_L} > 1 THEN {mixed} WHEN class_category = 'mixed' THEN sqft * 0.5e0 " if mixed else ""
    return f"sum((CASE {m}WHEN class_category = '{cls}' THEN sqft * {_L} ELSE 0e0 END) * part)"


STATS = dict(
    lot=LOTS,
    bld=f"SELECT *, {CLS_SQL} AS class_category, (xmax - xmin) * (ymax - ymin) * 10.7639e0 AS sqft FROM buildings",
    pr=f"SELECT a.apn, b.* EXCLUDE (xmin, ymin, xmax, ymax, x, y, part), {ell_overlap('b', 'a')} / (0.75e0 * (b.xmax - b.xmin) * (b.ymax - b.ymin)) AS part FROM bld b JOIN lot a ON abs(a.x - b.x) < 100 AND abs(a.y - b.y) < 100 AND {MEET} AND {ell_overlap('b', 'a')} > 0",
    bs=f"""SELECT apn, sum(sqft * {_L} * part) AS total_footprint_sqft, count(*) AS building_count, max(height) AS max_height, max(levels) AS max_levels, count(*) FILTER (WHERE bf_source = 'google') AS google_building_count,
      count(*) FILTER (WHERE bf_source = 'microsoft') AS microsoft_building_count, avg(confidence) AS mean_confidence, sum(sqft * part) FILTER (WHERE class_category = 'residential') AS residential_building_sqft,
      sum(sqft * part) FILTER (WHERE class_category <> 'residential') AS non_residential_building_sqft, count(*) FILTER (WHERE class_category = 'residential') AS residential_building_count,
      count(*) FILTER (WHERE class_category <> 'residential') AS non_residential_building_count, count(DISTINCT class_category) AS distinct_class_categories, {_floors('commercial', 'sqft')} AS commercial_sqft,
      {_floors('residential', f'sqft * ({_L} - 1)')} AS residential_sqft, {_floors('industrial')} AS industrial_sqft, {_floors('other')} AS other_sqft FROM pr GROUP BY apn""",
    st="""SELECT lot.*, coalesce(total_footprint_sqft, 0e0) AS total_footprint_sqft, coalesce(building_count, 0) AS building_count, max_height, max_levels, coalesce(google_building_count, 0) AS google_building_count,
      coalesce(microsoft_building_count, 0) AS microsoft_building_count, mean_confidence, coalesce(residential_building_sqft, 0e0) AS residential_building_sqft, coalesce(non_residential_building_sqft, 0e0) AS non_residential_building_sqft,
      coalesce(residential_building_count, 0) AS residential_building_count, coalesce(non_residential_building_count, 0) AS non_residential_building_count, coalesce(distinct_class_categories, 0) AS distinct_class_categories,
      coalesce(commercial_sqft, 0e0) AS commercial_sqft, coalesce(residential_sqft, 0e0) AS residential_sqft, coalesce(industrial_sqft, 0e0) AS industrial_sqft, coalesce(other_sqft, 0e0) AS other_sqft,
      CASE WHEN lot_size_acres > 0 THEN coalesce(total_footprint_sqft, 0e0) / (lot_size_acres * 43560e0) ELSE 0e0 END AS footprint_ratio FROM lot LEFT JOIN bs ON bs.apn = lot.apn""",
)
_ST_NUM = "total_footprint_sqft max_height mean_confidence residential_building_sqft non_residential_building_sqft commercial_sqft residential_sqft industrial_sqft other_sqft footprint_ratio lot_size_acres".split()
_ST_ID = "apn building_count max_levels google_building_count microsoft_building_count residential_building_count non_residential_building_count distinct_class_categories land_development_category".split()


def stats(t: Tables):
    b = classified(t).select("footprint_sqft", "levels", "height", "bf_source", "confidence", "class_category", *BOX)
    return P.building_stats(lots(t), P.building_pairs(lots(t), ell(b), 100.0))


@query("BAS06_building_stats", ctes("parcels", "buildings", **STATS) + f"SELECT {', '.join(_ST_ID)}, {', '.join(num(n, n, 6) for n in _ST_NUM)} FROM st")
def building_stats(t: Tables):
    return rounded(stats(t).select(*_ST_ID, *_ST_NUM), 6)


@query(
    "BAS07_sqft_by_type",
    ctes("parcels", "buildings", **STATS) + "SELECT apn, building_count, residential_building_count, non_residential_building_count, max_levels, land_development_category, "
    + nums(total_footprint_sqft="total_footprint_sqft", footprint_ratio="footprint_ratio", lot_size_acres="lot_size_acres", residential_building_sqft="residential_sqft",
           commercial_building_sqft="commercial_sqft", industrial_building_sqft="industrial_sqft", other_building_sqft="other_sqft") + " FROM st",
)
def sqft_by_type(t: Tables):
    return rounded(P.sqft_by_type(stats(t)))


# --- zones ---------------------------------------------------------------------------

GEO = "lpad(cast(geoid AS string), 12, '0')"
ZONES = dict(zn="SELECT lpad(cast(geoid AS varchar), 12, '0') AS geoid, xmin, ymin, xmax, ymax, hh, du, median_income FROM block_groups")


def zones(t: Tables):
    return t.block_groups.selectExpr(f"{GEO} AS geoid", *BOX, "hh", "du", "median_income")


PBG = "SELECT apn, min(geoid) AS block_group_geoid, left(min(geoid), 11) AS tract_geoid FROM lot a JOIN zn b ON a.x >= b.xmin AND a.x < b.xmax AND a.y >= b.ymin AND a.y < b.ymax GROUP BY apn"


def block_groups(t: Tables):
    return P.parcel_block_groups(lots(t), zones(t).select("geoid", *BOX), 2020, 500.0)


@query("BAS10_parcel_block_groups", ctes("parcels", "block_groups", lot=LOTS, **ZONES, pbg=PBG) + "SELECT apn, '2020-01-01' AS data_year, block_group_geoid, tract_geoid FROM pbg")
def parcel_block_groups(t: Tables):
    return block_groups(t).withColumn("data_year", F.col("data_year").cast("string"))


PZO = f"SELECT a.apn, b.geoid, {OVERLAP} AS area, hh, du FROM lot a JOIN zn b ON {MEET} AND {OVERLAP} > 0"


# zones around a hole
PZF = f"SELECT a.apn, b.geoid, {OVERLAP} - {HOLE_OVERLAP} AS area, hh, du FROM lot a JOIN zn b ON {MEET} AND {OVERLAP} - {HOLE_OVERLAP} > 1e-6"


@query("BAS11_parcel_zone_overlaps", ctes("parcels", "block_groups", lot=LOTS, **ZONES, pzo=PZF) + f"SELECT apn, geoid, {num('area', 'intersect_area_m2')}, hh, du FROM pzo")
def parcel_zone_overlaps(t: Tables):
    return rounded(P.parcel_zone_overlaps(lots(t), framed(zones(t)), 500.0, ["hh", "du"]))


@query(
    "BAS42_training_crosswalk",
    ctes("parcels", "buildings") + f"SELECT a.parcel_id AS apn, b.parcel_id, {num(f'max({ell_overlap("b", "a")})', 'intersect_area_m2')} FROM parcels a JOIN buildings b ON abs(a.x - b.x) < 100 AND abs(a.y - b.y) < 100 AND {MEET} AND {ell_overlap('b', 'a')} > 0 GROUP BY a.parcel_id, b.parcel_id",
)
def training_crosswalk(t: Tables):
    return rounded(P.crosswalk_pairs(ell(t.buildings), lots(t), 100.0))


KNOWN = "SELECT st.apn, x, y, footprint_ratio, building_count, st.lot_size_acres, land_development_category, block_group_geoid, tract_geoid, property_type, coalesce(units, 1) AS units, living_area AS living_sqft, building_sf AS building_sqft FROM st JOIN pbg ON pbg.apn = st.apn JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY apn ORDER BY sale_id) AS rn FROM sales2 WHERE nullif(trim(property_type), '') IS NOT NULL) WHERE rn = 1) s ON s.apn = st.apn WHERE footprint_ratio > 0"
# a parcel counts as sold only every third time, so that two thirds are unknown
SALES2 = "SELECT * EXCLUDE (property_type), CASE WHEN apn % 3 = 0 THEN property_type END AS property_type FROM sales"


def known(t: Tables, st=None):
    sales = t.sales.withColumn("property_type", F.when(F.col("apn") % 3 == 0, F.col("property_type")))
    return P.sales_features(stats(t) if st is None else st, block_groups(t), sales, ["sale_id"])


@query(
    "BAS12_sales_features",
    ctes("parcels", "buildings", "block_groups", "sales", **STATS, **ZONES, pbg=PBG, sales2=SALES2, kn=KNOWN)
    + f"SELECT apn, building_count, land_development_category, block_group_geoid, tract_geoid, property_type, units, {num('footprint_ratio', 'footprint_ratio', 6)}, {same('lot_size_acres living_sqft building_sqft')} FROM kn",
)
def sales_features(t: Tables):
    out = known(t).select("apn", "building_count", "land_development_category", "block_group_geoid", "tract_geoid", "property_type", "units", "footprint_ratio", "lot_size_acres", "living_sqft", "building_sqft")
    return out.select(*[rd(c, 6 if c == "footprint_ratio" else 4).alias(c) if d == "double" else F.col(c) for c, d in out.dtypes])


def _tier_sql(n: int, keys: list[str], near: bool, before: list[str]) -> str:
    fs = ["footprint_ratio", "building_count", "lot_size_acres"]
    on = " AND ".join(f"u.{k} = k.{k}" for k in keys) + (" AND sqrt((u.x - k.x) * (u.x - k.x) + (u.y - k.y) * (u.y - k.y)) <= 5000" if near else "")
    z = [f"coalesce((u.{f} - k.{f}) / nullif(s_{f}, 0e0), 0e0)" for f in fs]
    d = " + ".join(f"{e} * {e}" for e in z)
    w = " AND ".join(f"k.{f} BETWEEN u.{f} - 3 * s_{f} AND u.{f} + 3 * s_{f}" for f in fs)
    skip = "".join(f" AND u.apn NOT IN (SELECT apn FROM {b})" for b in before)
    stats_on = " AND ".join(f"g.{k} = u.{k}" for k in keys)
    return f"""t{n} AS (SELECT * FROM (SELECT u.apn, k.apn AS neighbour, {n} AS tier, row_number() OVER (PARTITION BY u.apn ORDER BY sqrt({d}), k.apn) AS rn FROM un u JOIN (SELECT {', '.join(keys)}, {', '.join(f'stddev_pop({f}) AS s_{f}' for f in fs)} FROM kn GROUP BY {', '.join(keys)}) g ON {stats_on}
        JOIN kn k ON {on} AND {w} WHERE true{skip}) WHERE rn <= 5)"""


IMPUTED = ", " + ",\n".join(
    [
        "un AS (SELECT st.*, block_group_geoid, tract_geoid FROM st JOIN pbg ON pbg.apn = st.apn WHERE footprint_ratio > 0 AND st.apn NOT IN (SELECT apn FROM kn))",
        _tier_sql(1, ["block_group_geoid", "land_development_category"], False, []),
        _tier_sql(2, ["tract_geoid", "land_development_category"], False, ["t1"]),
        _tier_sql(3, ["land_development_category"], True, ["t1", "t2"]),
        "im AS (SELECT p.apn, min(tier) AS imputed_from_tier, count(*) AS neighbor_count, min(ptype) AS imputed_property_type, quantile_cont(units, 0.5) AS imputed_units, quantile_cont(living_sqft, 0.5) AS imputed_living_sqft, quantile_cont(building_sqft, 0.5) AS imputed_building_sqft "
        "FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) p JOIN kn ON kn.apn = neighbour JOIN (SELECT apn, property_type AS ptype FROM (SELECT p.apn, property_type, row_number() OVER (PARTITION BY p.apn ORDER BY count(*) DESC, property_type) AS r FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) p JOIN kn ON kn.apn = neighbour GROUP BY p.apn, property_type) WHERE r = 1) m ON m.apn = p.apn GROUP BY p.apn)",
    ]
)
_ALLC = ctes("parcels", "buildings", "block_groups", "sales", **STATS, **ZONES, pbg=PBG, sales2=SALES2, kn=KNOWN) + IMPUTED


SIMILAR = ["apn", "x", "y", "lot_size_acres", "land_development_category", "building_count", "footprint_ratio"]


def imputed(t: Tables, st=None):
    st = cut(stats(t).select(*SIMILAR)) if st is None else st  # both sides are made from it
    return P.impute_from_similar(st, block_groups(t), known(t, st))


@query("BAS13_knn_imputation", _ALLC + f" SELECT apn, imputed_from_tier, neighbor_count, imputed_property_type, {same('imputed_units imputed_living_sqft imputed_building_sqft')} FROM im")
def knn_imputation(t: Tables):
    return rounded(imputed(t))


@query(
    "BAS14_authoritative_areas",
    _ALLC + f""", sd AS ({SALE_DEDUP}), j AS (SELECT st.apn, residential_building_sqft AS r, non_residential_building_sqft AS n, max_levels AS l, actual_living_sqft AS al, actual_building_sqft AS ab, imputed_living_sqft AS il, imputed_building_sqft AS ib
      FROM st LEFT JOIN sd ON sd.apn = st.apn LEFT JOIN im ON im.apn = st.apn)
    SELECT apn, {num('CASE WHEN r > 0 AND l > 0 THEN r * l WHEN r > 0 THEN r WHEN al > 0 THEN al WHEN il > 0 THEN il END', 'authoritative_residential_sqft')},
    {num('CASE WHEN n > 0 AND l > 0 THEN n * l WHEN n > 0 THEN n WHEN ab > 0 AND al > 0 THEN ab - al WHEN ab > 0 THEN ab WHEN ib > 0 AND il > 0 THEN ib - il WHEN ib > 0 THEN ib END', 'authoritative_non_residential_sqft')},
    CASE WHEN r > 0 AND l > 0 THEN 'overture_with_levels' WHEN r > 0 THEN 'overture_flat' WHEN al > 0 THEN 'assessor_sales' WHEN il > 0 THEN 'footprint_imputed' END AS data_source FROM j""",
)
def authoritative_areas(t: Tables):
    st = cut(stats(t).select(*SIMILAR, "residential_building_sqft", "non_residential_building_sqft", "max_levels"))
    return rounded(P.authoritative_areas(st, P.dedupe_sales(t.sales, ["sale_id"]), imputed(t, st)))


@query(
    "BAS15_dasymetric_weights",
    ctes("parcels", "buildings", "sales", **STATS, sd=SALE_DEDUP)
    + f""", j AS (SELECT st.apn, st.lot_size_acres * 43560e0 AS lot, residential_sqft AS r, commercial_sqft + industrial_sqft + other_sqft AS o, actual_living_sqft AS al, actual_building_sqft - actual_living_sqft AS ao, coalesce(p.intersection_density, 0e0) AS d
      FROM st LEFT JOIN sd ON sd.apn = st.apn JOIN parcels p ON p.parcel_id = st.apn)
    SELECT apn, {num('greatest(0e0, coalesce(al, r, lot * 0.15e0))', 'pop_dasym_weight')}, {num('greatest(0e0, coalesce(ao, nullif(o, 0e0), lot * 0.1e0)) * (1e0 + d / 400e0)', 'emp_dasym_weight')},
    {num('greatest(0e0, lot * 0.15e0)', 'pop_lot_weight')}, {num('greatest(0e0, lot * 0.1e0)', 'emp_lot_weight')} FROM j""",
)
def dasymetric_weights(t: Tables):
    sd = P.dedupe_sales(t.sales, ["sale_id"]).select(
        "apn", F.col("actual_living_sqft").alias("authoritative_residential_sqft"),
        (F.col("actual_building_sqft") - F.col("actual_living_sqft")).alias("authoritative_non_residential_sqft"),
    )
    density = t.parcels.select(F.col("parcel_id").alias("apn"), "intersection_density")
    row = P.sqft_by_type(stats(t)).join(sd, "apn", "left").join(density, "apn")
    out = P.dasymetric_weights(row)
    lot = P.lot_size_weights(row).select("apn", F.col("pop_dasym_weight").alias("pop_lot_weight"), F.col("emp_dasym_weight").alias("emp_lot_weight"))
    return rounded(out.join(lot, "apn").select("apn", "pop_dasym_weight", "emp_dasym_weight", "pop_lot_weight", "emp_lot_weight"))


@query(
    "BAS16_du_estimation",
    ctes("parcels", "block_groups", "sales", lot=LOTS, **ZONES, pzo=PZO)
    + f""", s AS (SELECT apn, sum(hh / nullif(du, 0e0) * area) / nullif(sum(area), 0e0) AS hh_size FROM pzo GROUP BY apn), au AS (SELECT apn, coalesce(units, 0) AS u FROM (SELECT *, row_number() OVER (PARTITION BY apn ORDER BY year_built DESC NULLS LAST, sale_id) AS rn FROM sales) WHERE rn = 1),
    j AS (SELECT lot.apn, coalesce(u, 0) AS assessor_units, coalesce(hh_size, 2.5e0) AS hh_size, coalesce(nullif(coalesce(u, 0) * 1e0, 0e0), CASE WHEN lot.apn % 4 <> 0 THEN (lot.apn % 9) * 0.5e0 END, 0e0) AS du, coalesce(CASE WHEN lot.apn % 4 <> 0 THEN (lot.apn % 9) * 0.5e0 END, 0e0) AS model_du FROM lot LEFT JOIN s ON s.apn = lot.apn LEFT JOIN au ON au.apn = lot.apn)
    SELECT apn, assessor_units, {num('hh_size', 'hh_size')}, {num('du', 'du')}, {num('du * coalesce(nullif(hh_size, 0e0), 2.5e0)', 'pop_dasym_weight')}, {num('du * 0.95e0', 'hh_dasym_weight')}, {num('du * 0.95e0', 'hh')}, {num('model_du', 'model_du')} FROM j""",
)
def du_estimation(t: Tables):
    model = lots(t).select("apn", F.when(F.col("apn") % 4 != 0, (F.col("apn") % 9) * 0.5).alias("du_total"))
    sizes = P.household_size(P.parcel_zone_overlaps(lots(t), zones(t), 500.0, ["hh", "du"]))
    out = P.estimate_units(model, sizes, t.sales, ["sale_id"])
    alone = P.estimate_units(model, sizes, None).select("apn", F.col("du").alias("model_du"))
    return rounded(out.join(alone, "apn").select("apn", "assessor_units", "hh_size", "du", "pop_dasym_weight", "hh_dasym_weight", "hh", "model_du"))


# --- classification -------------------------------------------------------------------

_C2 = "left(code, 2)"
T0 = f"""CASE WHEN {_C2} = 'A1' THEN CASE WHEN 1e0 / (1e0 + exp(0e0 - (coalesce(d, 225e0) - 225e0) * 0.04e0)) > 0.5e0 THEN '{K.SMALL_LOT}' ELSE '{K.LARGE_LOT}' END """ + " ".join(
    f"WHEN {_C2} IN ({', '.join(repr(c) for c in codes)}) THEN '{form}'" for form, codes in K.CODE_FORMS.items()
) + " END"
T1 = f"""CASE WHEN pt LIKE 'Single Family%' THEN CASE WHEN coalesce(slot, 0e0) < 0.15e0 THEN '{K.SMALL_LOT}' ELSE '{K.LARGE_LOT}' END WHEN pt LIKE 'Condo%' THEN '{K.ATTACHED}'
    WHEN pt LIKE 'Multiple Family%' AND units BETWEEN 2 AND 4 THEN '{K.ATTACHED}' WHEN pt LIKE 'Multiple Family%' AND units >= 5 THEN '{K.APARTMENTS}' END"""
T2 = f"""CASE WHEN bc = 'residential' AND lv >= 3 THEN '{K.APARTMENTS}' WHEN bc = 'residential' THEN CASE WHEN coalesce(lot, 0e0) < 0.15e0 THEN '{K.SMALL_LOT}' ELSE '{K.LARGE_LOT}' END
    WHEN bc = 'commercial' THEN '{K.RETAIL}' WHEN bc = 'industrial' THEN '{K.INDUSTRY}' WHEN bc = 'civic' THEN '{K.CIVIC}' END"""
T3B = f"CASE WHEN lot > 3 AND coalesce(fr, 0e0) < 0.02e0 THEN '{K.FARM}' END"
T4 = f"CASE WHEN lot > 10 THEN '{K.FARM}' WHEN lot > 3 AND zone LIKE '%A%' THEN '{K.FARM}' WHEN lot > 0.4e0 THEN '{K.LARGE_LOT}' WHEN lot > 0.15e0 THEN '{K.SMALL_LOT}' WHEN lot > 0 AND apn % 3 = 2 THEN '{K.APARTMENTS}' WHEN lot > 0 THEN '{K.ATTACHED}' END"
CLS_CODES = ["A1A", "A2B", "A30", "A40", "AE0", "AF0", "AG1", "AH2", "AJ0", "AD0", "AQ0", "AT0", "CA1", "IA0", "GC0", "ZZ0"]
PTYPES = ["Single Family Residence", "Multiple Family Residence", "Condominium", "Retail", None]
BCLASS = ["residential", "commercial", "industrial", "civic", None]


def _n(values):
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + "]"


CLS_ROWS = f"""SELECT o_orderkey AS apn, {pick_sql('o_custkey', CLS_CODES)} AS code, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_custkey % 450) * 1e0 END AS d, ({_n(PTYPES)})[cast(1 + o_orderkey % 5 AS int)] AS pt, (o_custkey % 40) / 100e0 AS slot,
    cast(o_custkey % 9 AS int) AS units, ({_n(BCLASS)})[cast(1 + o_custkey % 5 AS int)] AS bc, cast(o_orderkey % 5 AS int) AS lv, CASE WHEN o_orderkey % 13 = 0 THEN 12e0 ELSE floor(o_totalprice / 1e3) / 1e2 END AS lot, 'R' || CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'X' END AS zone,
    (o_custkey % 60) / 1000e0 AS fr, o_custkey % 25 AS county, o_custkey FROM orders"""


def cls_rows(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("apn"), pick(c, CLS_CODES).alias("code"), F.when(k % 6 != 0, (c % 450) * 1.0).alias("d"), pick(k, PTYPES).alias("pt"), ((c % 40) / 100.0).alias("slot"),
        (c % 9).cast("int").alias("units"), pick(c, BCLASS).alias("bc"), (k % 5).cast("int").alias("lv"),
        F.when(k % 13 == 0, 12.0).otherwise(F.floor(F.col("o_totalprice") / 1e3) / 1e2).alias("lot"), F.when(c % 3 == 0, "RA").otherwise("RX").alias("zone"),
        ((c % 60) / 1000.0).alias("fr"), (c % 25).alias("county"), "o_custkey",
    )


def cls_query(name: str, sql: str, column):
    @query(name, f"WITH c AS ({CLS_ROWS}) SELECT apn, {sql} AS form FROM c")
    def _run(t: Tables):
        return cls_rows(t).select("apn", column().alias("form"))


cls_query("CLS01_tier0_use_code", T0, lambda: K.tier0("code", "d"))
cls_query("CLS02_tier1_sales", T1, lambda: K.tier1("pt", "slot", "units"))
cls_query("CLS03_tier2_building", T2, lambda: K.tier2("bc", "lv", "lot"))
cls_query("CLS05_tier3b_footprint", T3B, lambda: K.tier3b("lot", "fr"))
cls_query("CLS06_tier4_area", T4, lambda: K.tier4("lot", "zone", "apn"))


@query(
    "CLS07_resolver",
    f"WITH c AS ({CLS_ROWS}), f AS (SELECT apn, {T1} AS t1, {T0} AS t0, {T2} AS t2, {T3B} AS t3b, {T4} AS t4 FROM c) SELECT apn, coalesce(t1, t0, t2, t3b, t4) AS built_form_key, "
    "CASE WHEN t1 IS NOT NULL THEN 'tier1' WHEN t0 IS NOT NULL THEN 'tier0' WHEN t2 IS NOT NULL THEN 'tier2' WHEN t3b IS NOT NULL THEN 'tier3b' WHEN t4 IS NOT NULL THEN 'tier4' END AS built_form_key_source FROM f",
)
def resolver(t: Tables):
    f = cls_rows(t).select(
        "apn", K.tier1("pt", "slot", "units").alias("t1"), K.tier0("code", "d").alias("t0"), K.tier2("bc", "lv", "lot").alias("t2"),
        K.tier3b("lot", "fr").alias("t3b"), K.tier4("lot", "zone", "apn").alias("t4"),
    )
    return f.select("apn", *K.resolve({"tier1": "t1", "tier0": "t0", "tier2": "t2", "tier3b": "t3b", "tier4": "t4"}))


@query(
    "CLS04_tier3_knn",
    f"""WITH c AS ({CLS_ROWS}), a AS (SELECT apn, county, coalesce(d, 0e0) AS intersection_density, floor(lot * 4e0) / 4e0 AS lot_size_acres, floor(fr * 1024e0) / 1024e0 AS footprint_ratio, {T0} AS form FROM c), g AS (SELECT county, stddev_pop(intersection_density) AS s1, stddev_pop(lot_size_acres) AS s2, stddev_pop(footprint_ratio) AS s3 FROM a WHERE form IS NOT NULL GROUP BY county),
    n AS (SELECT u.apn, k.form, row_number() OVER (PARTITION BY u.apn ORDER BY sqrt(coalesce((u.intersection_density - k.intersection_density) / nullif(s1, 0e0), 0e0) * coalesce((u.intersection_density - k.intersection_density) / nullif(s1, 0e0), 0e0) + coalesce((u.lot_size_acres - k.lot_size_acres) / nullif(s2, 0e0), 0e0) * coalesce((u.lot_size_acres - k.lot_size_acres) / nullif(s2, 0e0), 0e0) + coalesce((u.footprint_ratio - k.footprint_ratio) / nullif(s3, 0e0), 0e0) * coalesce((u.footprint_ratio - k.footprint_ratio) / nullif(s3, 0e0), 0e0)), k.apn) AS rn
      FROM a u JOIN a k ON k.county = u.county AND k.form IS NOT NULL JOIN g ON g.county = u.county WHERE u.form IS NULL)
    SELECT apn, form AS built_form_key FROM (SELECT apn, form, row_number() OVER (PARTITION BY apn ORDER BY count(*) DESC, form) AS r FROM n WHERE rn <= 5 GROUP BY apn, form) WHERE r = 1""",
)
def tier3_knn(t: Tables):
    a = cls_rows(t).select(
        "apn", "county", X.or_zero("d").alias("intersection_density"), (F.floor(F.col("lot") * 4.0) / 4.0).alias("lot_size_acres"), (F.floor(F.col("fr") * 1024.0) / 1024.0).alias("footprint_ratio"), K.tier0("code", "d").alias("built_form_key")
    )
    return K.tier3(a.where("built_form_key IS NULL").drop("built_form_key"), a.where("built_form_key IS NOT NULL"), ["county"])


_H = """CASE WHEN a <= 0 THEN 2 WHEN a > 3 THEN CASE WHEN apn % 5 < 3 THEN 14 ELSE 15 END WHEN a > 1.5e0 THEN CASE apn % 4 WHEN 0 THEN 11 WHEN 1 THEN 12 WHEN 2 THEN 10 ELSE 1 END WHEN a > 0.4e0 THEN CASE apn % 5 WHEN 0 THEN 10 ELSE 2 END
    WHEN a > 0.15e0 THEN CASE apn % 7 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END WHEN a > 0.08e0 THEN CASE apn % 3 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 7 END ELSE CASE apn % 5 WHEN 0 THEN 8 WHEN 1 THEN 9 ELSE 7 END END"""


@query(
    "CLS08_heuristic_form",
    f"SELECT apn, {_H} AS built_form_key, {rds('CASE WHEN a > 0 THEN round(least(greatest(10e0 / sqrt(a), 0.5e0), 25e0), 2) ELSE 0.5e0 END')} AS intersection_density FROM (SELECT o_orderkey AS apn, floor(o_totalprice / 1e3) / 1e2 * (CASE WHEN o_orderkey % 4 = 0 THEN 0.05e0 ELSE 1e0 END) AS a FROM orders)",
)
def heuristic_form(t: Tables):
    a = t.orders.select(F.col("o_orderkey").alias("apn"), (F.floor(F.col("o_totalprice") / 1e3) / 1e2 * F.when(F.col("o_orderkey") % 4 == 0, 0.05).otherwise(1.0)).alias("a"))
    return rounded(a.select("apn", K.heuristic_form("a", "apn").alias("built_form_key"), K.heuristic_density("a").alias("intersection_density")))


@query(
    "CLS09_closest_form",
    ctes("parcels", "base", "built_forms")
    + "SELECT parcel_id, id AS built_form_key FROM (SELECT b.parcel_id, f.id, row_number() OVER (PARTITION BY b.parcel_id ORDER BY abs(coalesce(f.du_per_acre, 0e0) - coalesce(b.dwelling_units_total, 0e0) / greatest(coalesce(b.gross_acres, 0e0), 0.01e0)), f.id) AS rn FROM base b, built_forms f) WHERE rn = 1",
)
def closest_form(t: Tables):
    p = t.base.select("parcel_id", F.col("gross_acres").alias("area_gross"), F.col("dwelling_units_total").alias("du"))
    return K.closest_form(p, t.built_forms).select("parcel_id", "built_form_key")


POI = ["amenity=cafe", "shop=mall", "tourism=museum", "leisure=park", "x=y", "amenity=cemetery", "sport=swimming", "railway=halt"]


@query(
    "CLS10_poi_category",
    "WITH p AS (SELECT event_id, " + pick_sql("event_id", POI) + " AS tag FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 AND tag <> 'amenity=cafe' THEN CASE WHEN tag LIKE 'amenity%' THEN 'places_of_worship' ELSE 'schools' END ELSE CASE tag WHEN 'amenity=cafe' THEN 'restaurants' WHEN 'shop=mall' THEN 'shopping' WHEN 'tourism=museum' THEN 'entertainment' WHEN 'leisure=park' THEN 'parks' WHEN 'amenity=cemetery' THEN 'places_of_worship' WHEN 'sport=swimming' THEN 'sports' WHEN 'railway=halt' THEN 'transit' ELSE 'unknown' END END AS category, "
    "CASE WHEN event_id % 2 = 0 AND tag NOT LIKE 'amenity%' THEN 'amenity=school' WHEN tag = 'x=y' THEN 'unknown' ELSE tag END AS subcategory FROM p",
)
def poi_categories(t: Tables):
    tag = pick(F.col("event_id"), POI)
    key, value = F.split(tag, "=")[0], F.split(tag, "=")[1]
    # even rows carry a second tag, which wins by precedence
    second = F.when((F.col("event_id") % 2 == 0) & (key != "amenity"), F.create_map(F.lit("amenity"), F.lit("school"))).otherwise(F.create_map().cast("map<string,string>"))
    p = t.events.select("event_id", F.map_concat(F.create_map(key, value), second).alias("tags"))
    return K.poi_category(p).select("event_id", "category", "subcategory")


@query(
    "CLS11_non_residential",
    """SELECT apn, CASE WHEN a < 10000 AND n = 0 THEN 'vacant' WHEN a BETWEEN 10000 AND 100000 AND n >= 1 AND c > 0.2e0 AND l >= 3 THEN 'commercial' WHEN a BETWEEN 10000 AND 100000 AND n >= 1 AND c > 0.2e0 THEN 'industrial' WHEN a BETWEEN 10000 AND 100000 AND c < 0.1e0 THEN 'other'
    WHEN a > 1000000 AND c < 0.01e0 THEN 'agricultural' END AS use FROM (SELECT o_orderkey AS apn, CASE WHEN o_orderkey % 9 = 0 THEN 2000000e0 ELSE o_totalprice / 4e0 END AS a, o_custkey % 3 AS n, (o_custkey % 50) / 100e0 AS c, o_orderkey % 5 AS l FROM orders)""",
)
def non_residential(t: Tables):
    a = t.orders.select(
        F.col("o_orderkey").alias("apn"), F.when(F.col("o_orderkey") % 9 == 0, 2000000.0).otherwise(F.col("o_totalprice") / 4.0).alias("a"), (F.col("o_custkey") % 3).alias("n"),
        ((F.col("o_custkey") % 50) / 100.0).alias("c"), (F.col("o_orderkey") % 5).alias("l"),
    )
    return a.select("apn", K.non_residential("a", "n", "c", "l").alias("use"))


FORMS = ["detsf_sl", "detsf_ll", "attsf", "mf2to4", "mf5p", "commercial", None]
DU_ROWS = f"SELECT o_orderkey AS apn, ({_n(FORMS)})[cast(1 + o_orderkey % 7 AS int)] AS form, CASE WHEN o_custkey % 5 = 0 THEN cast(o_custkey % 11 AS int) END AS units, (o_custkey % 13) * 700e0 AS sqft, 400e0 + o_custkey % 900 AS per, {pick_sql('o_custkey', ['urban', 'industrial', 'mixed_use'])} AS cat, o_custkey % 25 AS county_id FROM orders"
_DU = "CASE WHEN units > 0 THEN units * 1e0 WHEN form IN ('detsf_sl', 'detsf_ll', 'attsf') THEN 1e0 WHEN form = 'mf2to4' AND sqft > 0 THEN greatest(2e0, round(sqft / per)) WHEN form = 'mf2to4' THEN 2e0 WHEN form = 'mf5p' AND sqft > 0 THEN greatest(5e0, round(sqft / per)) WHEN form = 'mf5p' THEN 5e0 WHEN form IS NULL AND cat IN ('urban', 'mixed_use') THEN 1e0 ELSE 0e0 END"
_VAC = "CASE form WHEN 'detsf_sl' THEN 0.025e0 WHEN 'detsf_ll' THEN 0.025e0 WHEN 'attsf' THEN 0.05e0 WHEN 'mf2to4' THEN 0.05e0 WHEN 'mf5p' THEN 0.08e0 ELSE 0.05e0 END"


def du_rows(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        k.alias("apn"), pick(k, FORMS).alias("form"), F.when(c % 5 == 0, (c % 11).cast("int")).alias("units"), ((c % 13) * 700.0).alias("sqft"),
        (400.0 + c % 900).alias("per"), pick(c, ["urban", "industrial", "mixed_use"]).alias("cat"), (c % 25).alias("county_id"),
    )
    return rows.withColumn("du", K.dwelling_units("units", "form", "sqft", "per", "cat"))


@query("CLS12_dwelling_units", f"WITH r AS ({DU_ROWS}) SELECT apn, {_DU} AS du FROM r")
def dwelling_units(t: Tables):
    return du_rows(t).select("apn", "du")


@query("CLS14_vacancy", f"WITH r AS ({DU_ROWS}) SELECT apn, {num(_VAC, 'vacancy')}, {num(f'{_DU} * (1e0 - {_VAC})', 'hh', 6)}, {num(f'{_DU} * (1e0 - {_VAC}) * 2.6e0', 'pop', 6)} FROM r")
def vacancy(t: Tables):
    r = du_rows(t).withColumn("vacancy", K.vacancy("form"))
    hh, pop = K.households_and_people("du", "vacancy", F.lit(2.6))
    return r.select("apn", rd("vacancy").alias("vacancy"), rd(hh, 6).alias("hh"), rd(pop, 6).alias("pop"))


@query(
    "CLS15_unit_subtypes",
    f"WITH r AS ({DU_ROWS}), u AS (SELECT *, {_DU} AS du FROM r), m AS (SELECT county_id AS c, "
    + ", ".join(f"sum(CASE WHEN form = '{s}' THEN du END) / nullif(sum(du), 0e0) AS m_{s}" for s in K.SUBTYPES)
    + f" FROM u WHERE form IN ({', '.join(repr(s) for s in K.SUBTYPES)}) GROUP BY county_id) SELECT apn, "
    + ", ".join(num(f"CASE WHEN form = '{s}' THEN du WHEN form IS NOT NULL THEN 0e0 ELSE du * coalesce(m_{s}, 0e0) END", "du_" + s, 6) for s in K.SUBTYPES)
    + " FROM u LEFT JOIN m ON c = county_id",
)
def unit_subtypes(t: Tables):
    return rounded(K.unit_subtypes(du_rows(t)).select("apn", *["du_" + s for s in K.SUBTYPES]), 6)


@query(
    "CLS13_sqft_per_unit",
    """WITH p AS (SELECT o_orderkey AS apn, CASE WHEN o_custkey % 3 = 0 THEN 'mf5p' ELSE 'mf2to4' END AS subtype, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey * 7 % 997) * 0.5e0 END AS d FROM orders),
    k AS (SELECT c_custkey AS nb, CASE WHEN c_nationkey % 2 = 0 THEN 'mf5p' ELSE 'mf2to4' END AS subtype, (c_custkey * 13 % 1009) * 0.5e0 AS d, abs(c_acctbal) AS s, 2 + c_custkey % 7 AS u FROM customer),
    n AS (SELECT p.apn, s, u, row_number() OVER (PARTITION BY p.apn ORDER BY abs(p.d - k.d), nb) AS rn FROM p JOIN k ON k.subtype = p.subtype WHERE p.d IS NOT NULL AND s > 0), l AS (SELECT apn, sum(s) / sum(u) AS v FROM n WHERE rn <= 20 GROUP BY apn), c AS (SELECT subtype, sum(s) / sum(u) AS v FROM k WHERE s > 0 GROUP BY subtype)
    SELECT p.apn, """ + num("coalesce(l.v, c.v)", "sqft_per_unit") + " FROM p LEFT JOIN l ON l.apn = p.apn LEFT JOIN c ON c.subtype = p.subtype",
)
def sqft_per_unit(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = t.orders.select(k.alias("apn"), F.when(c % 3 == 0, "mf5p").otherwise("mf2to4").alias("subtype"), F.when(k % 17 != 0, (c * 7 % 997) * 0.5).alias("intersection_density"))
    ck = F.col("c_custkey")
    known_rows = t.customer.select(
        ck.alias("apn"), F.when(F.col("c_nationkey") % 2 == 0, "mf5p").otherwise("mf2to4").alias("subtype"), ((ck * 13 % 1009) * 0.5).alias("intersection_density"),
        F.abs("c_acctbal").alias("res_sqft"), (2 + ck % 7).alias("units"),
    )
    return rounded(K.sqft_per_unit(p, known_rows).select("apn", "sqft_per_unit"))
