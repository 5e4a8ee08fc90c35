"""Projections, filters, joins, aggregates, windows, sorts, sets, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.functions import filters as P
from landspan.operators import ranking as R
from landspan.operators import stats as ST
from landspan.queries.analysis import num, nums, same
from landspan.queries.binding import Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded

# --- projections -----------------------------------------------------------------


@query("PRJ01_null_default", ctes("parcels") + f"SELECT parcel_id, {num('coalesce(intersection_density, 0e0)', 'intersection_density')} FROM parcels")
def null_default(t: Tables):
    return rounded(t.parcels.select("parcel_id", X.or_zero("intersection_density").alias("intersection_density")))


@query("PRJ02_safe_ratio", ctes("parcels") + f"SELECT parcel_id, {num('value / nullif(intersection_density, 0e0)', 'r', 6)} FROM parcels")
def safe_ratio(t: Tables):
    return rounded(t.parcels.select("parcel_id", X.ratio("value", "intersection_density").alias("r")), 6)


@query(
    "PRJ03_case_ladder",
    ctes("parcels") + "SELECT parcel_id, CASE WHEN gross_acres > 4 THEN 'large' WHEN gross_acres > 2 THEN 'medium' WHEN gross_acres > 0.5e0 THEN 'small' ELSE 'tiny' END AS size_class FROM parcels",
)
def case_ladder(t: Tables):
    a = F.col("gross_acres")
    return t.parcels.select("parcel_id", X.ladder([(a > 4, "large"), (a > 2, "medium"), (a > 0.5, "small")], "tiny").alias("size_class"))


@query(
    "PRJ04_clamp",
    ctes("parcels") + f"SELECT parcel_id, {num('CASE WHEN intersection_density IS NOT NULL THEN least(greatest(intersection_density, 20e0), 150e0) END', 'clamped')}, {num('greatest(0e0, intersection_density - 100e0)', 'excess')} FROM parcels",
)
def clamp(t: Tables):
    d = F.col("intersection_density")
    return rounded(t.parcels.select("parcel_id", X.clamp(d, 20.0, 150.0).alias("clamped"), X.non_negative(d - 100.0).alias("excess")))


@query("PRJ05_round", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 7e0, 2) AS r2, round(l_quantity / 3e0, 4) AS r4 FROM lineitem")
def round_digits(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") / 7.0, 2).alias("r2"), F.round(F.col("l_quantity") / 3.0, 4).alias("r4"),
    )


@query("PRJ06_typed_literals", ctes("parcels") + "SELECT parcel_id, 0e0 AS zero, cast(NULL AS double) AS unknown_value, cast(NULL AS varchar) AS unknown_text FROM parcels")
def typed_literals(t: Tables):
    return t.parcels.select("parcel_id", F.lit(0.0).alias("zero"), X.typed_null("double").alias("unknown_value"), X.typed_null("string").alias("unknown_text"))


@query(
    "PRJ07_deltas",
    ctes("parcels", "base") + f"SELECT p.parcel_id, {num('coalesce(p.gross_acres, 0e0) - coalesce(b.gross_acres, 0e0)', 'gross_acres_delta')}, {num('coalesce(p.intersection_density, 0e0) - coalesce(b.intersection_density, 0e0)', 'intersection_density_delta')} FROM parcels p LEFT JOIN base b ON b.parcel_id = p.parcel_id",
)
def deltas(t: Tables):
    j = t.parcels.alias("p").join(t.base.alias("b"), F.col("p.parcel_id") == F.col("b.parcel_id"), "left")
    return rounded(j.select("p.parcel_id", *X.deltas("p", "b", ["gross_acres", "intersection_density"], "_delta")))


_M = ["population", "households", "building_sqft_total"]


@query("PRJ08_metric_template", ctes("base") + "SELECT " + ", ".join(num(f"sum({m}) / nullif(sum(gross_acres), 0e0)", m, 6) for m in _M) + " FROM base")
def metric_template(t: Tables):
    per_acre = X.per_metric(_M, lambda m: rd(X.ratio(F.sum(m), F.sum("gross_acres")), 6))
    return t.base.agg(*per_acre)


@query("PRJ10_canonical_mapping", "SELECT o_orderkey AS parcel_id, o_totalprice AS value, o_orderstatus AS land_use FROM orders")
def canonical_mapping(t: Tables):
    out = X.canonical(t.orders, {"parcel_id": "o_orderkey", "value": "o_totalprice", "land_use": "o_orderstatus"})
    return out.select("parcel_id", "value", "land_use")


@query(
    "PRJ11_blueprint_rows",
    ctes("built_forms") + f"SELECT key, id, {num('coalesce(building_coverage, 30e0)', 'building_coverage')}, {num('coalesce(pass_by_trip_pct, 0e0)', 'pass_by_trip_pct')}, {num('coalesce(du_per_acre, 0e0)', 'du_per_acre')}, '{{}}' AS jobs_by_sector FROM built_forms".replace("{{}}", "{}"),
)
def blueprint_rows(t: Tables):
    filled = {"building_coverage": 30.0, "pass_by_trip_pct": 0.0, "du_per_acre": 0.0}
    return rounded(t.built_forms.select("key", "id", *[F.coalesce(n, F.lit(v)).alias(n) for n, v in filled.items()], F.lit("{}").alias("jobs_by_sector")))


@query(
    "PRJ12_optional_input",
    ctes("parcels", "base") + f"SELECT p.parcel_id, {num('b.population', 'population')}, cast(NULL AS double) AS canopy FROM parcels p LEFT JOIN base b ON b.parcel_id = p.parcel_id",
)
def optional_input(t: Tables):
    out = X.optional_join(t.parcels.select("parcel_id"), t.base, "parcel_id", {"population": "double"})
    return rounded(X.optional_join(out, None, "parcel_id", {"canopy": "double"}))


# --- filters ---------------------------------------------------------------------

TREE = {
    "type": "group",
    "operator": "OR",
    "children": [
        {
            "type": "group",
            "operator": "AND",
            "children": [
                {"type": "column", "column": "gross_acres", "op": ">=", "value": 2},
                {"type": "column", "column": "land_use", "op": "LIKE", "value": "%HIGH%"},
                {"type": "column", "column": "status", "op": "NOT IN", "value": ["P"]},
            ],
        },
        {"type": "column", "column": "county_id", "op": "IN", "value": [3, 5]},
        {"type": "group", "children": []},
        {"type": "column", "column": "intersection_density", "op": "IS NULL"},
    ],
}


@query(
    "FLT01_filter_tree",
    ctes("parcels") + "SELECT parcel_id, status, county_id FROM parcels WHERE (gross_acres >= 2 AND land_use LIKE '%HIGH%' AND status NOT IN ('P')) OR county_id IN (3, 5) OR intersection_density IS NULL",
)
def filter_tree(t: Tables):
    return P.apply_filter(t.parcels, TREE).select("parcel_id", "status", "county_id")


@query(
    "FLT02_table_query",
    ctes("parcels") + "SELECT parcel_id, status, value FROM parcels WHERE status <> 'F' AND value > 100000 AND contains(land_use, 'URGENT') ORDER BY value DESC, parcel_id OFFSET 20 LIMIT 200",
)
def table_query(t: Tables):
    return P.table_query(
        t.parcels, [("status", "neq", "F"), ("value", "gt", 100000), ("land_use", "like", "URGENT")],
        ["parcel_id", "status", "value"], [F.desc("value"), F.asc("parcel_id")], limit=200, offset=20,
    )


@query("FLT03_any_of_list", ctes("block_groups") + "SELECT geoid, county_id FROM block_groups WHERE cast(county_id AS varchar) IN ('1', '7', '11')")
def any_of_list(t: Tables):
    return t.block_groups.where(F.col("county_id").cast("string").isin("1,7,11".split(","))).select("geoid", "county_id")


@query("FLT04_prefix_filter", "SELECT p_partkey, p_type FROM part WHERE left(p_type, 2) = concat('S', 'M') OR p_name LIKE 'red%'")
def prefix_filter(t: Tables):
    return t.part.where((F.substring("p_type", 1, 2) == "SM") | F.col("p_name").startswith("red")).select("p_partkey", "p_type")


@query(
    "FLT05_sigma_window",
    ctes("parcels")
    + f""", s AS (SELECT county_id AS c, avg(value) AS m, stddev_pop(value) AS sd FROM parcels GROUP BY county_id)
    SELECT p.parcel_id, {num('(value - m) / sd', 'z')} FROM parcels p JOIN s ON c = county_id WHERE value BETWEEN m - 1.5e0 * sd AND m + 1.5e0 * sd""",
)
def sigma_window(t: Tables):
    s = t.parcels.groupBy(F.col("county_id").alias("c")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    v, m, sd = F.col("value"), F.col("m"), F.col("sd")
    on = (F.col("county_id") == F.col("c")) & v.between(m - 1.5 * sd, m + 1.5 * sd)
    return rounded(t.parcels.join(s, on).select("parcel_id", ((v - m) / sd).alias("z")))


@query("FLT06_bounding_box", ctes("parcels") + "SELECT parcel_id FROM parcels WHERE xmin < 20000 AND xmax > 5000 AND ymin < 3000 AND ymax > 400")
def bounding_box(t: Tables):
    from landspan.sources.readers import in_bbox

    return t.parcels.where(in_bbox(5000, 400, 20000, 3000)).select("parcel_id")


@query("FLT07_observed_rows", ctes("sales") + "SELECT apn, sale_id FROM sales WHERE living_area IS NOT NULL OR building_sf IS NOT NULL")
def observed_rows(t: Tables):
    return t.sales.where("living_area IS NOT NULL OR building_sf IS NOT NULL").select("apn", "sale_id")


@query("FLT08_applicable_rows", ctes("base") + "SELECT parcel_id FROM base WHERE employment_total > 10 OR (population > 15 AND households > 0)")
def applicable_rows(t: Tables):
    farmed = F.col("employment_total") > 10
    lived_in = (F.col("population") > 15) & (F.col("households") > 0)
    return t.base.where(farmed | lived_in).select("parcel_id")


# --- joins -----------------------------------------------------------------------


@query("JOI01_left_join", ctes("parcels", "base") + f"SELECT p.parcel_id, {num('b.population', 'population')} FROM parcels p LEFT JOIN base b ON b.parcel_id = p.parcel_id")
def left_join(t: Tables):
    return rounded(t.parcels.select("parcel_id").join(t.base.select("parcel_id", "population"), "parcel_id", "left"))


@query("JOI02_inner_join", ctes("pairs", "block_groups") + f"SELECT parcel_id, zone_id, {num('overlap * pop', 'v', 2)} FROM pairs JOIN block_groups ON geoid = zone_id")
def inner_join(t: Tables):
    j = t.pairs.join(t.block_groups, F.col("geoid") == F.col("zone_id"))
    return j.select("parcel_id", "zone_id", rd(F.col("overlap") * F.col("pop"), 2).alias("v"))


CODES = "SELECT DISTINCT left(p_type, 2) AS use_code, left(p_type, 1) AS category FROM part"


@query("JOI05_code_prefix_join", f"WITH codes AS ({CODES}) SELECT p_partkey, category FROM part LEFT JOIN codes ON left(p_type, 2) = use_code AND use_code <> 'ST'")
def code_prefix_join(t: Tables):
    codes = t.part.select(F.substring("p_type", 1, 2).alias("use_code"), F.substring("p_type", 1, 1).alias("category")).distinct()
    codes = codes.where("use_code <> 'ST'")
    return t.part.join(codes, F.substring("p_type", 1, 2) == F.col("use_code"), "left").select("p_partkey", "category")


@query(
    "JOI06_two_level_lookup",
    """WITH m AS (SELECT 'A' AS subtype, 'O' AS class, 'exact' AS category UNION ALL SELECT 'A', NULL, 'any_a' UNION ALL SELECT 'R', NULL, 'any_r')
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(x.category, y.category, 'urban') AS category FROM lineitem
    LEFT JOIN m x ON x.subtype = l_returnflag AND x.class = l_linestatus LEFT JOIN m y ON y.subtype = l_returnflag AND y.class IS NULL""",
)
def two_level_lookup(t: Tables):
    from landspan.plans.landcover import lookup_category

    m = t.spark.createDataFrame([("A", "O", "exact"), ("A", None, "any_a"), ("R", None, "any_r")], "subtype string, class string, category string")
    rows = t.lineitem.withColumnsRenamed({"l_returnflag": "subtype", "l_linestatus": "class"})
    return lookup_category(rows, m).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "category")


@query("JOI07_one_row_join", ctes("base") + f"SELECT parcel_id, {num('population / total', 'share', 9)} FROM base, (SELECT sum(population) AS total FROM base)")
def one_row_join(t: Tables):
    total = t.base.agg(F.sum("population")).scalar()
    return t.base.select("parcel_id", rd(F.col("population") / total, 9).alias("share"))


@query("JOI08_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(t: Tables):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("JOI09_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_join(t: Tables):
    returned = t.lineitem.where("l_returnflag = 'R'")
    return t.orders.join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query(
    "JOI11_lateral_top1",
    "SELECT o_orderkey, l_partkey, l_extendedprice FROM (SELECT o_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rn FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE rn = 1",
)
def lateral_top1(t: Tables):
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    best = R.first_per(j, ["o_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber")])
    return best.select("o_orderkey", "l_partkey", "l_extendedprice")


TRACTS = "SELECT lpad(cast(o_custkey AS varchar), 6, '0') AS code, o_orderkey FROM orders"


@query(
    "JOI12_prefix_fallback",
    f"""WITH p AS ({TRACTS}), z AS (SELECT lpad(cast(s_suppkey * 10 AS varchar), 6, '0') AS geoid, s_nationkey FROM supplier),
    one AS (SELECT left(geoid, 5) AS tract, min_by(s_nationkey, geoid) AS county FROM z GROUP BY left(geoid, 5))
    SELECT o_orderkey, county FROM p LEFT JOIN one ON left(code, 5) = tract""",
)
def prefix_fallback(t: Tables):
    zones = t.supplier.select(X.zero_pad(F.col("s_suppkey") * 10, 6).alias("geoid"), "s_nationkey")
    one = zones.groupBy(F.substring("geoid", 1, 5).alias("tract")).agg(F.min_by("s_nationkey", "geoid").alias("county"))
    p = t.orders.select("o_orderkey", X.zero_pad("o_custkey", 6).alias("code"))
    return p.join(one, F.substring("code", 1, 5) == F.col("tract"), "left").select("o_orderkey", "county")


@query(
    "JOI13_tiered_fallback",
    f"""WITH p AS ({TRACTS}), z AS (SELECT lpad(cast(c_custkey * 3 AS varchar), 6, '0') AS geoid, c_acctbal AS v FROM customer),
    b AS (SELECT left(geoid, 5) AS k, avg(v) AS v FROM z GROUP BY 1), c AS (SELECT left(geoid, 4) AS k, avg(v) AS v FROM z GROUP BY 1)
    SELECT o_orderkey, {num('coalesce(z.v, b.v, c.v)', 'v')}, CASE WHEN z.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS tier
    FROM p LEFT JOIN z ON z.geoid = code LEFT JOIN b ON b.k = left(code, 5) LEFT JOIN c ON c.k = left(code, 4)""",
)
def tiered_fallback(t: Tables):
    z = t.customer.select(X.zero_pad(F.col("c_custkey") * 3, 6).alias("geoid"), F.col("c_acctbal").alias("v1"))

    def mean_by(width: int, name: str):
        return z.groupBy(F.substring("geoid", 1, width).alias("k" + name)).agg(F.avg("v1").alias("v" + name))

    p = t.orders.select("o_orderkey", X.zero_pad("o_custkey", 6).alias("code"))
    j = p.join(z, F.col("geoid") == F.col("code"), "left")
    j = j.join(mean_by(5, "2"), F.col("k2") == F.substring("code", 1, 5), "left")
    j = j.join(mean_by(4, "3"), F.col("k3") == F.substring("code", 1, 4), "left")
    tier = X.ladder([(F.col(f"v{i}").isNotNull(), i) for i in (1, 2, 3)])
    return j.select("o_orderkey", rd(F.coalesce("v1", "v2", "v3")).alias("v"), tier.alias("tier"))


@query(
    "JOI21_update_from_join",
    ctes("base") + f""", u AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)
    SELECT parcel_id, {num('coalesce(q, population)', 'population')} FROM base LEFT JOIN u ON l_orderkey = parcel_id""",
)
def update_from_join(t: Tables):
    u = t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("parcel_id")).agg(F.sum("l_quantity").alias("q"))
    return rounded(t.base.join(u, "parcel_id", "left").select("parcel_id", F.coalesce("q", "population").alias("population")))


@query("JOI22_distinct_key_join", f"SELECT {num('sum(o_totalprice)', 'total', 2)}, count(*) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey")
def distinct_key_join(t: Tables):
    keys = t.lineitem.where("l_quantity > 45").select("l_orderkey")
    kept = t.orders.join(keys, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return kept.agg(rd(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


# --- aggregates ------------------------------------------------------------------


@query("AGG01_grouped", f"SELECT l_returnflag, l_linestatus, {num('sum(l_quantity)', 's')}, count(*) AS n, {num('avg(l_discount)', 'a', 6)}, min(l_partkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
def grouped(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        rd(F.sum("l_quantity")).alias("s"), F.count("*").alias("n"), rd(F.avg("l_discount"), 6).alias("a"),
        F.min("l_partkey").alias("lo"), F.max("l_suppkey").alias("hi"),
    )


@query("AGG02_global", ctes("base") + f"SELECT {nums(du='sum(dwelling_units_total)', pop='sum(population)', emp='sum(employment_total)')}, count(*) AS n FROM base")
def global_row(t: Tables):
    return t.base.agg(rd(F.sum("dwelling_units_total")).alias("du"), rd(F.sum("population")).alias("pop"), rd(F.sum("employment_total")).alias("emp"), F.count("*").alias("n"))


@query("AGG03_filtered", f"SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, {num('sum(l_quantity) FILTER (WHERE l_returnflag <> {q}A{q})'.replace('{q}', chr(39)), 'q')} FROM lineitem GROUP BY l_suppkey")
def filtered(t: Tables):
    a = F.col("l_returnflag") == "A"
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(a).alias("n_a"), rd(F.sum(F.when(~a, F.col("l_quantity")))).alias("q"))


@query("AGG04_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def distinct_counts(t: Tables):
    # two plain groupings instead of one set per group: a hot flag is split by supplier
    return t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.lit(1).alias("_one")).groupBy("l_returnflag").agg(F.count("*").alias("suppliers"))


@query("AGG05_weighted_mean", ctes("pairs") + f"SELECT zone_id, {num('sum(overlap * weight) / nullif(sum(weight), 0e0)', 'm')} FROM pairs GROUP BY zone_id")
def weighted_mean(t: Tables):
    return t.pairs.groupBy("zone_id").agg(rd(X.ratio(F.sum(F.col("overlap") * F.col("weight")), F.sum("weight"))).alias("m"))


@query(
    "AGG06_weighted_correlation",
    f"""SELECT l_returnflag, {rds('(sw * swxy - swx * swy) / nullif(sqrt(greatest(0e0, sw * swxx - swx * swx)) * sqrt(greatest(0e0, sw * swyy - swy * swy)), 0e0)', 6)} AS r FROM
    (SELECT l_returnflag, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * x) AS swxx, sum(w * y * y) AS swyy, sum(w * x * y) AS swxy FROM
    (SELECT l_returnflag, l_tax + 1e0 AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY l_returnflag)""",
)
def weighted_correlation(t: Tables):
    from landspan.plans.comparison import weighted_r

    w = F.col("l_tax") + 1.0
    return t.lineitem.groupBy("l_returnflag").agg(rd(weighted_r(F.col("l_quantity"), F.col("l_extendedprice"), w), 6).alias("r"))


@query(
    "AGG07_percentiles",
    f"SELECT l_linestatus, {num('quantile_cont(l_extendedprice, 0.5)', 'median')}, {num('quantile_cont(l_extendedprice, 0.9)', 'p90')} FROM lineitem GROUP BY l_linestatus",
)
def percentiles(t: Tables):
    return rounded(R.percentiles(t.lineitem, "l_extendedprice", {"median": 0.5, "p90": 0.9}, ["l_linestatus"]))


@query(
    "AGG08_mode",
    "SELECT l_suppkey, l_linenumber AS mode FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY l_suppkey, l_linenumber) WHERE rn = 1",
)
def mode(t: Tables):
    return R.modes(t.lineitem, ["l_suppkey"], "l_linenumber")


@query("AGG09_stddev", f"SELECT l_returnflag, {num('stddev_pop(l_quantity)', 'sp', 6)}, {num('stddev_samp(l_quantity)', 'ss', 6)} FROM lineitem GROUP BY l_returnflag")
def stddev(t: Tables):
    return rounded(t.lineitem.groupBy("l_returnflag").agg(F.stddev_pop("l_quantity").alias("sp"), F.stddev_samp("l_quantity").alias("ss")), 6)


@query(
    "AGG10_conditional_pivot",
    ctes("paint") + "SELECT feature_id, " + ", ".join(num(f"max(CASE WHEN column_name = '{c}' THEN new_value END)", c) for c in ("du", "pop", "emp", "hh")) + " FROM paint GROUP BY feature_id",
)
def conditional_pivot(t: Tables):
    return rounded(t.paint.groupBy("feature_id").pivot("column_name", ["du", "pop", "emp", "hh"]).agg(F.max("new_value")))


@query("AGG11_having", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6")
def having(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 6")


@query("AGG12_distinct_rows", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def distinct_rows(t: Tables):
    return t.lineitem.select("l_partkey", "l_returnflag").distinct()


@query("AGG13_extent", ctes("buildings") + "SELECT parcel_id, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM buildings GROUP BY parcel_id")
def extent(t: Tables):
    from landspan.sources.readers import extent_of

    return extent_of(t.buildings, ["parcel_id"])


@query(
    "AGG14_histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    x AS (SELECT cast(floor((o_totalprice - lo) / (hi * (1 + 1e-10) - lo) * 10) AS bigint) + 1 AS bin, lo, hi FROM orders, b)
    SELECT bin, """ + nums(bin_min="lo + (hi - lo) / 10 * (bin - 1)", bin_max="lo + (hi - lo) / 10 * bin") + ", count(*) AS count FROM x GROUP BY bin, lo, hi",
)
def histogram(t: Tables):
    return rounded(ST.histogram(t.orders, "o_totalprice"))


@query("AGG15_frequencies", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
def frequencies(t: Tables):
    return ST.frequencies(t.orders, "o_orderpriority")


@query("AGG16_scalar_sum", ctes("base") + f"SELECT parcel_id, {num('gross_acres / (SELECT sum(gross_acres) FROM base)', 'share', 9)} FROM base")
def scalar_sum(t: Tables):
    return t.base.select("parcel_id", rd(F.col("gross_acres") / t.base.agg(F.sum("gross_acres")).scalar(), 9).alias("share"))


# --- windows ---------------------------------------------------------------------


@query(
    "WIN01_row_number_dedup",
    ctes("sales") + "SELECT apn, sale_id, year_built FROM (SELECT *, row_number() OVER (PARTITION BY apn ORDER BY year_built DESC NULLS LAST, sale_id) AS rn FROM sales) WHERE rn = 1",
)
def row_number_dedup(t: Tables):
    return R.first_per(t.sales, ["apn"], [F.desc_nulls_last("year_built"), F.asc("sale_id")]).select("apn", "sale_id", "year_built")


@query(
    "WIN02_top_k",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5",
)
def top_k(t: Tables):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return R.top_per(t.lineitem, ["l_suppkey"], order, 5, "rn").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rn")


@query("WIN03_share_of_total", ctes("pairs") + f"SELECT parcel_id, zone_id, {num('overlap / sum(overlap) OVER (PARTITION BY parcel_id)', 'share', 6)} FROM pairs")
def share_of_total(t: Tables):
    p = R.with_group_totals(t.pairs, ["parcel_id"], [F.sum("overlap").alias("whole")])
    return p.select("parcel_id", "zone_id", rd(F.col("overlap") / F.col("whole"), 6).alias("share"))


@query("WIN04_percent_rank", f"SELECT o_orderkey, {num('percent_rank() OVER (ORDER BY o_totalprice)', 'pr', 9)} FROM orders")
def percent_rank(t: Tables):
    return R.with_percent_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "pr").select("o_orderkey", rd("pr", 9).alias("pr"))


@query("WIN05_ntile", "SELECT tile, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM (SELECT o_totalprice, ntile(7) OVER (ORDER BY o_totalprice) AS tile FROM orders) GROUP BY tile")
def ntile(t: Tables):
    return R.ntile_ranges(t.orders, "o_totalprice", 7)


@query("WIN06_group_mean", ctes("parcels") + f"SELECT parcel_id, {num('coalesce(intersection_density, avg(intersection_density) OVER (PARTITION BY county_id))', 'filled', 6)} FROM parcels")
def group_mean(t: Tables):
    p = R.with_group_totals(t.parcels, ["county_id"], [F.avg("intersection_density").alias("m")])
    return p.select("parcel_id", rd(F.coalesce("intersection_density", "m"), 6).alias("filled"))


# --- sorts and sets --------------------------------------------------------------


@query("SRT01_order_by", ctes("base") + "SELECT parcel_id, population FROM base ORDER BY parcel_id")
def order_by(t: Tables):
    return t.base.select("parcel_id", "population").orderBy("parcel_id")


@query(
    "SRT02_distinct_on",
    "SELECT l_orderkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_suppkey, l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1",
)
def distinct_on(t: Tables):
    order = [F.desc("l_shipdate"), F.asc("l_suppkey"), F.asc("l_partkey"), F.asc("l_linenumber")]
    return R.first_per(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_suppkey", "l_extendedprice")


@query("SRT03_table_page", ctes("parcels") + "SELECT parcel_id, value FROM parcels ORDER BY value DESC NULLS LAST, parcel_id OFFSET 100 LIMIT 50")
def table_page(t: Tables):
    return P.page(t.parcels.select("parcel_id", "value"), "value", ["value", "parcel_id"], "parcel_id", 3, 50, True)


@query("SRT04_history_page", ctes("paint") + "SELECT event_id, feature_id, column_name FROM paint ORDER BY painted_at DESC NULLS LAST, event_id OFFSET 25 LIMIT 25")
def history_page(t: Tables):
    return P.page(t.paint, "painted_at", ["painted_at"], "event_id", 2, 25, True).select("event_id", "feature_id", "column_name")


@query("SRT05_sample_rows", "SELECT o_orderkey AS parcel_id, o_totalprice AS value FROM orders ORDER BY md5(concat('42:', cast(o_orderkey AS varchar))), o_orderkey LIMIT 100")
def sample_rows(t: Tables):
    # a hash of seed and key, so that a rerun on other partitions draws the same rows
    order = F.md5(F.concat(F.lit("42:"), F.col("parcel_id").cast("string")).cast("binary"))
    return t.parcels.select("parcel_id", "value").orderBy(order, "parcel_id").limit(100)


@query("SET01_union_all", "SELECT l_orderkey AS k, l_quantity AS v FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def union_all(t: Tables):
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return a.unionByName(t.orders.select(F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k")))


@query("SET02_union_distinct", "SELECT l_partkey AS k FROM lineitem UNION SELECT o_custkey FROM orders")
def union_distinct(t: Tables):
    return t.lineitem.select(F.col("l_partkey").alias("k")).union(t.orders.select("o_custkey")).distinct()


# --- scalar functions ------------------------------------------------------------


@query(
    "SCA01_strings",
    "SELECT c_custkey, left(c_mktsegment, 3) AS l3, c_name || '/' || c_mktsegment AS joined, concat('x', c_mktsegment) AS cc, trim('  ' || c_name || ' ') AS tr, c_mktsegment LIKE 'A%' AS lk, "
    "split_part(c_name, '#', 2) AS part2, lpad(cast(c_nationkey AS varchar), 3, '0') AS padded, nullif(trim(CASE WHEN c_nationkey = 3 THEN '  ' ELSE c_mktsegment END), '') AS blank FROM customer",
)
def strings(t: Tables):
    seg = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.left(seg, F.lit(3)).alias("l3"), F.concat_ws("/", "c_name", seg).alias("joined"), F.concat(F.lit("x"), seg).alias("cc"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("tr"), seg.like("A%").alias("lk"), F.split("c_name", "#")[1].alias("part2"),
        X.zero_pad("c_nationkey", 3).alias("padded"), X.blank_to_null(F.when(F.col("c_nationkey") == 3, "  ").otherwise(seg)).alias("blank"),
    )


@query("SCA02_dates", "SELECT s_suppkey, cast(make_date(2000 + s_nationkey, 1, 1) AS varchar) AS d, true AS now_known FROM supplier")
def dates(t: Tables):
    first = F.make_date(F.lit(2000) + F.col("s_nationkey"), F.lit(1), F.lit(1))
    return t.supplier.select("s_suppkey", first.cast("string").alias("d"), F.current_timestamp().isNotNull().alias("now_known"))


@query(
    "SCA03_math",
    "SELECT c_custkey, " + nums(e="exp(c_acctbal / 10000e0)", s="sqrt(abs(c_acctbal))", p="pow(c_nationkey, 3e0)", area="pi() * c_nationkey", a="abs(c_acctbal)",
                                g="1e0 / (1e0 + exp(0e0 - c_acctbal / 1000e0))", l="log10(abs(c_acctbal) + 1e0)") + ", NULL AS nan_gone FROM customer",
)
def math_functions(t: Tables):
    b = F.col("c_acctbal")
    return rounded(
        t.customer.select(
            "c_custkey", F.exp(b / 10000.0).alias("e"), F.sqrt(F.abs(b)).alias("s"), F.pow("c_nationkey", F.lit(3.0)).alias("p"),
            (F.pi() * F.col("c_nationkey")).alias("area"), F.abs(b).alias("a"), X.sigmoid(b / 1000.0).alias("g"), F.log10(F.abs(b) + 1.0).alias("l"),
            X.nan_to_null(F.lit(float("nan")) * b).alias("nan_gone"),
        )
    )


@query("SCA04_arrays", "SELECT vec_id, " + num("embedding[1]", "first_value") + ", cast(len(embedding) AS int) AS n, label AS inner_label FROM embeddings")
def arrays(t: Tables):
    s = t.embeddings.withColumn("s", F.array(F.struct(F.col("embedding")[0].cast("double").alias("value"), "label")))
    return s.select("vec_id", rd(X.first_field("s", "value")).alias("first_value"), F.size("embedding").alias("n"), F.col("s")[0]["label"].alias("inner_label"))


@query("SCA05_json", "SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k, coalesce(json_extract_string(props, '$.none'), 'default') AS missing FROM events")
def json_maps(t: Tables):
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.try_element_at(m, F.lit("k")).cast("int").alias("k"), F.coalesce(F.try_element_at(m, F.lit("none")), F.lit("default")).alias("missing"))


@query("SCA06_null_safe_compare", ctes("sales") + "SELECT apn, sale_id, units IS DISTINCT FROM (year_built % 6) AS differs FROM sales")
def null_safe_compare(t: Tables):
    return t.sales.select("apn", "sale_id", X.differs("units", F.col("year_built") % 6).alias("differs"))


@query(
    "SCA07_units",
    ctes("parcels") + f"SELECT parcel_id, {nums(sqft='gross_acres * 43560e0', sqm='gross_acres * 43560e0 * 0.092903e0', acres='value / 4046.86e0', back='value * 10.7639e0')}, {num('value / 2589988.11e0', 'sqmi', 8)} FROM parcels",
)
def units(t: Tables):
    from landspan.params import SQFT_PER_ACRE, SQFT_TO_SQM, SQM_PER_SQMI, SQM_TO_SQFT

    a, v = F.col("gross_acres"), F.col("value")
    return t.parcels.select(
        "parcel_id", rd(a * SQFT_PER_ACRE).alias("sqft"), rd(a * SQFT_PER_ACRE * SQFT_TO_SQM).alias("sqm"), rd(X.sqm_to_acres("value")).alias("acres"),
        rd(v * SQM_TO_SQFT).alias("back"), rd(v / SQM_PER_SQMI, 8).alias("sqmi"),
    )
