"""Scenario overlays, paint streams, network and pair queries (SCN, STR, TRN02, TRN04-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.operators import spatial as S
from landspan.plans import network as N
from landspan.plans import scenario as C
from landspan.plans import transport as T
from landspan.queries.alloc import BT_SQL, building_types
from landspan.queries.analysis import num, nums
from landspan.queries.binding import Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded
from landspan.session import scratch_path
from landspan.streaming import paint as P

# the paint log: some cells have an older value, some events clear
LOG = "SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE new_value / 2e0 END AS old_value FROM paint"


def log(t: Tables):
    return t.paint.withColumn("old_value", F.when(F.col("event_id") % 4 != 0, F.col("new_value") / 2.0))


LATEST = "SELECT scenario_id, feature_id, column_name, new_value AS painted_value, op FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, feature_id, column_name ORDER BY painted_at DESC, event_id DESC) AS rn FROM lg) WHERE rn = 1"
OVER = dict(lg=LOG, ov=f"SELECT scenario_id, feature_id, column_name, painted_value FROM ({LATEST}) WHERE op <> 'clear' AND painted_value IS NOT NULL")
KEY = C.KEY


@query("SCN02_paint_overlay", ctes("paint", **OVER) + "SELECT * FROM ov")
def paint_overlay(t: Tables):
    return C.overlay(log(t)).select(*KEY, "painted_value")


_OLD = "lag(CASE WHEN op <> 'clear' THEN new_value END) OVER (PARTITION BY scenario_id, feature_id, column_name ORDER BY painted_at, event_id)"


@query("SCN02_old_values", ctes("paint", lg=LOG) + f"SELECT event_id, scenario_id, feature_id, column_name, new_value, op, {_OLD} AS old_value FROM lg")
def old_values(t: Tables):
    out = C.with_old_values(t.paint.withColumn("painted_at", F.col("painted_at").cast("timestamp")))
    return out.select("event_id", *KEY, "new_value", "op", "old_value")


@query(
    "SCN05_undo_by_old_values",
    ctes("paint", lg0=f"SELECT scenario_id, feature_id, column_name, new_value, op, painted_at, event_id, batch_id, {_OLD} AS old_value FROM paint")
    + """, lg AS (SELECT scenario_id, feature_id, column_name, new_value, op, painted_at, event_id FROM lg0 UNION ALL SELECT scenario_id, feature_id, column_name, old_value, 'undo', TIMESTAMP '2025-01-01', event_id + 1000000000 FROM lg0 WHERE batch_id % 3 = 0)
    SELECT scenario_id, feature_id, column_name, painted_value FROM (""" + LATEST + ") WHERE op <> 'clear' AND painted_value IS NOT NULL",
)
def undo_by_old_values(t: Tables):
    full = C.with_old_values(t.paint.withColumn("painted_at", F.col("painted_at").cast("timestamp")))
    after = C.undo(full, F.col("batch_id") % 3 == 0, F.lit("2025-01-01 00:00:00").cast("timestamp"), 1, F.col("event_id") + 1000000000)
    return C.overlay(after).select(*KEY, "painted_value")


_E = "SELECT DISTINCT 1 AS scenario_id, feature_id, 'du' AS column_name, 7.5e0 AS painted_value FROM paint"


@query("SCN02_paint_log", ctes("paint", **OVER, ed=_E) + "SELECT ed.scenario_id, ed.feature_id, ed.column_name, ov.painted_value AS old_value, ed.painted_value AS new_value, 'paint' AS op, 77 AS batch_id FROM ed LEFT JOIN ov USING (scenario_id, feature_id, column_name)")
def paint_log(t: Tables):
    edits = t.paint.select(F.lit(1).cast("bigint").alias("scenario_id"), "feature_id", F.lit("du").alias("column_name"), F.lit(7.5).alias("painted_value")).distinct()
    rows = C.paint_events(C.overlay(log(t)), edits, F.current_timestamp(), 77)
    return rows.select(*KEY, "old_value", "new_value", "op", F.col("batch_id").cast("int").alias("batch_id"))


@query(
    "SNK03_paint_upsert",
    ctes("paint", **OVER) + ", e AS (SELECT DISTINCT 1 AS scenario_id, feature_id, 'du' AS column_name, 7.5e0 AS painted_value FROM paint) SELECT scenario_id, feature_id, column_name, painted_value FROM ov WHERE NOT (scenario_id = 1 AND column_name = 'du') UNION ALL SELECT * FROM e",
)
def paint_upsert(t: Tables):
    edits = t.paint.select(F.lit(1).cast("bigint").alias("scenario_id"), "feature_id", F.lit("du").alias("column_name"), F.lit(7.5).alias("painted_value")).distinct()
    C.check_columns(["du"])
    return C.paint(C.overlay(log(t)), edits)


BASE = "SELECT c_custkey AS parcel_id, c_acctbal AS du, c_nationkey * 1e0 AS pop, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 5e0 END AS emp, 1e0 AS hh, c_mktsegment AS land_use, c_nationkey / 10e0 AS acres FROM customer"


def base(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("parcel_id"), F.col("c_acctbal").alias("du"), (F.col("c_nationkey") * 1.0).alias("pop"), F.when(k % 3 != 0, 5.0).alias("emp"), F.lit(1.0).alias("hh"),
        F.col("c_mktsegment").alias("land_use"), (F.col("c_nationkey") / 10.0).alias("acres"),
    )


def _canvas(s: int) -> str:
    piv = ", ".join(f"max(CASE WHEN column_name = '{c}' THEN painted_value END) AS p_{c}" for c in ("du", "pop", "emp", "hh"))
    return f"SELECT parcel_id, {', '.join(f'coalesce(p_{c}, {c}) AS {c}' for c in ('du', 'pop', 'emp', 'hh'))}, land_use, acres, f IS NOT NULL AS uf_is_painted FROM bs LEFT JOIN (SELECT feature_id AS f, {piv} FROM ov WHERE scenario_id = {s} GROUP BY feature_id) ON f = parcel_id"


@query("SCN01_scenario_canvas", ctes("paint", bs=BASE, **OVER) + _canvas(1))
def scenario_canvas(t: Tables):
    out = C.scenario_canvas(base(t), C.overlay(log(t)), 1)
    return out.select("parcel_id", "du", "pop", "emp", "hh", "land_use", "acres", "uf_is_painted")


@query(
    "SCN03_paint_built_form",
    ctes("parcels", "built_forms") + ", j AS (SELECT parcel_id AS feature_id, gross_acres * du_per_acre AS u, gross_acres * emp_per_acre AS e, coalesce(nullif(household_size, 0e0), 2.5e0) AS s, coalesce(nullif(vacancy_rate, 0e0), 5e0) AS v, du_per_acre, emp_per_acre FROM parcels JOIN built_forms ON key = built_form_key), "
    "w AS (SELECT feature_id, CASE WHEN du_per_acre > 0 THEN u ELSE 0e0 END AS du, CASE WHEN emp_per_acre > 0 THEN e ELSE 0e0 END AS emp, s, v FROM j) SELECT 2 AS scenario_id, feature_id, column_name, " + num("painted_value", "painted_value", 6)
    + " FROM (SELECT feature_id, 'du' AS column_name, du AS painted_value FROM w UNION ALL SELECT feature_id, 'pop', du * s FROM w UNION ALL SELECT feature_id, 'hh', du * (1e0 - v / 100e0) FROM w UNION ALL SELECT feature_id, 'emp', emp FROM w)",
)
def paint_built_form(t: Tables):
    types = building_types(t).withColumnRenamed("id", "type_id")
    keys = types.select("type_id", F.col("key").alias("built_form_key"))
    features = t.parcels.join(keys, "built_form_key").select("parcel_id", F.col("gross_acres").alias("acres"), "type_id")
    return rounded(C.paint_building_type(features, types.drop("key"), 2), 6)


NAMES = ["sf detached", "townhouse row", "apartment 5plus", "mf 2to4", "multi family", "office"]


@query(
    "SCN03_paint_place_type",
    ctes("parcels", "built_forms", m="SELECT id % 5 AS place_type, id AS type_id, 10e0 + id / 7e0 AS percentage FROM built_forms", w="SELECT *, sum(percentage) OVER (PARTITION BY place_type) AS whole FROM m",
         j=f"SELECT parcel_id, sqrt(gross_acres + 0.003e0) * 0.75e0 * (percentage / whole) AS a, b.*, ({NAMES!r})[1 + b.id % 6] AS nm FROM parcels JOIN w ON place_type = parcel_id % 5 JOIN built_forms b ON b.id = type_id",
         u="SELECT parcel_id, nm, CASE WHEN du_per_acre > 0 THEN a * du_per_acre ELSE 0e0 END AS du, CASE WHEN emp_per_acre > 0 THEN a * emp_per_acre ELSE 0e0 END AS emp, coalesce(nullif(household_size, 0e0), 2.5e0) AS s, coalesce(nullif(vacancy_rate, 0e0), 5e0) AS v FROM j",
         g="""SELECT parcel_id, sum(du) AS du, sum(du * s) AS pop, sum(du * (1e0 - v / 100e0)) AS hh, sum(emp) AS emp, sum(CASE WHEN nm = 'sf detached' THEN du END) AS du_detsf, sum(CASE WHEN nm = 'townhouse row' THEN du END) AS du_attsf,
           sum(CASE WHEN nm = 'mf 2to4' THEN du WHEN nm = 'multi family' THEN du * 0.4e0 END) AS du_mf2to4, sum(CASE WHEN nm = 'apartment 5plus' THEN du WHEN nm = 'multi family' THEN du * 0.6e0 END) AS du_mf5p, sum(CASE WHEN nm IN ('mf 2to4', 'multi family', 'apartment 5plus') THEN du END) AS du_mf FROM u GROUP BY parcel_id""")
    + "SELECT 2 AS scenario_id, feature_id, column_name, " + num("v", "painted_value", 6) + " FROM (" + " UNION ALL ".join(f"SELECT parcel_id AS feature_id, '{c}' AS column_name, {c} AS v FROM g" for c in ("du", "pop", "hh", "emp", "du_detsf", "du_attsf", "du_mf2to4", "du_mf5p", "du_mf")) + ") WHERE v IS NOT NULL",
)
def paint_place_type(t: Tables):
    types = building_types(t).withColumnRenamed("id", "type_id").drop("key")
    types = types.withColumn("name", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("type_id") % 6 + 1).cast("int")))
    mixes = t.built_forms.select((F.col("id") % 5).alias("place_type"), F.col("id").alias("type_id"), (10.0 + F.col("id") / 7.0).alias("percentage"), F.lit(25.0).alias("row_pct"))
    features = t.parcels.select("parcel_id", F.sqrt(F.col("gross_acres") + 0.003).alias("acres"), (F.col("parcel_id") % 5).cast("int").alias("place_type"))
    return rounded(C.paint_place_type(features, mixes, types, 2), 6)


@query(
    "SCN04_clear_paint",
    ctes("paint", **OVER) + "SELECT 'kept' AS part, scenario_id, feature_id, column_name, painted_value AS v FROM ov WHERE NOT (feature_id % 2 = 0 AND column_name = 'pop') UNION ALL SELECT 'cleared', scenario_id, feature_id, column_name, painted_value FROM ov WHERE feature_id % 2 = 0 AND column_name = 'pop'",
)
def clear_paint(t: Tables):
    current = C.overlay(log(t)).select(*KEY, "painted_value")
    cells = t.paint.where("feature_id % 2 = 0 AND column_name = 'pop'").select(*KEY).distinct()
    kept, gone = C.clear(current, cells, F.current_timestamp(), 9)
    return kept.select(F.lit("kept").alias("part"), *KEY, F.col("painted_value").alias("v")).unionByName(
        gone.select(F.lit("cleared").alias("part"), *KEY, F.col("old_value").alias("v"))
    )


@query(
    "SCN05_undo",
    ctes("paint", lg0=LOG) + """, lg AS (SELECT scenario_id, feature_id, column_name, new_value, op, painted_at, event_id FROM lg0 UNION ALL SELECT scenario_id, feature_id, column_name, old_value, 'undo', TIMESTAMP '2025-01-01', event_id + 1000000000 FROM lg0 WHERE batch_id % 3 = 0)
    SELECT scenario_id, feature_id, column_name, painted_value FROM (""" + LATEST + ") WHERE op <> 'clear' AND painted_value IS NOT NULL",
)
def undo(t: Tables):
    at = F.lit("2025-01-01 00:00:00").cast(t.paint.schema["painted_at"].dataType)
    after = C.undo(log(t), F.col("batch_id") % 3 == 0, at, 1, F.col("event_id") + 1000000000)
    return C.overlay(after).select(*KEY, "painted_value")


RULES = [("du", "GT", 20.0, "block", "too dense"), ("pop", "LT", 3.0, "warn", "few people"), ("emp", "NOT_NULL", None, "warn", "missing"), ("hh", "GTE", 40.0, "warn", "many"), ("du", "EQ", 1.0, "warn", "one")]
RULES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{o}' AS operator, {'NULL' if v is None else v}::DOUBLE AS rule_value, '{s}' AS severity, '{m}' AS message" for c, o, v, s, m in RULES)
_VIOL = "CASE operator WHEN 'GT' THEN v > rule_value WHEN 'LT' THEN v < rule_value WHEN 'GTE' THEN v >= rule_value WHEN 'EQ' THEN v = rule_value WHEN 'NOT_NULL' THEN v IS NULL END"


def rules(t: Tables):
    return t.spark.createDataFrame(RULES, "column_name string, operator string, value double, severity string, message string")


@query(
    "SCN06_constraint_check",
    ctes("paint", e="SELECT event_id, column_name, CASE WHEN event_id % 6 = 0 THEN NULL ELSE new_value END AS v FROM paint", r=RULES_SQL) + f"SELECT event_id, e.column_name, operator, severity, message FROM e JOIN r ON r.column_name = e.column_name WHERE {_VIOL}",
)
def constraint_check(t: Tables):
    edits = t.paint.withColumn("painted_value", F.when(F.col("event_id") % 6 != 0, F.col("new_value")))
    return C.violations(edits, rules(t)).select("event_id", "column_name", "operator", "severity", "message")


@query(
    "SCN07_merge",
    ctes("paint", **OVER) + ", a AS (SELECT *, CASE WHEN feature_id % 3 <> 0 THEN 'approved' ELSE 'pending' END AS approval_status FROM ov), s AS (SELECT * FROM a WHERE scenario_id = 0 AND approval_status = 'approved'), t AS (SELECT feature_id, column_name FROM a WHERE scenario_id = 1) "
    "SELECT scenario_id, feature_id, column_name, painted_value, (SELECT count(*) FROM s WHERE (feature_id, column_name) NOT IN (SELECT feature_id, column_name FROM t)) AS rows_copied, (SELECT count(*) FROM s WHERE (feature_id, column_name) IN (SELECT feature_id, column_name FROM t)) AS rows_skipped "
    "FROM (SELECT scenario_id, feature_id, column_name, painted_value FROM a UNION ALL SELECT 1, feature_id, column_name, painted_value FROM s WHERE (feature_id, column_name) NOT IN (SELECT feature_id, column_name FROM t))",
)
def merge(t: Tables):
    # thin out the target so that there is something to copy
    ov = C.overlay(log(t)).select(*KEY, "painted_value").withColumn(
        "approval_status", F.when(F.col("feature_id") % 3 != 0, "approved").otherwise("pending")
    )
    out, counts = C.merge(ov, 0, 1)
    n = counts.select(F.struct("*")).scalar()
    return out.withColumn("_n", n).select(*KEY, "painted_value", "_n.*")


MEASURES = {"total_population": "pop", "total_households": "hh", "total_du": "du", "total_employment": "emp", "total_land_consumed_acres": "acres"}


def _totals(s: int) -> str:
    return f"SELECT 's{s}' AS scenario, " + ", ".join(num(f"coalesce(sum({c}), 0e0)", k, 2) for k, c in MEASURES.items()) + f" FROM ({_canvas(s)})"


@query("SCN09_compare_scenarios", ctes("paint", bs=BASE, **OVER) + _totals(0) + " UNION ALL " + _totals(1))
def compare_scenarios(t: Tables):
    ov = C.overlay(log(t))
    out = C.compare({f"s{i}": C.scenario_canvas(base(t), ov, i) for i in (0, 1)}, MEASURES)
    return rounded(out, 2)


@query(
    "SCN10_report_metrics",
    ctes("paint", bs=BASE, **OVER) + "SELECT " + ", ".join(num(f"sum({c})", k, 2) for k, c in MEASURES.items()) + ", (SELECT " + rds("round(sum(o_totalprice), 2)", 2) + " FROM orders) AS vmt_fee_revenue, 0e0 AS vmt_fee_revenue_forgone, (SELECT count(*) * 1e0 FROM orders) AS vmt_fee_vmt_exempt, 295e0 AS vmt_fee_rate FROM (" + _canvas(1) + ")",
)
def report_metrics(t: Tables):
    fees = t.orders.select(F.col("o_totalprice").alias("fee_revenue_total"), F.lit(0.0).alias("revenue_forgone"), F.lit(1.0).alias("vmt_exempt"))
    return rounded(C.report(C.scenario_canvas(base(t), C.overlay(log(t)), 1), fees, MEASURES), 2)


@query(
    "SCN11_table_diff",
    "WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders), b AS (SELECT o_orderkey + 10 AS k, o_orderstatus AS s, o_custkey AS c FROM orders) SELECT count(*) FILTER (WHERE a.k IS NULL) AS added, count(*) FILTER (WHERE b.k IS NULL) AS removed, "
    "count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND (a.s <> b.s OR a.c <> b.c)) AS changed, count(*) FILTER (WHERE a.s = b.s AND a.c = b.c) AS equal FROM a FULL JOIN b ON a.k = b.k",
)
def table_diff(t: Tables):
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    return C.row_diff(a, a.withColumn("k", F.col("k") + 10), ["k"])


@query("SCN12_current_values", ctes("paint", **OVER) + "SELECT feature_id, column_name, painted_value FROM ov WHERE scenario_id = 2")
def current_values(t: Tables):
    return C.current_values(C.overlay(log(t)), 2)


# --- streams ----------------------------------------------------------------------------


def landed_log(t: Tables) -> str:
    """The log as files in event order."""
    path = scratch_path(t.spark, "log")
    types = dict(x.split() for x in P.EVENT_SCHEMA.split(", "))
    ts = F.col("painted_at").cast("timestamp")
    rows = log(t).withColumn("painted_at", ts)
    rows.select(*[F.col(c).cast(k).alias(c) for c, k in types.items()]).repartitionByRange(4, "event_id").write.parquet(path)
    return path


@query("STR01_continuous_overlay", ctes("paint", **OVER) + "SELECT * FROM ov")
def continuous_overlay(t: Tables):
    state = scratch_path(t.spark, "overlay")
    P.continuous_overlay(P.read_log(t.spark, landed_log(t), 2), state).awaitTermination()
    return P.read_overlay(t.spark, state)


@query(
    "STR02_constraint_stream",
    ctes("paint", e="SELECT event_id, column_name, new_value AS v FROM paint WHERE op = 'paint'", r=RULES_SQL) + f"SELECT event_id, e.column_name, operator, severity FROM e JOIN r ON r.column_name = e.column_name WHERE {_VIOL}",
)
def constraint_stream(t: Tables):
    blocked, warned = scratch_path(t.spark, "blocked"), scratch_path(t.spark, "warned")
    P.screened_sinks(P.read_log(t.spark, landed_log(t)), rules(t), blocked, warned, scratch_path(t.spark, "ckpt")).awaitTermination()
    cols = ["event_id", "column_name", "operator", "severity"]
    return t.spark.read.parquet(blocked).select(*cols).unionByName(t.spark.read.parquet(warned).select(*cols))


@query(
    "STR03_edit_activity",
    # a bucket is closed once the newest event is two hours past its end
    ctes("paint") + "SELECT scenario_id, strftime(b, '%Y-%m-%d %H:%M') AS bucket, n AS edits FROM (SELECT scenario_id, date_trunc('hour', painted_at) AS b, count(*) AS n FROM paint GROUP BY 1, 2), (SELECT max(painted_at) AS newest FROM paint) WHERE b + INTERVAL 3 HOUR <= newest",
)
def edit_activity(t: Tables):
    path = scratch_path(t.spark, "activity")
    P.write_activity(P.read_log(t.spark, landed_log(t)), path, scratch_path(t.spark, "ckpt")).awaitTermination()
    return t.spark.read.parquet(path).select("scenario_id", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "edits")


@query("STR03_edit_activity_batch", ctes("paint") + "SELECT scenario_id, strftime(date_trunc('hour', painted_at), '%Y-%m-%d %H:%M') AS bucket, count(*) AS edits FROM paint GROUP BY 1, 2")
def edit_activity_batch(t: Tables):
    # the same operator on the landed log as a batch; the watermark has no effect there
    out = P.activity(t.paint.withColumn("painted_at", F.col("painted_at").cast("timestamp")))
    return out.select("scenario_id", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "edits")


# --- networks and pairs -----------------------------------------------------------------

_VID = "({c} + 2147483648) * 4294967296 + {r} + 2147483648"


@query(
    "TRN04_topology",
    ctes("roads") + """, e AS (SELECT floor(x1 / 10e0 + 0.5e0) AS a, floor(y1 / 10e0 + 0.5e0) AS b FROM roads UNION ALL SELECT floor(x2 / 10e0 + 0.5e0), floor(y2 / 10e0 + 0.5e0) FROM roads), v AS (SELECT a, b, count(*) AS d FROM e GROUP BY a, b)
    SELECT count(*) AS vertex_count, (SELECT count(*) FROM roads) AS edge_count, (SELECT count(*) FROM roads) AS total_edges, count(*) FILTER (WHERE d = 1) AS dead_end_count FROM v""",
)
def topology(t: Tables):
    vertices, edges = N.topology(t.roads, 10.0)
    return N.topology_report(vertices, edges)


@query(
    "TRN05_snap_parcels",
    ctes("parcels", "shops") + """, v AS (SELECT x, y, (cast(floor(x / 10e0 + 0.5e0) AS bigint) + 2147483648) AS a, (cast(floor(y / 10e0 + 0.5e0) AS bigint) + 2147483648) AS b FROM shops), g AS (SELECT a, b, min(x) AS x, min(y) AS y FROM v GROUP BY a, b)
    SELECT parcel_id, """ + num("min(sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)))", "distance_m") + " FROM parcels p, g GROUP BY parcel_id",
)
def snap_parcels(t: Tables):
    s = t.shops
    edges = s.select(F.col("poi_id").alias("id"), F.lit(1.0).alias("length"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    vertices, _ = N.topology(edges, 10.0)
    return rounded(N.snap(t.parcels, vertices, 500.0).select("parcel_id", "distance_m"))


@query(
    "TRN06_shortest_paths",
    """WITH RECURSIVE e AS (SELECT l_partkey AS k, cast(floor(l_partkey / 4) AS bigint) AS p, min(100e0 + l_linenumber * 10e0 + l_quantity) AS w FROM lineitem WHERE l_partkey > 0 GROUP BY l_partkey),
    up AS (SELECT k AS node, k AS anc, 0e0 AS d FROM e UNION ALL SELECT 0, 0, 0e0 UNION ALL SELECT up.node, e.p, up.d + e.w FROM up JOIN e ON e.k = up.anc),
    n AS (SELECT DISTINCT n_nationkey::BIGINT AS o FROM nation), s AS (SELECT DISTINCT s_suppkey AS t FROM supplier)
    SELECT a.node AS origin_parcel_id, b.node AS dest_parcel_id, """ + num("min(a.d + b.d) / 1000e0", "network_distance_km", 6) + " FROM up a JOIN n ON o = a.node JOIN up b ON b.anc = a.anc JOIN s ON t = b.node GROUP BY a.node, b.node",
)
def shortest_paths(t: Tables):
    """A tree of parts (parent = number / 4) with parallel lines of different length."""
    k = F.col("l_partkey")
    edges = t.lineitem.where("l_partkey > 0").select(
        k.alias("source"), F.floor(k / 4).cast("bigint").alias("target"), (100.0 + F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias("length")
    )
    origins = t.nation.select(F.col("n_nationkey").cast("bigint").alias("node"))
    targets = t.supplier.select(F.col("s_suppkey").alias("node"))
    costs = N.shortest_costs(edges, origins, targets)
    nodes = origins.unionByName(targets).distinct().select(F.col("node").alias("parcel_id"), F.col("node").alias("node_id"))
    return rounded(N.distance_matrix(costs, nodes), 6)


_Z = "SELECT s_suppkey AS parcel_id, (s_suppkey * 37 % 101) * 1e0 AS x, (s_suppkey * 53 % 97) * 1e0 AS y, abs(s_acctbal) AS trips, (s_suppkey % 13) * 10e0 AS emp, (s_suppkey % 7) * 4e0 AS du FROM supplier"


ALL_PAIRS = (
    f"""WITH z AS ({_Z}), p AS (SELECT a.parcel_id AS o, b.parcel_id AS t, a.trips, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, b.emp + b.du * 0.5e0 AS att FROM z a, z b),
    q AS (SELECT *, CASE WHEN d > 1e-10 THEN att * pow(d, -2e0) ELSE 0e0 END AS pull FROM p), s AS (SELECT o, sum(pull) AS s, sum(pull * d) AS sd FROM q GROUP BY o), i AS (SELECT t, sum(q.trips * pull / s) AS inbound FROM q JOIN s ON s.o = q.o WHERE s > 0 GROUP BY t)
    SELECT z.parcel_id, """ + nums(trips_outbound="CASE WHEN s > 0 THEN trips ELSE 0e0 END", trips_inbound="coalesce(inbound, 0e0)", trips_internal="CASE WHEN s > 0 THEN 0e0 ELSE trips END",
                                   avg_trip_length_km="CASE WHEN s > 0 AND trips > 0 THEN sd / s ELSE 0e0 END") + " FROM z JOIN s ON s.o = z.parcel_id LEFT JOIN i ON i.t = z.parcel_id"
)


def places(t: Tables):
    return t.supplier.selectExpr(*_Z.removeprefix("SELECT ").removesuffix(" FROM supplier").split(", "))


@query("TRN02_gravity_all_pairs", ALL_PAIRS)
def gravity_all_pairs(t: Tables):
    # several tiles even on the smallest tables
    return rounded(T.gravity_all(places(t), tile=32))


_NEAR = f"""WITH z AS ({_Z}), p AS (SELECT a.parcel_id AS o, b.parcel_id AS t, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM z a JOIN z b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 12.5e0 * 12.5e0)"""


@query("JOI20_bounded_pairs", _NEAR + f" SELECT o AS origin, t AS dest, {rds('d', 6)} AS network_distance_km FROM p")
def bounded_pairs(t: Tables):
    return rounded(T.pairs_within(places(t), 12.5), 6)
