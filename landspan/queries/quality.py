"""Statistics, imputation, models, audits and the function surface (STA, IMP, ML, AUD, UDF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators import allocate as A
from landspan.operators import impute as I
from landspan.operators import stats as ST
from landspan.operators.ranking import first_per
from landspan.plans import audits as Q
from landspan.plans import classify as K
from landspan.plans import ml
from landspan.plans import modules as M
from landspan.plans.canvas import HOME_AREAS, JOB_AREAS
from landspan.queries import alloc
from landspan.queries import analysis as AN
from landspan.queries import assessor as AS
from landspan.queries.analysis import num, nums, same
from landspan.queries.binding import Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded
from landspan.session import scratch_path

# --- statistics ---------------------------------------------------------------------------

COLS = ["c_acctbal", "c_nationkey", "odd"]
CUST = "SELECT c_acctbal, c_nationkey * 1e0 AS c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE pow(c_custkey % 30, 3e0) END AS odd FROM customer"


def cust(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select("c_acctbal", (F.col("c_nationkey") * 1.0).alias("c_nationkey"), F.when(k % 3 != 0, F.pow(k % 30, F.lit(3.0))).alias("odd"))


def _profile(c: str) -> str:
    q = ", ".join(f"quantile_cont({c}, {p}) AS {n}" for n, p in ST.PROBS.items())
    return f"SELECT '{c}' AS column_name, count(*) AS count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, min({c}) AS min_value, max({c}) AS max_value, avg({c}) AS mean, stddev_samp({c}) AS stddev, {q} FROM cu"


PROFILE = dict(cu=CUST, pf=" UNION ALL ".join(map(_profile, COLS)))
_PN = ["min_value", "max_value", "mean", "stddev", *ST.PROBS]


@query("STA01_column_profile", "WITH cu AS (" + CUST + "), pf AS (" + PROFILE["pf"] + f") SELECT column_name, count, null_count, distinct_count, {same(' '.join(_PN))}, distinct_count < 20 AS is_categorical FROM pf")
def column_profile(t: Tables):
    return rounded(ST.profile(cust(t), COLS))


def breaks_query(name: str, method: str, sql: str, digits: int = 4, classes: int = 5):
    @query(name, sql)
    def _run(t: Tables):
        edges = ST.breaks(t.orders, "o_totalprice", method, classes)
        return rounded(t.spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "i bigint, edge double"), digits)


_LH = "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders), (SELECT unnest(range(0, 6)) AS i)"
breaks_query("STA02_equal_interval", "equal_interval", f"SELECT i, {num('lo + (hi - lo) / 5e0 * i', 'edge')} FROM {_LH}")
breaks_query(
    "STA03_quantile_breaks", "quantile",
    f"WITH t AS (SELECT tile, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM (SELECT o_totalprice, ntile(5) OVER (ORDER BY o_totalprice) AS tile FROM orders) GROUP BY tile) SELECT 0 AS i, {num('lo', 'edge')} FROM t WHERE tile = 1 UNION ALL SELECT tile, {num('hi', 'edge')} FROM t",
)
breaks_query("STA04_logarithmic_breaks", "logarithmic", f"SELECT i, {num('CASE i WHEN 0 THEN lo WHEN 5 THEN hi ELSE pow(10e0, log10(lo) + (log10(hi) - log10(lo)) / 5e0 * i) END', 'edge', 2)} FROM {_LH}", 2)
breaks_query("STA05_std_breaks", "std_deviation", f"SELECT i, {num('m + (i - 2) * sd', 'edge', 2)} FROM {_LH}", 2)


# every way to cut the ten bins into four classes, and the cheapest
_BINS = f"""b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    x AS (SELECT cast(floor((o_totalprice - lo) / (hi * (1 + 1e-10) - lo) * 10) AS bigint) + 1 AS bin, lo, hi FROM orders, b),
    h AS (SELECT row_number() OVER (ORDER BY bin) AS i, (lo + (hi - lo) / 10 * (bin - 1) + lo + (hi - lo) / 10 * bin) / 2e0 AS v, count(*) AS n FROM x GROUP BY bin, lo, hi),
    m AS (SELECT max(i) AS m FROM h),
    seg AS (SELECT a.i AS f, z.i AS t, sum(c.n * c.v * c.v) - sum(c.n * c.v) * sum(c.n * c.v) / sum(c.n) AS cost FROM h a JOIN h z ON a.i <= z.i JOIN h c ON c.i BETWEEN a.i AND z.i GROUP BY 1, 2),
    cuts AS (SELECT p.t AS e1, q.t AS e2, r.t AS e3, m, p.cost + q.cost + r.cost + s.cost AS cost FROM m, seg p JOIN seg q ON q.f = p.t + 1 JOIN seg r ON r.f = q.t + 1 JOIN seg s ON s.f = r.t + 1 WHERE p.f = 1 AND s.t = m),
    top AS (SELECT * FROM cuts ORDER BY cost LIMIT 1)"""


@query("STA06_natural_breaks", f"WITH {_BINS} SELECT k AS i, {num('v', 'edge')} FROM top, (VALUES (0), (1), (2), (3), (4)) e(k) JOIN h ON h.i = CASE k WHEN 0 THEN 1 WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 ELSE m END")
def natural_breaks(t: Tables):
    edges = ST.breaks(t.orders, "o_totalprice", "natural_breaks", 4)
    return rounded(t.spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "i int, edge double"))


MANUAL = [1000.0, 100000.0, 200000.0, 450000.0]
_CLS = "CASE WHEN o_totalprice < 1000 THEN NULL WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice <= 450000 THEN 3 END"


@query("STA07_manual_classes", f"SELECT {_CLS} AS class, count(*) AS n FROM orders GROUP BY 1")
def manual_classes(t: Tables):
    return ST.class_counts(t.orders, "o_totalprice", ST.breaks(t.orders, "o_totalprice", "manual", manual=MANUAL))


@query(
    "STA08_recommendation",
    "WITH cu AS (" + CUST + "), pf AS (" + PROFILE["pf"] + ") SELECT column_name, CASE WHEN distinct_count < 20 THEN 'categorical' ELSE 'graduated' END AS symbology, "
    "CASE WHEN distinct_count < 20 THEN 'quantile' WHEN mean / nullif(median, 0e0) > 2 OR mean / nullif(median, 0e0) < 0.5e0 THEN 'logarithmic' WHEN max_value > min_value AND stddev / (max_value - min_value) < 0.1e0 THEN 'natural_breaks' ELSE 'quantile' END AS method FROM pf",
)
def recommendation(t: Tables):
    return ST.recommend(ST.profile(cust(t), COLS))


@query(
    "STA09_legend",
    f"WITH p AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders), c AS (SELECT {_CLS} AS class, o_totalprice IS NULL AS missing, count(*) AS n FROM p GROUP BY 1, 2) "
    "SELECT 1 AS class, '1000.00 — 100000.00' AS label, 1000e0 AS min_value, 100000e0 AS max_value, coalesce((SELECT n FROM c WHERE class = 1), 0) AS n UNION ALL SELECT 2, '100000.00 — 200000.00', 100000e0, 200000e0, coalesce((SELECT n FROM c WHERE class = 2), 0) "
    "UNION ALL SELECT 3, '200000.00 — 450000.00', 200000e0, 450000e0, coalesce((SELECT n FROM c WHERE class = 3), 0) UNION ALL SELECT NULL, 'No Data', NULL, NULL, coalesce((SELECT n FROM c WHERE missing), 0)",
)
def legend(t: Tables):
    p = t.orders.select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("v"))
    return ST.legend(p, "v", MANUAL)


# --- imputation ------------------------------------------------------------------------------

RULES = [I.Rule("pop", "pop_observed", I.DIRECT, 0.0, "county"), I.Rule("hh", None, I.REGIONAL, 1.5, "county"), I.Rule("density", None, I.NATIONAL, 12.5)]
IMP = """SELECT o_orderkey AS k, o_custkey % 25 AS county, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_custkey % 40) * 1e0 END AS pop, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 7) * 1e0 END AS pop_observed,
    CASE WHEN o_custkey % 25 = 4 OR o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 9) * 0.5e0 END AS hh, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 3e0 END AS density FROM orders"""


def imp(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("k"), (c % 25).alias("county"), F.when(k % 3 != 0, (c % 40) * 1.0).alias("pop"), F.when(k % 2 == 0, (c % 7) * 1.0).alias("pop_observed"),
        F.when((c % 25 != 4) & (k % 5 != 0), (c % 9) * 0.5).alias("hh"), F.when(k % 4 != 0, 3.0).alias("density"),
    )


_IMPQ = f"""WITH i AS ({IMP}), d AS (SELECT *, coalesce(pop, pop_observed) AS p1 FROM i), g AS (SELECT *, coalesce(avg(p1) OVER (PARTITION BY county), avg(p1) OVER (), 0e0) AS mp, coalesce(avg(hh) OVER (PARTITION BY county), avg(hh) OVER (), 0e0) AS mh FROM d)"""


@query("IMP01_rule_cascade", _IMPQ + f" SELECT k, {num('coalesce(p1, mp)', 'pop', 6)}, {num('coalesce(hh, mh)', 'hh', 6)}, {num('coalesce(density, 12.5e0)', 'density', 6)}, CASE WHEN pop IS NOT NULL THEN 0 WHEN pop_observed IS NOT NULL THEN 1 ELSE 2 END AS pop_tier FROM g")
def rule_cascade(t: Tables):
    return rounded(I.impute(imp(t), RULES).select("k", "pop", "hh", "density", "pop_tier"), 6)


@query(
    "IMP01_tier_counts",
    _IMPQ + " SELECT 'pop' AS \"column\", count(*) AS rows_total, count(pop) AS rows_already_populated, count(*) FILTER (WHERE pop IS NULL AND pop_observed IS NOT NULL) AS rows_imputed_direct, count(*) FILTER (WHERE p1 IS NULL) AS rows_imputed_regional, 0 AS rows_imputed_national, 0 AS rows_still_null FROM g "
    "UNION ALL SELECT 'hh', count(*), count(hh), 0, count(*) - count(hh), 0, 0 FROM g UNION ALL SELECT 'density', count(*), count(density), 0, 0, count(*) - count(density), 0 FROM g",
)
def tier_counts(t: Tables):
    return I.tier_counts(I.impute(imp(t), RULES), RULES)


@query("IMP02_fill_constant", f"WITH i AS ({IMP}) SELECT k, coalesce(density, 12.5e0) AS density FROM i")
def fill_constant(t: Tables):
    return I.fill_constant(imp(t), "density", 12.5).select("k", "density")


@query("IMP03_fill_from_forms", ctes("parcels", "built_forms") + f"SELECT parcel_id, {num('coalesce(CASE WHEN parcel_id % 2 = 0 THEN 1e0 END, f.far)', 'far')} FROM parcels LEFT JOIN built_forms f ON f.id = parcel_id % 40")
def fill_from_forms(t: Tables):
    k = F.col("parcel_id")
    p = t.parcels.select(k, F.when(k % 2 == 0, 1.0).alias("far"), (k % 40).alias("type_id"))
    return rounded(I.fill_from_forms(p, t.built_forms, "far", "type_id").select("parcel_id", "far"))


@query(
    "IMP04_validation",
    f"""WITH i AS ({IMP}), m AS (SELECT *, CASE WHEN k % 7 <> 0 THEN pop END AS masked FROM i), f AS (SELECT *, coalesce(masked, avg(masked) OVER (PARTITION BY county), avg(masked) OVER (), 0e0) AS guess FROM m), e AS (SELECT pop AS truth, guess FROM f WHERE k % 7 = 0 AND pop > 0)
    SELECT count(*) AS n_parcels, count(guess) AS n_imputed, """ + nums(mae="avg(abs(guess - truth))", rmse="sqrt(avg((guess - truth) * (guess - truth)))", mape="avg(abs((guess - truth) / truth) * 100e0)", correlation="corr(truth, guess)", coverage_pct="count(guess) * 100e0 / count(*)") + " FROM e",
)
def imputation_validation(t: Tables):
    df, hidden = imp(t), F.col("k") % 7 == 0
    filled = I.impute(I.mask(df, "pop", hidden), [I.Rule("pop", None, I.REGIONAL, 0.0, "county")])
    return rounded(I.validate(df, "pop", hidden, filled, "k"))


# --- models -------------------------------------------------------------------------------------

TARGETS = ["du_detsf_sl", "du_detsf_ll"]
PARC = f"SELECT p_partkey AS apn, p_size / 10e0 AS lot_size_acres, {AS.pick_sql('p_partkey', ['A1A', 'B22', 'C3X', 'A2Z'])} AS landuse, {AS.pick_sql('p_size', ['R1', 'C2'])} AS zone, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS land_development_category FROM part"
REF = "SELECT o_orderkey AS parcel_id, (o_custkey % 7) * 1e0 AS du_detsf_sl, (o_custkey % 4) * 0.5e0 AS du_detsf_ll FROM orders"
XW = "SELECT l_orderkey AS parcel_id, l_partkey AS apn, max(l_extendedprice) AS area FROM lineitem GROUP BY l_orderkey, l_partkey"
BLD = "SELECT l_partkey AS apn, sum(l_quantity) AS residential_building_sqft, count(*) AS building_count FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey"


def parcels(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("apn"), (F.col("p_size") / 10.0).alias("lot_size_acres"), AS.pick(k, ["A1A", "B22", "C3X", "A2Z"]).alias("landuse"), AS.pick(F.col("p_size"), ["R1", "C2"]).alias("zone"),
        F.when(k % 9 != 0, F.col("p_type")).alias("land_development_category"),
    )


def building_features(t: Tables):
    return t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("apn")).agg(F.sum("l_quantity").alias("residential_building_sqft"), F.count("*").alias("building_count"))


def training(t: Tables):
    ref = t.orders.select(F.col("o_orderkey").alias("parcel_id"), ((F.col("o_custkey") % 7) * 1.0).alias("du_detsf_sl"), ((F.col("o_custkey") % 4) * 0.5).alias("du_detsf_ll"))
    xw = t.lineitem.groupBy(F.col("l_orderkey").alias("parcel_id"), F.col("l_partkey").alias("apn")).agg(F.max("l_extendedprice").alias("intersect_area_m2"))
    return ml.training_set(ref, xw, parcels(t), {"buildings": building_features(t)}, TARGETS)


_TRAIN = f"""WITH p AS ({PARC}), r AS ({REF}), x AS ({XW}), b AS ({BLD}), o AS (SELECT * FROM (SELECT x.apn, r.*, row_number() OVER (PARTITION BY x.apn ORDER BY area DESC, r.parcel_id) AS rn FROM x JOIN r ON r.parcel_id = x.parcel_id) WHERE rn = 1),
    tr AS (SELECT o.apn, du_detsf_sl, du_detsf_ll, lot_size_acres, landuse, zone, coalesce(land_development_category, 'standard') AS land_development_category, coalesce(residential_building_sqft, 0e0) AS residential_building_sqft, coalesce(building_count, 0) * 1e0 AS building_count
      FROM o JOIN p ON p.apn = o.apn LEFT JOIN b ON b.apn = o.apn)"""


@query("ML01_training_set", _TRAIN + " SELECT * FROM tr")
def training_set(t: Tables):
    return training(t)


@query(
    "ML02_feature_build",
    _TRAIN + " SELECT apn, least(building_count, 50e0) AS n_building_count, CASE WHEN left(landuse, 2) = 'A1' THEN 1e0 ELSE 0e0 END AS lu_a1, CASE WHEN left(zone, 1) = 'R' THEN 1e0 ELSE 0e0 END AS zone_r, CASE WHEN land_development_category = 'standard' THEN 1e0 ELSE 0e0 END AS ldc_standard FROM tr",
)
def feature_build(t: Tables):
    train = training(t)
    e = ml.learn_encoding(train)
    hot = {"lu_a1": f"lu_{e.codes.index('A1')}", "zone_r": f"zone_{e.zones.index('R')}", "ldc_standard": f"ldc_{e.categories.index('standard')}"}
    return ml.encode(train, e).select("apn", "n_building_count", *[F.col(v).alias(k) for k, v in hot.items()])


# Every target of the three models, as a function of the two that the training set carries.
DU_TARGETS = {
    "du_detsf_sl": "du_detsf_sl", "du_detsf_ll": "du_detsf_ll", "du_attsf": "du_detsf_sl / 2", "du_mf2to4": "du_detsf_ll * 2",
    "du_mf5p": "du_detsf_sl * 3",
}
SQFT_TARGETS = {f"bldg_area_{n}": f"du_detsf_sl * {100 + 10 * i} + du_detsf_ll * {50 + 5 * i}" for i, n in enumerate([*HOME_AREAS, "mf", *JOB_AREAS])}
JOBS_TARGETS = {f"{n}_per_acre": f"du_detsf_sl / {i + 2} + du_detsf_ll" for i, n in enumerate(["emp_ret", "emp_off", "emp_pub", "emp_ind", "emp_ag"])}


def modelled(t: Tables, derive: dict[str, str]):
    train = training(t).withColumns({k: F.expr(v) for k, v in derive.items() if k != v})
    return train, ml.learn_encoding(train), list(derive)


def model_query(name: str, derive: dict[str, str], total: str | None, whole: bool):
    @query(name)
    def _run(t: Tables):
        train, e, targets = modelled(t, derive)
        return ml.predict(ml.fit(train, targets, e), parcels(t), e, targets, total, whole)


model_query("ML03_du_regressor", DU_TARGETS, "du_total", True)
model_query("ML04_sqft_regressor", SQFT_TARGETS, None, False)
model_query("ML05_jobs_regressor", JOBS_TARGETS, None, False)


@query("ML06_transfer")
def transfer(t: Tables):
    """Models of one region on another one that lacks most feature columns."""
    train = training(t)
    e = ml.learn_encoding(train)
    folder = scratch_path(t.spark, "models")
    ml.cached_fit(train, TARGETS, e, folder)
    model, _ = ml.cached_fit(train, TARGETS, e, folder)
    other = t.customer.select(F.col("c_custkey").alias("apn"), F.lit("A1Q").alias("landuse"), F.lit(None).cast("string").alias("zone"), F.col("c_mktsegment").alias("land_development_category"))
    return ml.predict(model, other, e, TARGETS, "du_total", True)


@query(
    "ML07_batch_prediction",
    "SELECT count(*) AS n, 0 AS negative, 0 AS fractional, 0 AS unequal_totals, 0 AS changed, true AS varied FROM part",
)
def batch_prediction(t: Tables):
    """All parcels by a trained model and by the same one loaded from its folder: what must hold of the result."""
    train, e, targets = modelled(t, DU_TARGETS)
    folder = scratch_path(t.spark, "models")
    fitted, _ = ml.cached_fit(train, targets, e, folder)
    loaded, _ = ml.cached_fit(train, targets, e, folder)
    one, two = (ml.predict(m, parcels(t), e, targets, "du_total", True) for m in (fitted, loaded))
    both = one.alias("l").join(two.alias("r"), "apn")
    parts = [F.col("l." + x) for x in targets]
    count = lambda cond: F.count_if(cond).alias
    any_of = lambda cs: F.greatest(*[c.cast("int") for c in cs]) == 1
    return both.agg(
        F.count("*").alias("n"),
        count(any_of([p < 0 for p in parts]))("negative"),
        count(any_of([p != F.round(p) for p in parts]))("fractional"),
        count(sum(parts[1:], parts[0]) != F.col("l.du_total"))("unequal_totals"),
        count(any_of([F.col("l." + x) != F.col("r." + x) for x in targets]))("changed"),
        (F.count_distinct("l.du_total") > 1).alias("varied"),
    )


@query("ML08_holdout_r2")
def holdout_r2(t: Tables):
    train = training(t)
    scores = ml.holdout_scores(train, TARGETS, ml.learn_encoding(train), "tweedie")
    return t.spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "target string, r2 double")


@query("ML09_fingerprint", "SELECT count(*) AS n, true AS same_content, false AS same_after_change FROM part")
def fingerprint(t: Tables):
    a = ml.fingerprint(t.part)
    b = ml.fingerprint(t.part.repartition(3, "p_name"))
    c = ml.fingerprint(t.part.withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") == 1, 1).otherwise(0)))
    tag = F.struct("total", "mixed")
    return a.withColumn("_b", b.select(tag).scalar()).withColumn("_c", c.select(tag).scalar()).select(
        "n", F.struct("total", "mixed").eqNullSafe(F.col("_b")).alias("same_content"), F.struct("total", "mixed").eqNullSafe(F.col("_c")).alias("same_after_change")
    )


@query("ML10_embedding_features")
def embedding_features(t: Tables):
    e = t.embeddings.select((F.col("vec_id") % 450).alias("parcel_id"), F.col("vec_id").alias("seq"), "embedding")
    apns = t.part.select(F.col("p_partkey").alias("parcel_id"), F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("apn"))
    out, _ = ml.embedding_features(e, apns)
    return out


@query("ML10_embedding_dedup", "SELECT vec_id % 450 AS parcel_id, max(vec_id) AS seq FROM embeddings GROUP BY 1")
def embedding_dedup(t: Tables):
    e = t.embeddings.select((F.col("vec_id") % 450).alias("parcel_id"), F.col("vec_id").alias("seq"))
    return first_per(e, ["parcel_id"], [F.desc("seq")])


@query("ML11_parameter_search")
def parameter_search(t: Tables):
    train = training(t)
    best, score = ml.search(train, "du_detsf_sl", ml.learn_encoding(train), {"maxDepth": [2, 4], "stepSize": [0.1, 0.3], "subsamplingRate": [0.8]}, folds=3, rounds=8)
    return t.spark.createDataFrame([(str(best), float(score))], "setting string, rmse double")


# --- audits ----------------------------------------------------------------------------------


def audit(name: str, sql: str):
    return query(name, sql)


@audit(
    "AUD01_keys",
    "SELECT 'not_null' AS audit, count(*) AS violations FROM orders WHERE nullif(o_orderkey % 50, 0) IS NULL UNION ALL SELECT 'unique', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) "
    "UNION ALL SELECT 'row_count', CASE WHEN (SELECT count(*) FROM orders) BETWEEN 1 AND 10 THEN 0 ELSE 1 END UNION ALL SELECT 'same_row_count', CASE WHEN (SELECT count(*) FROM orders) <> (SELECT count(*) FROM lineitem) THEN 1 ELSE 0 END",
)
def audit_keys(t: Tables):
    found = {
        "not_null": Q.not_null(t.orders.select(F.nullif(F.col("o_orderkey") % 50, F.lit(0)).alias("k")), ["k"]),
        "unique": Q.unique(t.lineitem, ["l_orderkey", "l_linenumber"]),
        "row_count": Q.row_count_between(t.orders, 1, 10),
        "same_row_count": Q.same_row_count(t.orders, t.lineitem),
    }
    return _counts(found)


def _counts(found):
    out = None
    for name, df in found.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("audit"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@audit("AUD02_ranges", "SELECT s_suppkey, 's_acctbal' AS \"column\", s_acctbal AS value FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000 UNION ALL SELECT s_suppkey, 'k', (s_suppkey - 5) * 1e0 FROM supplier WHERE s_suppkey - 5 < 0 OR s_suppkey - 5 > 9000")
def audit_ranges(t: Tables):
    df = t.supplier.select("s_suppkey", "s_acctbal", (F.col("s_suppkey") - 5).alias("k"))
    low = Q.non_negative(df, ["s_acctbal", "k"])
    return low.unionByName(Q.between(df, ["s_acctbal", "k"], most=9000.0))


@audit(
    "AUD03_row_identities",
    ctes("base") + "SELECT 'subtype_sum' AS audit, count(*) AS violations FROM base WHERE abs(coalesce(dwelling_units_sf_ll, 0e0) + dwelling_units_sf_sl + dwelling_units_attached_sf + dwelling_units_mf_5p - dwelling_units_total) > 0.01e0 "
    "UNION ALL SELECT 'at_most', count(*) FROM base WHERE households > population + 1e-9 UNION ALL SELECT 'proportions', count(*) FROM base WHERE abs(coalesce(nullif(households, 0e0) / 100e0, 0e0) + 0.95e0 - 1e0) > 0.01e0 UNION ALL SELECT 'one_hot', count(*) FROM base WHERE dwelling_units_sf_sl > 0 AND dwelling_units_mf_5p > 0 "
    # every 97th net impact is off by one, and the sectors of every 13th zone
    "UNION ALL SELECT 'fiscal', count(*) FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'sectors', 2 * count(*) FROM supplier WHERE s_suppkey % 13 = 0",
)
def audit_row_identities(t: Tables):
    b = t.base
    fiscal = AN.module_table(t, "fiscal_net_impact")
    fiscal = fiscal.withColumn("net_fiscal_impact", F.col("net_fiscal_impact") + F.when(F.col("parcel_id") % 97 == 0, 1.0).otherwise(0.0))
    off = F.when(F.col("geoid") % 13 == 0, 5.0).otherwise(0.0)
    jobs = alloc.zone_jobs(t).withColumns({"emp_ret": F.col("emp_ret") + off, "emp_ind": F.col("emp_ind") - off})
    return _counts(
        {
            "subtype_sum": Q.sums_to(b, "dwelling_units_total", ["dwelling_units_sf_ll", "dwelling_units_sf_sl", "dwelling_units_attached_sf", "dwelling_units_mf_5p"], 0.01),
            "at_most": Q.at_most(b, "households", "population"),
            "proportions": Q.proportions(b.withColumns({"a": F.nullif(F.col("households"), F.lit(0.0)) / 100.0, "b": F.lit(0.95)}), ["a", "b"]),
            "one_hot": Q.one_hot(b, ["dwelling_units_sf_sl", "dwelling_units_mf_5p"]),
            "fiscal": Q.fiscal_identity(fiscal),
            "sectors": Q.sector_identity(jobs),
        }
    )


@audit(
    "AUD04_conservation",
    "SELECT 'population' AS audit, 0 AS violations FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'employment', 0 UNION ALL SELECT 'trips', 0 UNION ALL SELECT 'broken', 1",
)
def audit_conservation(t: Tables):
    lot = alloc.lots(t).select("parcel_id", "pop_weight", "du_estimated", "vacancy_rate")
    zones = t.block_groups.select("geoid", F.col("pop").alias("total_population"), F.col("du").alias("total_housing_units"))
    pairs = alloc.pair_rows(t, lot, zones)
    people = A.dasymetric_population(pairs)
    jobs = A.employment_weights(alloc.lots(t))
    all_weight = F.col("w_ret") + F.col("w_off") + F.col("w_pub") + F.col("w_ind") + F.col("w_ag")
    job_pairs = alloc.emp_pairs(t).withColumn("w", all_weight)
    wide = M.run(["trip_distribution"], AN.inputs(t))
    # trips to parcels outside the table are left out of the OD table first
    known = AN.od_table(t).join(t.parcels.select(F.col("parcel_id").alias("dest")), "dest", "left_semi")
    return _counts(
        {
            "population": Q.allocation_conserved(pairs, zones.withColumnRenamed("total_population", "pop"), "geoid", "pop_weight", "pop", people, 0.05),
            "employment": Q.allocation_conserved(job_pairs, alloc.zone_jobs(t), "geoid", "w", "emp", A.dasymetric_employment(alloc.emp_pairs(t)), 0.005),
            "trips": Q.trips_conserved(M.table(wide, "trip_distribution"), M.table(wide, "trip_generation")),
            "broken": Q.conserved(t.orders, "o_totalprice", t.orders.where("o_orderkey % 2 = 0"), "o_totalprice", 0.05),
        }
    )


@audit(
    "AUD05_coverage",
    "SELECT 'uncovered' AS audit, count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'match_rate', CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) > 0.05e0 * (SELECT count(*) FROM orders) THEN 1 ELSE 0 END "
    "UNION ALL SELECT 'filled', CASE WHEN (SELECT count(nullif(o_orderkey % 3, 0)) * 1e0 / count(*) FROM orders) < 0.9e0 THEN 1 ELSE 0 END",
)
def audit_coverage(t: Tables):
    a, b = t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.withColumnRenamed("l_orderkey", "k")
    return _counts(
        {
            "uncovered": Q.uncovered(a, b, "k"),
            "match_rate": Q.match_rate(a, b, "k", 0.05),
            "filled": Q.filled_share(a.withColumn("v", F.nullif(F.col("k") % 3, F.lit(0))), "v", 0.9),
        }
    )


@audit(
    "AUD06_domains",
    "SELECT 'domain' AS audit, count(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'jobs_without_floor', count(*) FROM supplier WHERE (s_nationkey % 3 > 0 AND s_suppkey % 4 = 0) OR s_suppkey % 5 = 0 "
    "UNION ALL SELECT 'jobs_on_empty_land', count(*) FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 2 = 1",
)
def audit_domains(t: Tables):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = t.supplier.select(
        (n % 3).alias("emp_ret"), F.lit(0).alias("emp_off"), F.lit(1).alias("emp_ind"), (k % 4).alias("commercial_sqft"), (k % 5).alias("industrial_sqft"),
        F.when(k % 7 == 0, "undeveloped").otherwise("urban").alias("land_development_category"), (k % 2).alias("emp"),
    )
    return _counts({"domain": Q.outside_domain(t.orders, "o_orderstatus", ["F", "O"]), "jobs_without_floor": Q.jobs_without_floor(s), "jobs_on_empty_land": Q.jobs_on_empty_land(s)})


@audit(
    "AUD07_form_tiers",
    f"WITH c AS ({AS.CLS_ROWS}), f AS (SELECT *, {AS.T0} AS t0, {AS.T1} AS t1, {AS.T4} AS t4 FROM c), r AS (SELECT *, coalesce(t1, t0, t4) AS k FROM f) SELECT 'tier0' AS audit, 0 AS violations UNION ALL SELECT 'tier1_against_tier0', (SELECT count(*) FROM f WHERE t1 IS NOT NULL AND t0 IS DISTINCT FROM t1) "
    f"UNION ALL SELECT 'multi_family', (SELECT count(*) FROM r WHERE left(code, 2) IN ('A2', 'AT') AND k IS NOT NULL AND k NOT IN ({', '.join(repr(x) for x in Q.MULTI_FAMILY)})) UNION ALL SELECT 'priority', 0",
)
def audit_form_tiers(t: Tables):
    f = AS.cls_rows(t).select(
        "*", K.tier0("code", "d").alias("t0"), K.tier1("pt", "slot", "units").alias("t1"), K.tier4("lot", "zone", "apn").alias("t4"), F.col("code").alias("landuse")
    )
    r = f.select("*", *K.resolve({"tier1": "t1", "tier0": "t0", "tier4": "t4"}))
    return _counts(
        {
            "tier0": Q.tier_mismatch(f, "t0", K.tier0("code", "d")),
            "tier1_against_tier0": Q.tier_mismatch(f, "t0", K.tier1("pt", "slot", "units")),
            "multi_family": Q.multi_family_codes(r),
            "priority": Q.tier_priority(r, f.where("t1 IS NOT NULL")),
        }
    )


# every eleventh form of each tier is spoiled, in another rhythm for each
_SPOILED = {"tier0": ("t0", 11), "tier1": ("t1", 7), "tier2": ("t2", 5), "tier3b": ("t3b", 3), "tier4": ("t4", 13)}
_CODE_SQL = {k: f"left(code, 2) IN ({', '.join(map(repr, codes))}) AND tier0 <> '{form}'" for k, (codes, form) in Q.CODE_AUDITS.items()}
_MF = ", ".join(map(repr, Q.MULTI_FAMILY))
_RULE_SQL = _CODE_SQL | {
    "A1_to_detsf": f"left(code, 2) = 'A1' AND coalesce(nullif(lot, 0e0), 0.01e0) >= 0.08e0 AND tier0 <> CASE WHEN 1e0 / (1e0 + exp(-0.04e0 * (coalesce(d, 225e0) - 225e0))) > 0.5e0 THEN '{K.SMALL_LOT}' ELSE '{K.LARGE_LOT}' END",
    "A2_falls_through": f"left(code, 2) = 'A2' AND k NOT IN ({_MF})",
    "AT_to_mf": f"left(code, 2) = 'AT' AND k NOT IN ({_MF})",
    "mf_unit_boundary": f"(pt = 'MF' OR pt LIKE 'Multiple Family%') AND units >= 2 AND tier1 <> CASE WHEN units <= 4 THEN '{K.ATTACHED}' ELSE '{K.APARTMENTS}' END",
    "sfr_lot_boundary": f"(pt = 'SFR' OR pt LIKE 'Single Family%') AND tier1 <> CASE WHEN slot < 0.15e0 THEN '{K.SMALL_LOT}' ELSE '{K.LARGE_LOT}' END",
    "tier2_sfr_lot_bound": f"tier2 IN ('{K.SMALL_LOT}', '{K.LARGE_LOT}') AND left(coalesce(code, ''), 2) NOT IN ('A2', 'AT') AND tier2 <> CASE WHEN lot < 0.15e0 THEN '{K.SMALL_LOT}' ELSE '{K.LARGE_LOT}' END",
    "tier3b_footprint_filter": f"lot > 3e0 AND fr < 0.02e0 AND coalesce(tier3b, '') <> '{K.FARM}'",
    "tier4_area_heuristic": f"tier4 <> CASE WHEN lot > 10e0 THEN '{K.FARM}' WHEN lot > 3e0 AND zone LIKE '%A%' THEN '{K.FARM}' WHEN lot > 0.15e0 THEN '{K.LARGE_LOT}' WHEN lot > 0.01e0 THEN '{K.SMALL_LOT}' END",
}


@audit(
    "AUD07_form_rules",
    f"WITH c AS ({AS.CLS_ROWS}), f AS (SELECT *, {AS.T0} AS t0, {AS.T1} AS t1, {AS.T2} AS t2, {AS.T3B} AS t3b, {AS.T4} AS t4 FROM c), "
    f"s AS (SELECT *, {', '.join(f'CASE WHEN {c} IS NOT NULL AND apn % {n} = 0 THEN {K.CIVIC!r} ELSE {c} END AS {t}' for t, (c, n) in _SPOILED.items())} FROM f), "
    "r AS (SELECT *, coalesce(tier1, tier0, tier2, tier3b, tier4) AS k FROM s) " + " UNION ALL ".join(f"SELECT '{k}' AS audit, count(*) FILTER (WHERE {v}) AS violations FROM r" for k, v in _RULE_SQL.items()),
)
def audit_form_rules(t: Tables):
    f = AS.cls_rows(t).select(
        "*", K.tier0("code", "d").alias("t0"), K.tier1("pt", "slot", "units").alias("t1"), K.tier2("bc", "lv", "lot").alias("t2"),
        K.tier3b("lot", "fr").alias("t3b"), K.tier4("lot", "zone", "apn").alias("t4"),
    )
    spoiled = {tier: F.when(F.col(c).isNotNull() & (F.col("apn") % n == 0), K.CIVIC).otherwise(F.col(c)) for tier, (c, n) in _SPOILED.items()}
    names = {"code": "landuse", "lot": "lot_size_acres", "d": "intersection_density", "pt": "property_type", "slot": "sales_lot_size_acres", "fr": "footprint_ratio"}
    f = f.withColumns(spoiled).withColumnsRenamed(names)
    return Q.form_violations(f.withColumn("built_form_key", F.coalesce("tier1", "tier0", "tier2", "tier3b", "tier4")))


@audit(
    "AUD08_case_tables",
    # every order is a case whose status is expected to be that of its priority; one in ten cases has no order
    "SELECT k AS o_orderkey, s AS o_orderstatus, e AS expected_o_orderstatus FROM (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'O' END AS e FROM orders WHERE o_orderkey % 10 <> 0) WHERE s IS DISTINCT FROM e "
    "UNION ALL SELECT -o_orderkey - 1, NULL, CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'O' END FROM orders WHERE o_orderkey % 10 = 0",
)
def audit_case_tables(t: Tables):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    expected = F.when(p == "1-URGENT", "F").when(p == "2-HIGH", None).otherwise("O")
    cases = t.orders.select(F.when(k % 10 == 0, -k - 1).otherwise(k).alias("o_orderkey"), expected.alias("o_orderstatus"))
    return Q.expected_rows(t.orders, cases, ["o_orderkey"], ["o_orderstatus"])


# --- the function surface --------------------------------------------------------------------


@query("UDF01_column_functions", ctes("parcels") + f"SELECT parcel_id, {num('gross_acres * 43560e0 * 0.4e0', 'floor_area', 2)}, {num('greatest(0e0, gross_acres - 1e0)', 'rest')} FROM parcels")
def column_functions(t: Tables):
    """Python functions that return Columns stay in generated code."""
    return t.parcels.select("parcel_id", rd(X.floor_area("gross_acres", F.lit(0.4)), 2).alias("floor_area"), rd(X.non_negative(F.col("gross_acres") - 1.0)).alias("rest"))


@query("UDF02_sql_functions", ctes("parcels") + f"SELECT parcel_id, {num('value / 4046.86e0', 'acres', 6)}, {num('greatest(0e0, value - 200000e0)', 'positive_part', 2)} FROM parcels")
def sql_functions(t: Tables):
    """The same scalars as SQL functions of the session."""
    from landspan.functions.sql import register

    register(t.spark)
    return t.parcels.selectExpr("parcel_id", "acres(value) AS a", "clamp_non_negative(value - 200000) AS p").select("parcel_id", rd("a", 6).alias("acres"), rd("p", 2).alias("positive_part"))


@query("UDF03_table_functions", "SELECT count(*) AS rows, count(DISTINCT l_partkey) AS parts FROM lineitem")
def table_functions(t: Tables):
    """DataFrame in, DataFrame out, composed with transform."""
    return t.lineitem.transform(lambda d: d.groupBy("l_partkey").agg(F.count("*").alias("n"))).transform(lambda d: d.agg(F.sum("n").alias("rows"), F.count("*").alias("parts")))


@query(
    "UDF04_set_returning",
    "SELECT event_id, json_extract_string(c, '$.type') AS type, cast(json_extract_string(c, '$.pct') AS double) AS pct FROM (SELECT event_id, unnest(['{\"type\": \"flood\", \"pct\": ' || cast(event_id % 50 AS varchar) || '}', '{\"type\": \"slope\", \"pct\": 10}']) AS c FROM events)",
)
def set_returning(t: Tables):
    doc = F.format_string('[{"type": "flood", "pct": %d}, {"type": "slope", "pct": 10}]', F.col("event_id") % 50)
    return t.events.select("event_id", F.inline(F.from_json(doc, "array<struct<type:string,pct:double>>")))
