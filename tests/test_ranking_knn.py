import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landspan.operators import ranking as R
from landspan.operators.knn import nearest_k


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small ranges stay apart, so that the two-level numbering is exercised."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def frame(spark, n=700, skew=0.4):
    rng = np.random.default_rng(11)
    v = np.where(rng.uniform(size=n) < skew, 7.0, rng.integers(0, 300, n).astype(float))
    k = np.where(rng.uniform(size=n) < 0.4, "hot", rng.integers(0, 4, n).astype(str))
    pdf = pd.DataFrame({"id": range(n), "k": k, "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_values_span_several_ranges(spark):
    _, df = frame(spark)
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    assert R._with_range(counts, [], "v").select("_range").distinct().count() > 1


def test_percent_rank(spark):
    pdf, df = frame(spark)
    got = R.with_percent_rank(df, "v", "pr").select("id", "pr").toPandas().set_index("id")["pr"]
    want = (pdf["v"].rank(method="min") - 1) / (len(pdf) - 1)
    assert np.allclose(got.sort_index(), want)


def test_percentiles_per_key(spark):
    pdf, df = frame(spark)
    got = R.percentiles(df, "v", {"m": 0.5, "p9": 0.9}, ["k"]).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["v"].quantile([0.5, 0.9]).unstack()
    assert np.allclose(got["m"], want[0.5]) and np.allclose(got["p9"], want[0.9])


def test_ntile_edges(spark):
    pdf, df = frame(spark, n=103)
    got = R.ntile_ranges(df, "v", 7).orderBy("tile").toPandas()
    parts = np.array_split(np.sort(pdf["v"].to_numpy()), 7)
    assert got["low"].tolist() == [p[0] for p in parts]
    assert got["high"].tolist() == [p[-1] for p in parts]
    assert got["n"].tolist() == [len(p) for p in parts]


def test_mode_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", 5)], "k string, v int")
    got = {r["k"]: r["mode"] for r in R.modes(df, ["k"], "v").collect()}
    assert got == {"a": 1, "b": 5}


def test_nearest_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(900, 3))
    p[300:600] = 0.25  # a third of all points in one place
    q = rng.normal(size=(80, 3)) * 1.5
    pk, qk = rng.integers(0, 2, 900), rng.integers(0, 3, 80)
    cols = "k int, a double, b double, c double"
    points = spark.createDataFrame([(i, int(pk[i]), *map(float, p[i])) for i in range(900)], "pid int, " + cols)
    queries = spark.createDataFrame([(i, int(qk[i]), *map(float, q[i])) for i in range(80)], "qid int, " + cols)
    for window in (1.0, 9.0):
        got = nearest_k(queries, points, ["k"], ["a", "b", "c"], 4, "qid", "pid", window, same=["a", "b", "c"])
        found = {}
        for r in got.collect():
            found.setdefault(r["qid"], []).append((r["rank"], r["pid"]))
        for i in range(80):
            gap = np.abs(p - q[i])
            ok = (pk == qk[i]) & (gap <= window).all(axis=1)
            d = np.sqrt(((p - q[i]) ** 2).sum(axis=1))
            want = [int(j) for j in sorted(np.flatnonzero(ok), key=lambda j: (d[j], j))[:4]]
            assert [pid for _, pid in sorted(found.get(i, []))] == want


def test_group_totals_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "k string, v double")
    got = sorted((str(r["k"]), r["s"]) for r in R.with_group_totals(df, ["k"], [F.sum("v").alias("s")]).collect())
    assert got == [("None", 3.0), ("None", 3.0), ("a", 5.0)]
