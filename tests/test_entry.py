import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from landspan.queries import load
from landspan.queries.binding import RAW

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
# no SQL says the same: samples, models, iterative breaks, a stream's closed windows
ROWS_ONLY = {
    "ML03_du_regressor", "ML04_sqft_regressor",
    "ML05_jobs_regressor", "ML06_transfer", "ML08_holdout_r2", "ML10_embedding_features", "ML11_parameter_search",
}


def test_listing_needs_no_session():
    code = "import __spark_entry__ as e; from landspan.queries import load; q = load().QUERIES; print(len(q), len(set(q) & set(e.queries()) & set(e.oracle_sql())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, m = map(int, out.stdout.split())
    assert n - m == len(ROWS_ONLY)


def test_every_query_has_sql_or_is_known_without():
    assert set(load().QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY


def test_entry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["total_population"] > 0


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in RAW:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


#: Queries of more than a few seconds even on the smallest tables; scripts/check.py runs them all.
SLOW = {"BAS13", "BAS14", "TRN06", "ANA31", "CLS04", "CLS09"}


@pytest.mark.parametrize("name", sorted(n for n in load().SQL if n.split("_")[0] not in SLOW))
def test_against_sql(spark, con, name):
    cur = con.execute(load().SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = sorted(str(tuple(r)) for r in load().QUERIES[name](spark, SF).select(*names).collect())
    assert got == want
