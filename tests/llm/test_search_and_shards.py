"""Hard negatives, ranked search and shards against brute force, with nulls, ties, repeats, hot groups and clashing columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landspan.llm import automaton_ranking, interleaving, strassen

CLASHING = ["row", "codes", "anchor", "pair", "score", "key", "rank", "term", "item", "stratum", "shuffle", "cell", "place", "slot", "shard", "size", "tie_1"]


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df


# hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 65, 40), (70, 64, 131)])
@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_product(shape, leaf):
    n, k, m = shape
    if leaf == 1 and n > 40:
        leaf = 2
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(2**62), 2**62, (n, k)), rng.integers(-(2**62), 2**62, (k, m))  # sums wrap
    assert (strassen.product(a, b, leaf) == a @ b).all()


def test_heaps_merge():
    rng = np.random.default_rng(3)
    g, s, k = rng.integers(0, 4, 400), rng.integers(0, 9, 400), np.arange(400)
    whole, parts = strassen.Heaps(5), strassen.Heaps(5)
    whole.add(g, s, k)
    for part in np.array_split(rng.permutation(400), 7):
        parts.add(g[part], s[part], k[part])
    assert all((x == y).all() for x, y in zip(whole.rows, parts.rows))


def test_window_bounds():
    for p in range(-50, 200):
        low, high = strassen.window(np.array([p]))
        assert {n for n in range(-100, 300) if 30 * p <= 100 * n <= 90 * p} == set(range(int(low[0]), int(high[0]) + 1))


def mined_by_hand(rows):
    """rows: (vec_id, embedding, label); every pair is scored in Python's integers."""
    held = []
    for key, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
        held.append((key, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    at = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (anchor, label, a) in enumerate(held):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), key, other) for j, (key, other, b) in enumerate(held) if j != i]
        positives = sorted((r for r in scored if r[2] == label), key=at)[:5]
        for s, p, _ in positives:
            inside = sorted((r for r in scored if r[2] != label and 30 * s <= 100 * r[0] <= 90 * s), key=at)[:10]
            out += [(anchor, p, n, r[1], s, r[0]) for n, r in enumerate(inside, 1)]
    return sorted(out, key=str)


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def vectors(n=430):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        v = (rng.integers(-2, 6, 6) / 16).tolist() if i % 3 else [0.25] * 6  # a third are one vector
        rows.append((i, v, int(rng.integers(0, 4))))
    rows += [
        (200, [0.25, 0.5], 1), (200, [0.25, 0.5], 1),  # copies of an id, shorter vectors
        (300, None, 1), (301, [0.1, None], 1), (302, [float("nan")], 1), (303, [float("inf")], 1), (400, [0.5] * 6, None),
        (None, [0.25] * 6, 2), (1000, [], 1), (1001, [0.5] * 9, 3), (-100, [0.3] * 6, 2),
    ]
    return rows


@pytest.mark.parametrize("block", [strassen.BLOCK, 2])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(strassen, "TILE", 64)
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, EMBEDDINGS).repartition(5))
    got = strassen.mine(df, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # two copies of an anchor are each other's positive, so ids repeat; as sorted lists the answers agree
    assert sorted(map(tuple, got.collect()), key=str) == mined_by_hand(rows)


def test_no_vectors(spark):
    none = spark.createDataFrame([], EMBEDDINGS)
    assert strassen.mine(none).count() == 0
    assert strassen.mine(spark.createDataFrame([(100, [1.0], 1)], EMBEDDINGS)).count() == 0


def test_components_beyond_64_bits(spark):
    rows = [(100, [3e38, 1.0], 1), (101, [-3e38, 1.0], 1), (102, [1.0, 1.0], 2)]
    assert strassen.mine(spark.createDataFrame(rows, EMBEDDINGS)).count() <= 10


# ranked search

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_hand(documents, items, k=50):
    cut = lambda t: TERM.findall((t or "").translate(LOW))
    docs = [(d, cut(t)) for d, t in documents]
    n, total = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, t in docs:
            tf, m = Counter(t), 100 - 50 + (50 * len(t) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in wanted if tf[x])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)] + ["ÉTÉ", "été", "naïve", "日本", "Ä", "x1"]
    some = lambda n: " ".join(rng.choice(words, n))
    documents = [(i, re.sub(" ", lambda _: rng.choice([" ", "\n", "--", "'"]), some(int(rng.integers(1, 30))))) for i in range(150)]
    documents += [(i, "w1 w2 w3") for i in range(200, 300)]  # ties, and a third of all rows alike
    documents += [(7, "W1, w1; W2"), (7, "W1, w1; W2"), (None, "w1 w5"), (None, None), (500, None), (501, ""), (502, "?! \x00 -")]
    documents += [(600, "w3 " * 30_000), (601, "w9" + "z" * 5000 + " w9")]
    items = [(i, some(5)) for i in range(12)] + [(0, "w3 w3"), (20, None), (21, ""), (22, "nowhere"), (None, "w5 w1"), (23, "w1,W1"), (24, "w9" + "z" * 5000)]
    return documents, items


@pytest.mark.parametrize("most", [automaton_ranking.BLOCK, 6])
def test_ranking(spark, monkeypatch, most):
    monkeypatch.setattr(automaton_ranking, "PIECE", 1000)
    documents, items = searched()
    docs = clashing(spark.createDataFrame([(d, t, None, None, 0) for d, t in documents], DOCUMENTS).repartition(5))
    asked = clashing(spark.createDataFrame(items, "item_id long, text string").repartition(2))
    got = automaton_ranking.rank(docs, asked, most=most)
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(documents, items)
    few = automaton_ranking.rank(docs, asked, k=3, most=most)
    assert sorted(map(tuple, few.collect()), key=str) == ranked_by_hand(documents, items, 3)


def test_nothing_to_rank(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, 3)], DOCUMENTS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert automaton_ranking.rank(docs.limit(0), items).count() == 0
    assert automaton_ranking.rank(docs, items.limit(0)).count() == 0
    assert automaton_ranking.rank(docs, spark.createDataFrame([("one", "B")], "item_id string, text string")).first()["item_id"] == "one"


def test_pieces_share_their_blanks():
    data = b" aa bbb cccccccccc d "
    cut = list(automaton_ranking.pieces(data, 6))
    assert all(p.startswith(b" ") and p.endswith(b" ") and data[at : at + len(p)] == p for at, p in cut)
    assert b" ".join(p.strip() for _, p in cut).split() == data.split()


# shards


def sharded():
    rng = np.random.default_rng(9)
    source = lambda i: "big" if i % 3 == 0 else None if i % 11 == 0 else f"s{int(rng.integers(0, 6))}"
    rows = [(i, "same text" if i % 5 == 0 else f"text é {i}", None, source(i), 0) for i in range(1003)]
    return rows + [(1, "again", None, "big", 0), (None, None, None, None, None), (None, "no id", None, "big", 0), (2000, "", None, "", 0)]


def test_shards(spark):
    rows = sharded()
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = interleaving.shard(clashing(df.repartition(7))).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None
    )
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    # ids are unique enough here to look the source up
    of = {d: s for d, _, _, s, _ in rows if d not in (1, None)}
    have = Counter((of[r["doc_id"]], r["shard"]) for r in got if r["doc_id"] in of)
    for s, n in Counter(of.values()).items():
        assert all(abs(have[s, k] - n / 16) <= 3 for k in range(16))
    # another split of the same rows is dealt alike
    again = interleaving.shard(df.repartition(3, "text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, interleaving.shard(df, seed=14).collect())) != sorted(map(str, got))


def test_few_and_no_rows_to_shard(spark):
    df = spark.createDataFrame(sharded()[:5], DOCUMENTS)
    assert sorted(r["slot"] for r in interleaving.shard(df).collect()) == [0] * 5
    assert interleaving.shard(df.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    df = clashing(spark.createDataFrame(sharded(), DOCUMENTS)).withColumn("document", F.lit(1))
    interleaving.write_shards(df, str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("_shard", "_slot").exceptAll(df).count() == 0 and back.count() == df.count()
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in interleaving.shard(df, 4).collect()}
    assert {(r["doc_id"], r["_shard"], r["_slot"]) for r in back.collect()} == want
