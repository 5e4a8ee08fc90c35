"""The operators against brute force, on small fixtures and the smallest given tables."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landspan.llm import (
    count_tree, deobfuscate, exact_dedup, graph, language_bits, line_templates, mixing, pitman_yor, positional_index, queries,
    secret_forest, text, zstd_quality,
)

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("documents", "labels", "benchmark", "embeddings")


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.queries()[name](spark, SMALL).select(*names).collect()) == want


# ---- words and hashes


def test_words_and_hashes():
    texts = ["Ab  c\tab", "", "x", " \n", "é AB à\x0bq", "no\xa0break ab"]
    data, offsets = batch(texts)
    starts, ends, row = text.spans(data, offsets)
    raw = data.tobytes()
    got = [(int(r), raw[s:e].decode()) for r, s, e in zip(row, starts, ends)]
    import re

    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    h = text.hashes(data, starts, ends)
    by = {}
    for (_, w), x in zip(got, h):
        by.setdefault(w.translate({c: c + 32 for c in range(65, 91)}), set()).add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


# ---- 2


def test_collisions_of_the_digest_are_told_apart(spark, tmp_path):
    rng = random.Random(1)
    texts = [rng.choice(["A b", "a B", "c", "d", "e f", "g", ""]) for _ in range(200)]
    path = str(tmp_path / "d")
    frame(spark, texts).select("doc_id", "text").repartition(4).write.parquet(path)
    weak = lambda c: F.pmod(F.crc32(c), F.lit(3)).cast("string")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(path)
    stream = stream.withColumn("locator", F.lit("here"))
    checkpoint = str(tmp_path / "state")
    exact_dedup.remember(stream, checkpoint, weak)
    got = exact_dedup.settle(spark.read.parquet(path), exact_dedup.memory(spark, checkpoint), weak).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t.lower(), []).append(i)
    want = {i: (max(g), len(g)) for g in groups.values() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want and len(got) == len(texts)


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    path, checkpoint = str(tmp_path / "d"), str(tmp_path / "state")
    for part in (["x", "y"], ["X", "z"]):
        rows = [(i + (10 if part[0] == "X" else 0), t) for i, t in enumerate(part)]
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(path)
        stream = spark.readStream.schema("doc_id long, text string").parquet(path).withColumn("locator", F.lit(""))
        exact_dedup.remember(stream, checkpoint)
    state = exact_dedup.memory(spark, checkpoint)
    assert sorted((r["group_size"], r["keep_id"]) for r in state.collect()) == [(1, 1), (1, 11), (2, 10)]


# ---- 1


def test_boilerplate_goes_and_copies_stay(spark):
    rng = random.Random(2)
    v = vocabulary(rng)
    line = lambda n: " ".join(rng.choice(v) for _ in range(n))
    plate, passage = "Page {} of this report was printed for you", line(60)
    texts = ["\n".join([line(9), plate.format(i), line(12)]) for i in range(6)]
    texts += ["\n".join([line(9), passage, line(8 + i)]) for i in range(4)]
    copied = "\n".join(line(10 + i) for i in range(5))
    texts += [copied] * 5 + [copied + "\n" + line(20)] + [line(14)] * 2
    out = {r["doc_id"]: r["text"] for r in line_templates.cleaned(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == "\n".join(x for x in t.split("\n") if x != passage and not x.startswith("Page"))


def test_lines_recur_by_texts_alone(spark):
    """What a rule on surroundings would keep: inner and outer lines, framed passages, passages that one text has in many copies."""
    rng = random.Random(5)
    v = vocabulary(rng)
    line = lambda n: " ".join(rng.choice(v) for _ in range(n))
    plate, framed, copied = [line(9), line(10), line(11)], line(30), line(25)
    texts = ["\n".join([line(8), *plate, line(8)]) for _ in range(30)]
    texts += ["\n".join([line(8), "", framed, "", line(8)]) for _ in range(30)]
    texts += ["\n".join([line(8), copied, line(8)]) for _ in range(10)] + ["\n".join([line(8), copied, line(7)])] * 25
    # two templates under the same leading words, each with a name as its field
    head = " ".join(line(3).split())
    one, two = line(7), line(7)
    names = [f"{rng.choice(v)}{rng.choice(v)}" for _ in range(40)]
    texts += ["\n".join([line(8), f"{head} {n} {tail}"]) for tail in (one, two) for n in names]
    gone = {*plate, framed, copied}
    out = {r["doc_id"]: r["text"] for r in line_templates.cleaned(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == "\n".join(x for x in t.split("\n") if x not in gone and not x.startswith(head + " "))


def test_ties_of_patterns_do_not_depend_on_the_split(spark):
    rng = random.Random(6)
    v = vocabulary(rng)
    head, tail = "a b c", " ".join(rng.choice(v) for _ in range(9))
    texts = [f"{head} {rng.choice(v)} {tail}\n{rng.choice(v)} {i % 7}" for i in range(60)]
    got = [sorted(map(str, line_templates.cleaned(frame(spark, texts).repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1]


# ---- 3


def test_seating_follows_the_restaurant_rule():
    rng = np.random.default_rng(0)
    n, c, a, d = 4000, 40, 0.7, 0.6
    got = pitman_yor.seat(np.full(n, c), np.full(n, a), d, rng).mean()
    tables = np.ones(n)
    for i in range(1, c):
        tables += rng.random(n) < a / (a + i - d * tables)
    assert abs(got - tables.mean()) < 0.15
    assert (pitman_yor.seat(np.array([0, 1, 10**6]), np.array([1.0, 1.0, 5.0]), 0.5, rng) >= [0, 1, 1]).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    v, contexts = 30, 4
    word = np.sort(text.mix(np.arange(v).astype(np.uint64)))
    pairs = sorted({(w, int(c)) for w in word for c in rng.integers(-1, contexts, 3)})
    w, c = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32)
    n = rng.integers(1, 90, len(w))
    totals = pitman_yor.Totals(contexts, v)
    for s in range(4):
        *_, (tables, orders, root) = pitman_yor.seatings(0, w, c, n, totals)
        own = c >= 0
        totals.tables.append(np.bincount(c[own], tables[own], minlength=contexts))
        totals.root.append((orders.sum(), root.sum()))
        totals.guests = np.bincount(c[own], n[own], minlength=contexts).astype(float)
    ask = pitman_yor._probabilities(0, (w, c, n), totals, 1)
    every = np.concatenate([word, [np.uint64(12345)]])
    for context in range(-1, contexts):
        p, _ = ask(every, np.full(len(every), context, np.int32))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in pitman_yor.score(docs, chunk_words=50_000).collect()}
    rows = [(r["doc_id"], r["text"].translate({c: c + 32 for c in range(65, 91)}).split()) for r in docs.collect()]
    count = Counter()
    for i, ws in rows:
        if zlib.crc32(str(i).encode()) % 10:
            count.update([*ws, None])
    n, v = sum(count.values()), len(count)
    for i, ws in rows:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])
        r = got[i]
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_rare_words_are_contexts(spark):
    rng, parts = random.Random(7), [8, 30]
    v = vocabulary(rng, 40)
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10]
    rows = [(train[i], " ".join(rng.choice(v) for _ in range(300))) for i in range(100)]
    # two in 30 000 tokens: too rare to be a context if that took one in 10 000
    rows += [(train[i], "seldom follower") for i in (100, 101)]
    words = sorted({w for _, t in rows for w in t.split()}) + ["unseen"]
    rows += [(held[i], f"seldom {w}") for i, w in enumerate(words)] + [(held[len(words)], "seldom"), (held[len(words) + 1], "unseen follower")]
    got = []
    for n in parts:
        got.append({r["doc_id"]: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), chunk_words=4_000).collect()})
    assert all(math.isclose(got[0][i]["score"], r["score"], rel_tol=1e-9) for i, r in got[1].items())
    at = {w: got[0][held[i]]["score"] for i, w in enumerate(words)}
    assert at["follower"] > max(at[w] for w in v) + 0.5
    # the same model without Spark, from other random draws
    brute = _brute_pitman_yor([(i, t.split()) for i, t in rows if i in set(train)])
    for i, t in rows[102:]:
        assert math.isclose(got[0][i]["score"], brute(t.split()), abs_tol=0.2), t


def _brute_pitman_yor(docs, sweeps=5):
    """The same model by seating every customer alone, with plain dictionaries; a function from words to log10 p."""
    rng = np.random.default_rng(3)
    pairs, vocab = Counter(), set()
    for _, ws in docs:
        for a, b in zip([None, *ws], [*ws, "\n"]):
            pairs[a, b] += 1
            vocab.add(b)
    own = {p: c for p, c in pairs.items() if p[0] is not None}
    d = min(0.95, max(0.05, sum(c == 1 for c in own.values()) / max(1, sum(c == 1 for c in own.values()) + 2 * sum(c == 2 for c in own.values()))))
    tables = {p: 1 if p in own else c for p, c in pairs.items()}
    root_d, root, samples = None, dict.fromkeys(vocab, 1), []
    for sweep in range(sweeps):
        orders, of, guests = Counter(), Counter(), Counter()
        for (a, b), t in tables.items():
            orders[b] += t
            if a is not None:
                of[a] += t
                guests[a] += pairs[a, b]
        if root_d is None:
            ones, twos = sum(c == 1 for c in orders.values()), sum(c == 2 for c in orders.values())
            root_d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        k, s = sum(orders.values()), sum(root.values())
        base = (1 + root_d * s) / (len(vocab) + 1)
        share = lambda b, o=orders, r=dict(root), k=k, base=base: (o[b] - root_d * r.get(b, 0) + base) / (1 + k)
        if sweep >= 2:
            samples.append((dict(tables), of, guests, share))
        for (a, b), c in own.items():
            tables[a, b] = int(pitman_yor.seat(np.array([c]), np.array([(1 + d * of[a]) * share(b)]), d, rng)[0])
        root = {b: int(pitman_yor.seat(np.array([orders[b]]), np.array([base]), root_d, rng)[0]) for b in vocab}

    def score(ws):
        total = 0.0
        for a, b in zip([None, *ws], [*ws, "\n"]):
            ps = []
            for t, of, guests, share in samples:
                p = share(b)
                if a is not None:
                    p = ((pairs[a, b] - d * t[a, b] if (a, b) in pairs else 0) + (1 + d * of[a]) * p) / (1 + guests[a])
                ps.append(p)
            total += math.log10(sum(ps) / len(ps))
        return total

    return score


# ---- 4


def test_restores_noisy_words():
    words = Counter("the loser was an idiot and a stupid pathetic moron with trash in better rooms look good".split() * 3)
    pair, first = Counter(), Counter()
    for w, n in words.items():
        for a, b in zip(f"^{w}$", f"^{w}$"[1:]):
            pair[a + b] += n
            first[a] += n
    chars = deobfuscate.CharModel({p: math.log(n / first[p[0]]) for p, n in pair.items()})
    for noisy, plain in {"l0ser": "loser", "1diot": "idiot", "id!ot": "idiot", "stuuupid": "stupid", "p@thet1c": "pathetic", "l.o.s.e.r": "loser", "m0r0n": "moron", "m*oron": "moron"}.items():
        assert deobfuscate.restore(noisy, chars) == plain
        assert deobfuscate.readings(f"you {noisy} there", chars, {}) == [plain]
    assert deobfuscate.readings("you i d i o t there", chars, {}) == ["idiot"]
    assert deobfuscate.readings("a good room, 12 rooms", chars, {}) == []


def test_restores_long_words_and_text_set_apart():
    words = "the loser was an idiot and a stupid pathetic moron with trash in better rooms look good you you".split()
    pair, first = Counter(), Counter()
    for w in words * 3:
        for a, b in zip(f"^{w}$", f"^{w}$"[1:]):
            pair[a + b] += 1
            first[a] += 1
    chars = deobfuscate.CharModel({p: math.log(n / first[p[0]]) for p, n in pair.items()}, words={w: -3.0 for w in words})
    hits = lambda text: set(" ".join(deobfuscate.readings(text, chars, {})).split())
    assert hits("a st" + "u" * 90 + "pid one") == {"stupid"}
    assert "loser" in hits("-".join(["l.o.s.e.r"] * 20))
    for spaced in ("i d 1 0 t", "i, d, i, o, t", "i d d i o t", "1 d ! o t", "i - d - i - o - t", "i d i o t " * 5000):
        assert "idiot" in hits(f"some {spaced} there"), spaced[:40]
    assert {"you", "idiot"} <= hits("so y o u i d i o t there") and {"loser", "idiot"} <= hits("l o s e r i d i o t")
    assert hits("page 1 2 3 4 of 5 6") == set()


def test_toxic_documents_are_found_also_in_disguise(spark):
    rng = random.Random(3)
    v = vocabulary(rng)
    bad = ["loser", "idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        ws = [rng.choice(v) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            w = rng.choice(bad)
            if i % 16 == 0:
                w = {"loser": "l0ser", "idiot": "i d i o t", "moron": "mooooron", "scum": "s.c.u.m"}[w]
            ws.insert(rng.randrange(len(ws)), w)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in deobfuscate.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert len(held) > 100 and {i for i in held if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)


def test_toxicity_learns_from_every_labelled_row(spark):
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    want = {i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2}
    for most in (0, n):  # joined by a shuffle, and not
        got = deobfuscate.training(docs, labels, "toxic", 2, 4, broadcast_ids=most).select("key", "label").collect()
        assert len(got) == len(want) and {r["key"] for r in got} == want
        assert all(r["label"] == (r["key"] % 9 == 0) for r in got)


# ---- 5


def test_forest_keeps_keys_and_removes_numbers(spark):
    found = secret_forest.scan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    assert len(found) > 50
    assert sum(r["known"] == r["predicted"] for r in found) >= 0.97 * len(found)
    assert {0, 1} == {r["predicted"] for r in found}


def test_secrets_without_digits_short_or_with_marks_are_candidates(spark):
    values = ["correcthorsebat", "hunter2", "p@ss.w0rd!x=9", "tr0ub4dor&3"]
    plain = ["the extraordinarily long word", *(f"password = {v}" for v in values), "my secret: hunter2."]
    found = secret_forest.scan(frame(spark, plain)).collect()
    assert {(r["doc_id"], r["finding"], r["known"]) for r in found} == {
        (0, "extraordinarily", 0), (1, "correcthorsebat", 1), (2, "hunter2", 0), (3, "p@ss.w0rd!x=9", 0), (4, "tr0ub4dor&3", 0), (5, "hunter2", 0)
    }
    assert all(plain[r["doc_id"]][r["start"] :].startswith(r["finding"]) for r in found)


def test_words_are_counted_over_all_documents(spark):
    n = 6000
    rare = ["zyxwvuts", "qponmlkj"]
    texts = [f"common words stand here {'' if i % 2000 else rare[0]}" for i in range(n)] + [f"key={rare[0]}{rare[1]}"]
    docs = frame(spark, texts)
    pairs, words = secret_forest.background(docs)
    assert {r["word"] for r in words.collect()} == {"common", "words", "stand", "here", rare[0]} and "zy" in pairs and "qp" in pairs
    one = docs.where(F.col("doc_id") == n)
    got = secret_forest.candidates(one, pairs, words).first()["features"]
    assert got[secret_forest.FEATURES.index("covered")] == 0.5


# ---- 6


def brute_components(texts, k=5):
    sets = []
    for t in texts:
        ws = t.lower().split()
        sets.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def near_copies(seed, n=260):
    rng = random.Random(seed)
    v = vocabulary(rng, 60)
    passage = " ".join(rng.choice(v) for _ in range(30))
    texts = [" ".join(rng.choice(v) for _ in range(rng.randint(1, 90))) for _ in range(20)]
    while len(texts) < n:
        ws = rng.choice(texts[: 3 if rng.random() < 0.6 else len(texts)]).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(ws))
            ws[at : at + rng.randint(0, 2)] = [rng.choice(v)] * rng.randint(1, 2)
        if rng.random() < 0.2:
            ws = [*ws, *passage.split()]
        texts.append(" ".join(ws))
    rng.shuffle(texts)
    return [*texts, "", "   "]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(count_tree, "BLOCK", 16)
    monkeypatch.setattr(count_tree, "FREQUENT_IN_SAMPLE", 6)
    texts = near_copies(seed)
    sizes, roots = brute_components(texts)
    docs = frame(spark, texts)
    pts = count_tree.points(docs)
    found = count_tree.links(docs, pts, leaf=16).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in count_tree.join(docs).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    assert all(roots[r["a"]] == roots[r["b"]] for r in found)


def test_texts_of_unrelated_long_documents_do_not_travel(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    long = [[f"w{rng.randrange(10**6)}" for _ in range(6000 + 40 * i)] + passage for i in range(6)]
    long.append([*long[3][:-300], *passage])
    docs, saved, save = frame(spark, [" ".join(x) for x in long]), [], count_tree.save
    monkeypatch.setattr(count_tree, "save", lambda df, name: saved.append((name, save(df, name))) or saved[-1][1])
    found = count_tree.links(docs, count_tree.points(docs)).collect()
    assert {(r["a"], r["b"]) for r in found} == {(3, 6)}
    assert {r["id"] for r in [df for name, df in saved if name == "wanted"][-1].collect()} <= {3, 6}


@pytest.mark.parametrize("seed", [3, 4])
def test_fine_points_keep_all_that_link(seed):
    rng = np.random.default_rng(seed)
    sets = [rng.integers(0, 2**63, rng.integers(5, 60)).astype(np.uint64) for _ in range(8)]
    for _ in range(60):
        old = sets[rng.integers(len(sets))]
        sets.append(np.concatenate([old[rng.random(len(old)) > rng.random() * 0.3], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)]))
    sets = [np.unique(x) for x in sets if len(x)]
    width = [1 << (max(8, len(x)) - 1).bit_length() for x in sets]
    fine = [count_tree.pack(np.bincount((x % np.uint64(w)).astype(np.int64), minlength=w).astype("<u2")) for x, w in zip(sets, width)]
    n, ids = [len(x) for x in sets], np.arange(len(sets))
    for leaf_2 in (0, 1):
        leaf = ids % (leaf_2 + 1)
        rows = pd.DataFrame({"leader": 0, "leaf_1": 0, "leaf_2": leaf_2, "leaf": leaf, "id": ids, "n": n, "label": ids // 3, "size": n, "fine": fine})
        got = set(count_tree._may_link_finely(75)(rows)["id"])
        similar = lambda a, b: 100 * (k := len(np.intersect1d(a, b))) >= 75 * (len(a) + len(b) - k)
        linked = {i for i in ids for j in ids if i // 3 != j // 3 and (not leaf_2 or leaf[i] != leaf[j]) and similar(sets[i], sets[j])}
        assert linked and linked <= got < set(ids)


def test_bound_never_rules_out_a_link():
    texts = near_copies(5, 80)
    row, value = count_tree.shingles(*batch(texts))
    sets = [set(value[row == i].tolist()) for i in range(len(texts))]
    points = [np.bincount(np.array(list(s), np.uint64) % np.uint64(16), minlength=16) if s else np.zeros(16, int) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            assert len(sets[i] & sets[j]) <= np.minimum(points[i], points[j]).sum()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


# ---- 7, 10


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = zstd_quality.quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in got if r["quality"] == 1]
    bad = [r["score"] for r in got if r["quality"] == 0]
    assert sum(x >= 0.3 for x in good) > 0.95 * len(good)
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_calibration_rises():
    at, share = deobfuscate.isotonic(np.array([0.0, 1, 2, 3]), np.array([0, 1, 0, 1]), np.array([9.0, 1, 1, 9]))
    assert (np.diff(at) >= 0).all() and (np.diff(share) >= 0).all() and share[0] < 0.1 and share[-1] > 0.9


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_bits.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)


def test_filters_hold_what_was_put_in(spark):
    docs = spark.createDataFrame([(1, "aa", "hello world"), (2, "bb", "bonjour monde")], "key long, lang string, text string")
    model = language_bits.fit(docs)
    assert model.languages == ["aa", "bb"]
    best, _ = language_bits.decide(*batch(["HELLO", "monde", "?"]), model)
    assert list(best[:2]) == [0, 1]


def test_any_number_of_languages_and_rare_words(spark):
    rng = random.Random(8)
    rows, rare = [], {}
    for k in range(150):
        v = vocabulary(rng, 12)
        rare[f"l{k:03}"] = "".join(rng.choice("klmnopqrstuvwxyz") for _ in range(9))
        rows += [(100 * k + i, f"l{k:03}", " ".join(rng.choice(v) for _ in range(40))) for i in range(4)]
        rows.append((100 * k + 50, f"l{k:03}", f"{' '.join(v)} {rare[f'l{k:03}']}"))
    model = language_bits.fit(spark.createDataFrame(rows, "key long, lang string, text string"))
    assert len(model.languages) == 150
    best, score = language_bits.decide(*batch(list(rare.values())), model)
    assert [model.languages[i] for i in best] == list(rare) and (score > 0).all()


def test_texts_without_a_known_gram_back_off(spark):
    rows = [(1, "aa", "hello world"), (2, "bb", "szczypiorek"), (3, "bb", "szczypiorek")]
    model = language_bits.fit(spark.createDataFrame(rows, "key long, lang string, text string"))
    best, score = language_bits.decide(*batch(["zczxx", "wqqo", "w", "Ж", "HELLO"]), model)
    assert [model.languages[i] for i in best] == ["bb", "aa", "aa", "bb", "aa"]
    assert abs(score[3] - 2 / 3) < 1e-12


# ---- 8


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    scattered = "x y alpha beta q gamma delta r epsilon zeta eta s theta iota kappa"
    docs = frame(spark, [scattered, "alpha only here", " ".join(reversed(item.split()))])
    items = positional_index.item_terms(spark.createDataFrame([(1, item)], "item_id long, text string"))
    index = positional_index.postings(docs, items)
    near = positional_index.proximity(index, items, terms=2).select("_doc").distinct()
    ids = positional_index.numbered(docs).join(near, "_doc").select("doc_id").collect()
    assert 0 in {r["doc_id"] for r in ids} and 1 not in {r["doc_id"] for r in ids}
    assert positional_index.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).where("contaminated").count() == 0


def test_full_counts_bound_nothing():
    a, b = np.array([[65535, 3]], np.uint16), np.array([[65535, 1], [7, 1]], np.uint16)
    assert count_tree._reaches(count_tree._most_shared(a, b), np.array([10**9, 10**9]), 75).tolist() == [True, False]
    assert count_tree._reaches(count_tree._most_shared(a[0], b[1]), np.int64(18), 75)


def test_bits_miss_no_word_and_covers_are_exact(spark, monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 9))) for _ in range(3000)})
    low = ["".join(rng.choice([*words, "zzzz", "-7_"]) for _ in range(4)) + str(i) for i in range(400)] + ["", "--", "abc"]
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    df = spark.createDataFrame([(x,) for x in low], "low string").distinct()
    want = {x: sum(map(len, secret_forest.covering(x, set(words).__contains__))) / max(1, len(x)) for x in low}
    for per_word in (32, 2):  # with few bits many pieces pass that are no words
        monkeypatch.setattr(secret_forest, "BITS_PER_WORD", per_word)
        got = {r["low"]: r["covered"] for r in secret_forest.word_features(df, {}, dictionary).collect()}
        assert got == want and 0 < sum(got.values()) < len(got)


def test_triggers_are_in_all_that_the_formats_match():
    for t in ("AKIA" + "A" * 16, "ghu_" + "a" * 36, "xoxb-" + "1" * 12, "AIza" + "x" * 35, "\u017fecret=abcdefabcdef", "API_KEY: 'abcdefabcdef'", "apikey=abcdefabcdef", "to\u212aen=abcdefabcdef"):
        found = secret_forest.FORMATS.search(t) or secret_forest.ASSIGNED.search(t)
        assert found and [s for s in secret_forest.spans(t) if s[2]]


# ---- 9


def test_mix_does_not_depend_on_the_split(spark):
    rng = random.Random(3)
    v = vocabulary(rng)
    texts = [" ".join(rng.choice(v) for _ in range(rng.randrange(1, 80))) for _ in range(3000)] + ["the same"] * 5
    df = frame(spark, texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 7))
    got = [sorted(map(tuple, mixing.taken(df.repartition(n, *by)).select("doc_id", "taken").collect())) for n, by in ((1, ()), (9, ("text",)))]
    assert got[0] == got[1]


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {**stopped, **{s: weight[s] * level for s in free}}
        stopped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_words_taken(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(600)]
    rows += [(1000, "only a few words", "tiny"), (1001, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(docs, block_words=32, shard_slots=100).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[s]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 64 for s in sizes)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_slots_are_permuted(n):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(got) == list(range(n))
    if n > 100:
        assert (got != np.arange(n)).mean() > 0.9


# ---- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    v = vocabulary(rng, 3000)
    line = lambda n: " ".join(rng.choice(v) for _ in range(n))
    passage, leak = line(55), line(25)
    base = line(80)
    near = base.split()
    near[40] = "changed"
    texts, toxic = [line(70) + "\n" + line(30) for _ in range(300)], []
    for i in range(0, 300, 5):
        texts[i] = "you loser " + texts[i]
        toxic.append(i)
    plate = {1, 2, 3, 4}
    for i in plate:
        texts[i] += "\n" + passage
    texts += [base, base, " ".join(near), line(20) + " " + leak + " " + line(20)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = after.cache()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert set(kept["toxicity"]) == set(range(304)) - set(toxic)
    assert {i for i, t in kept["line_dedup"].items() if t != texts[i]} == plate
    assert all(passage not in t for t in kept["line_dedup"].values())
    assert set(kept["ngram_jaccard_join"]) == set(kept["line_dedup"]) - {301, 302}
    assert set(kept["decontamination"]) == set(kept["ngram_jaccard_join"]) - {303}
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["size"] for r in mixed} == {i: len(t.split()) for i, t in kept["decontamination"].items()}


def test_words_are_counted_without_holding_their_repeats():
    texts = pa.RecordBatch.from_arrays([pa.array(["common words stand here " * 25_000] * 2 + ["here", None])], ["text"])
    list(secret_forest._count_words(iter([texts])))
    tracemalloc.start()
    one = list(secret_forest._count_words(iter([texts.slice(0, 1)])))
    single = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    every = list(secret_forest._count_words(iter([texts] * 4)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert one[0].to_pylist()[0] == {"word": "common", "n": 25_000, "docs": 1}
    assert {(r["word"], r["n"], r["docs"]) for r in every[0].to_pylist()} == {("common", 200_000, 8), ("words", 200_000, 8), ("stand", 200_000, 8), ("here", 200_004, 12)}
    assert peak < 2 * single


def test_candidates_meet_their_words_by_the_same_plan_at_every_size(spark):
    docs = frame(spark, ["password = hunter2 and extraordinarily long", "token: abcdefgh1234"])
    low = spark.createDataFrame([("a", 1.0)], "word string, n double")
    out = secret_forest.candidates(docs, {}, low.select("word"))
    assert "SortMergeJoin [low#" in out._jdf.queryExecution().executedPlan().toString()


def test_a_chunk_is_packed_bucket_by_bucket(monkeypatch):
    """What a chunk holds at once is a few arrays of its tokens, and buckets come in order with all their pairs."""
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("", (), {"partitionId": staticmethod(lambda: 0)}))
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 2000) % 50_000) for _ in range(150)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), pa.array([i % 10 == 0 for i in range(150)]), pa.array(texts)], ["doc_id", "held", "text"])
    work = pitman_yor._payloads(16, 1 << 30)
    list(work(iter([rows.slice(0, 1)])))
    tracemalloc.start()
    (out,) = work(rows.slice(i, 5) for i in range(0, 150, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["bucket"].to_pylist() == sorted(set(out["bucket"].to_pylist()))
    assert sum(int(pitman_yor.unpack(x.as_py(), np.int32).sum()) for x in out["times"]) == 150 * 2001
    found = pitman_yor._bucket(16)(pa.Table.from_batches([out.slice(0, 1)]))
    assert found["n_train"][0].as_py() == pitman_yor.unpack(out["seen"][0].as_py(), np.int32).sum()
    assert peak < 52 * 150 * 2001


def test_a_bucket_holds_a_repeated_pair_once():
    """The chunks of a bucket repeat their pairs, and the bucket's memory does not grow with the repeats."""
    rng = np.random.default_rng(5)
    word = np.sort(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    follows = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64))
    row = {
        "bucket": 3, "word": pitman_yor.pack_rising(word), "pairs": pitman_yor.pack(np.ones(len(word), np.int32)),
        "context": pitman_yor.pack((np.arange(len(word)) % 501 - 1).astype(np.int32)), "follows": pitman_yor.pack_rising(follows),
        "seen": pitman_yor.pack(np.full(len(word), 2, np.int32)),
    }

    def peak(n):
        rows = pa.Table.from_pylist([row] * n)
        tracemalloc.start()
        found = pitman_yor._bucket(16)(rows)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found["n_train"][0].as_py() == 2 * n * len(word) and found["n_words"][0].as_py() == len(word)
        return most

    peak(1)
    assert peak(40) < 3 * peak(2)
