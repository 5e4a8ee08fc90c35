"""Nulls in any column, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from landspan.llm import (
    count_tree, deobfuscate, exact_dedup, language_bits, line_templates, mixing, pitman_yor, positional_index, secret_forest, zstd_quality,
)

LONG = "word " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "en", "a", 49),
    (2, "THE QUICK brown fox jumps over the lazy dog again", "en", None, 49),
    (2, "THE QUICK brown fox jumps over the lazy dog again", "en", None, 49),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, " \t\n ", None, "a", 4),
    (None, "no id here", "en", "a", 10),
    (6, LONG, "en", "b", len(LONG)),
    (7, "two words", None, "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
#: Names that the operators use for themselves.
CLASHING = ["doc", "words", "digest", "body", "line", "leaf", "row", "number", "size", "key", "label", "score", "held", "bucket", "id", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, None, None), (None, 1, 1), (99, 0, 1)], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "no id here"), (4, "Two words")],
        "item_id long, text string",
    )


def by_id(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=str)


def test_exact_dedup(spark, docs, none, tmp_path):
    path = str(tmp_path / "d")
    docs.repartition(3).write.parquet(path)
    got = by_id(exact_dedup.dedup(spark, path, 1), "keep_id", "group_size", "kept")
    assert got == sorted(
        [(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True),
         (None, None, 1, True), (6, 6, 1, True), (7, 7, 1, True)], key=str,
    )
    empty = str(tmp_path / "e")
    none.write.parquet(empty)
    assert exact_dedup.dedup(spark, empty).count() == 0


def test_lines(docs, none):
    out = line_templates.cleaned(docs)
    assert set(CLASHING) < set(out.columns) and out.where("line = 'clash'").count() == len(ROWS)
    assert by_id(out, "text", "_n_lines") == sorted(((r[0], r[1], 0 if r[1] is None else r[1].count("\n") + 1) for r in ROWS), key=str)
    assert line_templates.cleaned(none).count() == 0


def test_language_model(docs, none):
    got = pitman_yor.score(docs).collect()
    assert len(got) == len(ROWS) and all(r["score"] < 0 for r in got if r["n_tokens"] > 1)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((r[1] or "").split()) + 1 for r in ROWS)
    assert {(r["doc_id"], r["score"]) for r in got if r["doc_id"] == 2}.__len__() == 1
    assert pitman_yor.score(none).count() == 0


def test_toxicity(docs, none, labels):
    got = deobfuscate.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert {r["score"] for r in deobfuscate.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert deobfuscate.toxicity(none, labels).count() == 0
    model = deobfuscate.fit(deobfuscate.training(docs, labels, "toxic", 2, 4))
    assert deobfuscate.tolerable(docs, model, threshold=1.1).columns == docs.columns


def test_secrets(docs, none):
    assert secret_forest.scan(docs).count() == 0
    assert secret_forest.scan(none).count() == 0
    one = docs.limit(1).withColumn("text", F.lit("key 4429526289707589 here"))
    assert [(r["start"], r["length"], r["score"]) for r in secret_forest.scan(one).collect()] == [(4, 16, 1.0)]


def test_tree(docs, none):
    got = by_id(count_tree.join(docs), "n_shingles", "component_id")
    want = [(1, 6, 1), (2, 6, 1), (2, 6, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 1, None), (6, 1, 6), (7, 1, 7)]
    assert got == sorted(want, key=str)
    assert count_tree.join(none).count() == 0
    kept = count_tree.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in by_id(kept) if r[0]) == [1, 3, 4, 5, 6, 7]


def test_quality(docs, none, labels):
    got = zstd_quality.quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in zstd_quality.quality(docs, labels.limit(0)).collect()} == {1.0}
    assert zstd_quality.quality(none, labels).count() == 0


def test_index(docs, none, items):
    got = by_id(positional_index.decontaminate(docs, items), "n_words", "n_hit", "n_items", "contaminated")
    want = [(1, 10, 8, 1, True), (2, 10, 8, 1, True), (2, 10, 8, 1, True), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 0, 0, 0, False),
            (None, 3, 0, 0, False), (6, 30_000, 0, 0, False), (7, 2, 2, 1, True)]
    assert got == sorted(want, key=str)
    assert positional_index.decontaminate(none, items).count() == 0
    assert positional_index.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    clean = positional_index.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 4


def test_mixing(docs, none):
    got = mixing.taken(docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["taken"] for r in got if r["size"] == 0} == {0}
    again = mixing.taken(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.taken(none).count() == 0


def test_language(docs, none):
    got = language_bits.identify(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 6, 7)} == {"en"}
    assert {r["lang_pred"] for r in language_bits.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_bits.identify(none).count() == 0


def test_pipeline(spark, docs, none, labels, items, tmp_path):
    """Nulls, repeated ids, clashing columns and empty tables pass through all stages."""
    import corpus_pipeline

    for name, table in (("rows", docs), ("none", none)):
        sf = str(tmp_path / name)
        table.repartition(2).write.parquet(f"{sf}/documents.parquet")
        labels.withColumn("toxic", F.lit(0)).write.parquet(f"{sf}/labels.parquet")  # nothing is learned, nothing rejected
        items.where("item_id is null or item_id <> 1").write.parquet(f"{sf}/benchmark.parquet")
        kept = spark.read.parquet(f"{sf}/documents.parquet")
        columns = kept.columns
        for at, (stage, fn) in enumerate(corpus_pipeline.STAGES):
            kept = fn(spark, kept, sf)
            if at + 1 < len(corpus_pipeline.STAGES):
                assert kept.columns == columns, stage
        assert {"doc_id", "taken"} <= set(kept.columns)
        got = sorted((r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()), key=str)
        if name == "none":
            assert got == []
        else:
            # 7 and the row without id hold an item; 2 is linked to 1, the smaller id; nothing else goes
            assert [i for i in got if i is not None] == [1, 3, 4, 5, 6]
