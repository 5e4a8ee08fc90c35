"""The operators over the whole given tables, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.llm import (
    automaton_ranking, count_tree, deobfuscate, exact_dedup, interleaving, language_bits, line_templates, mixing,
    pitman_yor, positional_index, secret_forest, strassen, zstd_quality,
)

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined), text_sha256 of what remains."""
    out = line_templates.cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.size("_dropped").cast("long").alias("n_dropped"),
        F.array_join(F.transform("_dropped", lambda x: x.cast("string")), ",").alias("dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


B = "\\x20\\x09-\\x0D"
NEED = "greatest(3, ceil(24.0 / tokens))"
SQL_1 = f"""
WITH d AS (SELECT doc_id, text, md5(text) AS tx, string_split(regexp_replace({FOLDED}, '[^{B}]*[0-9][^{B}]*', '<*>', 'g'), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, tx, unnest(range(len(ls))) AS line, regexp_extract_all(unnest(ls), '[^{B}]+') AS t FROM d WHERE text IS NOT NULL),
l AS (SELECT *, len(t) AS tokens, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS body FROM l0),
shared AS (SELECT leaf FROM l WHERE tokens >= 3 GROUP BY leaf, tokens HAVING count(DISTINCT tx) >= {NEED}),
known AS (SELECT leaf, body, any_value(t) AS t, {{'less': -count(DISTINCT tx), 'at': min({{'d': doc_id, 'l': line}}), 'body': body}} AS o FROM l JOIN shared USING (leaf) GROUP BY leaf, body),
cut AS (SELECT *, unnest(range(len(t) - ceil(0.8e0 * len(t))::BIGINT + 1)) AS j, len(t) - ceil(0.8e0 * len(t))::BIGINT + 1 AS n FROM known),
blk AS (SELECT *, t[4 + (j * (len(t) - 3)) // n : 3 + ((j + 1) * (len(t) - 3)) // n] AS b FROM cut),
grp AS (SELECT leaf, j, b, min(o) AS p FROM blk GROUP BY leaf, j, b HAVING count(*) > 1),
tried AS (SELECT DISTINCT blk.leaf, blk.body, blk.t, p FROM blk JOIN grp ON grp.leaf = blk.leaf AND grp.j = blk.j AND grp.b = blk.b AND p.body <> blk.body),
best AS (SELECT x.leaf, x.body, min(p) AS p FROM tried x JOIN known y ON y.leaf = x.leaf AND y.body = p.body
         WHERE len(list_filter(list_zip(x.t, y.t), lambda v: v[1] = v[2])) >= 0.8e0 * len(x.t) GROUP BY x.leaf, x.body),
tmpl AS (SELECT known.leaf, known.body, coalesce(p.body, known.body) AS template FROM known LEFT JOIN best ON best.leaf = known.leaf AND best.body = known.body),
rec AS (SELECT leaf, template FROM l JOIN tmpl USING (leaf, body) GROUP BY leaf, template, tokens HAVING count(DISTINCT tx) >= {NEED}),
gone AS (SELECT doc_id, line FROM l JOIN tmpl USING (leaf, body) JOIN rec USING (leaf, template)),
g AS (SELECT doc_id, list(line ORDER BY line) AS xs FROM gone GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, coalesce(len(xs), 0) AS n_dropped, coalesce(array_to_string(xs, ','), '') AS dropped,
       sha256(CASE WHEN xs IS NULL THEN coalesce(text, '') ELSE
           coalesce(array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(xs, i)),
                                                   lambda i: string_split(text, chr(10))[i + 1]), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


SQL_2 = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deobfuscate.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, finding_sha256, known, held_out, score, predicted of every candidate."""
    found = secret_forest.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "start", "length", F.sha2("finding", 256).alias("finding_sha256"), "known", "held_out", "score", "predicted"
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tree.join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


WORDS = f"regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+')"
SQL_6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontaminate(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


WORDS_8 = f"regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL_8 = f"""
WITH d AS (SELECT doc_id, {WORDS_8} AS w FROM documents),
b AS (SELECT item_id, {WORDS_8} AS w FROM benchmark),
bw AS (SELECT item_id, list_aggregate(list_slice(w, s, s + least(10, len(w)) - 1), 'string_agg', ' ') AS win, least(10, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, list_aggregate(list_slice(w, s, s + n - 1), 'string_agg', ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_bits.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strassen.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL_11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_ranking.rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERMS = f"regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL_12 = f"""
WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY 1),
x AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS part
      FROM tf JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM x JOIN q USING (term) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 50
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaving.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_13 = """
WITH crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) ORDER BY n) AS steps
             FROM range(256) r(n)),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
             xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(regexp_replace(rtrim(regexp_replace(hex(coalesce(text, '')), '(..)', '\\1 ', 'g')), '^$', '0'), ' '), lambda h: ('0x' || h)::BIGINT),
                 lambda a, b: xor(a // 256, steps[xor(a, b) % 256 + 1])), 4294967295) AS raw,
             ('0x' || md5('13:' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS shuffle
      FROM documents, crc),
e AS (SELECT * REPLACE (CASE WHEN size = 1 THEN 0 ELSE raw END AS raw) FROM d),
r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY shuffle, doc_id, size, raw) - 1) + 1) / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, CASE WHEN source IS NULL THEN '' ELSE '=' || source END) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, raw::BIGINT AS text_crc32, 'rows' AS law, (16 * place // n)::INTEGER AS shard,
       place - (16 * place // n * n + 15) // 16 AS slot, NULL::INTEGER AS grown_shard
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_templates": op1,
        "op2_exact_dedup": op2,
        "op3_pitman_yor": op3,
        "op4_deobfuscated_toxicity": op4,
        "op5_secret_forest": op5,
        "op6_count_vector_tree": op6,
        "op7_zstd_quality": op7,
        "op8_positional_index": op8,
        "op9_block_mixing": op9,
        "op10_language_bits": op10,
        "op11_strassen_negatives": op11,
        "op12_automaton_ranking": op12,
        "op13_stratified_interleaving": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_templates": SQL_1,
        "op2_exact_dedup": SQL_2,
        "op6_count_vector_tree": SQL_6,
        "op8_positional_index": SQL_8,
        "op11_strassen_negatives": SQL_11,
        "op12_automaton_ranking": SQL_12,
        "op13_stratified_interleaving": SQL_13,
    }
