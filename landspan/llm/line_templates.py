"""Line dedup by a tree of log templates.

Every line is parsed to a fixed depth: first by its number of tokens, then by its leading
tokens, where a token with a digit is a variable field.  The leaf that it reaches holds
lines of one shape, of any number of templates.  Two lines of a leaf are of one template
if they agree in at least ``SIMILAR`` of their tokens.  The tokens behind the leading ones
are cut into one block more than may differ, so that two such lines have a block in common;
under each block the most widespread line (then the first found) is the pattern, and a line
takes the most widespread pattern that it agrees with, else itself.  Where lines differ from
their pattern is a variable field.

A template recurs if it stands in at least ``MIN_DOCS`` different texts, and in more if it
has few tokens, which agree by chance: tokens times texts must reach ``LEAST_TOKENS``.
Copies of a text count once, however many there are, and what a pair of texts shares is left
to the operators that look for near copies.  All lines of recurring templates are dropped.

Every line travels as a few hashes; token lists are fetched only for leaves that recur.
A template with very many lines is only counted, in partial sums.

Defined results: a null text has no lines and stays null; an empty text is one line
without tokens.  Lines with fewer than ``MIN_TOKENS`` tokens are always kept.  A document
that loses all its lines keeps an empty text.  Rows that repeat an id and text lose the
same lines, as do rows without ``doc_id`` with equal texts.  Among equally widespread lines
the one with the smallest (doc_id, line) is the pattern.  Other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.llm.store import save
from landspan.llm.text import BLANK, fold, words

DEPTH = 3
SIMILAR = 0.8
MIN_TOKENS = 3
MIN_DOCS = 3
#: Tokens that the lines of a recurring template hold together, one line for each text.
LEAST_TOKENS = 24
#: Lines (a few numbers each) that are sent to every task at most.
FEW_LINES = 500_000
VARIABLE = "<*>"


def tokens(line: Column) -> Column:
    """The tokens of a folded line, each with a digit replaced."""
    return words(F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"[^{BLANK}]*[0-9][^{BLANK}]*", VARIABLE)).otherwise(line))


def folded_lines() -> Column:
    return F.split(fold(F.col("text")), "\n")


def parsed(documents: DataFrame) -> DataFrame:
    """doc_id, _doc, _text, line, tokens (number), leaf, body: hashes of each row, its text, each line and its leaf."""
    shape = lambda t: F.struct(F.size(t).alias("tokens"), F.xxhash64(F.size(t), F.slice(t, 1, DEPTH)).alias("leaf"), F.xxhash64(t).alias("body"))
    return (
        numbered(documents)
        .where("text is not null")
        .select("doc_id", "_doc", F.xxhash64("text").alias("_text"), F.posexplode(F.transform(F.transform(folded_lines(), tokens), shape)).alias("line", "one"))
        .select("doc_id", "_doc", "_text", "line", "one.*")
    )


def numbered(documents: DataFrame) -> DataFrame:
    return documents.withColumn("_doc", F.xxhash64("doc_id", "text"))


def enough(docs: Column) -> Column:
    return docs >= F.greatest(F.lit(MIN_DOCS), F.ceil(F.lit(LEAST_TOKENS) / F.col("tokens")))


def blocks(t: Column) -> Column:
    """Hashes of the blocks into which the tokens behind the leading ones are cut: one more than may differ."""
    rest = F.size(t) - DEPTH
    n = F.size(t) - F.ceil(SIMILAR * F.size(t)) + 1
    edge = lambda j: F.floor(j * rest / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64(j, F.slice(t, DEPTH + 1 + edge(j), edge(j + 1) - edge(j))))


def templates(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """leaf, body, template (the body of its pattern) of every line of the leaves that may recur."""
    shared = (
        lines.where(F.col("tokens") >= MIN_TOKENS)
        .groupBy("leaf", "tokens")
        .agg(F.countDistinct("_text").alias("docs"))
        .where(enough(F.col("docs")))
    )
    shared = save(shared, "leaves")
    # how widespread each distinct line of those leaves is, and where it is found first
    spread = (
        lines.join(shared.select("leaf"), "leaf", "left_semi")
        .groupBy("leaf", "body")
        .agg(F.countDistinct("_text").alias("docs"), F.min(F.struct("doc_id", "line", "_doc")).alias("at"))
    )
    spread = save(spread.select("leaf", "body", F.struct((-F.col("docs")).alias("less"), "at.doc_id", "at.line", "body").alias("order"), "at._doc", "at.line"), "bodies")
    wanted = save(spread.groupBy("_doc").agg(F.collect_list(F.struct("line", "leaf", "body", "order")).alias("wanted")), "wanted")
    wanted = F.broadcast(wanted) if spread.count() <= FEW_LINES else wanted
    known = (
        numbered(documents.where("text is not null").select("doc_id", "text"))
        .join(wanted, "_doc")
        .dropDuplicates(["_doc"])
        .select(folded_lines().alias("ls"), F.explode("wanted").alias("w"))
        .select("w.leaf", "w.body", "w.order", tokens(F.get(F.col("ls"), F.col("w.line"))).alias("t"))
    )
    known = save(known, "lines")
    filed = known.select("leaf", "body", F.explode(blocks(F.col("t"))).alias("block"))
    first = known.select("leaf", "order", F.explode(blocks(F.col("t"))).alias("block")).groupBy("leaf", "block")
    first = first.agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    tried = filed.join(first, ["leaf", "block"]).where("order.body <> body").select("leaf", "body", "order").distinct()
    pattern = known.select("leaf", F.col("body").alias("of"), F.col("t").alias("pattern"))
    both = tried.join(known.select("leaf", "body", "t"), ["leaf", "body"]).join(pattern.withColumnRenamed("leaf", "l"), (F.col("leaf") == F.col("l")) & (F.col("order.body") == F.col("of")))
    agree = F.size(F.filter(F.zip_with("t", "pattern", lambda a, b: a == b), lambda x: x))
    best = both.where(agree >= SIMILAR * F.size("t")).groupBy("leaf", "body").agg(F.min("order").alias("best"))
    return known.select("leaf", "body").join(best, ["leaf", "body"], "left").select("leaf", "body", F.coalesce("best.body", "body").alias("template"))


def recurring(lines: DataFrame, found: DataFrame) -> DataFrame:
    """leaf, template, docs of the templates that recur."""
    of = lines.join(found, ["leaf", "body"]).groupBy("leaf", "template", "tokens")
    return of.agg(F.countDistinct("_text").alias("docs")).where(enough(F.col("docs")))


def drops(documents: DataFrame) -> DataFrame:
    """_doc, _dropped: the numbers of the lines that go, per document that has any."""
    lines = save(parsed(documents), "parsed")
    found = save(templates(documents, lines), "templates")
    gone = found.join(recurring(lines, found).select("leaf", "template"), ["leaf", "template"], "left_semi").select("leaf", "body")
    return save(
        lines.join(gone, ["leaf", "body"], "left_semi").groupBy("_doc").agg(F.sort_array(F.collect_set("line")).alias("_dropped")), "drops"
    )


def cleaned(documents: DataFrame) -> DataFrame:
    """``documents`` with recurring lines dropped, and with ``_n_lines`` and ``_dropped`` (line numbers)."""
    gone = drops(documents)
    few = (gone.agg(F.sum(F.size("_dropped"))).first()[0] or 0) <= FEW_LINES
    gone = F.broadcast(gone) if few else gone
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("_dropped"), i)), "\n")
    out = numbered(documents).join(gone, "_doc", "left").drop("_doc")
    return (
        out.withColumn("_n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)))
        .withColumn("text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept))
        .withColumn("_dropped", F.coalesce("_dropped", F.array().cast("array<int>")))
    )
