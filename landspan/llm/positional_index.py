"""Benchmark decontamination by a distributed positional inverted index.

The index stores a posting (term, document, position) for each training token whose term
some test item has; a token without such a term can be in no match.  It is written once
to the shared folder.  For every window of an item its ``RAREST`` rarest terms, by the
index's own counts, name the postings to start from.  A posting at position ``p`` of a term
that stands at ``q`` in an item gives the offset ``p - q`` at which the item would lie in
the document; the offset-adjusted lists are intersected, that is, an offset that so many
places agree on is a candidate.  There the item's words are held against the document's,
and every run of a whole window is an exact match.  Any occurrence of a window holds its
rarest terms, so none is missed.

Proximity matches are items several of whose rarest terms fall near one offset: the
offset-adjusted lists are intersected with a tolerance instead of exactly.

Only tokens that the items use are postings, one row each, so one frequent word is spread
over all files of the index.  Terms are broadcast while the items have at most
``FEW_TERMS`` of them and joined by a shuffle beyond; candidates likewise.

Defined results: null or wordless texts have no words, no hits, and the digest of an empty
list.  Items that are null, wordless or without id match nothing.  Repeated item rows with
one id and text count once; rows with the same id and other text are matched each, under
that id.  Document rows that repeat an id get the hits of their own text.  Rows of
documents without id are returned with their hits as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.llm.store import save
from landspan.llm.text import fold
from landspan.llm.text import words as split_words

SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
WINDOW = 10
RAREST = 2
#: Rows that may be sent to every task: terms (a hash and two counts) and candidates (a few numbers).
FEW_TERMS = 500_000
FEW_CANDIDATES = 500_000


def words(text: Column) -> Column:
    return split_words(fold(text), SEPARATORS)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if counted to be at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def item_terms(benchmark: DataFrame) -> DataFrame:
    """One row per item text: item_id, item (a key of id and text), terms."""
    return (
        benchmark.select("item_id", words(F.col("text")).alias("terms"))
        .where("item_id is not null and size(terms) > 0")
        .distinct()
        .withColumn("item", F.xxhash64("item_id", "terms"))
    )


def numbered(documents: DataFrame) -> DataFrame:
    """``_doc`` names a row by its id and text, so that rows that repeat an id stay apart."""
    return documents.withColumn("_doc", F.xxhash64("doc_id", "text"))


def postings(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The index: term (hash), _doc, position, of the tokens that some item has."""
    terms = items.select(F.explode("terms").alias("word")).distinct()
    tokens = numbered(documents).select("_doc", F.posexplode(words(F.col("text"))).alias("position", "word"))
    return save(
        tokens.join(small(terms, FEW_TERMS), "word", "left_semi").select(F.xxhash64("word").alias("term"), "_doc", "position"), "postings"
    )


def places(items: DataFrame) -> DataFrame:
    """item, term, at: where every term stands in every item."""
    return items.select("item", F.posexplode("terms").alias("at", "word")).select("item", F.xxhash64("word").alias("term"), "at")


def rarest(items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, term, at, need: for each window of an item, the places of its terms that are rarest in the index.

    ``need``: how many places agree wherever a window of the item occurs.
    """
    df = save(index.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    counted = places(items).join(df, "term", "left").fillna(0, "df")
    sizes = items.select("item", F.size("terms").alias("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.least(F.col("at"), F.greatest(F.lit(0), F.col("n") - window)))
    return (
        counted.join(sizes, "item")
        .select("item", "term", "at", "df", F.least("n", F.lit(RAREST)).alias("need"), F.explode(starts).alias("start"))
        .groupBy("item", "start", "need")
        .agg(F.sort_array(F.collect_list(F.struct("df", "at", "term"))).alias("terms"))
        .select("item", "need", F.explode(F.slice("terms", 1, RAREST)).alias("least"))
        .select("item", "need", "least.term", "least.at")
        .distinct()
    )


def offsets(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """_doc, item, shift: where an item may lie, by the postings of its rarest terms."""
    found = index.join(small(seeds, FEW_TERMS), "term").select("_doc", "item", (F.col("position") - F.col("at")).alias("shift"), "need")
    agreed = found.groupBy("_doc", "item", "shift", "need").agg(F.count(F.lit(1)).alias("places"))
    return save(agreed.where("places >= need").select("_doc", "item", "shift"), "offsets")


def exact(documents: DataFrame, items: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """_doc, item, item_id, shift, hits: the words of the document inside whole windows of the item."""
    docs = numbered(documents).select("_doc", "text")
    docs = docs.join(small(candidates.select("_doc").distinct(), FEW_CANDIDATES), "_doc", "left_semi").dropDuplicates(["_doc"])
    pairs = docs.select("_doc", words(F.col("text")).alias("words")).join(candidates, "_doc").join(items, "item")
    # the item's places that differ from the document at this offset, between two borders
    differ = "filter(sequence(0, size(terms) - 1), i -> not coalesce(get(words, shift + i) = terms[i], false))"
    long_gaps = "filter(sequence(0, size(ends) - 2), k -> ends[k + 1] - ends[k] > need)"
    inside = f"flatten(transform({long_gaps}, k -> sequence(shift + ends[k] + 1, shift + ends[k + 1] - 1)))"
    return (
        pairs.withColumn("need", F.least(F.size("terms"), F.lit(window)))
        .withColumn("ends", F.expr(f"concat(array(-1), {differ}, array(size(terms)))"))
        .withColumn("hits", F.expr(inside))
        .where("size(hits) > 0")
        .select("_doc", "item", "item_id", "shift", "hits")
    )


def proximity(index: DataFrame, items: DataFrame, terms: int = 5, slack: int = 8) -> DataFrame:
    """_doc, item, shift, n_terms: items with ``terms`` of their rarest places within about ``slack`` of one offset.

    The offsets are counted in overlapping bands of width ``2 * slack``; a band's centre is returned.
    """
    seeds = rarest(items, index)
    found = index.join(small(seeds, FEW_TERMS), "term").select("_doc", "item", "at", (F.col("position") - F.col("at")).alias("shift"))
    band = F.floor(F.col("shift") / slack)
    bands = found.select("_doc", "item", "at", F.explode(F.array(band, band + 1)).alias("band"))
    need = F.least(F.lit(terms), F.col("places"))
    return (
        bands.groupBy("_doc", "item", "band")
        .agg(F.countDistinct("at").alias("n_terms"))
        .join(seeds.groupBy("item").agg(F.countDistinct("at").alias("places")), "item")
        .where(F.col("n_terms") >= need)
        .select("_doc", "item", (F.col("band") * slack).alias("shift"), "n_terms")
    )


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """_doc, item_id, shift, hits of every exact match, by way of the index."""
    items = save(item_terms(benchmark), "items")
    index = postings(documents, items)
    return exact(documents, items, offsets(index, rarest(items, index, window)), window)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` that hold no window of any item, with all their columns."""
    hit = save(matches(documents, benchmark, window).select("_doc").distinct(), "hit")
    return numbered(documents).join(small(hit, FEW_CANDIDATES), "_doc", "left_anti").drop("_doc")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = save(
        matches(documents, benchmark, window)
        .groupBy("_doc")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
        ),
        "found",
    )
    rows = numbered(documents).select("_doc", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return rows.join(found, "_doc", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
