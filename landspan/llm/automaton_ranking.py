"""Ranked lexical search by an Aho-Corasick scan of the documents.

The items' terms, each between two blanks, form one automaton that every task builds and
runs over its documents' bytes, in which A-Z are lower-cased and every other ASCII
character that is neither letter nor digit is a blank.  The blanks guard the borders: only
whole terms are found, and neighbours share the blank between them.  The automaton's
outputs are term numbers, counted per document and mapped to the items that hold them, so
that term frequencies come straight from the text; there is no index of the documents.

Two scans are made.  The first counts documents, their terms, and the documents of each
item term; each task sends one row per term.  The second scores: in 64-bit integers, term
by term, into one number per document and item, and each task keeps the ``k`` best
documents of each item.  These are merged in two steps, so that an item that all documents
match gathers a bounded number of rows in each task.

Only items are broadcast.  They are dealt by hash into blocks of about ``BLOCK`` terms, and
each block has an automaton and scans of its own.  A text is scanned in pieces of ``PIECE``
bytes cut at blanks; a longer term lengthens its piece.

Defined results: null texts have no terms, and documents without terms count nowhere.
Equal scores are ordered by id, rows without id last; repeated rows are documents of their
own.  Rows of one item id are one item, as are rows without id.  Items without terms and
documents without a term of an item do not appear.  Other columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.llm.store import bounded_batches, save
from landspan.llm.text import fold, runs

#: Characters between terms.
BREAKS = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
TOP = 50
#: Terms of a block of items, and bytes of a piece of text.
BLOCK, PIECE = 100_000, 1 << 18
NO_ID = np.iinfo(np.int64).max
_SEEN_AS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.array_remove(F.split(fold(text), f"[{BREAKS}]+"), ""))


@dataclass
class Items:
    """A block of items: their terms, and of each term the items that hold it (those of term t from ``at[t]`` to ``at[t + 1]``)."""

    ids: list
    terms: list[str]
    at: np.ndarray
    items: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        """The guarded terms, as the bytes that a text is seen as."""
        out = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            out.add_word(f" {term} ".encode().decode("latin-1"), number)
        out.make_automaton()
        return out


def pieces(data: bytes, most: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of consecutive pieces that begin and end with a blank; the blank between two belongs to both."""
    at = 0
    while at < len(data) - 1:
        end = data.rfind(b" ", at + 1, at + most)
        if end < 0:
            end = data.find(b" ", at + 1)
        yield at, data[at : end + 1]
        at = end


def scan(texts: pa.Array, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of every text; and text, term and count of what the automaton finds, sorted."""
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    starts = np.cumsum([0] + [len(t) + 1 for t in raw])
    data = (b" " + b" ".join(raw) + b" ").translate(_SEEN_AS)
    blank = np.frombuffer(data, np.uint8) == 32
    begins = np.flatnonzero(blank[:-1] & ~blank[1:])
    sizes = np.bincount(np.searchsorted(starts, begins, "right") - 1, minlength=len(raw))[: len(raw)] if len(raw) else np.zeros(0, np.int64)
    ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(automaton):
        for at, piece in pieces(data):
            hits = np.fromiter(chain.from_iterable(automaton.iter(piece.decode("latin-1"))), np.int64).reshape(-1, 2)
            ends.append(hits[:, 0] + at)
            found.append(hits[:, 1])
    n = max(1, len(automaton))
    # a match ends with a blank that lies behind its text's last byte at most
    key = np.sort((np.searchsorted(starts, np.concatenate(ends) - 1, "right") - 1) * n + np.concatenate(found))
    first = runs(key)
    doc, term = np.divmod(key[first], n)
    return sizes, doc, term, np.diff(np.append(first, len(key)))


def _count_rows(items: Items):
    """One row per item term: its documents; and one with the documents and terms of the task, under -1."""

    def work(batches: Iterator[pa.RecordBatch]):
        automaton = items.automaton()
        holding, documents, total = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            sizes, _, term, _ = scan(batch.column(0), automaton)
            holding += np.bincount(term, minlength=len(holding))
            documents += int((sizes > 0).sum())
            total += int(sizes.sum())
        some = np.flatnonzero(holding)
        number = pa.array(np.append(some, -1))
        yield pa.RecordBatch.from_arrays([number, pa.array(np.append(holding[some], documents)), pa.array(np.append(0 * some, total))], ["term", "documents", "total"])

    return work


@dataclass
class Corpus:
    """What scores need of all documents: their number, their terms, and the weight of each item term."""

    documents: int
    total: int
    weights: np.ndarray


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def scores(sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, items: Items, corpus: Corpus) -> tuple[np.ndarray, ...]:
    """Document, item and score of all that share a term."""
    m = 100 - 50 + (50 * sizes * corpus.documents) // max(1, corpus.total)
    part = corpus.weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))
    width = items.at[term + 1] - items.at[term]
    at = np.repeat(items.at[term] - np.cumsum(width) + width, width) + np.arange(width.sum())
    key = np.repeat(doc, width) * len(items.ids) + items.items[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = runs(key)
    total = np.add.reduceat(np.repeat(part, width)[order], first) if len(key) else key
    return *np.divmod(key[first], max(1, len(items.ids))), total


def _ranked_rows(items: Items, corpus: Corpus, k: int):
    """Item, document and score of the ``k`` best documents of each item in this task."""

    def work(batches: Iterator[pa.RecordBatch]):
        automaton = items.automaton()
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        least = np.ones(len(items.ids), np.int64)  # a score below cannot enter any more
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(NO_ID))
            for at in range(0, len(ids), 256):
                doc, item, score = scores(*scan(batch.column(1).slice(at, 256), automaton), items, corpus)
                some = score >= least[item]
                item, score, key = (np.concatenate(x) for x in zip(best, (item[some], score[some], ids[at : at + 256][doc[some]])))
                order = np.lexsort((key, -score, item))
                item, score, key = item[order], score[order], key[order]
                place = np.arange(len(item)) - np.searchsorted(item, item, "left")
                kept = place < k
                best = item[kept], score[kept], key[kept]
                full = place == k - 1
                least[item[full]] = score[full]
        item, score, key = best
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(key, mask=key == NO_ID), pa.array(score)], ["item", "doc_id", "score"])

    return work


def _blocks(items: DataFrame, most: int) -> Iterator[Items]:
    """The items in blocks of about ``most`` terms, fetched one at a time."""
    held = items.select(F.col("item_id"), F.explode(terms(F.col("text"))).alias("term")).distinct()
    held = save(held, "item_terms")
    n = max(1, -(-held.count() // most))
    for b in range(n):
        block = held.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.lit(n)) == b)
        rows = block.orderBy("term").toArrow()
        ids: dict = {}
        of = np.array([ids.setdefault(i, len(ids)) for i in rows["item_id"].to_pylist()], np.int64)
        words = rows["term"].to_pylist()
        first = [i for i, w in enumerate(words) if not i or w != words[i - 1]]
        yield Items(list(ids), [words[i] for i in first], np.array([*first, len(words)], np.int64), of)


def rank(documents: DataFrame, items: DataFrame, k: int = TOP, most: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents."""
    spark = documents.sparkSession
    bounded_batches(spark)
    kind = items.schema["item_id"].dataType
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = None
    for block in _blocks(items, most):
        counts = documents.select("text").mapInArrow(_count_rows(block), "term long, documents long, total long")
        counted = counts.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).toArrow().to_pylist()
        all_of = next((r for r in counted if r["term"] == -1), {"documents": 0, "total": 0})
        holding = np.zeros(len(block.terms), np.int64)
        for r in counted:
            if r["term"] >= 0:
                holding[r["term"]] = r["documents"]
        corpus = Corpus(all_of["documents"], all_of["total"], np.array([weight(all_of["documents"], int(h)) for h in holding], np.int64))
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        rows = rows.mapInArrow(_ranked_rows(block, corpus, k), "item long, doc_id long, score long").where("score > 0")
        some = rows.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*best))).where(F.col("rank") <= k)
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {kind.simpleString()}")
        found = top.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.union(found)
    return out
