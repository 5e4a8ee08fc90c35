"""Language identification by bit-sliced Bloom filters.

Every language has a Bloom filter of all n-grams found in its training texts.  The filters
lie side by side: slot ``s`` of the table is a bitmask with bit ``l`` set if language ``l``
has set that slot, as many words of 64 bits as the languages need.  The AND of an n-gram's
slots is the set of all languages that contain it, found in as many reads as there are hash
functions, whatever the number of languages.

For every language a text's hits are counted over its n-grams, corrected for the false
positives that the filter's fill predicts, and weighed: an n-gram that few languages
contain says more.  The language with the largest corrected share wins; ties go to the one
with more training rows, then to the first name.  A text of which no n-gram is found is read
again by shorter ones, which have tables of their own, down to single bytes; if those are
not found either, the language with most training rows is taken, with its share of them as
the score.  N-grams are bytes of the text after folding case, with everything but letters
as one blank.

The filters are fitted on at most ``FIT_ROWS`` rows per language, a documented bound,
chosen by hash.  The tables are sent to the tasks; they have ``SPARE`` slots for each n-gram
of the language that has most.

Defined results: a null text or one without a letter is ``und`` with score 0.  Rows
without ``doc_id`` are predicted and are neither learned from nor held out.  Without any
training row everything is ``und``.  Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.deobfuscate import held_out
from landspan.llm.text import mix, slices

FIT_ROWS = 4000
#: Bytes of an n-gram, hash functions, slots per n-gram, least slots of a table (a power of two).
GRAM, PROBES, SPARE, SLOTS = 4, 2, 16, 1 << 16
#: Parts in which the n-grams of a language are gathered.
PARTS = 64
UND = "und"

# ASCII letters in lower case, every other ASCII byte a blank, other bytes themselves
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[65:91] = _PLAIN[97:123] = np.arange(97, 123)


def grams(data: np.ndarray, offsets: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of every n-gram of ``size`` bytes that holds a letter; a text is framed by blanks."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    # a blank before and after each text
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(n), lengths) + 1
    b = np.full(len(data) + 2 * n, 32, np.uint8)
    b[at] = _PLAIN[data]
    # capitals of the Latin-1 letters: C3 80-9E but the multiplication sign
    low = np.flatnonzero(b[:-1] == 0xC3) + 1
    low = low[(b[low] >= 0x80) & (b[low] <= 0x9E) & (b[low] != 0x97)]
    b[low] += 0x20
    row = np.repeat(np.arange(n), lengths + 2)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (row[1:] != row[:-1])
    b, row = b[keep], row[keep]
    if len(b) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    g = b[: len(b) - size + 1].astype(np.uint32)
    for k in range(1, size):
        g = (g << np.uint32(8)) | b[k : len(b) - size + 1 + k]
    row_of = row[: len(g)]
    whole = row_of == row[size - 1 :]
    if size == 1:
        whole &= g != 32
    return row_of[whole], g[whole]


def probes(g: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of n-grams, one array per hash function."""
    h = mix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Level:
    size: int  # bytes of its n-grams
    table: np.ndarray  # uint64[slots, words]: which languages have set the slot
    false: np.ndarray  # false-positive rate per language


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]  # the longest n-grams first
    prior: np.ndarray  # share of the training rows per language


def _train_rows(names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]):
        number = {n: i for i, n in enumerate(names)}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            at = 0
            for part, data, offsets in slices(batch.column(0), batch.column(1)):
                for size in range(GRAM, 0, -1):
                    row, g = grams(data, offsets, size)
                    key = np.unique(lang[at : at + len(part)][row] << 32 | g.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key >> 32).astype(np.int32)), pa.array(np.full(len(key), size, np.int32)), pa.array(key & 0xFFFFFFFF)], ["lang", "size", "gram"]
                    )
                at += len(part)

    return work


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "size": rows["size"].iloc[:1], "grams": [rows["gram"].to_numpy().astype(np.uint32).tobytes()]})


def level(size: int, per_language: list[np.ndarray]) -> Level:
    """The table that holds all these n-grams of each language."""
    most = max((len(g) for g in per_language), default=0)
    slots = max(SLOTS, 1 << max(SPARE * most - 1, 0).bit_length())
    table = np.zeros((slots, (len(per_language) + 63) // 64), np.uint64)
    fill = np.zeros(len(per_language))
    for i, g in enumerate(per_language):
        set_ = np.unique(np.concatenate(probes(g, slots)))
        table[set_, i // 64] |= np.uint64(1 << i % 64)
        fill[i] = len(set_) / slots
    return Level(size, table, fill**PROBES)


def fit(train: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """``train``: key, lang, text."""
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    rows = {r["lang"]: r["rows"] for r in counts.collect()}
    names = sorted(rows)
    if not names:
        return Model([], [], np.zeros(0))
    some = train.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64(F.lit(23), "key"), F.col("rows")) < fit_rows)
    seen = some.select("lang", "text").mapInArrow(_train_rows(names), "lang int, size int, gram long").distinct()
    packed = seen.groupBy("lang", "size", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).alias("part")).applyInPandas(_packed, "lang int, size int, grams binary")
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in packed.collect():  # 4 bytes per n-gram
        found.setdefault((r["size"], r["lang"]), []).append(np.frombuffer(r["grams"], np.uint32))
    of = lambda size, i: np.concatenate(found.get((size, i), [np.zeros(0, np.uint32)]))
    levels = [level(size, [of(size, i) for i in range(len(names))]) for size in range(GRAM, 0, -1)]
    return Model(names, levels, np.array([rows[n] for n in names]) / sum(rows.values()))


def shares(data: np.ndarray, offsets: np.ndarray, one: Level) -> np.ndarray:
    """Corrected and weighed hits of every text (rows) in every language (columns)."""
    m, k = len(offsets) - 1, len(one.false)
    row, g = grams(data, offsets, one.size)
    if not len(g):
        return np.zeros((m, k))
    mask = np.full((len(g), one.table.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
    for slot in probes(g, len(one.table)):
        mask &= one.table[slot]
    # n-grams with the same set of languages in the same text are counted together
    flat = mask[:, 0] if mask.shape[1] == 1 else mask.view(f"V{8 * mask.shape[1]}").ravel()
    sets, which = np.unique(flat, return_inverse=True)
    pair, n = np.unique(row * len(sets) + which, return_counts=True)
    r, s = pair // len(sets), pair % len(sets)
    bits = np.unpackbits(np.ascontiguousarray(sets).view(np.uint8).reshape(len(sets), -1), axis=1, bitorder="little")[:, :k].astype(bool)
    size = bits.sum(axis=1)
    weight = (1.0 / np.maximum(size, 1))[s] * n
    found = size[s] > 0
    all_ = np.bincount(r, np.where(found, weight, n / k), minlength=m)
    share = np.zeros((m, k))
    for i in range(k):
        mine = bits[s, i]
        hit = np.bincount(r[mine], weight[mine], minlength=m)
        share[:, i] = np.maximum(0, hit - one.false[i] * all_) / (1 - one.false[i])
    return share


def decide(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, score) of every text."""
    m, k = len(offsets) - 1, len(model.languages)
    if not k:
        return np.zeros(m, int), np.zeros(m)
    share = np.zeros((m, k))
    open_ = np.arange(m)
    for one in model.levels:
        part, to = data, offsets
        if len(open_) < m:
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in open_])
            to = np.concatenate([[0], np.cumsum(np.diff(offsets)[open_])])
        share[open_] = shares(part, to, one)
        open_ = open_[share[open_].sum(axis=1) == 0]
        if not len(open_):
            break
    share[open_] = model.prior
    order = np.argsort(-model.prior, kind="stable")
    best = order[share[:, order].argmax(axis=1)]
    return best, share[np.arange(m), best] / share.sum(axis=1)


def _predict_rows(model: Model):
    names = np.array([*model.languages, UND], object)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = 0
            for ids, data, offsets in slices(batch.column(0), batch.column(1)):
                best, score = decide(data, offsets, model)
                letters = batch.column(2).slice(at, len(ids)).to_numpy(zero_copy_only=False).astype(bool)
                known = letters & bool(len(model.languages))
                best = np.where(known, best, len(model.languages))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"]
                )
                at += len(ids)

    return work


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter.alias("letter"))
    out = rows.mapInArrow(_predict_rows(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")


def identify(documents: DataFrame) -> DataFrame:
    train = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(2, 4))
    return predict(documents, fit(train.select(F.col("doc_id").alias("key"), "lang", "text")))
