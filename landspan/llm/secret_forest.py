"""Secret scan with a random forest that removes false positives.

Candidates are all long runs of key-like characters, with or without a digit, all spans of
known formats, and all values assigned to a cue, whatever characters they hold.  A span
within a longer one is part of it.  The forest sees, of each: its length and character
classes, how often the class changes from one character to the next and how likely its
characters follow each other in the corpus, how much of it dictionary words cover, the path
it was found under, and the words beside it.  It is trained from labelled findings, (doc_id, start, secret), and scores
every candidate; those above a threshold remain.

``known_formats`` labels findings by published key formats and unmistakable assignments;
the registered query trains on such labels of the documents that its hash does not hold
out.  Assigned values of which no format says anything are scored and not trained on.
Another table of findings can be passed.

Letter pairs and words are counted over all documents.  The dictionary holds every word of
at least ``WORD_LETTERS`` letters found in ``WORD_DOCS`` documents; it is a table that is
joined to the pieces of the distinct candidates and to the words beside them, so that no
task holds it whole unless it is small.  The forest is fitted on at most about ``FIT_ROWS``
findings of each label, a documented bound, chosen by hash; every document is scanned whole.

Defined results: null and empty texts have no candidates; rows without ``doc_id`` are
scanned and never trained on.  Repeated rows give repeated findings.  A null path is an
empty one.  Without findings of both labels every candidate's score is 1, so that nothing
is removed unlearned.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.deobfuscate import held_out
from landspan.llm.store import bounded_batches, save

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}")
#: Words that often stand before a secret.
CUES = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "auth", "bearer", "credential")
#: Published formats of keys, and assignments of hexadecimal or base64 values to a cue.
FORMATS = re.compile(
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}"
    r"|(?:token|password|passwd|pwd|secret|api_?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_\-]{12,})",
    re.I,
)
#: A value assigned to a cue: at least 6 characters without blanks, quotes, brackets or separators of lists.
ASSIGNED = re.compile(r"(?:token|password|passwd|pwd|secret|api_?key)[\"']?\s*[=:]\s*[\"']?([^\s\"'`,;<>(){}\[\]]{6,})", re.I)
#: Marks that end a sentence rather than a value.
CLOSING = ".:!?"
FIT_ROWS = 20_000
#: Documents that hold a word of the dictionary, and its letters, at least; letters of a piece, at most.
WORD_DOCS, WORD_LETTERS, PIECE = 3, 4, 12
#: Bits per word of the dictionary that tell most other pieces apart, and bits at most (32 MB).
BITS_PER_WORD, MOST_BITS = 32, 1 << 28
#: Words that a task counts at once.
COUNT_WORDS = 1_000_000
TREES, DEPTH, SEED, THRESHOLD = 40, 8, 7, 0.5
FEATURES = ["length", "digits", "upper", "lower", "marks", "changes", "distinct", "likely", "covered", "path_depth", "path_length", "cue", "cue_near", "assigned", "quoted", "before_known", "after_known"]


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def covering(word: str, known: Callable[[str], bool]) -> list[str]:
    """The dictionary words of at least 4 letters that cover the word, the longest first from the left."""
    out = []
    for run in re.findall(r"[^\W\d_]+", word):  # words hold nothing but letters
        at = 0
        while at <= len(run) - WORD_LETTERS:
            for n in range(min(PIECE, len(run) - at), WORD_LETTERS - 1, -1):
                if known(run[at : at + n]):
                    out.append(run[at : at + n])
                    at += n
                    break
            else:
                at += 1
    return out


def beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a span, empty if there is none."""
    before = re.findall(r"\w+", text[max(0, start - 80) : start].lower())
    after = re.findall(r"\w+", text[end : end + 40])
    return before[-1] if before else "", after[0].lower() if after else ""


def features(text: str, start: int, end: int, path: str) -> list[float]:
    """The features that need neither letter pairs nor the dictionary; 0 for the others."""
    word = text[start:end]
    n, low = len(word), word.lower()
    kinds = [kind(c) for c in word]
    before = text[max(0, start - 80) : start]
    words = re.findall(r"\w+", before.lower())
    return [
        float(n),
        *(kinds.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        len(set(word)) / n,
        0.0,
        0.0,
        float(path.count("/")),
        float(len(path)),
        float(any(c in low or (words and words[-1] == c) for c in CUES)),
        float(any(w in CUES for w in words[-4:])),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before != ""),
        0.0,
        0.0,
    ]


#: One of these, whatever the case, is part of all that FORMATS or ASSIGNED match.
TRIGGERS = ("akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "aiza", "token", "password", "passwd", "pwd", "secret", "apikey", "api_key")


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the findings that a known format marks as secrets."""
    return [m.span(1) if m.group(1) else m.span() for m in FORMATS.finditer(text)]


def assigned_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the values assigned to a cue, without the marks that end a sentence."""
    found = ((m.start(1), m.start(1) + len(m.group(1).rstrip(CLOSING))) for m in ASSIGNED.finditer(text))
    return [(a, b) for a, b in found if b > a]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, known) of all candidates; ``known``: 1 if a format marks it, -1 if it is assigned and none does, else 0."""
    low = text.casefold()
    marked, assigned = (secret_spans(text), assigned_spans(text)) if any(t in low for t in TRIGGERS) else ([], [])
    every = sorted({m.span() for m in CANDIDATE.finditer(text)} | {*marked, *assigned}, key=lambda s: (s[0], -s[1]))
    out, last = [], 0
    for a, b in every:
        if b <= last:
            continue
        last = b
        touches = lambda others: any(x < b and a < y for x, y in others)  # noqa: B023, E731
        out.append((a, b, 1 if touches(marked) else -1 if touches(assigned) else 0))
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, where, text in zip(*(c.to_pylist() for c in batch.columns)):
            for a, b, known in spans(text or ""):
                word = text[a:b]
                out.append((id_, a, b - a, word, int(known == 1), known < 0, features(text, a, b, where or ""), word.lower(), *beside(text, a, b)))
        cols = list(zip(*out)) or [()] * len(FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, FOUND)], schema=FOUND)


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("finding", pa.string()), ("known", pa.int32())]
    + [("undecided", pa.bool_()), ("features", pa.list_(pa.float64())), ("low", pa.string()), ("before", pa.string()), ("after", pa.string())]
)
FOUND_DDL = (
    "doc_id long, start long, length long, finding string, known int, undecided boolean, features array<double>, "
    "low string, before string, after string"
)


def word_bits(words: DataFrame) -> np.ndarray:
    """Bits at two hashes of each word, about ``BITS_PER_WORD`` for each word and ``MOST_BITS`` at most: no word is missed."""
    slots = 1 << 15
    while slots < min(MOST_BITS, BITS_PER_WORD * words.count()):
        slots *= 2
    h = F.xxhash64("word")
    both = F.explode(F.array(*(F.pmod(x, F.lit(slots)) + 1 for x in (h, F.shiftright(h, 32))))).alias("slot")
    parts = words.select(both).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((slots >> 15, 1 << 12), np.uint8)
    for r in parts.toArrow().to_pylist():
        out[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _word_features(pairs: dict[str, float], bits: np.ndarray):
    """Of every distinct candidate (low, and the pieces that are ``no`` words) how likely its characters follow each other, and what covers it.

    A piece counts as a word if the bits say so and it is not known to be none.
    """
    last = len(bits) * 8 - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.tobytes()

        def maybe(piece: str) -> bool:
            h = xxhash.xxh64_intdigest(piece.encode(), 42)  # the seed of Spark's xxhash64
            a, b = h & last, h >> 32 & last
            return bool(held[a >> 3] >> (a & 7) & 1 and held[b >> 3] >> (b & 7) & 1)

        for batch in batches:
            low, no = (c.to_pylist() for c in batch.columns)
            likely = [sum(pairs.get(x[i : i + 2], -9.0) for i in range(len(x) - 1)) / max(1, len(x) - 1) for x in low]
            parts = [covering(x, (lambda p, n=n: p not in n and maybe(p)) if n else maybe) for x, n in zip(low, no)]
            cover = [sum(map(len, p)) / max(1, len(x)) for x, p in zip(low, parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(likely, pa.float64()), pa.array(cover, pa.float64()), pa.array(parts, pa.list_(pa.string()))], ["low", "likely", "covered", "parts"])

    return work


def word_features(low: DataFrame, pairs: dict[str, float], dictionary: DataFrame) -> DataFrame:
    """low, likely, covered of every distinct candidate; ``covered`` is exact.

    Candidates are covered by the bits; the words so used are looked up in the dictionary,
    and candidates with one that is none are covered again without it, until all are words.
    """
    work = _word_features(pairs, word_bits(dictionary))
    todo, done = low.select("low", F.array().cast("array<string>").alias("no")), None
    while True:
        tried = save(todo.mapInArrow(work, "low string, likely double, covered double, parts array<string>"), "covered")
        used = tried.select("low", F.explode("parts").alias("word"))
        false = save(used.select("word").distinct().join(dictionary, "word", "left_anti"), "no_words")
        wrong = save(used.join(false.hint("merge"), "word").groupBy("low").agg(F.collect_set("word").alias("more")), "wrong")
        if wrong.isEmpty():
            good = tried
        else:
            good = tried.join(wrong.select("low").hint("merge"), "low", "left_anti")
        good = good.select("low", "likely", "covered")
        done = good if done is None else done.unionByName(good)
        if wrong.isEmpty():
            return done
        todo = todo.join(wrong.hint("merge"), "low").select("low", F.array_union("no", "more").alias("no"))


def candidates(documents: DataFrame, pairs: dict[str, float], dictionary: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, start, length, finding, known, undecided, features of every candidate.

    ``known``: a format marks it as a secret; ``undecided``: it is assigned and no format says anything.
    """
    where = F.col(path).cast("string") if path in documents.columns else F.lit("")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), "text")
    found = save(rows.mapInArrow(_found, FOUND_DDL), "found")
    low = found.select("low").distinct()
    of_word = save(word_features(low, pairs, dictionary), "found_words")
    # as many candidates as documents: by one plan at every size, so that disk grows as the input does
    out = found.join(of_word.hint("merge"), "low")
    for side in ("before", "after"):
        near = found.select(F.col(side).alias("word")).distinct().join(dictionary, "word", "left_semi")
        near = save(near.select(F.col("word").alias(side), F.lit(1.0).alias(f"{side}_known")), f"found_{side}")
        out = out.join(near, side, "left")
    put = {"likely": F.col("likely"), "covered": F.col("covered")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("before_known", "after_known")}
    whole = F.array(*(put.get(name, F.col("features")[i]) for i, name in enumerate(FEATURES)))
    return out.select("doc_id", "start", "length", "finding", "known", "undecided", whole.alias("features"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, docs, size = Counter(), Counter(), 0

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[w] for w in n], pa.int64())], ["word", "n", "docs"])

    for batch in batches:
        for text in batch.column(0):
            words = re.findall(r"[^\W\d_]+", (text.as_py() or "").lower())
            n.update(words)  # a word's repeats are not held
            docs.update(set(words))
            size += len(words)
            if size >= COUNT_WORDS:
                yield counted()
                n, docs, size = Counter(), Counter(), 0
    yield counted()


def background(documents: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """Log probabilities of letter pairs, and the dictionary (word), of all documents."""
    bounded_batches(documents.sparkSession)
    words = documents.select("text").mapInArrow(_count_words, "word string, n long, docs long")
    words = save(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "words")
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")
    pair = words.where(F.length("word") > 1).select("word", "n", at).select(F.expr("substring(word, i, 2)").alias("pair"), "n")
    # as many rows as letters follow each other
    rows = pair.groupBy("pair").agg(F.sum("n").alias("n")).collect()
    first: dict[str, int] = {}
    for p, n in rows:
        first[p[0]] = first.get(p[0], 0) + n
    known = words.where((F.length("word") >= WORD_LETTERS) & (F.col("docs") >= WORD_DOCS))
    return {p: math.log(n / first[p[0]]) for p, n in rows}, known.select("word")


def scan(documents: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """doc_id, start, length, finding, known, held_out, score, predicted of every candidate.

    ``findings``: doc_id, start, secret (0 or 1); by default what known formats say of the
    documents that are not held out.
    """
    found = save(candidates(documents, *background(documents), path), "candidates").withColumn("held_out", held_out(0, 5))
    if findings is None:
        train = found.where(~F.col("undecided")).withColumn("secret", F.col("known"))
    else:
        train = found.join(findings.select("doc_id", "start", "secret").dropDuplicates(["doc_id", "start"]), ["doc_id", "start"])
    train = train.where("doc_id is not null and not held_out")
    sizes = {r["secret"]: r["n"] for r in train.groupBy("secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return found.select("doc_id", "start", "length", "finding", "known", "held_out", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    size = F.when(F.col("secret") == 1, F.lit(sizes[1])).otherwise(F.lit(sizes[0]))
    train = train.where(F.pmod(F.xxhash64(F.lit(4), "doc_id", "start"), size) < FIT_ROWS)
    train = save(train.select("doc_id", "start", "secret", "features").orderBy("doc_id", "start").coalesce(1), "findings")
    forest = RandomForestClassifier(
        featuresCol="v", labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p", rawPredictionCol="raw", predictionCol="best"
    ).fit(train.select("secret", array_to_vector("features").alias("v")))
    scored = forest.transform(found.withColumn("v", array_to_vector("features")))
    score = vector_to_array("p")[1]
    return scored.select(
        "doc_id", "start", "length", "finding", "known", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")
    )
