"""Toxicity by noisy-channel deobfuscation.

Written words may be a noisy form of what is meant: letters replaced by look-alikes
(``l0ser``), letters repeated (``stuuupid``) or set apart (``i d i o t``, ``l.o.s.e.r``).
For every word that could be such a form a lattice of readings is built: each character
stands for itself or for what it may replace, a run of one letter for one or two of them,
a mark between letters for nothing.  Viterbi decoding picks the path with the best sum of
the channel's cost and the log probability under a character bigram model of plain words
learned from the training texts.  Plain words have one path and stay as they are.

Runs of tokens of one character, look-alikes and marks among them, go through the same
lattice, where a blank stands for nothing or for a word border, as does a mark in a long
chain.  They are decoded once for each of a few costs of a border; what is then no word of the
training texts is also split into such words, and every word of these readings counts.  Words and runs of any length are decoded.

The restored words are scored by what the labels teach: the log odds of words and of the
beginnings of words (so that inflected forms count) in toxic against other documents.  A
document's evidence is the strongest of its restored words, so that a long text gathers no
guilt by its length, and a rising calibration curve turns it into a probability.

The model is fitted on every labelled row that is not held out: letter pairs, words and
features are counted in Spark, and so is the calibration.  Words that are less probable
than a letter that belongs to no word are unknown, which bounds the words by construction;
the model holds at most ``MOST_WEIGHTS`` weights and is sent to every task.  All texts are
scored whole, independently of each other.

Defined results: null and empty texts have no evidence and get the base rate's score.
Rows without ``doc_id`` are scored and are not held out.  Repeated rows get equal scores.
Without labelled rows of both kinds every score is 0.  A label is the larger of the labels
given to an id.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.llm.store import bounded_batches, save
from landspan.llm.text import Hasher, runs, slices, spans

#: More ids than this are joined by a shuffle.
BROADCAST_IDS = 1_000_000
MOST_WEIGHTS = 200_000
#: Toxic documents that a feature needs, other documents granted to each feature, and its least odds.
MIN_SUPPORT, GRANTED, LEAST_ODDS = 3, 2.5, 5
#: Word beginnings of these many letters are features too.
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.3
RANK = 0.02
#: What a look-alike character may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
#: Log costs of the channel: a replaced, a dropped and a repeated character.
REPLACED, DROPPED, REPEATED = -1.0, -0.7, -0.5
#: Log costs of a word border at a blank; a text set apart is read once with each.
BORDERS = (0.0, -2.0, 1.0)
#: Characters of a word, and marks in it, from which its marks may be borders as well.
CHAIN, CHAIN_MARKS = 12, 4
#: Letters of a known word, at most, and the log probability of a letter that belongs to none.
WORD, UNKNOWN = 30, -16.0
#: Longer texts are not remembered.
REMEMBERED = 100
LETTER = re.compile(r"[^\W\d_]")
STRIP = " .,;:!?\"'|()[]{}*#%&$-_~`<>/\\=+"
FRONT = " .,;:?\"'()[]{}*#%&-_~`>/\\="


def held_out(rest: int, modulus: int) -> Column:
    """Whether the document's CRC leaves this remainder; rows without id are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest, F.lit(False))


@dataclass
class CharModel:
    """Log probabilities of a letter after another, from plain words (``^`` and ``$`` are the borders), and of the words."""

    pairs: dict[str, float] = field(default_factory=dict)
    floor: float = -8.0
    words: dict[str, float] = field(default_factory=dict)

    def __call__(self, a: str, b: str) -> float:
        return self.pairs.get(a + b, self.floor)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of one character: the readings and their costs."""
    out = []
    for run in re.finditer(r"(.)\1*", word, re.S):
        c, n = run.group(1), len(run.group())
        paths: list[tuple[str, float]] = []
        for letter in LOOK_ALIKES.get(c, ""):
            paths.append((letter, REPLACED + (REPEATED if n > 1 else 0)))
        if LETTER.match(c):
            paths += [(c, 0.0 if n == 1 else REPEATED)] + ([(c * 2, 0.0 if n == 2 else REPEATED)] if n > 1 else [])
        else:
            paths.append(("", DROPPED))
        out.append(paths)
    return out


def decoded(steps: list[list[tuple[str, float]]], chars: CharModel) -> str:
    """The best path (Viterbi; the state is the last letter, ``^`` at a border); a blank in a piece is a border."""
    best, back = {"^": 0.0}, []
    for paths in steps:
        after: dict[str, float] = {}
        came: dict[str, tuple[str, str]] = {}
        for last, score in best.items():
            for piece, cost in paths:
                s, at = score + cost, last
                for letter in piece:
                    s += chars(at, "$" if letter == " " else letter)
                    at = "^" if letter == " " else letter
                if at not in after or s > after[at]:
                    after[at], came[at] = s, (last, piece)
        best = after
        back.append(came)
    at = max((score + chars(last, "$"), last) for last, score in best.items())[1]
    out = []
    for came in reversed(back):
        at, piece = came[at]
        out.append(piece)
    return "".join(reversed(out))


def restore(word: str, chars: CharModel) -> str:
    """The most probable plain reading of a word."""
    return decoded(lattice(word), chars)


def split(glued: str, words: dict[str, float]) -> list[str]:
    """The known words of the most probable division of some letters into words; the rest are letters by themselves."""
    best, back = [0.0], [0]
    for j in range(1, len(glued) + 1):
        best.append(best[j - 1] + UNKNOWN)
        back.append(j - 1)
        for i in range(max(0, j - WORD), j - 1):
            p = words.get(glued[i:j])
            if p is not None and best[i] + p > best[j]:
                best[j], back[j] = best[i] + p, i
    out, j = [], len(glued)
    while j:
        out.append(glued[back[j] : j])
        j = back[j]
    return [w for w in reversed(out) if len(w) > 1]


def apart(written: str, chars: CharModel) -> list[str]:
    """The words of the most probable readings of characters set apart, one reading per cost of a border."""
    gaps, tokens = [], []
    for m in re.finditer(r"(\s*)(\S)", written):
        gaps.append(len(m.group(1)))
        tokens.append(m.group(2))
    found: dict[str, None] = {}
    for border in BORDERS:
        steps, i = [], 0
        while i < len(tokens):
            j = i + 1
            while j < len(tokens) and tokens[j] == tokens[i] and gaps[j] < 2:
                j += 1
            if i:
                steps.append([("", 0.0), (" ", 0.0 if gaps[i] > 1 else border)] if gaps[i] or not LETTER.match(tokens[i]) or not LETTER.match(tokens[i - 1]) else [("", 0.0)])
            paths = lattice(tokens[i] * (j - i))[0]
            if tokens[i] in LOOK_ALIKES and (tokens[i].isdigit() or gaps[i] or not i):
                paths = [(p, c) for p, c in paths if p]  # a look-alike that stands alone stands for a letter
            # a letter that comes twice may close one word and open the next
            steps.append(paths + [(f"{p} {p}", c + border) for p, c in paths if len(p) == 1 and j - i > 1])
            i = j
        for w in decoded(steps, chars).split():
            if len(w) > 1 and w not in found:
                found[w] = None
                if chars.words and w not in chars.words:
                    found |= dict.fromkeys(split(w, chars.words))
    return list(found)


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STANDS = np.zeros(256, bool)
_STANDS[[ord(c) for c in LOOK_ALIKES if ord(c) < 128]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Tokens of a run set apart and letters in it, at least; bytes of such a token, at most.
APART, APART_LETTERS, TOKEN_BYTES = 3, 2, 5


def noisy(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words that may be noisy forms, and of runs of ``APART`` single characters.

    A word may be noisy if something else stands between its letters, if a look-alike stands
    before them, or if a letter comes three times in a row.
    """
    starts, ends, row = spans(data, offsets)
    if not len(starts):
        return starts, ends, row
    letter = _LETTERS[data]
    count = np.concatenate([[0], np.cumsum(letter)])
    letters = count[ends] - count[starts]
    at = np.arange(len(data))
    inside = np.zeros(len(data), bool)
    inside[starts] = True
    word = np.cumsum(inside) - 1  # of each byte; blanks belong to the word before
    at, word = at[letter], word[letter]
    first, last = np.full(len(starts), -1), np.full(len(starts), -2)
    begin = runs(word)
    first[word[begin]] = at[begin]
    last[word[begin]] = at[np.append(begin[1:], len(at)) - 1] if len(at) else at[:0]
    odd = last - first + 1 > letters
    odd |= _STANDS[data[starts]] & (letters > 1)
    if len(data) > 2:
        low = data | np.where(data < 128, 32, 0).astype(np.uint8)
        three = np.flatnonzero((low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[:-2] & letter[1:-1] & letter[2:])
        hit = np.searchsorted(starts, three, "right") - 1
        odd[hit[three + 2 < ends[hit]]] = True
    odd &= letters > 1
    # tokens of one letter or look-alike, with or without marks, next to each other
    within = lambda which: (total := np.concatenate([[0], np.cumsum(which)]))[ends] - total[starts]
    begun = within((letter & (data < 128)) | (data >= 0xC0))  # letters, not their bytes
    single = (begun + within(_DIGIT[data]) <= 1) & (ends - starts <= TOKEN_BYTES)
    sign = begun + within(_STANDS[data]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    edge = np.unique(np.concatenate([edge, runs(row)]))
    group = np.append(edge[edge < len(single)], len(single))
    signs, plain = np.concatenate([[0], np.cumsum(sign)]), np.concatenate([[0], np.cumsum(begun)])
    a, b = group[:-1], group[1:]
    a, b = (x[single[a] & (signs[b] - signs[a] >= APART) & (plain[b] - plain[a] >= APART_LETTERS)] for x in (a, b))
    return np.concatenate([starts[odd], starts[a]]), np.concatenate([ends[odd], ends[b - 1]]), np.concatenate([row[odd], row[a]])


def reading(written: str, chars: CharModel, known: dict[str, str]) -> str:
    """The restored form of a noisy word, or the words of characters set apart; ``known`` remembers what was decoded."""
    if written in known:
        return known[written]
    low = written.lower().strip()
    if len(low.split()) > 1:
        out = " ".join(apart(low, chars))
    else:
        word = low.rstrip(STRIP).lstrip(FRONT)
        out = restore(word, chars) if len(word) >= 3 else ""
        if len(word) > CHAIN and sum(not c.isalnum() for c in word) >= CHAIN_MARKS:
            out = " ".join(dict.fromkeys([out, *apart(word, chars)]))
    if len(written) <= REMEMBERED:
        if len(known) > 200_000:
            known.clear()
        known[written] = out
    return out


def readings(text: str, chars: CharModel, known: dict[str, str]) -> list[str]:
    """The restored forms of all noisy words of one text."""
    raw = text.encode()
    starts, ends, _ = noisy(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    found = (reading(raw[a:b].decode("utf-8", "replace"), chars, known) for a, b in zip(starts, ends))
    return [x for x in found if x]


# Plain words are seen as hashes of bytes: a word without its surrounding marks, and its beginnings.
_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(rows, hashes) of the words, then of the beginnings of longer words, one pair per length."""
    starts, ends, row = spans(data, offsets, _MARK)
    lengths, h = ends - starts, Hasher(data)
    yield row, h(starts, ends)
    for k in BEGINNINGS:
        long = lengths > k
        yield row[long], h(starts[long], starts[long] + k) ^ np.uint64(k)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words and word beginnings of every text, sorted."""
    row, h = (np.concatenate(x) for x in zip(*word_hashes(data, offsets)))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


#: Nothing learned: every score is 0.
NEVER = (np.zeros(1), np.zeros(1))


@dataclass
class Model:
    chars: CharModel
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]  # evidence and its probability, rising


#: Slots of a table that says of most hashes that they are no feature.
SIEVE = 1 << 20


def evidence(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The largest weight among each text's features, 0 without any."""
    out = np.zeros(len(offsets) - 1)
    if not len(keys) or not len(data):
        return out
    low = np.uint64(SIEVE - 1)
    sieve = np.zeros(SIEVE, bool)
    sieve[(keys & low).astype(np.int64)] = True
    for row, h in word_hashes(data, offsets):
        some = sieve[(h & low).astype(np.int64)]
        row, h = row[some], h[some]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        np.maximum.at(out, row[hit], weights[at[hit]])
    return out


def restored(data: np.ndarray, offsets: np.ndarray, chars: CharModel, known: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with the readings of their noisy words added at the end."""
    starts, ends, row = noisy(data, offsets)
    if not len(starts):
        return data, offsets
    raw, more = data.tobytes(), {}
    for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist()):
        word = reading(raw[a:b].decode("utf-8", "replace"), chars, known)
        if word:
            more.setdefault(r, set()).add(word)
    parts = [raw[offsets[i] : offsets[i + 1]] + (b"\n" + "\n".join(sorted(more[i])).encode() if i in more else b"") for i in range(len(offsets) - 1)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _char_model(texts: DataFrame) -> CharModel:
    """Counts letter pairs and words of the training rows, in Spark; a model has as many pairs as the alphabet allows."""
    def count(batches):
        for batch in batches:
            seen: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
                    if 2 <= len(w) <= WORD:
                        seen[" " + w] = seen.get(" " + w, 0) + 1
                    w = f"^{w}$"
                    for a, b in zip(w, w[1:]):
                        seen[a + b] = seen.get(a + b, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pair", "n"])

    plain = save(texts.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")), "plain")
    word = F.col("pair").startswith(" ")
    counts = lambda df: dict(zip(*(c.to_pylist() for c in df.toArrow().columns)))  # noqa: E731  bounded by the alphabet and by UNKNOWN
    total = plain.where(word & (F.col("n") > 1)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = counts(plain.where(~word))
    words = counts(plain.where(word & (F.col("n") > 1) & (F.col("n") >= math.exp(UNKNOWN) * total)))
    first: dict[str, int] = {}
    for pair, n in pairs.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    size = len(first) + 1
    return CharModel({pair: math.log((n + 0.1) / (first[pair[0]] + 0.1 * size)) for pair, n in pairs.items()}, words={w[1:]: math.log(n / total) for w, n in words.items()})


def _feature_rows(chars: CharModel):
    def work(batches: Iterator[pa.RecordBatch]):
        known: dict[str, str] = {}
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for part, data, offsets in slices(batch.column(1), batch.column(0)):
                data, offsets = restored(data, offsets, chars, known)
                row, h = features(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind[at : at + len(part)][row].astype(np.int64))], ["feature", "kind"])
                at += len(part)

    return work


def _score_rows(model: Model):
    def work(batches: Iterator[pa.RecordBatch]):
        known: dict[str, str] = {}
        for batch in batches:
            for ids, data, offsets in slices(batch.column(0), batch.column(1)):
                data, offsets = restored(data, offsets, model.chars, known)
                total = evidence(data, offsets, model.keys, model.weights)
                score = np.interp(total, *model.curve)
                yield pa.RecordBatch.from_arrays([ids, pa.array(total), pa.array(score)], ["key", "evidence", "score"])

    return work


def training(documents: DataFrame, labels: DataFrame, label: str, rest: int, modulus: int, fit_rows: int | None = None, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """key, label, text of all labelled rows that are not held out, or of about ``fit_rows`` of them."""
    marked = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    marked = marked.where(~held_out(rest, modulus))
    bounded_batches(documents.sparkSession)
    n = max(1, marked.count())
    if fit_rows is not None:
        marked = marked.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(n)) < fit_rows)
    # while the ids are few, the documents' texts stay where they are
    few = min(n, n if fit_rows is None else fit_rows) <= broadcast_ids
    rows = documents.select("doc_id", "text").where(~held_out(rest, modulus)).join(F.broadcast(marked) if few else marked, "doc_id")
    return save(rows.select(F.col("doc_id").cast("long").alias("key"), "label", "text"), "training")


def weighed(counts: DataFrame, bad: str, good: str, n_bad: int, n_good: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of the features that are clearly more frequent in toxic documents."""
    rate = F.log(((F.col(bad) + 0.5) / (n_bad + 1)) / ((F.col(good) + GRANTED) / (n_good + 1)))
    kept = (
        counts.where(F.col(bad) >= MIN_SUPPORT)
        .select("feature", rate.alias("weight"))
        .where(F.col("weight") > math.log(LEAST_ODDS))
        .orderBy(F.desc("weight"), "feature")
        .limit(MOST_WEIGHTS)
        .toArrow()
    )
    keys = np.asarray(kept["feature"]).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(kept["weight"], float)[order]


def fit(train: DataFrame) -> Model:
    """``train``: key, label, text of all training rows.

    The curve is fitted on evidence from features that each row's own half did not choose.
    """
    fold = F.pmod(F.xxhash64(F.lit(29), "key"), F.lit(2))
    train = train.withColumn("fold", fold)
    chars = _char_model(train.select("text"))
    sizes = {(r["label"], r["fold"]): r["n"] for r in train.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda label, *folds: sum(sizes.get((label, f), 0) for f in folds)
    if not size(1, 0, 1) or not size(0, 0, 1):
        return Model(chars, np.zeros(0, np.uint64), np.zeros(0), NEVER)
    seen = train.select("text", (F.col("label") * 2 + F.col("fold")).alias("kind")).mapInArrow(_feature_rows(chars), "feature long, kind long")
    tally = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long"))
    counts = save(
        seen.groupBy("feature")
        .agg(
            tally(2, 3).alias("bad"), tally(0, 1).alias("good"),
            tally(2).alias("bad_0"), tally(0).alias("good_0"), tally(3).alias("bad_1"), tally(1).alias("good_1"),
        )
        .where("bad > 0"),
        "features",
    )
    binned = None
    for f in (0, 1):
        half = Model(chars, *weighed(counts, f"bad_{f}", f"good_{f}", size(1, f), size(0, f)), NEVER)
        other = train.where(F.col("fold") != f).select("key", "text", "label")
        scored = other.select("key", "text").mapInArrow(_score_rows(half), "key long, evidence double, score double")
        rows = scored.join(other.select("key", "label"), "key").select(F.round("evidence", 2).alias("x"), "label")
        binned = rows if binned is None else binned.union(rows)
    bins = binned.groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "label").limit(100_000).collect()
    curve = isotonic(*(np.array([r[c] for r in bins], float) for c in ("x", "label", "n")))
    return Model(chars, *weighed(counts, "bad", "good", size(1, 0, 1), size(0, 0, 1)), curve)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising calibration curve: pooled adjacent violators, each pool smoothed by half a row of each label.

    A small share of the rank of x keeps the curve strictly rising, so that a pool's rows stay ordered.
    """
    pools: list[list[float]] = []  # positives, rows, least and largest x
    order = np.argsort(x, kind="stable")
    for a, b, c in zip(x[order], y[order], n[order]):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            positives, rows, _, largest = pools.pop()
            pools[-1] = [pools[-1][0] + positives, pools[-1][1] + rows, pools[-1][2], largest]
    at = np.array([e for p in pools for e in p[2:]])
    share = np.repeat([(p[0] + 0.5) / (p[1] + 1) for p in pools], 2)
    share = np.maximum.accumulate(share)
    knots = np.unique(np.concatenate([at, x]))
    rank = np.interp(knots, x[order], np.cumsum(n[order]) / n.sum())
    return knots, (1 - RANK) * np.interp(knots, at, share) + RANK * rank


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("key"), "text")
    out = rows.mapInArrow(_score_rows(model), "key long, evidence double, score double")
    return out.select(
        F.col("key").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence"
    ).select("doc_id", held_out(2, 4).alias("held_out"), "score", "predicted", "evidence")


def tolerable(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with all their columns.

    Only the text goes to Python and only the score comes back.
    """
    bounded_batches(documents.sparkSession)

    @F.arrow_udf("double")
    def probability(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for text in texts:
            found = [np.zeros(0)]
            for _, data, offsets in slices(text, text):
                data, offsets = restored(data, offsets, model.chars, known)
                found.append(np.interp(evidence(data, offsets, model.keys, model.weights), *model.curve))
            yield pa.array(np.concatenate(found))

    return documents.where(probability("text") < threshold)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(training(documents, labels, "toxic", 2, 4)))
