"""Language-model scores by a hierarchical Pitman-Yor process.

Words are drawn in restaurants.  The root restaurant serves every word; its base is
uniform over the training vocabulary and one unknown word.  Each training word is a
context with a restaurant of its own, which seats the words that follow it and orders new
dishes from the root, the parent that all contexts share.  So a context's tables are the
root's customers, beside a document's first word, which follows nothing.

Seating is sampled by Gibbs sweeps: given all other dishes' tables, the customers of a
dish are seated one after another, at an old table or a new one, by the Chinese-restaurant
rule.  A word's probability is averaged over the seatings of the sweeps after the first
``BURN_IN``.  Discounts come from the counts of counts.

Everything about one word, its dishes in all contexts and at the root, lies in one bucket
by the word's hash.  Counts are summed per chunk of documents before they travel, so a hot
word comes once per chunk and context.  Chunks are dealt to the buckets once, with each
distinct (context, word) pair once, and get its probability back; they add up the documents.

Totals per context are added up in the bucket of the context's own word.  A bucket asks
there once for all contexts of its dishes; between sweeps only the numbers of those
contexts travel whose tables can change.  The driver sees sums over everything.

Defined results: a null or empty text is one end token.  Rows without ``doc_id`` are
training rows (nothing holds them out) and are scored.  Repeated rows are counted as often
as they come and score alike.  Without training rows every probability is the base's.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.deobfuscate import held_out
from landspan.llm.store import bounded_batches, give_back, giving_back, save_dealt
from landspan.llm.text import hashes, mix, runs, slices, spans

SWEEPS, BURN_IN = 4, 2
#: Words of the documents that a chunk holds, about.
CHUNK_WORDS = 2 << 20
#: The end of a document, as a word's hash.
END = np.uint64(0x656E642E656E642E)
STRENGTH = 1.0
PSEUDO = 0.1
#: Customers seated one by one; beyond, so many at once as make up this share of those seated.
SINGLY, SHARE = 64, 16
SEED = 5


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all tokens in order, each row closed by its end."""
    starts, ends, row = spans(data, offsets)
    m = len(offsets) - 1
    h = np.concatenate([hashes(data, starts, ends), np.full(m, END)])
    row = np.concatenate([row, np.arange(m)])
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def pack(a: np.ndarray) -> bytes:
    """Compressed by planes: first the lowest byte of all values, then the next."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_rising(a: np.ndarray) -> bytes:
    """Sorted values by their steps."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_rising(b: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(b, kind), dtype=kind)


# ---- counts -------------------------------------------------------------------------


def _payloads(buckets: int, chunk_words: int):
    """Batches (doc_id, held, text) to one row per chunk and bucket.

    ``word`` and its ``pairs``, ``context``, ``seen``: the chunk's distinct pairs whose word is in
    the bucket, in that order, with their counts in training documents; a context is a place in
    ``follows``, or -1 for none.  ``docs``, ``doc``, ``times``: in how many documents each pair occurs, in
    which and how often.  One row of each chunk also lists its documents: ``ids``, ``held`` and
    ``sizes``.
    """

    def close(chunk: int, ids: list, held: list, sizes: list, words: list) -> pa.RecordBatch:
        held_, size = np.concatenate(held), np.concatenate(sizes)
        m = len(size)
        every = np.concatenate(words)
        words.clear()  # arrays as long as the chunk go as soon as they can
        vocab = np.unique(every)
        number = np.searchsorted(vocab, every).astype(np.int32)
        del every
        width = len(vocab) + 1
        before = np.append(np.int32(0), number[:-1] + 1)
        before[np.cumsum(size)[:-1]] = 0  # a document's first word follows nothing
        document = np.repeat(np.arange(m, dtype=np.int32), size)
        bucket = (mix(vocab) % np.uint64(buckets)).astype(np.int32)[number]
        order = np.argsort(bucket, kind="stable")
        begin = runs(bucket[order])
        rows = []
        for mine in np.split(order, begin[1:]):
            pairs, at = np.unique(number[mine].astype(np.int64) * width + before[mine], return_inverse=True)
            key, times = np.unique(at * m + document[mine], return_counts=True)
            pair, in_doc = key // m, (key % m).astype(np.int32)
            first = runs(pair)
            seen = np.add.reduceat(times * ~held_[in_doc], first)
            docs = np.diff(np.append(first, len(pair)))
            used, at = np.unique(pairs % width, return_inverse=True)
            after = used[:1] == 0  # 0 is no context
            different, each = np.unique(vocab[pairs // width], return_counts=True)
            rows.append(
                (
                    int(bucket[mine[0]]), chunk, pack_rising(different), pack(each.astype(np.int32)), pack((at - after.sum()).astype(np.int32)), pack_rising(vocab[used[after.sum() :] - 1]),
                    pack(seen.astype(np.int32)), pack(docs.astype(np.int32)), pack(in_doc), pack(times.astype(np.int32)), None, None, None,
                )
            )
        rows[0] = (*rows[0][:10], [x for part in ids for x in part], pack(held_.astype(np.uint8)), pack(size.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PAYLOAD)], schema=PAYLOAD)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids, held, sizes, words, total = [], [], [], [], 0
        for batch in batches:
            at = 0
            for part, data, offsets in slices(batch.column(0), batch.column(2)):
                m = len(part)
                row, h = tokens(data, offsets)
                ids.append(part.to_pylist())
                held.append(batch.column(1).slice(at, m).to_numpy(zero_copy_only=False).astype(bool))
                sizes.append(np.bincount(row, minlength=m))
                words.append(h)
                total += len(h)
                at += m
                if total >= chunk_words:
                    yield close(chunk, ids, held, sizes, words)
                    give_back()
                    ids, held, sizes, words, total, chunk = [], [], [], [], 0, chunk + 1
        if ids:
            yield close(chunk, ids, held, sizes, words)
            give_back()

    return work


PAYLOAD = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64())]
    + [(c, pa.binary()) for c in ("word", "pairs", "context", "follows", "seen", "docs", "doc", "times")]
    + [("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("sizes", pa.binary())]
)
PAYLOAD_DDL = (
    "bucket int, chunk long, word binary, pairs binary, context binary, follows binary, seen binary, docs binary, doc binary, times binary, "
    "ids array<long>, held binary, sizes binary"
)


def _words(word: bytes, pairs: bytes) -> np.ndarray:
    """The words of a payload row's pairs."""
    return np.repeat(unpack_rising(word, np.uint64), unpack(pairs, np.int32))


def _places(contexts: np.ndarray) -> Callable[[bytes, bytes], np.ndarray]:
    """A function from a payload row's ``context`` and ``follows`` to places in ``contexts``, -1 for none."""
    order = np.argsort(contexts)

    def places(context: bytes, follows: bytes) -> np.ndarray:
        at = order[np.searchsorted(contexts, unpack_rising(follows, np.uint64), sorter=order)]
        return np.append(at, -1)[unpack(context, np.int32)].astype(np.int32)  # -1 is the last

    return places


def _part(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each context's own word, where its totals are added up."""
    return (mix(contexts) % np.uint64(buckets)).astype(np.int32)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, seen) of all parts, each pair once, sorted."""
    word, context, seen = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.lexsort((context, word))
    word, context, seen = word[order], context[order], seen[order]
    del order
    if len(word):
        begin = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (context[1:] != context[:-1]))))
        word, context, seen = word[begin], context[begin], np.add.reduceat(seen, begin)
    return word, context, seen


def _bucket(buckets: int):
    """Payload rows of a bucket to its training pairs, sorted, and all its contexts by part and hash."""

    def work(rows: pa.Table) -> pa.Table:
        each = lambda *names: zip(*((x.as_py() for x in rows[c]) for c in names))  # noqa: E731  one row leaves Arrow memory at a time
        contexts, more = np.zeros(0, np.uint64), []
        for (follows,) in each("follows"):
            more.append(unpack_rising(follows, np.uint64))
            if sum(map(len, more)) > len(contexts):
                contexts, more = np.unique(np.concatenate([contexts, *more])), []
        contexts = np.unique(np.concatenate([contexts, *more]))
        contexts = contexts[np.argsort(_part(contexts, buckets), kind="stable")]
        places = _places(contexts)
        pairs, more = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)), []
        for w, n, c, f, s in each("word", "pairs", "context", "follows", "seen"):
            seen = unpack(s, np.int32).astype(np.int64)
            keep = seen > 0
            more.append((_words(w, n)[keep], places(c, f)[keep], seen[keep]))
            if sum(len(x[0]) for x in more) > len(pairs[0]):  # chunks repeat pairs, so not all are held at once
                pairs, more = _summed([pairs, *more]), []
        word, context, seen = _summed([pairs, *more])
        return pa.table(
            {
                "bucket": rows["bucket"].slice(0, 1),
                **{c: pa.array([x], pa.binary()) for c, x in zip(("word", "context", "customers", "contexts"), (pack_rising(word), pack(context), pack(seen), pack(contexts)))},
                **{c: pa.array([x], pa.int64()) for c, x in (("n_words", len(runs(word))), ("n_train", int(seen.sum())))},
            }
        )

    return giving_back(work)


DISHES = "bucket int, word binary, context binary, customers binary, contexts binary, n_words long, n_train long"


# ---- seating ------------------------------------------------------------------------


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers come one after another.

    ``new``: the weight of a new table, (strength + discount * all tables) * parent's
    probability.  The first customer opens a table.  Past ``SINGLY`` customers, groups that
    grow with those seated draw their new tables at once from the same odds.
    """
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        step = 1 if seated < SINGLY else seated // SHARE
        a, t = new[live], tables[live]
        p = a / (a + np.maximum(seated - discount * t, 1e-9))
        n = np.minimum(step, customers[live] - seated)
        tables[live] += rng.random(len(live)) < p if step == 1 else rng.binomial(n, p)
        seated += step
        live = live[customers[live] > seated]
    return np.minimum(tables, customers)


class Totals:
    """Sums over all buckets, one set per sweep: what a bucket must know of the others.

    Contexts are numbered as in the bucket.
    """

    def __init__(self, contexts: int, vocabulary: int):
        self.contexts, self.vocabulary = contexts, vocabulary
        self.guests = np.zeros(contexts)  # customers per context restaurant
        self.tables: list[np.ndarray] = []  # per sweep, per context restaurant
        self.root: list[tuple[float, float]] = []  # per sweep: the root's customers and tables
        self.discount, self.root_discount = 0.5, 0.5


def seatings(bucket: int, word: np.ndarray, context: np.ndarray, customers: np.ndarray, totals: Totals):
    """One (tables per dish, root customers per word, root tables per word) per sweep known so far, and one more.

    The first has a table per dish.  Each sweep draws from its own seed and the totals of the
    one before, so any task can replay them.
    """
    begin = runs(word)
    if not len(begin):
        for _ in range(len(totals.root) + 1):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return
    of_word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(word))))
    own = context >= 0
    tables = np.where(own, 1, customers)  # without a restaurant, every customer is the root's
    orders = np.add.reduceat(tables, begin)
    root = np.ones(len(begin), np.int64)
    yield tables, orders, root
    for sweep, (k, s) in enumerate(totals.root):
        rng = np.random.default_rng([SEED, sweep, bucket])
        parent = root_share(orders, root, k, s, totals)
        new = (STRENGTH + totals.discount * totals.tables[sweep][np.maximum(context, 0)]) * parent[of_word] if totals.contexts else parent[of_word]
        tables = np.where(own, seat(np.where(own, customers, 0), new, totals.discount, rng), customers)
        orders = np.add.reduceat(tables, begin)
        base = (STRENGTH + totals.root_discount * s) / (totals.vocabulary + 1)
        root = seat(orders, np.full(len(orders), base), totals.root_discount, rng)
        yield tables, orders, root


def root_share(orders, root, k: float, s: float, totals: Totals):
    """The root's probability of words with these customers and tables."""
    base = (STRENGTH + totals.root_discount * s) / (totals.vocabulary + 1)
    return (orders - totals.root_discount * root + base) / (STRENGTH + k)


@dataclass
class Sweeps:
    """Sums over everything: the root's customers and tables per sweep, and the discounts."""

    vocabulary: int
    root: list[tuple[float, float]] = field(default_factory=list)
    discount: float = 0.5
    root_discount: float = 0.5


def _history(r) -> list[np.ndarray]:
    """What a bucket was told so far: numbers of the contexts whose tables can change, customers, tables per sweep.

    The first sweep's tables are of all contexts, the others' of those that can change.
    """
    known = [unpack(x, np.int64) for x in (r.history if r.history is not None else [])]
    told = sorted(r.replies if r.replies is not None else [], key=lambda x: x["part"])
    column = lambda c: np.concatenate([unpack(x[c], np.int64) for x in told] or [np.zeros(0, np.int64)])
    if known:
        return [*known, column("tables")]
    number = np.concatenate([np.cumsum(unpack(x["number"], np.int64)) for x in told] or [np.zeros(0, np.int64)])
    guests, tables = column("guests"), column("tables")
    return [number[guests > tables], guests, tables]


def _local(history: list[np.ndarray], sweeps: Sweeps) -> Totals:
    """The totals of a bucket's contexts; contexts with one customer a dish keep their tables."""
    _, guests, first, *later = history
    totals = Totals(len(guests), sweeps.vocabulary)
    totals.guests, totals.root, totals.tables = guests.astype(float), sweeps.root, [first]
    totals.discount, totals.root_discount = sweeps.discount, sweeps.root_discount
    for values in later:
        totals.tables.append(first.copy())
        totals.tables[-1][guests > first] = values
    return totals


def _seat(sweeps: Sweeps, buckets: int):
    """Seat a bucket once more: one row of its state and sums, and one message to each part of its contexts."""

    def seat_one(r) -> pd.DataFrame:
        word, context, customers = unpack_rising(r.word, np.uint64), unpack(r.context, np.int32), unpack(r.customers, np.int64)
        contexts = unpack(r.contexts, np.uint64)
        first = not sweeps.root
        history = [] if first else _history(r)
        totals = Totals(len(contexts), sweeps.vocabulary) if first else _local(history, sweeps)
        for tables, orders, root in seatings(r.bucket, word, context, customers, totals):
            pass  # the last counts
        own = context >= 0
        add = lambda x: np.bincount(context[own], x[own], minlength=len(contexts)).astype(np.int64)
        laid, part = add(tables), _part(contexts, buckets)
        ones = [float(x) for n in (1, 2) for x in ((customers[own] == n).sum(), (orders == n).sum())]
        out = [(r.bucket, None, [pack(x) for x in history], None, None, None, float(orders.sum()), float(root.sum()), *ones)]
        if first:
            keys, guests = contexts, add(customers)
        else:
            live = history[1] > history[2]
            keys, laid, part, guests = history[0], laid[live], part[live], None
        begin = runs(part)
        for a, b in zip(begin, np.append(begin[1:], len(part))):
            key = keys[a:b] if first else np.diff(keys[a:b], prepend=0)
            out.append((r.bucket, int(part[a]), None, pack(key), pack(guests[a:b]) if first else None, pack(laid[a:b]), *[0.0] * 6))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEATED.split(", ")]).astype({"part": "Int32"})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield seat_one(r)
                give_back()

    return work


SEATED = (
    "bucket int, part int, history array<binary>, keys binary, guests binary, tables binary, "
    "customers_ double, tables_ double, ones double, root_ones double, twos double, root_twos double"
)


def _add_up(first: bool):
    """Messages of all buckets to one part, answered with the sums: numbers and customers at first, then tables."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        laid = [unpack(x, np.int64) for x in rows["tables"]]
        if first:
            keys = [unpack(x, np.uint64) for x in rows["keys"]]
            number = np.unique(np.concatenate(keys), return_inverse=True)[1]
            at = np.split(number, np.cumsum([len(k) for k in keys])[:-1])
        else:
            at = [np.cumsum(unpack(x, np.int64)) for x in rows["keys"]]
        every = np.concatenate(at)
        total = lambda x: np.bincount(every, np.concatenate(x)).astype(np.int64)  # noqa: E731  exact below 2^53
        tables = total(laid)
        out = {"bucket": rows["bucket"], "part": rows["part"], "number": None, "guests": None, "tables": [pack(tables[i]) for i in at]}
        if first:
            guests = total([unpack(x, np.int64) for x in rows["guests"]])
            out |= {"number": [pack(np.diff(i, prepend=0)) for i in at], "guests": [pack(guests[i]) for i in at]}
        return pd.DataFrame(out)

    return giving_back(work)


def seated(dishes: DataFrame, sweeps: Sweeps, n: int, buckets: int) -> DataFrame:
    """``dishes`` with each bucket's history and replies after a first seating and ``n`` sweeps."""
    told = dishes
    for sweep in range(n + 1):
        out = save_dealt(told.mapInPandas(_seat(sweeps, buckets), SEATED), "seats", "bucket", buckets)
        state = out.where("part IS NULL")
        sums = state.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("customers_", "tables_", "ones", "root_ones", "twos", "root_twos"))).first()
        sweeps.root.append((sums[0], sums[1]))
        if not sweep:
            share = lambda one, two: min(0.95, max(0.05, one / max(1.0, one + 2 * two)))
            sweeps.discount, sweeps.root_discount = share(sums[2], sums[4]), share(sums[3], sums[5])
        replies = (
            out.where("part IS NOT NULL").select("bucket", "part", "keys", "guests", "tables")
            .groupBy("part").applyInPandas(_add_up(not sweep), "bucket int, part int, number binary, guests binary, tables binary")
            .groupBy("bucket").agg(F.collect_list(F.struct("part", "number", "guests", "tables")).alias("replies"))
        )
        # dealt by bucket as the dishes are, so only the replies travel
        told = dishes.join(state.select("bucket", "history").hint("merge"), "bucket").join(replies.hint("merge"), "bucket", "left")
    return told


# ---- scores -------------------------------------------------------------------------


def _probabilities(bucket: int, dishes, totals: Totals, burn_in: int):
    """A function (word, context) -> (averaged probability, training count of the word)."""
    word, context, customers = dishes
    begin = runs(word)
    vocab = word[begin]
    count = np.add.reduceat(customers, begin) if len(begin) else np.zeros(0, np.int64)
    width = totals.contexts + 1
    key = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(word)))) * width + context + 1
    samples = islice(seatings(bucket, word, context, customers, totals), burn_in, len(totals.root))  # a later one has no totals yet
    samples = list(zip(samples, totals.root[burn_in:], totals.tables[burn_in:]))

    def ask(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(vocab, w), max(len(vocab) - 1, 0))
        known = vocab[at] == w if len(vocab) else np.zeros(len(w), bool)
        pick = lambda x: np.where(known, x[at], 0) if len(vocab) else np.zeros(len(w))
        wanted = np.where(known, at * width + c + 1, -1)
        dish = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        served = known & (key[dish] == wanted) if len(key) else known
        own, where = c >= 0, np.maximum(c, 0)
        p = np.zeros(len(w))
        for (tables, orders, root), (k, s), all_tables in samples:
            parent = root_share(pick(orders), pick(root), k, s, totals)
            if totals.contexts:
                here = np.where(served, (customers - totals.discount * tables)[dish], 0) if len(key) else 0
                mine = (here + (STRENGTH + totals.discount * all_tables[where]) * parent) / (STRENGTH + totals.guests[where])
                parent = np.where(own, mine, parent)
            p += parent / len(samples)
        return p, pick(count).astype(np.int64)

    return ask


def _answers(sweeps: Sweeps, n_train: int, burn_in: int):
    """Payload rows of a bucket, and its dishes with what it was told, to sums per document of its chunks."""

    def work(rows: pa.Table, told: pa.Table) -> pa.Table:
        mine = SimpleNamespace(**told.to_pylist()[0])
        dishes = unpack_rising(mine.word, np.uint64), unpack(mine.context, np.int32), unpack(mine.customers, np.int64)
        ask = _probabilities(mine.bucket, dishes, _local(_history(mine), sweeps), burn_in)
        places = _places(unpack(mine.contexts, np.uint64))
        out = []
        for i in range(rows.num_rows):  # one row's pairs at a time leave Arrow memory
            r = {c: rows[c][i].as_py() for c in ("word", "pairs", "context", "follows", "docs", "doc", "times")}
            p, c = ask(_words(r["word"], r["pairs"]), places(r["context"], r["follows"]))
            base = np.log10((c + PSEUDO) / (n_train + PSEUDO * (sweeps.vocabulary + 1)))
            docs, doc, times = unpack(r["docs"], np.int32), unpack(r["doc"], np.int32), unpack(r["times"], np.int32)
            seen, at = np.unique(doc, return_inverse=True)
            add = lambda x: pack(np.bincount(at, np.repeat(x, docs) * times, minlength=len(seen)))
            out.append((pack(seen.astype(np.int32)), add(np.log10(p)), add(base), add(c > 0)))
        sums = [pa.array(list(x), pa.binary()) for x in zip(*out)] or [pa.array([], pa.binary())] * 4
        passed = {c: rows[c] for c in ("chunk", "ids", "held", "sizes")}
        return pa.table(passed | dict(zip(("doc", "score", "base", "known"), sums)))

    return giving_back(work)


def _documents(rows: pd.DataFrame) -> pd.DataFrame:
    """The answers of all buckets to one chunk, added up per document."""
    lists = rows[rows["ids"].notna()].iloc[0]
    size = unpack(lists["sizes"], np.int64)
    sums = {c: np.zeros(len(size)) for c in ("score", "base", "known")}
    for r in rows.itertuples(index=False):
        doc = unpack(r.doc, np.int32)
        for c in sums:
            sums[c][doc] += unpack(getattr(r, c), np.float64)
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in lists["ids"]], "Int64"),
            "held_out": unpack(lists["held"], np.uint8).astype(bool),
            "n_tokens": size,
            "n_known": np.rint(sums["known"]).astype(np.int64),
            "base_score": sums["base"],
            "score": sums["score"],
        }
    )


def score(documents: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(0, 10).alias("held"), "text")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = docs.mapInArrow(_payloads(buckets, chunk_words), PAYLOAD_DDL).repartition(buckets, "bucket")
    pairs = save_dealt(pairs, "pairs", "bucket", buckets)
    dishes = pairs.select("bucket", "word", "pairs", "context", "follows", "seen").groupBy("bucket").applyInArrow(_bucket(buckets), DISHES)
    dishes = save_dealt(dishes, "dishes", "bucket", buckets)
    n_words, n_train = dishes.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_train"))).first()
    shared = Sweeps(n_words)
    told = seated(dishes, shared, sweeps, buckets)
    answers = pairs.drop("seen").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(
        _answers(shared, n_train, burn_in),
        "chunk long, doc binary, score binary, base binary, known binary, ids array<long>, held binary, sizes binary",
    )
    out = answers.groupBy("chunk").applyInPandas(
        _documents, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
