"""Hard negatives by Strassen products of anchor and candidate tiles.

Components become integers, ``floor(256 x)``, and the scores of a block of anchors against
a tile of candidates are one integer matrix product, computed by Strassen's recursion: odd
sides are padded with a row or column of zeros, seven products of half the sides replace
eight, and sides of ``LEAF`` or less are multiplied plainly.  Sums and products of int64
form a ring, so a score that fits 64 bits is exact whatever the sums in between do.

Two passes over the candidates follow.  The first keeps, per task and anchor, a heap of
the best rows of the anchor's label; heaps of all tasks merge into the anchor's positives.
The second keeps a heap per anchor and positive of the best rows of another label inside
the positive's window of scores; these merge into the negatives.  A heap holds as many
rows as the answer, whatever the number of candidates, so a label or a group of equal
vectors may hold any share of all rows.

Anchors are dealt into blocks of about ``BLOCK`` rows at most; each block is fetched once
and sent to the tasks that scan the candidates, which never move.  The work is the number
of anchors times the number of rows, as an exact search demands.

Defined results: rows with a null label, a null vector or a null or non-finite component
take no part.  A vector that is shorter than another ends in zeros; an empty one scores 0.
Components beyond 64 bits are held at their ends, and sums beyond wrap.  Rows without id
are candidates, last among equal scores, and never anchors.  Repeated rows are rows of
their own: a copy of an anchor may be its positive, and its answer comes once for each copy.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landspan.llm.store import bounded_batches, save

#: Anchors of a block, candidates of a tile, and sides that are multiplied plainly.
BLOCK, TILE, LEAF = 8_192, 1_024, 32
#: Cells of a product that are held at once.
CELLS = 1 << 20
NO_ID = np.iinfo(np.int64).max


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Strassen product of two int64 matrices, modulo 2**64."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    odd = n % 2, k % 2, m % 2
    if any(odd):
        a = np.pad(a, ((0, odd[0]), (0, odd[1])))
        b = np.pad(b, ((0, odd[1]), (0, odd[2])))
    i, j, l = (x // 2 for x in (*a.shape, b.shape[1]))  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((a.shape[0], b.shape[1]), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """The best ``k`` rows of every group: higher scores first, then smaller ids; heaps merge by adding their rows."""

    def __init__(self, k: int):
        self.k = k
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(3))  # group, score, id

    def add(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        group, score, key = (np.concatenate(x) for x in zip(self.rows, (group, score, key)))
        order = np.lexsort((key, -score, group))
        group = group[order]
        first = np.searchsorted(group, group, "left")
        kept = np.arange(len(group)) - first < self.k
        self.rows = group[kept], score[order][kept], key[order][kept]


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that hold the ``k`` largest allowed scores of each row, ties at the end included."""
    lowest = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, lowest)
    at = masked.shape[1] - k
    least = np.partition(masked, at, axis=1)[:, at] if at > 0 else np.full(len(masked), lowest)
    return np.nonzero(allowed & (masked >= least[:, None]))


def prepared(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, codes of the rows that take part."""
    fits = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(9.2e18)), F.lit(-9.2e18))))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    key, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return (
        embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select(
            F.monotonically_increasing_id().alias("row"),
            key.alias("vec_id"),
            F.when(key % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            fits.alias("codes"),
        )
    )


def matrix(codes: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of integers as rows, padded with zeros to the longest, ``width`` at least."""
    codes = codes.cast(pa.large_list(pa.int64()))
    offsets = np.asarray(codes.offsets)
    lengths = np.diff(offsets)
    values = np.asarray(codes.values)[offsets[0] : offsets[-1]] if len(codes) else np.zeros(0, np.int64)
    out = np.zeros((len(codes), max([width, *lengths.tolist()])), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


@dataclass
class Anchors:
    """A block of anchors: what a task needs of them."""

    row: np.ndarray
    label: np.ndarray
    codes: np.ndarray

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First anchor, scores, and rows, ids and labels of the candidates of each pair of tiles."""
        row, key, label = (np.asarray(batch.column(i).fill_null(NO_ID)) for i in range(3))
        codes = matrix(batch.column(3), self.codes.shape[1])
        own = np.pad(self.codes, ((0, 0), (0, codes.shape[1] - self.codes.shape[1])))
        step = max(1, CELLS // TILE)
        for at in range(0, len(row), TILE):
            part = slice(at, at + TILE)
            tile = np.ascontiguousarray(codes[part].T)
            for first in range(0, len(own), step):
                yield first, product(own[first : first + step], tile), row[part], key[part], label[part]


def _positive_rows(anchors: Anchors, k: int):
    def work(batches: Iterator[pa.RecordBatch]):
        heaps = Heaps(k)
        for batch in batches:
            for first, scores, row, key, label in anchors.tiles(batch):
                own = slice(first, first + len(scores))
                same = (anchors.label[own, None] == label) & (anchors.row[own, None] != row)
                i, j = best(scores, same, k)
                heaps.add(i + first, scores[i, j], key[j])
        yield _rows(heaps, "anchor")

    return work


def _rows(heaps: Heaps, name: str) -> pa.RecordBatch:
    group, score, key = heaps.rows
    return pa.RecordBatch.from_arrays([pa.array(group), pa.array(score), pa.array(key, mask=key == NO_ID)], [name, "score", "key"])


def _negative_rows(anchors: Anchors, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """``anchor``, ``low``, ``high``: of every positive, sorted by anchor."""

    def work(batches: Iterator[pa.RecordBatch]):
        heaps = Heaps(k)
        for batch in batches:
            for first, scores, _, key, label in anchors.tiles(batch):
                a, b = np.searchsorted(anchor, [first, first + len(scores)])
                for at in range(a, b, max(1, CELLS // TILE)):
                    part = slice(at, min(b, at + max(1, CELLS // TILE)))
                    own = scores[anchor[part] - first]
                    inside = (anchors.label[anchor[part], None] != label) & (own >= low[part, None]) & (own <= high[part, None])
                    i, j = best(own, inside, k)
                    heaps.add(i + at, own[i, j], key[j])
        yield _rows(heaps, "pair")

    return work


def merged(heaps: DataFrame, group: str, k: int) -> DataFrame:
    """The heaps of all tasks as one of ``k`` rows per group, with ``rank`` from 1: first some tasks' heaps, then those."""
    order = [F.desc("score"), F.asc_nulls_last("key")]
    some = heaps.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(group, "some").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("some").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def window(positive: np.ndarray, least: int = 3, most: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score in tenths of the positive's, without overflow: rounded up, and down."""
    q, r = np.divmod(positive, 10)
    return least * q - (-least * r) // 10, most * q + (most * r) // 10


def mine(embeddings: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = save(prepared(embeddings), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-anchors.count() // block))
    out = None
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow().combine_chunks()
        held = Anchors(np.asarray(own["row"]), np.asarray(own["label"]), matrix(own["codes"].combine_chunks()))
        ids = np.asarray(own["vec_id"])
        found = rows.select("row", "vec_id", "label", "codes").mapInArrow(_positive_rows(held, positives), "anchor long, score long, key long")
        found = merged(found, "anchor", positives).orderBy("anchor", "rank").toArrow()  # a few rows per anchor of the block
        anchor, score = np.asarray(found["anchor"]), np.asarray(found["score"])
        low, high = window(score)
        pairs = pa.table({"pair": pa.array(np.arange(len(anchor))), "anchor_id": pa.array(ids[anchor], pa.int64()), "positive_id": found["key"], "positive_score": found["score"]})
        heaps = rows.select("row", "vec_id", "label", "codes").mapInArrow(_negative_rows(held, anchor, low, high, negatives), "pair long, score long, key long")
        mined = merged(heaps, "pair", negatives).join(spark.createDataFrame(pairs), "pair").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        if blocks > 1:
            mined = save(mined, "mined")
        out = mined if out is None else out.union(mined)
    return out
