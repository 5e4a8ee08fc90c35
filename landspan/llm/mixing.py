"""Mixing sources to target weights in packed blocks.

Each source's documents are laid end to end and cut into blocks of equal length.  Output
shards of a fixed number of slots draw how many slots each source gets: the whole part of
its share outright, the rest by a multinomial draw seeded with the shard's number.  A
source's slots, numbered through all shards, are mapped to blocks by one pseudorandom
permutation of its block numbers per epoch (the swap-or-not shuffle), so a block is taken
again only when all have been taken as often.  Slots and blocks are joined by number.

Nothing runs over a whole source in one task: running sums are taken in buckets of about
``BUCKET_ROWS`` rows, then over the buckets' totals.  The driver holds one number per
source and refuses more than ``MOST_SOURCES`` of them.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source
of its own, after all others; a source without words has target 0.  Rows that repeat a
doc_id, or have none, are packed and counted each for itself.  An empty table gives an
empty mix.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landspan.llm.store import save
from landspan.llm.text import mix as spread

BLOCK_WORDS = 128
SHARD_SLOTS = 8192
MOST_REPEATS = 3
BUCKET_ROWS = 8192
MOST_SOURCES = 1_000_000
ROUNDS = 40
SEED = 11


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, number, source_size, target, from ``source`` and ``size`` of the documents.

    Sources weigh 1, 2, 3, repeating, in order of their names' code points, null last, and
    share all words by weight.  A source that would get over three times its size gets that
    and leaves the rest to the others, until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = save(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(order) - 1)
        .withColumn("weight", (F.col("number") % 3 + 1).cast("double"))
        .withColumn("most", F.col("source_size") * float(MOST_REPEATS)),
        "sources",
    )
    level = 0.0
    while True:
        # what a unit of weight gets once the sources that stop at ``level`` have stopped
        stops = F.col("most") <= F.col("weight") * F.lit(level)
        free, left, total = src.agg(
            F.sum(F.when(~stops, F.col("weight"))), F.sum(F.when(stops, F.col("most"))), F.sum("source_size")
        ).first()
        now = (total - (left or 0.0)) / free if free else level
        if now <= level:
            break
        level = now
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return src.select("source", "number", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def running(rows: DataFrame, key: str, value: str, bucket: str, order: list[str], out: str) -> DataFrame:
    """``out``: the sum of ``value`` over earlier rows with the same key, by bucket and then ``order``."""
    totals = rows.groupBy(key, bucket).agg(F.sum(value).alias("_total"))
    before = totals.select(
        key, bucket, (F.sum("_total").over(Window.partitionBy(key).orderBy(bucket)) - F.col("_total")).alias("_before")
    )
    inner = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_here", F.sum(value).over(inner) - F.col(value))
        .join(before, [key, bucket])
        .withColumn(out, F.col("_before") + F.col("_here"))
        .drop("_before", "_here")
    )


def segments(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """number, block, row, start, words: which words of which row make up each block of a source."""
    counts = sized.groupBy("number").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("buckets"))
    rows = (
        sized.where("size > 0")
        .join(F.broadcast(counts), "number")  # a row per source; a shuffle by source would be as uneven as they are
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "digest"), F.col("buckets")).cast("int"))
    )
    laid = running(rows, "number", "size", "bucket", ["doc_id", "digest", "row"], "begin")
    length = F.lit(block_words).cast("long")
    first, last = F.floor(F.col("begin") / length), F.floor((F.col("begin") + F.col("size") - 1) / length)
    cut = laid.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0), F.col("block") * length - F.col("begin"))
    end = F.least(F.col("size"), (F.col("block") + 1) * length - F.col("begin"))
    return cut.select("number", "block", "row", start.alias("start"), (end - start).alias("words"))


def draws(spark, shares: list[float], shards: int, slots: int, shard_slots: int) -> DataFrame:
    """shard, number, count: the slots that each shard draws for each source."""
    share = np.asarray(shares, float)
    share = share / share.sum()

    def draw(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                n = min(shard_slots, slots - int(shard) * shard_slots)
                whole = np.floor(share * n + 1e-9).astype(np.int64)
                rest, left = np.maximum(share * n - whole, 0), n - int(whole.sum())
                if left > 0:
                    p = rest / rest.sum() if rest.sum() > 0 else share
                    whole = whole + np.random.default_rng([SEED, int(shard)]).multinomial(left, p)
                got = np.flatnonzero(whole)
                yield pd.DataFrame({"shard": np.int64(shard), "number": got.astype(np.int32), "count": whole[got]})

    return spark.range(shards).mapInPandas(draw, "shard long, number int, count long")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 sends ``index``: the swap-or-not shuffle, row by row."""
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), spread(key.astype(np.uint64))
    for r in range(rounds):
        salt = spread(key + np.uint64(2 * r + 1))
        partner = (salt % n + n - x) % n
        high = np.maximum(x, partner)
        swap = spread(high ^ spread(salt + np.uint64(0x5851F42D4C957F2D))) & np.uint64(1) == 1
        x = np.where(swap, partner, x)
    return x.astype(np.int64)


def permute(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), n.to_numpy(), key.to_numpy()))


def slots(src: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, number, block: the block that fills each slot."""
    blocks = F.ceil(F.col("source_size") / block_words)
    # slots whose words add up to the target when all blocks, the short last one too, are equally likely
    want = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)
    src = src.select("number", blocks.alias("blocks"), want.alias("want"))
    shares = [r["want"] for r in src.orderBy("number").collect()]
    total = round(sum(shares))
    if not total:
        return src.sparkSession.createDataFrame([], "shard long, number int, block long")
    shards = -(-total // shard_slots)
    drawn = draws(src.sparkSession, shares, shards, total, shard_slots).withColumn(
        "bucket", F.floor(F.col("shard") / BUCKET_ROWS).cast("int")
    )
    drawn = running(save(drawn, "draws"), "number", "count", "bucket", ["shard"], "begin")
    each = drawn.join(src, "number").select(
        "shard", "number", "blocks", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("count") - 1)).alias("slot")
    )
    # a draw above a source's share must not make a block come once too often
    each = each.where(F.col("slot") < F.col("blocks") * MOST_REPEATS)
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    key = F.xxhash64(F.lit(SEED), "number", epoch)
    return each.select("shard", "number", F.pandas_udf(permute, T.LongType())(F.col("slot") % F.col("blocks"), "blocks", key).alias("block"))


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, plan, segments): the sized rows with their targets; which block fills which slot; what blocks hold."""
    # places follow from id and text alone; the row's number only joins, and tells equal rows apart
    sized = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    rows = save(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    src = save(targets(rows), "targets")
    if (n := src.count()) > MOST_SOURCES:
        raise ValueError(f"{n} sources; at most {MOST_SOURCES} fit the driver and a broadcast")
    rows = rows.join(F.broadcast(src), rows["source"].eqNullSafe(src["source"])).drop(src["source"])
    return rows, slots(src, block_words, shard_slots), segments(rows, block_words)


def taken(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Per document row: doc_id, size, source_size, target of its source, words that the mix takes of it."""
    rows, plan, parts = mix(documents, block_words, shard_slots)
    times = plan.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    got = parts.join(times, ["number", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(got, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
