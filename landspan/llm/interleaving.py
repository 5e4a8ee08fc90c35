"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; row ``r`` (from 0) of a
source of ``n`` rows gets the fractional rank ``(2r + 1) / 2n``.  Sorted by it, the sources
interleave in proportion, and any run of consecutive places holds each source's share to
within a row or two.  The places are cut into shards whose counts differ by one at most.

Both rankings are two-level: rows fall into cells, by the leading bits of the shuffle hash
or by the fractional rank, which both spread evenly whatever the sources; the cells' counts
are summed up, and each cell is numbered on its own.  A source with a third of all rows
spans all cells.  The text is read once, for its size and checksum; only these, the
source and the hash travel.

Defined results: a null text has size 1 and the checksum of no bytes.  Rows without source
are a source of their own; rows without id are shuffled like others.  Repeated rows fill
places of their own.  A source with fewer rows than shards misses some shards.  Where the
table has fewer rows than there are shards, some stay empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.llm.store import save

SHARDS, SEED = 16, 13
#: Bits of the shuffle hash, bits that make a cell at least, and rows of a cell aimed at.
BITS, LEAST_BITS, CELL_ROWS = 60, 8, 1 << 16


def shuffled(seed: int, *parts: Column) -> Column:
    """The leading bits of a hash of the seed and the parts, as a number."""
    named = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def numbered(rows: DataFrame, groups: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number (from 0) in each group, by cell and then ``order``; and ``<name>_of``, the group's rows."""
    counts = save(rows.groupBy(*groups, cell).agg(F.count(F.lit(1)).alias("in_cell")), "cells")
    # one row per group and cell is left here
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    before = F.sum("in_cell").over(whole.orderBy(cell)) - F.col("in_cell")
    counts = counts.select(*groups, cell, before.alias("before"), F.sum("in_cell").over(whole).alias(f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy(*groups, cell).orderBy(*order))
    rows = rows.withColumn("inside", inside).join(counts, [*groups, cell])
    return rows.withColumn(name, F.col("before") + F.col("inside") - 1).drop("before", "inside", cell)


def interleaved(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``place``, ``shard`` and ``slot`` of rows with ``stratum`` (not null) and ``shuffle``; the columns named ``tie*`` settle equal hashes."""
    ties = sorted(c for c in rows.columns if c.startswith("tie"))
    rows = save(rows, "strata")
    n = rows.count()
    bits = min(BITS, max(LEAST_BITS, (n // CELL_ROWS).bit_length()))
    ranked = numbered(rows.withColumn("cell", F.shiftright("shuffle", BITS - bits)), ["stratum"], "cell", ["shuffle", *ties], "rank")
    ranked = ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("rank_of")))
    ranked = save(ranked.withColumn("cell", F.floor(F.col("fraction") * (1 << bits))), "ranked")
    placed = numbered(ranked, [], "cell", ["fraction", "stratum"], "place")
    first = F.expr(f"(shard * place_of + {shards - 1}) div {shards}")
    return placed.withColumn("shard", F.expr(f"cast((place * {shards}) div place_of as int)")).withColumn("slot", F.col("place") - first)


def described(documents: DataFrame, seed: int = SEED, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, stratum, shuffle of every document, the order of ties, and ``more``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long"))
    stratum = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    key = F.col("doc_id").cast("long")
    return documents.select(
        key.alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), stratum.alias("stratum"),
        shuffled(seed, key).alias("shuffle"), key.alias("tie_1"), size.alias("tie_2"), crc.alias("tie_3"), *more,
    )


def shard(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    return interleaved(described(documents, seed), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, files: int = 1) -> None:
    """The documents with all their columns, in a folder ``_shard=N`` per shard and about ``files`` files in each, by slot.

    Here the texts travel with their places, once per step.
    """
    whole = F.struct(*(F.col(c) for c in documents.columns)).alias("document")
    placed = interleaved(described(documents, seed, whole), shards).repartitionByRange(shards * files, "place")
    out = placed.sortWithinPartitions("place").select("document.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out.write.partitionBy("_shard").parquet(path)
