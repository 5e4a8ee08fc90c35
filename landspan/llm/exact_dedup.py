"""Exact duplicates by a stateful stream.

A Structured Streaming aggregation keeps, in RocksDB on disk and without expiry, one
entry per digest: how often it came, the largest document id and where that document's
content lies.  State survives restarts in the shared checkpoint folder, so documents
that arrive later are held against all earlier ones.  The state is then read back as a
table; every hit (a document whose digest another one holds) is compared byte for byte
with the content that the state points to, and texts that share a digest but differ are
told apart by their whole text.

Defined results: a null text counts as empty, and all empty texts are one group.  A row
without ``doc_id`` is compared and counted, but stays only where no row of its group has
an id.  Rows that repeat one id and text count as copies and share the flag ``kept``.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.llm.store import save
from landspan.llm.text import fold
from landspan.session import scratch_path

#: Copies compared with one copy of the kept text; larger groups are salted.
SALT_ROWS = 2000
#: Digests that more than one document has, sent to every task up to this many, shuffled beyond.
FEW_DIGESTS = 200_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each small store claims megabytes of disk ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(folded: Column) -> Column:
    return F.sha2(folded, 256)


def remember(stream: DataFrame, checkpoint: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Run the stream over all that is there and leave the state in ``checkpoint``.

    ``stream`` has ``doc_id``, ``text`` and ``locator`` (where the content lies).  Called
    again with the same checkpoint, it goes on from the state that it left.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        keyed = stream.select(digest(fold(F.col("text"))).alias("digest"), "doc_id", "locator")
        seen = keyed.groupBy("digest").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "locator")).alias("keep")
        )
        query = (
            seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def memory(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, group_size, keep_id, locator."""
    state = spark.read.format("statestore").load(checkpoint)
    (key,), (size, keep) = (state.schema[c].dataType.fieldNames() for c in ("key", "value"))
    return state.select(
        F.col(f"key.{key}").alias("digest"),
        F.col(f"value.{size}").alias("group_size"),
        F.col(f"value.{keep}.doc_id").alias("keep_id"),
        F.col(f"value.{keep}.locator").alias("locator"),
    )


def collisions(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Digests whose documents are not all byte for byte equal to the kept one.

    ``docs``: doc_id, digest, body.  Large groups are salted, with the kept text once per salt.
    """
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    shared = state.where("group_size > 1").select("digest", "group_size", "keep_id")
    held = docs.join(F.broadcast(shared) if shared.count() <= FEW_DIGESTS else shared, "digest")
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = (
        held.where(is_kept)
        .groupBy("digest", "group_size")
        .agg(F.min("body").alias("kept_body"))
        .select("digest", "kept_body", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    )
    hits = held.select("digest", "body", F.pmod(F.xxhash64("doc_id", "body"), salts).cast("int").alias("salt"))
    return hits.join(kept, ["digest", "salt"]).where("body <> kept_body").select("digest").distinct()


def settle(documents: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``documents``."""
    body = fold(F.col("text"))
    docs = documents.select("doc_id", digest(body).alias("digest"), body.alias("body"))
    state = save(state, "digests")
    differ = save(collisions(docs, state), "collisions")
    groups = docs.select("doc_id", "digest", F.sha2("body", 256).alias("text_sha256")).join(
        state.select("digest", "group_size", "keep_id"), "digest", "left"
    )
    if not differ.isEmpty():
        shared = docs.join(differ, "digest")
        exact = shared.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        apart = shared.join(exact, ["digest", "body"]).select(
            "digest", "doc_id", F.sha2("body", 256).alias("text_sha256"), "group_size", "keep_id"
        )
        groups = groups.join(differ, "digest", "left_anti").unionByName(apart)
    return groups.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def dedup(spark: SparkSession, path: str, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Stream the Parquet table at ``path`` into fresh state, then settle its rows."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    stream = (
        spark.readStream.schema(schema)
        .option("maxBytesPerTrigger", bytes_per_batch)
        .parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, one file will do as well as a folder
        .select("doc_id", "text", F.col("_metadata.file_path").alias("locator"))
    )
    checkpoint = scratch_path(spark, "seen")
    remember(stream, checkpoint)
    return settle(spark.read.parquet(path).select("doc_id", "text"), memory(spark, checkpoint))
