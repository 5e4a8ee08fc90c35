"""The paint log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landspan.plans import scenario

EVENT_SCHEMA = (
    "event_id bigint, scenario_id bigint, feature_id bigint, column_name string, "
    "old_value double, new_value double, op string, batch_id bigint, painted_at timestamp"
)


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Append-only folder of paint events."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


LAST = ["painted_at", "event_id"]
#: The state lives on disk, and its files hold what is in them.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def continuous_overlay(events: DataFrame, checkpoint: str) -> StreamingQuery:
    """STR01: keep the last event of every cell as keyed state, without expiry.

    A micro batch touches the cells it paints and no others; an older event that arrives
    late loses against the newer one in the state.  The state's own log makes restarts
    exact.  ``read_overlay`` reads the state as a table; there is no second copy.
    """
    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        last = F.max_by(F.struct("new_value", "op"), F.struct(*LAST))
        cells = events.where(F.col("column_name").isin(list(scenario.PAINTABLE))).groupBy(*scenario.KEY).agg(last.alias("e"))
        # the running query keeps the settings that it started with
        return (
            cells.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_overlay(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The overlay that ``continuous_overlay`` has left: cells with a painted value."""
    state = spark.read.format("statestore").load(checkpoint)
    keys = state.schema["key"].dataType.fieldNames()
    event = state.schema["value"].dataType.fieldNames()[0]  # of the value and what it was chosen by
    t = state.select(*[F.col("key")[k].alias(n) for k, n in zip(keys, scenario.KEY)], F.col("value")[event].alias("e"))
    return t.where((F.col("e.op") != "clear") & F.col("e.new_value").isNotNull()).select(
        *scenario.KEY, F.col("e.new_value").alias("painted_value")
    )


def screen(events: DataFrame, rules: DataFrame) -> DataFrame:
    """STR02: violations of incoming edits (stream-static join with the rules)."""
    edits = events.where("op = 'paint'").withColumn("painted_value", F.col("new_value"))
    return scenario.violations(edits, rules)


def screened_sinks(events: DataFrame, rules: DataFrame, blocked: str, warned: str, checkpoint: str) -> StreamingQuery:
    """STR02: blocking and warning violations into two tables from one pass."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        found = screen(batch, rules).withColumn("micro_batch", F.lit(batch_id))
        for severity, path in (("block", blocked), ("warn", warned)):
            # a repeated batch replaces its own partition
            found.where(F.col("severity") == severity).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("micro_batch").parquet(path)

    return (
        events.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """STR03: edits per scenario and time bucket; later events than ``late`` are dropped."""
    return (
        events.withWatermark("painted_at", late)
        .groupBy("scenario_id", F.window("painted_at", width).alias("w"))
        .agg(F.count("*").alias("edits"), F.approx_count_distinct("batch_id").alias("batches"))
        .select("scenario_id", F.col("w.start").alias("bucket"), "edits", "batches")
    )


def write_activity(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """STR03 appended once a bucket is closed by the watermark."""
    return (
        activity(events)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
