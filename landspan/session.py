"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "spark.landspan.scratch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PLANNING = threading.Lock()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, as on one
    machine, ``spark.landspan.scratch`` must name a folder that all executors see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH, None)
    if not root:
        raise ValueError(f"set spark.checkpoint.dir, or {SCRATCH} on one machine, to a folder that all executors see")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The data is on shared storage afterwards, so a lost executor costs a re-read
    and not a rerun of every earlier round.  The shuffle files that led to it go at once,
    and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return _last_read(df).checkpoint(eager=True)


def _last_read(df: DataFrame) -> DataFrame:
    """The same rows as a plan of its own, whose shuffle files go with the action that reads it."""
    conf = df.sparkSession.conf
    with _PLANNING:  # the setting counts when a plan is made, not when it runs
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            return df.select("*")
        finally:
            conf.set(CLEANUP, before)
