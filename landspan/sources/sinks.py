"""Writers: full tables, upserts, partitioned tables, packets."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.operators.ranking import first_per
from landspan.session import cut


def replace(df: DataFrame, path: str) -> DataFrame:
    """SNK01: replace a whole table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def view(df: DataFrame, name: str) -> DataFrame:
    """SNK02."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path holds anything, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


BUCKET = "_bucket_of_"
#: Rows that one bucket holds, about; a table with more times as many is dealt anew.
BUCKET_ROWS, GROWN = 250_000, 4


def upsert(new: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str] = (), rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """SNK03: replace rows by unique key, add the others.

    The table is partitioned by a hash bucket of the key, and the partition column's name
    keeps their number.  Buckets hold about ``rows_per_bucket`` rows; once they hold
    ``GROWN`` times as many on average, the table is dealt into more of them, which costs a
    rewrite each time the table has grown so much.  Otherwise only buckets that the
    new rows fall into are read and rewritten (dynamic partition overwrite swaps them in
    on commit), so the cost follows the new rows and not the table.  Of new rows with one
    key the last by ``newest`` counts, by all their columns where that is not given.
    """
    spark = new.sparkSession
    order = list(newest) or [n for n, t in new.dtypes if n not in keys and "map<" not in t]
    new = first_per(new, list(keys), [F.desc(c) for c in order] or [F.lit(0)])
    old = spark.read.parquet(path) if exists(spark, path) else None
    if old is None:
        buckets = max(1, -(-new.count() // rows_per_bucket))
        column = f"{BUCKET}{buckets}"
    else:
        column = next(c for c in old.columns if c.startswith(BUCKET))
        buckets = int(column.removeprefix(BUCKET))
    new = cut(new.withColumn(column, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    rows = new
    if old is not None:
        # at most one number per bucket reaches the driver; the scan then skips the other folders
        touched = [r[0] for r in new.select(column).distinct().collect()]
        kept = old.where(F.col(column).isin(touched)).join(new.select(*keys), list(keys), "left_anti")
        rows = kept.unionByName(new, allowMissingColumns=True)
    (
        rows.repartition(column)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )
    table = spark.read.parquet(path).drop(column)
    n = table.count()  # of the files' footers
    if n <= GROWN * rows_per_bucket * buckets:
        return table
    more = f"{BUCKET}{-(-n // rows_per_bucket)}"
    whole = cut(table).withColumn(more, F.pmod(F.xxhash64(*keys), F.lit(-(-n // rows_per_bucket))).cast("int"))
    whole.repartition(more).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(more).parquet(path)
    return spark.read.parquet(path).drop(more)


DEFAULT_PART = "default"


def list_partitioned(df: DataFrame, path: str, column: str, values: Sequence[str]) -> DataFrame:
    """SNK04: one partition per listed value, all others in the default partition.

    The column itself stays in the data; readers filter on ``part`` to prune.
    """
    part = F.when(F.col(column).isin(list(values)), F.col(column)).otherwise(DEFAULT_PART)
    df.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(path)
    return df.sparkSession.read.parquet(path)


def land(df: DataFrame, path: str, disposition: str, primary_key: Sequence[str] = ()) -> DataFrame:
    """SNK05: ``replace`` or ``append``; rows of one load are unique by primary key."""
    if disposition not in ("replace", "append"):
        raise ValueError(f"unknown disposition: {disposition}")
    if primary_key:
        df = df.dropDuplicates(list(primary_key))
    df.write.mode("overwrite" if disposition == "replace" else "append").parquet(path)
    return df.sparkSession.read.parquet(path)


def story_packet(spark: SparkSession, path: str, tables: Mapping[str, DataFrame | None], metadata: Mapping) -> list[str]:
    """SNK06: one CSV folder per non-empty table and a metadata JSON file."""
    written = []
    for name, df in tables.items():
        if df is None or df.isEmpty():
            continue
        df.write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)
        written.append(name)
    text = json.dumps({**metadata, "tables": written}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/metadata.json")
    return written


# Rate columns that are never NULL in an exported built-form table.
ZERO_RATES = (
    "du_per_acre", "emp_per_acre", "far", "indoor_water_rate", "outdoor_water_rate",
    "irrigable_area_fraction", "building_coverage", "electricity_eui", "gas_eui", "trip_rate_override",
)


def built_form_export(types: DataFrame, names: Mapping[str, str | Column]) -> DataFrame:
    """SNK07: project and rename; rates default to 0."""
    cols = {k: v if isinstance(v, Column) else F.col(v) for k, v in names.items()}
    return types.select(
        [
            (F.coalesce(v, F.lit(0.0)) if k in ZERO_RATES else v).alias(k)
            for k, v in cols.items()
        ]
    )
