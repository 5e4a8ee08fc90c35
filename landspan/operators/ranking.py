"""Ranks, quantiles, modes and top rows that stay distributed under hot keys.

An unpartitioned window sorts the whole table in one task, and a window over a
hot key sorts that key in one task.  The operators here first collapse the table
to distinct (key, value) counts, then number them in two levels: value ranges get
running totals (a row per shuffle partition and key), and every range is numbered on
its own.  A value shared by a third of all rows is one counted row from the start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.session import cut

def _same_keys(keys: Sequence[str], prefix: str = "_k_") -> Column:
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(prefix + k))
        cond = part if cond is None else cond & part
    return cond


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: "_k_" + k for k in keys})


def _with_range(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``_range``: number of the value's range.

    Spark samples the (key, value) order and cuts it into as many ranges as it shuffles
    to, so a key with many distinct values spans many of them.  The table is written
    once, which fixes the numbers.
    """
    return cut(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values per key with ``n`` (copies), ``less`` (rows below), ``total``.

    NULL values are left out.  The counted values are written once, since the rest
    reads them several times.
    """
    names = list(keys)
    if not names:
        df, names = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*names, value).agg(F.count("*").alias("n"))
    counts = _with_range(counts, names, value)
    per_range = counts.groupBy(*names, "_range").agg(F.sum("n").alias("_in_range"))
    whole = Window.partitionBy(*names)
    before = F.sum("_in_range").over(whole.orderBy("_range")) - F.col("_in_range")
    per_range = _renamed(
        per_range.select(
            *names,
            F.col("_range").alias("_r"),
            before.alias("_before"),
            F.sum("_in_range").over(whole).alias("total"),
        ),
        names,
    )
    inside = Window.partitionBy(*names, "_range").orderBy(value)
    return counts.join(per_range, _same_keys(names) & (F.col("_range") == F.col("_r"))).select(
        *keys,
        value,
        "n",
        (F.col("_before") + F.sum("n").over(inside) - F.col("n")).alias("less"),
        "total",
    )


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (key, column name, value)."""
    pairs = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_s")).select(*keys, "_s.*")


def with_percent_ranks(df: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """WIN04: percent_rank over the whole table for each {value column: new column}.

    All columns are ranked in one pass and joined back on the value.
    """
    ranks = value_ranks(_long(df, list(outputs)), "_v", ["_c"])
    share = F.when(F.col("total") > 1, F.col("less") / (F.col("total") - 1)).otherwise(0.0)
    for value, out in outputs.items():
        one = ranks.where(F.col("_c") == value).select(F.col("_v"), share.alias(out))
        df = df.join(one, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")
    return df


def with_percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """WIN04 for one column."""
    return with_percent_ranks(df, {value: out})


def _tile_of(row: Column, total: Column, n: int) -> Column:
    """NTILE number of the zero-based row: the first ``total % n`` tiles get one more."""
    small = F.floor(total / n)
    extra = total % n
    edge = extra * (small + 1)
    # small = 0 means every row is in the first part
    late = extra + F.floor((row - edge) / F.greatest(small, F.lit(1)))
    return F.when(row < edge, F.floor(row / (small + 1))).otherwise(late) + 1


def ntile_ranges(df: DataFrame, value: str, n: int) -> DataFrame:
    """WIN05 / STA03: lowest and highest value and row count of each of n tiles.

    A value's copies may span several tiles; each (value, tile) part is counted.
    """
    ranks = value_ranks(df, value)
    first = _tile_of(F.col("less"), F.col("total"), n)
    last = _tile_of(F.col("less") + F.col("n") - 1, F.col("total"), n)
    parts = ranks.select(value, "n", "less", "total", F.explode(F.sequence(first, last)).alias("tile"))
    small, extra = F.floor(F.col("total") / n), F.col("total") % n
    start = (F.col("tile") - 1) * small + F.least(F.col("tile") - 1, extra)
    stop = start + small + F.when(F.col("tile") <= extra, 1).otherwise(0)
    rows = F.least(stop, F.col("less") + F.col("n")) - F.greatest(start, F.col("less"))
    return (
        parts.withColumn("_rows", rows)
        .groupBy("tile")
        .agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("_rows").alias("n"))
    )


def percentiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """AGG07: exact interpolated percentiles per key, one column per name."""
    keys = list(keys)
    ranks = value_ranks(df, value, keys)
    v, less, n, total = F.col(value), F.col("less"), F.col("n"), F.col("total")
    aggs, picks = [], []
    for name, p in probs.items():
        pos = (total - 1) * p
        for part, row in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((less <= row) & (row < less + n), v)).alias(f"_{name}_{part}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_f"))
        lo, hi, f = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "f"))
        picks.append((lo + (hi - lo) * f).alias(name))
    return ranks.groupBy(*keys).agg(*aggs).select(*keys, *picks)


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str], prefix: str = "median_") -> DataFrame:
    """AGG07: medians of several columns per key in one pass."""
    keys = list(keys)
    one = percentiles(_long(df, columns, keys), "_v", {"_m": 0.5}, [*keys, "_c"])
    return one.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(prefix + c) for c in columns]
    )


def modes(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """AGG08: most frequent known value per key, the smallest on a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = first_per(counts, keys, [F.desc("_n"), F.asc(value)])
    return best.select(*keys, F.col(value).alias(out))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """WIN01 / SRT02: the first row per key; ``order`` must be a full order.

    Spark limits each key before the shuffle (WindowGroupLimit), so a hot key
    sends one row per task.
    """
    return top_per(df, keys, order, 1)


def top_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """WIN02: the first k rows per key."""
    number = rank or "_row"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(number, F.row_number().over(window)).where(F.col(number) <= k)
    return out if rank else out.drop(number)


def with_group_totals(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]
) -> DataFrame:
    """WIN03 / WIN06: group aggregates on every row.

    Totals are pre-aggregated and joined back, so a hot key is summed in every
    map task and the join side to replicate is one row per key.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*aggs).withColumnsRenamed({k: "_k_" + k for k in keys})
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col("_k_" + k))
        cond = part if cond is None else cond & part
    return df.join(totals, cond, "left").drop(*["_k_" + k for k in keys])
