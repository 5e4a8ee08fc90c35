"""Registry of checked queries: name -> (Spark query, check SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.queries.binding import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; ``sql`` is the same result for DuckDB."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return keep


def rd(column: Column | str, digits: int = 4) -> Column:
    """Round half up by arithmetic, the same in both engines (see ``rds``)."""
    c = F.col(column) if isinstance(column, str) else column
    m = F.lit(float(10**digits))
    return F.floor(c * m + 0.5) / m


def rds(text: str, digits: int = 4) -> str:
    """``rd`` as SQL text."""
    return f"floor(({text}) * 1e{digits} + 0.5e0) / 1e{digits}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every double column of a result rounded with ``rd``."""
    return df.select(
        [rd(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def rounded_sql(names, digits: int = 4) -> str:
    """Select list that rounds the named columns."""
    return ", ".join(f"{rds(n, digits)} AS {n}" for n in names)
