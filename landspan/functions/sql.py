"""Scalar SQL functions of a session, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from landspan.params import SQM_PER_ACRE


def register(spark: SparkSession) -> None:
    """UDF02: acres(m2), intersection_acres(overlap m2) and clamp_non_negative(x).

    SQL functions are inlined into the plan, so they cost nothing.
    """
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION acres(m2 DOUBLE) RETURNS DOUBLE RETURN m2 / {SQM_PER_ACRE}D"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION intersection_acres(m2 DOUBLE) RETURNS DOUBLE "
        f"RETURN coalesce(m2, 0D) / {SQM_PER_ACRE}D"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION clamp_non_negative(x DOUBLE) RETURNS DOUBLE RETURN greatest(0D, x)"
    )
