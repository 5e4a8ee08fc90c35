"""Reference against computed: totals, weighted means, correlations, grades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.params import SQFT_PER_ACRE


def weighted_r(x: Column, y: Column, w: Column) -> Column:
    """AGG06: weighted Pearson r from one-pass moments (NULL without spread).

    Rows where any of the three is missing are left out.
    """
    known = x.isNotNull() & y.isNotNull() & w.isNotNull()

    def s(v: Column) -> Column:
        return F.sum(F.when(known, v))

    sw, swx, swy = s(w), s(w * x), s(w * y)
    vx = F.greatest(sw * s(w * x * x) - swx * swx, F.lit(0.0))
    vy = F.greatest(sw * s(w * y * y) - swy * swy, F.lit(0.0))
    return X.ratio(sw * s(w * x * y) - swx * swy, F.sqrt(vx) * F.sqrt(vy))


def totals(df: DataFrame, metrics: Sequence[str], prefix: str) -> DataFrame:
    """BAS39: one row with the sum of every metric."""
    return df.agg(*[X.or_zero(F.sum(m)).alias(prefix + m) for m in metrics])


def weighted_means(df: DataFrame, measures: Sequence[str], weight: str = "pop") -> DataFrame:
    """BAS39: one row with weighted means of rates and incomes."""
    return df.agg(
        *[X.ratio(X.or_zero(F.sum(F.col(m) * F.col(weight))), F.sum(weight)).alias(m + "_wavg") for m in measures]
    )


def comparison_rows(computed: DataFrame, reference: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """BAS39: both sides side by side (computed under its name, reference as ref_)."""
    r = reference.select(key, *[F.col(m).alias("ref_" + m) for m in metrics])
    return computed.join(r, key)


def correlations(rows: DataFrame, metrics: Sequence[str], weight: Column) -> DataFrame:
    """BAS39: one row with the weighted correlation of every metric, in one pass."""
    return rows.agg(*[weighted_r(F.col(m), F.col("ref_" + m), weight).alias("r_" + m) for m in metrics])


def summary(
    computed: DataFrame, reference: DataFrame, key: str, metrics: Sequence[str], weight: Column, rates: Sequence[str]
) -> DataFrame:
    """BAS39: totals of both sides, correlations and weighted means as one row.

    The four parts are one-row aggregates, met as scalar structs.
    """
    parts = [
        totals(reference, metrics, "ref_"),
        totals(computed, metrics, "computed_"),
        correlations(comparison_rows(computed, reference, key, metrics), metrics, weight),
    ]
    row = weighted_means(computed, rates)
    for p in parts:
        names = p.columns
        row = row.withColumn("_p", p.select(F.struct(*names)).scalar()).select("*", "_p.*").drop("_p")
    return row


# Least correlation of each grade.
GRADES = (("GOOD", 0.70), ("OK", 0.50), ("WARN", 0.30), ("POOR", 0.10))


def grade(summary_row: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """BAS40: one row per metric: both totals, difference, percent, r and its grade."""
    lines = summary_row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.col("ref_" + m).alias("ref"),
                        F.col("computed_" + m).alias("computed"),
                        F.col("r_" + m).alias("r"),
                    )
                    for m in metrics
                ]
            )
        ).alias("s")
    ).select("s.*")
    usable = (F.col("ref") != 0) & (F.col("computed") != 0)
    known = F.col("ref").isNotNull() & F.col("computed").isNotNull()
    diff = F.col("computed") - F.col("ref")
    r = F.col("r")
    return lines.select(
        "metric",
        "ref",
        "computed",
        F.when(usable, diff).when(known, 0.0).alias("diff"),
        F.when(usable, X.ratio(diff, "ref") * 100.0).when(known, 0.0).alias("pct_diff"),
        "r",
        X.ladder([(r.isNull(), "N/A"), *[(r >= low, g) for g, low in GRADES]], "FAIL").alias("status"),
    )


def coverage(df: DataFrame, checks: Mapping[str, Column], by: str | None = None) -> DataFrame:
    """BAS41: rows and matched rows per check, over the table or per category."""
    total = F.count("*")
    out = [total.alias("total")]
    for name, cond in checks.items():
        out += [F.count_if(cond).alias(name), X.ratio(F.count_if(cond) * 1.0, total).alias(name + "_share")]
    return (df.groupBy(F.coalesce(F.col(by), F.lit("NULL")).alias(by)) if by else df.groupBy()).agg(*out)


def rename_view(df: DataFrame, names: Mapping[str, str | tuple[str, float]], defaults: Mapping[str, float]) -> DataFrame:
    """BAS43: old column names to new ones, with unit factors and defaults for the rest."""
    out = []
    for new, old in names.items():
        col = F.col(old) if isinstance(old, str) else F.col(old[0]) * old[1]
        out.append(col.alias(new))
    out += [F.lit(float(v)).alias(n) for n, v in defaults.items()]
    return df.select(*out)


# Profile defaults and bounds.
PROFILE = {
    "household_size": 2.5, "vacancy_rate": 5.0, "indoor_water_rate": 200.0,
    "irrigable_area_fraction": 0.25, "electricity_eui": 70.0, "gas_eui": 100.0,
}
FAR_DEFAULT, FAR_LEAST, COVER_DEFAULT, OUTDOOR_DEFAULT = 0.3, 0.1, 25.0, 300.0


def built_form_profiles(components: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """BAS44: built-form parameters from the mean of its components (missing counts as 0).

    ``components``: built_form_id, dwelling_unit_density, employment_density,
    gross_net_ratio, building_sqft_total, residential_irrigated_sqft and one
    ``<sector>_density`` per sector.
    """
    base = ["dwelling_unit_density", "employment_density", "gross_net_ratio", "building_sqft_total", "residential_irrigated_sqft"]
    means = components.groupBy("built_form_id").agg(
        *[F.avg(X.or_zero(n)).alias(n) for n in [*base, *[s + "_density" for s in sectors]]]
    )
    ratio = F.when(F.col("gross_net_ratio") > 0, F.col("gross_net_ratio")).otherwise(1.0)
    sqft, wet = F.col("building_sqft_total"), F.col("residential_irrigated_sqft")
    jobs = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(s).alias("key"), (F.col(s + "_density") * ratio).alias("value")) for s in sectors]),
            lambda e: e["value"] > 0,
        )
    )
    far = F.when(sqft > 0, sqft / SQFT_PER_ACRE / ratio).otherwise(FAR_DEFAULT)
    cover = F.when(sqft > 0, sqft * 100.0 / SQFT_PER_ACRE).otherwise(COVER_DEFAULT)
    return means.select(
        "built_form_id",
        (F.col("dwelling_unit_density") * ratio).alias("du_per_acre"),
        (F.col("employment_density") * ratio).alias("emp_per_acre"),
        F.greatest(far, F.lit(FAR_LEAST)).alias("far"),
        F.least(cover, F.lit(100.0)).alias("building_coverage"),
        F.when(wet > 0, wet * 0.01).otherwise(OUTDOOR_DEFAULT).alias("outdoor_water_rate"),
        jobs.alias("jobs_by_sector"),
        *[F.lit(v).alias(n) for n, v in PROFILE.items()],
    )
