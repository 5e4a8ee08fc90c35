"""Filling missing values, and checking how well it works."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.session import cut

DIRECT, REGIONAL, NATIONAL = 1, 2, 3


@dataclass(frozen=True)
class Rule:
    """How to fill one column: tiers from ``strategy`` on are tried in order."""

    column: str
    source: str | None = None
    strategy: int = NATIONAL
    default: float | None = 0.0
    group: str | None = None


def impute(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """IMP01: direct column, then group mean, then constant; adds ``<column>_tier``.

    Tier 0 was known, 1 direct, 2 regional, 3 national, NULL still missing.  Group
    means see what the direct tier filled.

    However many rules there are, the table is read twice: once for all means, once to
    fill (and twice more for rules that read what other rules fill).  Each row becomes a (rule, group) row per regional rule, summed before it
    travels; the means come back as one map per group column, joined by the group.
    """
    for rule in rules:
        if rule.column not in df.columns:
            raise ValueError(f"column {rule.column} not found")
    for wave in _waves(rules):
        df = _filled(df, wave)
    return df


def _waves(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Rules that can be worked out together; one that reads or fills what an earlier one fills comes in a later wave."""
    out: list[list[Rule]] = []
    at: dict[str, int] = {}
    for r in rules:
        wave = max((at[c] + 1 for c in (r.column, r.source, r.group) if c in at), default=0)
        out += [[]] * (wave + 1 - len(out))
        out[wave] = [*out[wave], r]
        at[r.column] = wave
    return out


def _filled(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    columns = set(df.columns)
    direct = {r.column: [(0, F.col(r.column))] + ([(1, F.col(r.source))] if r.strategy <= DIRECT and r.source in columns else []) for r in rules}
    regional = [(i, r) for i, r in enumerate(rules) if r.strategy <= REGIONAL and r.group in columns]
    means = {}
    if regional:
        seen = lambda r: F.coalesce(*[o.cast("double") for _, o in direct[r.column]])
        cells = [F.struct(F.lit(i).alias("rule"), F.col(r.group).cast("string").alias("group"), seen(r).alias("seen")) for i, r in regional]
        sums = df.select(F.inline(F.array(*cells))).groupBy("rule", "group").agg(F.sum("seen").alias("s"), F.count("seen").alias("n"))
        # a row per rule and group is left; the first row of its map is the rule's overall mean
        sums = cut(sums)
        overall = {r["rule"]: r["m"] for r in sums.groupBy("rule").agg(X.ratio(F.sum("s"), F.sum("n")).alias("m")).collect()}
        for group in dict.fromkeys(r.group for _, r in regional):
            of = [i for i, r in regional if r.group == group]
            some = sums.where(F.col("rule").isin(of) & (F.col("n") > 0)).groupBy("group")
            some = some.agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("s") / F.col("n")))).alias("_m_" + group))
            some = some.withColumnRenamed("group", "_g_" + group)
            df = df.join(some, F.col(group).cast("string").eqNullSafe(F.col("_g_" + group)), "left")
            means |= {i: F.coalesce(F.try_element_at("_m_" + group, F.lit(i)), F.lit(overall.get(i)).cast("double"), F.lit(0.0)) for i in of}
    filled = {}
    for i, rule in enumerate(rules):
        options = [*direct[rule.column]]
        if i in means:
            options.append((2, means[i]))
        if rule.default is not None:
            options.append((3, F.lit(float(rule.default))))
        filled[rule.column] = F.coalesce(*[o.cast("double") for _, o in options])
        filled[rule.column + "_tier"] = X.ladder([(o.isNotNull(), t) for t, o in options])
    return df.withColumns(filled).drop(*[p + r.group for _, r in regional for p in ("_m_", "_g_")])


def tier_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """IMP01: rows per column and tier, in one pass."""
    names = [r.column for r in rules]
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("column"), F.col(n + "_tier").alias("tier")) for n in names])
        ).alias("s")
    ).select("s.*")
    tier = F.col("tier")
    return long.groupBy("column").agg(
        F.count("*").alias("rows_total"),
        F.count_if(tier == 0).alias("rows_already_populated"),
        F.count_if(tier == 1).alias("rows_imputed_direct"),
        F.count_if(tier == 2).alias("rows_imputed_regional"),
        F.count_if(tier == 3).alias("rows_imputed_national"),
        F.count_if(tier.isNull()).alias("rows_still_null"),
    )


def fill_constant(df: DataFrame, column: str, value: float) -> DataFrame:
    """IMP02."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def fill_from_forms(df: DataFrame, forms: DataFrame, column: str, on: str, key: str = "id") -> DataFrame:
    """IMP03: missing values from the row's built form."""
    if column not in forms.columns:
        raise ValueError(f"column {column} not found in the built forms")
    defaults = forms.select(F.col(key).alias("_key"), F.col(column).alias("_default"))
    return (
        df.join(defaults, F.col(on) == F.col("_key"), "left")
        .withColumn(column, F.coalesce(column, "_default"))
        .drop("_key", "_default")
    )


def validate(df: DataFrame, column: str, masked: Column, filled: DataFrame, key: str) -> DataFrame:
    """IMP04: errors of ``filled`` against the known positive values that were masked."""
    truth = df.where(masked & (F.col(column) > 0)).select(key, F.col(column).alias("truth"))
    both = truth.join(filled.select(key, F.col(column).alias("guess")), key, "left")
    diff = F.col("guess") - F.col("truth")
    return both.agg(
        F.count("*").alias("n_parcels"),
        F.count("guess").alias("n_imputed"),
        F.avg(F.abs(diff)).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.abs(diff / F.col("truth")) * 100.0).alias("mape"),
        F.corr("truth", "guess").alias("correlation"),
        (F.count("guess") * 100.0 / F.count("*")).alias("coverage_pct"),
    )


def mask(df: DataFrame, column: str, masked: Column) -> DataFrame:
    """The table with the chosen cells set to NULL."""
    return df.withColumn(column, F.when(~masked, F.col(column)))
