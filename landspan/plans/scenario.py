"""Scenario overlays: painting, undo, constraints, merge, comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators.allocate import (
    SECTORS,
    SUB_SECTORS,
    building_allocation,
    place_type_allocation,
)
from landspan.plans.canvas import HOME_AREAS, JOB_AREAS

# Columns that may be painted (every measure but the static areas).
_USES = [
    "res_detsf", "res_detsf_sl", "res_detsf_ll", "res_attsf", "res_mf", "res", "emp", "emp_ret", "emp_off",
    "emp_pub", "emp_ind", "emp_ag", "emp_military", "mixed_use", "no_use",
]
PAINTABLE = [
    "area_parcel", "area_dev_condition", "area_row", "pop", "pop_groupquarter", "hh", "du", "median_income",
    "rent_burden_pct", "pct_minority", "pct_college_educated", "cost_burden_pct", "du_detsf", "du_detsf_sl",
    "du_detsf_ll", "du_attsf", "du_mf", "du_mf2to4", "du_mf5p", "emp", "residential_irrigated_area",
    "commercial_irrigated_area",
]
PAINTABLE += ["area_parcel_" + u for u in _USES]
PAINTABLE += ["emp_" + s for s in [*SECTORS, *SUB_SECTORS]]
PAINTABLE += ["bldg_area_" + s for s in [*HOME_AREAS, "mf", *JOB_AREAS]]
KEY = ["scenario_id", "feature_id", "column_name"]
LOG = [*KEY, "old_value", "new_value", "op", "batch_id", "painted_at", "event_id"]


def overlay(log: DataFrame) -> DataFrame:
    """SCN02: current painted values: the last event of every cell decides.

    A paint without value, a clear or an undo back to nothing leaves no row.  The
    last event is a partial aggregate, so a hot cell is reduced in every map task.
    """
    latest = F.max_by(F.struct("op", "new_value", "painted_at"), F.struct("painted_at", "event_id"))
    cells = log.where(F.col("column_name").isin(list(PAINTABLE))).groupBy(*KEY).agg(latest.alias("e"))
    return cells.where((F.col("e.op") != "clear") & F.col("e.new_value").isNotNull()).select(
        *KEY, F.col("e.new_value").alias("painted_value"), F.col("e.painted_at").alias("painted_at")
    )


def check_columns(names: Sequence[str]) -> None:
    """SCN02: only paintable columns may be painted."""
    bad = [n for n in names if n not in PAINTABLE]
    if bad:
        raise ValueError(f"columns cannot be painted: {bad}")


def paint(current: DataFrame, edits: DataFrame) -> DataFrame:
    """SCN02: upsert edits (key, painted_value) into an overlay."""
    kept = current.select(*KEY, "painted_value").join(edits.select(*KEY), KEY, "left_anti")
    return kept.unionByName(edits.select(*KEY, "painted_value"))


def paint_events(current: DataFrame, edits: DataFrame, at: Column, batch_id: int) -> DataFrame:
    """SCN02: the log rows of edits, with the value that each cell of ``current`` had before (nothing if unpainted)."""
    old = current.select(*KEY, F.col("painted_value").alias("old_value"))
    return edits.select(*KEY, F.col("painted_value").alias("new_value")).join(old, KEY, "left").select(
        *KEY,
        "old_value",
        "new_value",
        F.lit("paint").alias("op"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        at.alias("painted_at"),
    )


def with_old_values(log: DataFrame, width: str = "day") -> DataFrame:
    """SCN02 / SCN05: every event with the value its cell had just before it, whatever the log says.

    An as-of join of the log with itself in two steps: inside pieces of time, and over the
    last events of the pieces, so that a cell with any number of events is in no one task.
    A clear leaves no value.
    """
    order = ["painted_at", "event_id"]
    # in a struct, so that no value is told from no event
    log = log.withColumns({"_piece": F.date_trunc(width, "painted_at"), "_now": F.struct(F.when(F.col("op") != "clear", F.col("new_value")).alias("v"))})
    pieces = log.groupBy(*KEY, "_piece").agg(F.max_by("_now", F.struct(*order)).alias("_last"))
    pieces = pieces.select(*KEY, "_piece", F.lag("_last").over(Window.partitionBy(*KEY).orderBy("_piece")).alias("_earlier"))
    inside = Window.partitionBy(*KEY, "_piece").orderBy(*order)
    out = log.withColumn("_before", F.lag("_now").over(inside)).join(pieces, [*KEY, "_piece"])
    old = F.coalesce("_before", "_earlier")["v"]
    return out.withColumn("old_value", old).drop("_piece", "_now", "_before", "_earlier")


def scenario_canvas(base: DataFrame, painted: DataFrame, scenario_id, key: str = "parcel_id") -> DataFrame:
    """SCN01: base table with the scenario's painted values on top, and a flag.

    The column list of the pivot is given, so no job runs to find it.
    """
    columns = [c for c in PAINTABLE if c in base.columns]
    wide = (
        painted.where(F.col("scenario_id") == scenario_id)
        .groupBy(F.col("feature_id").alias("_feature"))
        .pivot("column_name", columns)
        .agg(F.max("painted_value"))
        .withColumnsRenamed({c: "_p_" + c for c in columns})
    )
    out = base.join(wide, F.col(key) == F.col("_feature"), "left")
    out = out.withColumns({c: F.coalesce("_p_" + c, F.col(c)) for c in columns})
    return out.withColumn("uf_is_painted", F.col("_feature").isNotNull()).drop(
        "_feature", *["_p_" + c for c in columns]
    )


def clear(current: DataFrame, cells: DataFrame, at, batch_id) -> tuple[DataFrame, DataFrame]:
    """SCN04: overlay without the cells, and the log rows of the deletions."""
    gone = current.join(cells.select(*KEY), KEY, "left_semi")
    log = gone.select(
        *KEY,
        F.col("painted_value").alias("old_value"),
        X.typed_null("double").alias("new_value"),
        F.lit("clear").alias("op"),
        F.lit(batch_id).alias("batch_id"),
        X.c(at).alias("painted_at"),
    )
    return current.join(cells.select(*KEY), KEY, "left_anti"), log


def undo(log: DataFrame, chosen: Column, at: Column, undo_batch: int, next_event: Column) -> DataFrame:
    """SCN05: the log with undo events for the chosen, not yet undone events.

    An undo writes the event's old value back (nothing means the base value again);
    the undone events are marked.  ``overlay`` of the result is the restored state.
    """
    done = F.col("undone_at").isNotNull() if "undone_at" in log.columns else F.lit(False)
    hit = chosen & ~done & (F.col("op") != "undo")
    marked = log.withColumn(
        "undone_at", F.when(hit, at).otherwise(F.col("undone_at") if "undone_at" in log.columns else None)
    )
    events = log.where(hit).select(
        *KEY,
        F.col("new_value").alias("old_value"),
        F.col("old_value").alias("new_value"),
        F.lit("undo").alias("op"),
        F.lit(undo_batch).cast("bigint").alias("batch_id"),
        at.alias("painted_at"),
        next_event.alias("event_id"),
    )
    return marked.unionByName(events, allowMissingColumns=True)


# Operators of a paint rule (a rule is violated where its test holds).
RULE_TESTS = {
    "EQ": lambda v, c: v == c,
    "NEQ": lambda v, c: v != c,
    "LT": lambda v, c: v < c,
    "LTE": lambda v, c: v <= c,
    "GT": lambda v, c: v > c,
    "GTE": lambda v, c: v >= c,
}


def violations(edits: DataFrame, rules: DataFrame) -> DataFrame:
    """SCN06: edits that violate a rule of their column.

    ``rules``: column_name, operator, value, severity, message.  A missing painted
    value violates only NOT_NULL.
    """
    r = rules.select(
        "column_name", F.upper("operator").alias("operator"), F.col("value").alias("rule_value"), "severity", "message"
    )
    v, c = F.col("painted_value"), F.col("rule_value")
    cases = [(F.col("operator") == "NOT_NULL", v.isNull())]
    cases += [(F.col("operator") == name, F.coalesce(test(v, c), F.lit(False))) for name, test in RULE_TESTS.items()]
    painted = edits.where(F.col("column_name").isin(list(PAINTABLE)))
    return painted.join(r, "column_name").where(X.ladder(cases, False))


def check_batch(edits: DataFrame, rules: DataFrame) -> tuple[bool, DataFrame]:
    """SCN06: whether a blocking rule is violated, and all violations."""
    found = violations(edits, rules)
    return not found.where("severity = 'block'").isEmpty(), found


def _subtype_columns(name: Column, du: Column) -> dict[str, Column]:
    """Units by the kind of home a building type's name speaks of."""
    low = F.lower(name)

    def has(*parts: str) -> Column:
        cond = low.contains(parts[0])
        for p in parts[1:]:
            cond = cond | low.contains(p)
        return cond

    kind = X.ladder(
        [
            (has("detached", "sf"), "detsf"),
            (has("attsf", "townhouse"), "attsf"),
            (has("mf", "multi", "apartment") & has("2-4", "2to4", "2_to_4"), "mf2to4"),
            (has("mf", "multi", "apartment") & has("5+", "5p", "5_plus", "5plus"), "mf5p"),
            (has("mf", "multi", "apartment"), "mf"),
        ]
    )
    two = X.ladder([(kind == "mf2to4", du), (kind == "mf", du * 0.4)])
    five = X.ladder([(kind == "mf5p", du), (kind == "mf", du * 0.6)])
    return {
        "du_detsf": F.when(kind == "detsf", du),
        "du_attsf": F.when(kind == "attsf", du),
        "du_mf2to4": two,
        "du_mf5p": five,
        "du_mf": F.when(kind.isin("mf2to4", "mf5p", "mf"), du),
    }


def _long(df: DataFrame, scenario_id, values: Mapping[str, Column]) -> DataFrame:
    """Known values as rows (scenario, feature, column, painted_value)."""
    items = F.filter(
        F.array(*[F.struct(F.lit(k).alias("column_name"), v.alias("painted_value")) for k, v in values.items()]),
        lambda s: s["painted_value"].isNotNull(),
    )
    return df.select(F.lit(scenario_id).alias("scenario_id"), F.col("parcel_id").alias("feature_id"), F.explode(items).alias("s")).select(
        "scenario_id", "feature_id", "s.*"
    )


TOTALS = {"du": "dwelling_units", "pop": "population", "hh": "households", "emp": "employment"}


def paint_building_type(features: DataFrame, types: DataFrame, scenario_id) -> DataFrame:
    """SCN03: painted rows of a building type on every feature; right of way is already
    out of the acres.  ``features``: parcel_id, acres, type_id.
    """
    got = building_allocation(F.col("acres"), F.lit(0.0))
    rows = features.join(types, "type_id")
    return _long(rows, scenario_id, {k: got[v] for k, v in TOTALS.items()})


def place_breakdown_columns(rows: DataFrame, names: Mapping[int, str] | None = None) -> DataFrame:
    """Units by subtype from a breakdown array with a ``name`` per line."""
    long = rows.select("parcel_id", F.explode("breakdown").alias("b"))
    cols = _subtype_columns(F.col("b.name"), F.col("b.dwelling_units"))
    return long.groupBy("parcel_id").agg(*[F.sum(v).alias(k) for k, v in cols.items()])


def paint_place_type(features: DataFrame, mixes: DataFrame, types: DataFrame, scenario_id) -> DataFrame:
    """SCN03: painted rows of a place type: totals, and units by the types' names.

    ``features``: parcel_id, acres, place_type; ``types`` has type_id and name.
    """
    whole = place_type_allocation(features, mixes, types.drop("name"))
    names = types.select("type_id", "name")
    lines = whole.select("parcel_id", F.explode("breakdown").alias("b")).select("parcel_id", "b.type_id", "b.dwelling_units")
    cols = _subtype_columns(F.col("name"), F.col("dwelling_units"))
    parts = lines.join(names, "type_id").groupBy("parcel_id").agg(*[F.sum(v).alias(k) for k, v in cols.items()])
    rows = whole.join(parts, "parcel_id", "left")
    values = {k: F.col(v) for k, v in TOTALS.items()} | {k: F.col(k) for k in cols}
    return _long(rows, scenario_id, values)


def merge(painted: DataFrame, source, target) -> tuple[DataFrame, DataFrame]:
    """SCN07: approved rows of one scenario copied into another where it has none.

    Returns the new overlay and one row with rows_copied and rows_skipped.
    """
    cell = ["feature_id", "column_name"]
    approved = painted.where((F.col("scenario_id") == source) & (F.col("approval_status") == "approved"))
    taken = painted.where(F.col("scenario_id") == target).select(*cell, F.lit(True).alias("_taken"))
    marked = approved.join(taken, cell, "left")
    kind = painted.schema["scenario_id"].dataType
    copied = marked.where("_taken IS NULL").drop("_taken").withColumn("scenario_id", F.lit(target).cast(kind))
    counts = marked.agg(
        F.count_if(F.col("_taken").isNull()).alias("rows_copied"), F.count("_taken").alias("rows_skipped")
    )
    return painted.unionByName(copied), counts


def compare(canvases: Mapping[str, DataFrame], measures: Mapping[str, str]) -> DataFrame:
    """SCN09: totals per scenario, one row each."""
    out = None
    for name, df in canvases.items():
        row = df.agg(*[X.or_zero(F.sum(c)).alias(total) for total, c in measures.items()]).select(
            F.lit(name).alias("scenario"), "*"
        )
        out = row if out is None else out.unionByName(row)
    return out


def report(canvas: DataFrame, fees: DataFrame | None, measures: Mapping[str, str], rate: float = 295.0) -> DataFrame:
    """SCN10: one row of totals, with the fee sums where a fee table exists."""
    row = canvas.agg(*[F.sum(c).alias(total) for total, c in measures.items()])
    if fees is None:
        return row
    sums = fees.agg(
        F.struct(
            *[
                F.round(X.or_zero(F.sum(c)), 2).alias(n)
                for n, c in (
                    ("vmt_fee_revenue", "fee_revenue_total"),
                    ("vmt_fee_revenue_forgone", "revenue_forgone"),
                    ("vmt_fee_vmt_exempt", "vmt_exempt"),
                )
            ]
        )
    ).scalar()
    return row.withColumn("_f", sums).select("*", "_f.*", F.lit(rate).alias("vmt_fee_rate")).drop("_f")


def schema_diff(source: DataFrame, target: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """SCN11: columns that are missing on one side or differ in type."""
    a, b = dict(source.dtypes), dict(target.dtypes)
    return [(c, a.get(c), b.get(c)) for c in sorted(a.keys() | b.keys()) if a.get(c) != b.get(c)]


def row_diff(source: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """SCN11: one row with the counts of added, removed, changed and equal rows."""
    shared = [c for c in source.columns if c in target.columns and c not in key]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*key, F.struct(*shared).alias(tag))

    both = side(source, "_s").join(side(target, "_t"), list(key), "full")
    s, t = F.col("_s"), F.col("_t")
    return both.agg(
        F.count_if(s.isNull()).alias("added"),
        F.count_if(t.isNull()).alias("removed"),
        F.count_if(s.isNotNull() & t.isNotNull() & (s != t)).alias("changed"),
        F.count_if(s.eqNullSafe(t) & s.isNotNull()).alias("equal"),
    )


def current_values(painted: DataFrame, scenario_id) -> DataFrame:
    """SCN12."""
    return painted.where(F.col("scenario_id") == scenario_id).select("feature_id", "column_name", "painted_value").orderBy(
        "feature_id", "column_name"
    )
