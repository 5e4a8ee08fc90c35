"""Allocation of zone values (ALC08-17, AGG17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.operators import allocate as A
from landspan.queries.analysis import num, nums, same
from landspan.queries.binding import Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded

# jobs per zone: every sub-sector a small number from the zone id
JOBS = {"emp_" + s: f"(s_suppkey * {i + 3} % {11 + 2 * i}) * 1e0" for i, s in enumerate(A.SUB_SECTORS)}
SECTOR_JOBS = {
    "emp_" + k: "(" + " + ".join(f"({JOBS['emp_' + s]})" for s in subs) + ")" for k, subs in A.SECTORS.items()
}
ZONE_JOBS = {
    "geoid": "s_suppkey",
    "emp": "(" + " + ".join(f"({v})" for v in JOBS.values()) + ")",
    **SECTOR_JOBS,
    **JOBS,
}
# parcel attributes used as weights
LOT = {
    "parcel_id": "o_orderkey",
    "area_parcel_emp": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE floor(o_totalprice / 1e4) END",
    "area_parcel_acres": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE floor(o_totalprice / 2e4) END",
    "area_gross_acres": "floor(o_totalprice / 8e3)",
    "area_gross": "floor(o_totalprice / 8e3)",
    "commercial_sqft": "CASE WHEN o_custkey % 4 = 0 THEN 0e0 ELSE (o_custkey % 50) * 20e0 END",
    "industrial_sqft": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE (o_custkey % 40) * 10e0 END",
    "other_sqft": "(o_custkey % 7) * 30e0",
    "res_sqft": "(o_custkey % 11) * 100e0",
    "emp_weight": "CASE WHEN o_custkey % 5 = 0 THEN 0e0 ELSE 1e0 END",
    "emp_ret_per_acre": "(o_orderkey % 5) * 1e0",
    "emp_off_per_acre": "CASE WHEN o_custkey % 2 = 0 THEN 0e0 ELSE 2e0 END",
    "emp_pub_per_acre": "0e0 * o_custkey",
    "emp_ind_per_acre": "(o_orderkey % 3) * 0.5e0",
    "emp_ag_per_acre": "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 0.25e0 END",
    "pop_weight": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_custkey % 13) * 2.5e0 END",
    "du_estimated": "(o_custkey % 13) * 1e0",
    "vacancy_rate": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0.08e0 END",
}


def exprs(columns: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in columns.items()]


def table_sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(exprs(columns))} FROM {source}"


def zone_jobs(t: Tables):
    return t.supplier.selectExpr(*exprs(ZONE_JOBS))


def lots(t: Tables):
    return t.orders.selectExpr(*exprs(LOT))


PAIR_CTES = dict(zj=table_sql(ZONE_JOBS, "supplier"), lot=table_sql(LOT, "orders"))


def pair_rows(t: Tables, parcels, zones):
    p = t.pairs.withColumnRenamed("zone_id", "geoid")
    return p.join(parcels, "parcel_id").join(zones, "geoid")


_BT = dict(
    stories="CASE WHEN id % 5 = 0 THEN 3e0 ELSE NULL END",
    footprint_per_unit="CASE WHEN id % 10 = 0 THEN 80e0 ELSE NULL END",
    parking_spaces_per_unit="1.5e0",
    parking_spaces_per_1000sqft="CASE WHEN id % 2 = 0 THEN 2e0 ELSE NULL END",
    parking_sqft_per_space="CASE WHEN id % 4 = 0 THEN NULL ELSE 320e0 END",
)
BT_SQL = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _BT.items()) + " FROM built_forms"


def building_types(t: Tables):
    return t.built_forms.selectExpr("*", *exprs(_BT))


def _bt_sql(acres: str, row: str, source: str) -> str:
    """ALC08 spelled out as nested selects over ``source``."""
    return f"""SELECT *, spaces * coalesce(nullif(parking_sqft_per_space, 0e0), 300e0) * 0.092903e0 AS parking_area_m2 FROM (
    SELECT *, 1.5e0 * dwelling_units + coalesce(parking_spaces_per_1000sqft, 0e0) * (floor_area_m2 / 0.092903e0 / 1000e0) AS spaces,
      CASE WHEN outdoor_water_rate > 0 THEN (site - ground) * coalesce(irrigable_area_fraction, 0e0) * outdoor_water_rate ELSE 0e0 END AS water_outdoor_l FROM (
    SELECT *, CASE WHEN far > 0 THEN site * far WHEN stories > 0 AND footprint_per_unit > 0 AND dwelling_units > 0 THEN dwelling_units * footprint_per_unit * stories
        WHEN building_coverage > 0 AND stories > 0 THEN site * (building_coverage / 100e0) * stories ELSE 0e0 END AS floor_area_m2,
      CASE WHEN far > 0 THEN CASE WHEN site * far > 0 AND building_coverage > 0 THEN site * (building_coverage / 100e0) ELSE 0e0 END
        WHEN stories > 0 AND footprint_per_unit > 0 AND dwelling_units > 0 THEN dwelling_units * footprint_per_unit
        WHEN building_coverage > 0 AND stories > 0 THEN site * (building_coverage / 100e0) ELSE 0e0 END AS ground,
      dwelling_units * coalesce(nullif(household_size, 0e0), 2.5e0) AS population,
      dwelling_units * (1e0 - coalesce(nullif(vacancy_rate, 0e0), 5e0) / 100e0) AS households FROM (
    SELECT *, used * 43560e0 * 0.092903e0 AS site, CASE WHEN du_per_acre > 0 THEN used * du_per_acre ELSE 0e0 END AS dwelling_units,
      CASE WHEN emp_per_acre > 0 THEN used * emp_per_acre ELSE 0e0 END AS employment FROM (
    SELECT *, {acres} * (1e0 - {row} / 100e0) AS used FROM {source}))))"""


_BT_OUT = nums(
    dwelling_units="dwelling_units", population="population", households="households", employment="employment",
    floor_area_m2="floor_area_m2", building_footprint_m2="ground",
    water_indoor_l="CASE WHEN indoor_water_rate > 0 THEN population * indoor_water_rate * 365e0 ELSE 0e0 END",
    water_outdoor_l="water_outdoor_l", electricity_kwh="coalesce(floor_area_m2 * electricity_eui, 0e0)",
    gas_kwh="coalesce(floor_area_m2 * gas_eui, 0e0)", trips_per_day="coalesce(dwelling_units * trip_rate_override, 0e0)",
    parking_spaces="spaces", parking_area_m2="parking_area_m2",
)


@query(
    "ALC08_building_type",
    ctes("parcels", "built_forms", bt=BT_SQL, j="SELECT * FROM parcels JOIN bt ON key = built_form_key", o=_bt_sql("gross_acres", "25e0", "j"))
    + f"SELECT parcel_id, {num('used', 'developable_acres')}, {num('gross_acres - used', 'row_acres')}, {_BT_OUT} FROM o",
)
def building_type(t: Tables):
    j = t.parcels.join(building_types(t).withColumnRenamed("key", "built_form_key"), "built_form_key")
    got = A.building_allocation(F.col("gross_acres"), F.lit(25.0))
    return rounded(j.select("parcel_id", *[v.alias(k) for k, v in got.items()]))


# shares by sector of every building type; every seventh type has none
_SHARES = "id % 5", "id % 3"
_SECTOR = {"emp_retail": _SHARES[0], "emp_office": _SHARES[1]}


def with_sectors(bt):
    r, o = (F.expr(f"cast({x} AS double)") for x in _SHARES)
    shares = F.create_map(F.lit("retail"), r, F.lit("office"), o)
    return bt.withColumn("jobs_by_sector", F.when(F.col("id") % 7 != 0, shares))


def by_sector(m="employment_by_sector"):
    return [F.coalesce(F.try_element_at(m, F.lit(s)), F.lit(0.0)).alias("emp_" + s) for s in ("retail", "office")]


def _sector_sql(share: str) -> str:
    return f"CASE WHEN employment > 0 AND type_id % 7 <> 0 AND ({_SHARES[0]} + {_SHARES[1]}) > 0 THEN employment * (({share}) * 1e0 / ({_SHARES[0]} + {_SHARES[1]})) ELSE 0e0 END".replace("id %", "type_id %").replace("type_type_id", "type_id")


@query(
    "ALC08_jobs_by_sector",
    ctes("parcels", "built_forms", bt=BT_SQL, j="SELECT *, id AS type_id FROM parcels JOIN bt ON key = built_form_key", o=_bt_sql("gross_acres", "25e0", "j"))
    + "SELECT parcel_id, " + ", ".join(num(_sector_sql(v), k) for k, v in _SECTOR.items()) + " FROM o",
)
def building_type_sectors(t: Tables):
    j = t.parcels.join(with_sectors(building_types(t)).withColumnRenamed("key", "built_form_key"), "built_form_key")
    got = A.building_allocation(F.col("gross_acres"), F.lit(25.0), sectors="jobs_by_sector")
    return rounded(j.select("parcel_id", got["employment_by_sector"].alias("employment_by_sector")).select("parcel_id", *by_sector()))


@query(
    "PRJ09_jobs_by_sector",
    ctes("parcels", "built_forms")
    + f"""SELECT parcel_id, {rds('CASE WHEN j > 0 THEN j * 3e0 / 10e0 ELSE 0e0 END')} AS emp_retail, {rds('CASE WHEN j > 0 THEN j * 7e0 / 10e0 ELSE 0e0 END')} AS emp_office,
    {rds('j * 0.302e0')} AS fixed_ret, {rds('j * 0.698e0')} AS fixed_rest
    FROM (SELECT parcel_id, coalesce(gross_acres * emp_per_acre, 0e0) AS j FROM parcels LEFT JOIN built_forms ON key = built_form_key)""",
)
def jobs_by_sector(t: Tables):
    from landspan.functions import expr as X

    bf = t.built_forms.select(F.col("key").alias("built_form_key"), "emp_per_acre")
    shares = F.from_json(F.lit('{"retail": 3, "office": 7}'), "map<string,double>")
    out = t.parcels.join(bf, "built_form_key", "left").select(
        "parcel_id", X.or_zero(F.col("gross_acres") * F.col("emp_per_acre")).alias("j")
    )
    out = out.withColumn("m", X.spread_map("j", shares))
    return rounded(
        out.select(
            "parcel_id",
            X.or_zero(F.try_element_at("m", F.lit("retail"))).alias("emp_retail"),
            X.or_zero(F.try_element_at("m", F.lit("office"))).alias("emp_office"),
            *X.spread("j", {"ret": 0.302, "rest": 0.698}, "fixed_"),
        )
    )


_MIX = "SELECT concat('Brand#', cast(1 + (id * 5) % 25 AS string)) AS place_type, id AS type_id, 10e0 + id % 7 AS percentage, CASE WHEN id % 3 = 0 THEN 0e0 ELSE 20e0 END AS row_pct0 FROM built_forms"


@query(
    "ALC09_place_type",
    ctes(
        "parcels", "built_forms", bt=BT_SQL, mix0=_MIX,
        mix="SELECT *, sum(percentage) OVER (PARTITION BY place_type) AS whole, max(row_pct0) OVER (PARTITION BY place_type) AS row_pct FROM (SELECT * FROM mix0 UNION ALL SELECT concat('Brand#', cast(1 + (type_id * 3) % 25 AS string)), type_id, 5e0 + type_id % 4, CASE WHEN type_id % 3 = 0 THEN 0e0 ELSE 20e0 END FROM mix0)",
        j="SELECT p.parcel_id, sqrt(p.gross_acres + 0.003e0) AS gross_acres, mix.type_id, percentage, whole, row_pct, bt.* EXCLUDE (id), sqrt(p.gross_acres + 0.003e0) * (1e0 - coalesce(nullif(row_pct, 0e0), 25e0) / 100e0) AS dev FROM parcels p JOIN mix ON place_type = built_form_key JOIN bt ON bt.id = type_id",
        j2="SELECT *, dev * coalesce(percentage / nullif(whole, 0e0), 0e0) AS part FROM j",
        o=_bt_sql("part", "0e0", "j2"),
    )
    + f"""SELECT parcel_id, {num('max(dev)', 'developable_acres')}, {num('max(gross_acres - dev)', 'row_acres')}, """
    + ", ".join(num(f"sum({v})", k, 3) for k, v in dict(
        dwelling_units="dwelling_units", population="population", households="households", employment="employment", floor_area_m2="floor_area_m2",
        building_footprint_m2="ground", water_indoor_l="CASE WHEN indoor_water_rate > 0 THEN population * indoor_water_rate * 365e0 ELSE 0e0 END",
        water_outdoor_l="water_outdoor_l", electricity_kwh="coalesce(floor_area_m2 * electricity_eui, 0e0)", gas_kwh="coalesce(floor_area_m2 * gas_eui, 0e0)",
        trips_per_day="coalesce(dwelling_units * trip_rate_override, 0e0)", parking_spaces="spaces", parking_area_m2="parking_area_m2").items())
    + ", " + ", ".join(num(f"sum({_sector_sql(v)})", k, 3) for k, v in _SECTOR.items())
    + f", string_agg(concat(cast(type_id AS varchar), ':', cast(cast(floor(part * 1e4 + 0.5e0) AS bigint) AS varchar)), ',' ORDER BY type_id, percentage) AS parts FROM o GROUP BY parcel_id",
)
def place_type(t: Tables):
    mix = t.built_forms.selectExpr(
        "concat('Brand#', cast(1 + (id * 5) % 25 AS string)) AS place_type", "id AS type_id",
        "10e0 + id % 7 AS percentage", "CASE WHEN id % 3 = 0 THEN 0e0 ELSE 20e0 END AS row_pct0",
    )
    more = mix.selectExpr(
        "concat('Brand#', cast(1 + (type_id * 3) % 25 AS string)) AS place_type", "type_id",
        "5e0 + type_id % 4 AS percentage", "row_pct0",
    )
    mix = mix.unionByName(more)
    row = mix.groupBy("place_type").agg(F.max("row_pct0").alias("row_pct"))
    mix = mix.drop("row_pct0").join(row, "place_type")
    parcels = t.parcels.select("parcel_id", F.sqrt(F.col("gross_acres") + 0.003).alias("acres"), F.col("built_form_key").alias("place_type"))
    types = with_sectors(building_types(t)).withColumnRenamed("id", "type_id").drop("key")
    out = A.place_type_allocation(parcels, mix, types, "jobs_by_sector")
    out = out.select("*", *by_sector()).drop("employment_by_sector")
    part = F.transform(
        "breakdown",
        lambda b: F.concat(b["type_id"].cast("string"), F.lit(":"), F.floor(b["acres"] * 1e4 + 0.5).cast("string")),
    )
    head = ["developable_acres", "row_acres"]
    body = [n for n in out.columns if n not in ("parcel_id", "breakdown", *head)]
    return out.select(
        "parcel_id", *[rd(n).alias(n) for n in head], *[rd(n, 3).alias(n) for n in body],
        F.array_join(part, ",").alias("parts"),
    )


_FACTOR = "fac AS (SELECT parcel_id, zone_id, overlap / zt AS weight FROM (SELECT *, sum(overlap) OVER (PARTITION BY zone_id) AS zt FROM pairs))"


def zone_factors(t: Tables):
    """Pair table with each zone's overlaps as its area."""
    from landspan.operators.ranking import with_group_totals

    p = with_group_totals(t.pairs, ["zone_id"], [F.sum("overlap").alias("zone_area")])
    return p.select(
        F.col("zone_id").alias("source_id"), F.col("parcel_id").alias("target_id"), "overlap", "zone_area",
        (F.col("overlap") / F.col("zone_area")).alias("weight"),
    )


@query(
    "ALC10_allocate_columns",
    ctes("pairs", "block_groups") + f", {_FACTOR} SELECT f.parcel_id AS target_id, "
    + ", ".join(num(f"sum(coalesce({c}, 0e0) * weight)", c, 6) for c in ("pop", "hh", "emp", "median_income"))
    + " FROM fac f JOIN block_groups b ON b.geoid = f.zone_id GROUP BY f.parcel_id",
)
def allocate_columns(t: Tables):
    cols = ["pop", "hh", "emp", "median_income"]
    out = A.allocate(zone_factors(t).select("source_id", "target_id", "weight"), t.block_groups, "geoid", cols)
    return rounded(out, 6)


def hint_pairs(t: Tables):
    zones = t.block_groups.select(F.col("geoid").alias("source_id"), "pop", "median_income")
    return (
        zone_factors(t).withColumnRenamed("zone_area", "source_area").join(zones, "source_id")
        .select("target_id", "overlap", "source_area", "pop", "median_income")
    )


_HINT = """h AS (SELECT f.parcel_id, sum(coalesce(pop, 0e0) * w) AS pop, sum(coalesce(median_income, 0e0) * overlap) / nullif(sum(overlap), 0e0) AS median_income
    FROM (SELECT *, overlap / zt AS w FROM (SELECT *, sum(overlap) OVER (PARTITION BY zone_id) AS zt FROM pairs)) f JOIN block_groups b ON b.geoid = f.zone_id GROUP BY f.parcel_id)"""
HINTS = {"pop": "sum", "median_income": "avg"}


@query(
    "AGG17_rollup_by_hint",
    ctes("pairs", "block_groups") + f", {_HINT} SELECT parcel_id AS target_id, {num('pop', 'pop', 6)}, {num('median_income', 'median_income')} FROM h",
)
def rollup_by_hint(t: Tables):
    out = A.by_hint(hint_pairs(t), HINTS)
    return out.select("target_id", rd("pop", 6).alias("pop"), rd("median_income").alias("median_income"))


@query(
    "ALC11_allocate_by_hint",
    ctes("pairs", "block_groups", "base")
    + f", {_HINT} SELECT b.parcel_id, {num('CASE WHEN b.parcel_id % 6 = 0 THEN 0e0 ELSE coalesce(CASE WHEN b.parcel_id % 2 = 0 THEN b.population END, h.pop) END', 'pop', 6)}, {num('h.median_income', 'median_income')} FROM base b LEFT JOIN h ON h.parcel_id = b.parcel_id",
)
def allocate_by_hint(t: Tables):
    base = t.base.select(
        "parcel_id",
        F.when(F.col("parcel_id") % 6 == 0, -1.0).when(F.col("parcel_id") % 2 == 0, F.col("population")).alias("pop"),
    )
    out = A.allocate_by_hint(base, "parcel_id", hint_pairs(t), HINTS)
    return out.select("parcel_id", rd("pop", 6).alias("pop"), rd("median_income").alias("median_income"))


@query(
    "ALC12_impute_area_proportional",
    ctes("pairs", "block_groups", "base") + f""", {_FACTOR}, a AS (SELECT f.parcel_id, sum(coalesce(emp, 0e0) * weight) AS emp FROM fac f JOIN block_groups b ON b.geoid = f.zone_id GROUP BY f.parcel_id)
    SELECT b.parcel_id, {num('coalesce(b.employment_total, a.emp)', 'emp', 6)} FROM base b LEFT JOIN a ON a.parcel_id = b.parcel_id""",
)
def impute_area_proportional(t: Tables):
    got = A.allocate(zone_factors(t).select("source_id", "target_id", "weight"), t.block_groups, "geoid", ["emp"])
    base = t.base.select("parcel_id", F.col("employment_total").alias("emp"))
    return rounded(A.fill_where_null(base, "parcel_id", got, ["emp"]), 6)


@query(
    "ALC13_county_control_total",
    ctes("base", "block_groups")
    + f""", s AS (SELECT coalesce(sum(employment_total), 0e0) AS have FROM base), w AS (SELECT coalesce(sum(emp) * 1000, 0e0) AS want FROM block_groups)
    SELECT parcel_id, {num('CASE WHEN employment_total > 0 AND want > have THEN employment_total * (want / have) ELSE employment_total END', 'employment_total')} FROM base, s, w""",
)
def county_control_total(t: Tables):
    total = t.block_groups.agg((F.sum("emp") * 1000).alias("employment_total"))
    out = A.scale_to_total(t.base.select("parcel_id", "employment_total"), ["employment_total"], total, "employment_total")
    return rounded(out)


@query(
    "ALC14_dasymetric_population",
    ctes("pairs", "block_groups", **PAIR_CTES)
    + f""", j AS (SELECT p.parcel_id, b.geoid, b.pop, b.du, pop_weight, du_estimated, vacancy_rate FROM pairs p JOIN lot ON lot.parcel_id = p.parcel_id JOIN block_groups b ON b.geoid = p.zone_id),
    z AS (SELECT geoid, sum(coalesce(pop_weight, 0e0)) AS wp, sum(coalesce(du_estimated, 0e0)) AS wd FROM j GROUP BY geoid)
    SELECT parcel_id, {num('sum(pop * (coalesce(pop_weight, 0e0) / nullif(wp, 0e0)))', 'pop', 6)}, {num('sum(du * (du_estimated / nullif(wd, 0e0)))', 'du', 6)},
    {num('sum(du * (du_estimated / nullif(wd, 0e0)) * (1e0 - coalesce(vacancy_rate, 0.05e0)))', 'hh', 6)} FROM j JOIN z ON z.geoid = j.geoid GROUP BY parcel_id""",
)
def dasymetric_population(t: Tables):
    zones = t.block_groups.select("geoid", F.col("pop").alias("total_population"), F.col("du").alias("total_housing_units"))
    lot = lots(t).select("parcel_id", "pop_weight", "du_estimated", "vacancy_rate")
    return rounded(A.dasymetric_population(pair_rows(t, lot, zones)), 6)


_AREA = "coalesce(area_parcel_emp, area_parcel_acres, area_gross_acres, area_gross, 0e0)"
_SQFT = "(coalesce(commercial_sqft, 0e0) + coalesce(industrial_sqft, 0e0) + coalesce(other_sqft, 0e0) + 1e0)"


def _weight_sql(sector: str) -> str:
    w = f"greatest(0e0, {_AREA} * {_SQFT} * coalesce(emp_{sector}_per_acre, 0e0))"
    gate = {"ret": "commercial_sqft", "off": "commercial_sqft", "ind": "industrial_sqft"}.get(sector)
    return f"(CASE WHEN coalesce({gate}, 0e0) > 0 OR emp_weight > 0 THEN {w} ELSE 0e0 END)" if gate else w


_EMP_SUBS = A.SUB_SECTORS


def _emp_sql() -> str:
    ws = ", ".join(f"{_weight_sql(s)} AS w_{s}" for s in A.SECTORS)
    tot = " + ".join(f"w_{s}" for s in A.SECTORS)
    sums = ", ".join(f"sum(w_{s}) AS t_{s}" for s in A.SECTORS)

    def share(s):
        return f"(w_{s} / nullif(CASE WHEN t_{s} > 0 THEN t_{s} ELSE t_all END, 0e0))"

    cols = [num(f"sum(emp * (({tot}) / nullif(t_all, 0e0)))", "emp", 6)]
    cols += [num(f"sum(emp_{s} * {share(s)})", "emp_" + s, 6) for s in A.SECTORS]
    cols += [num(f"sum(emp_{n} * {share(A.sector_of(n))})", "emp_" + n, 6) for n in _EMP_SUBS]
    return (
        ctes("pairs", **PAIR_CTES)
        + f""", lw AS (SELECT *, {ws} FROM lot), j AS (SELECT p.parcel_id, zj.*, {', '.join('w_' + s for s in A.SECTORS)} FROM pairs p JOIN lw ON lw.parcel_id = p.parcel_id JOIN zj ON zj.geoid = p.zone_id),
        z AS (SELECT geoid AS g, {sums}, sum({tot}) AS t_all FROM j GROUP BY geoid) SELECT parcel_id, {', '.join(cols)} FROM j JOIN z ON g = geoid GROUP BY parcel_id"""
    )


def emp_pairs(t: Tables):
    lot = A.employment_weights(lots(t)).select("parcel_id", *["w_" + s for s in A.SECTORS])
    return pair_rows(t, lot, zone_jobs(t))


@query("ALC15_dasymetric_employment", _emp_sql())
def dasymetric_employment(t: Tables):
    return rounded(A.dasymetric_employment(emp_pairs(t)), 6)


# Floor-area column that hosts a sector's jobs.
SQFT_OF = {"ret": "commercial_sqft", "off": "commercial_sqft", "pub": "other_sqft", "ind": "industrial_sqft"}


@query(
    "ALC17_sector_employment",
    ctes("pairs", **PAIR_CTES)
    + """, j AS (SELECT p.parcel_id, zj.geoid, emp_ret, emp_off, emp_pub, emp_ind, coalesce(nullif(commercial_sqft, 0e0), res_sqft) AS commercial_sqft, coalesce(nullif(industrial_sqft, 0e0), res_sqft) AS industrial_sqft,
    coalesce(nullif(other_sqft, 0e0), res_sqft) AS other_sqft FROM pairs p JOIN lot ON lot.parcel_id = p.parcel_id JOIN zj ON zj.geoid = p.zone_id),
    z AS (SELECT geoid AS g, sum(coalesce(commercial_sqft, 0e0)) AS tc, sum(coalesce(industrial_sqft, 0e0)) AS ti, sum(coalesce(other_sqft, 0e0)) AS tx FROM j GROUP BY geoid) SELECT parcel_id, """
    + ", ".join(
        num(f"coalesce(sum(emp_{s} * (coalesce({c}, 0e0) / nullif({z}, 0e0))), 0e0)", "emp_" + s, 6)
        for s, c, z in (("ret", "commercial_sqft", "tc"), ("off", "commercial_sqft", "tc"), ("pub", "other_sqft", "tx"), ("ind", "industrial_sqft", "ti"))
    )
    + " FROM j JOIN z ON g = geoid GROUP BY parcel_id",
)
def sector_employment(t: Tables):
    lot = lots(t).select("parcel_id", "commercial_sqft", "industrial_sqft", "other_sqft", "res_sqft")
    zones = zone_jobs(t).select("geoid", *["emp_" + s for s in SQFT_OF])
    return rounded(A.sector_employment(pair_rows(t, lot, zones), SQFT_OF, estimated="res_sqft"), 6)


@query(
    "ALC16_crosswalk",
    ctes("pairs", "parcels")
    + f""", w AS (SELECT zone_id, parcel_id, overlap, CASE WHEN sum(overlap) OVER (PARTITION BY parcel_id) > 0 THEN overlap / sum(overlap) OVER (PARTITION BY parcel_id) ELSE 1e0 END AS share,
      row_number() OVER (PARTITION BY zone_id ORDER BY overlap DESC, parcel_id) AS rn FROM pairs)
    SELECT zone_id, {num('sum(gross_acres * share)', 'gross_acres', 4)}, {num('sum(value * share)', 'value', 2)}, max(CASE WHEN rn = 1 THEN built_form_key END) AS built_form_key,
      max(CASE WHEN rn = 1 THEN w.parcel_id END) AS parcel_id, {num('sum(intersection_density * share) / nullif(sum(share), 0e0)', 'intersection_density', 6)}
    FROM w JOIN parcels p ON p.parcel_id = w.parcel_id GROUP BY zone_id""",
)
def crosswalk(t: Tables):
    out = A.crosswalk(
        t.pairs, t.parcels, "parcel_id", "zone_id", "overlap", ["gross_acres", "value"], ["built_form_key"], ["intersection_density"]
    )
    return out.select(
        "zone_id", rd("gross_acres", 4).alias("gross_acres"), rd("value", 2).alias("value"), "built_form_key", "parcel_id",
        rd("intersection_density", 6).alias("intersection_density"),
    )
