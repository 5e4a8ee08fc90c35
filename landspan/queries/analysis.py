"""Analysis modules (ANA, TRN01-03, PIP, ALC01-07) over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.functions import geometry as G
from landspan.params import DEFAULTS, SQM_PER_ACRE
from landspan.plans import modules as M
from landspan.plans import transport
from landspan.queries.binding import TABLES, Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded
from landspan.queries.spatial import COVER_CTES, constraint_polygons, lot_rings

# parcel-to-parcel trips: every line links two parcels
OD_SQL = (
    "SELECT l_orderkey AS origin, l_partkey * 7 + l_suppkey AS dest, "
    "min(l_quantity / 10e0) AS network_distance_km FROM lineitem "
    "GROUP BY l_orderkey, l_partkey * 7 + l_suppkey"
)
FOOD_SQL = (
    "SELECT l_orderkey AS parcel_id, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS healthy_count, "
    "count(CASE WHEN l_returnflag <> 'A' THEN 1 END) AS unhealthy_count FROM lineitem GROUP BY l_orderkey"
)
EQUITY_SQL = (
    "SELECT o_orderkey AS parcel_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 20000e0 + o_custkey * 7 % 60000 END AS median_income, "
    "(o_orderkey % 60) * 1e0 AS rent_burden_pct, (o_custkey % 100) * 1e0 AS pct_minority, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 0e0 ELSE (o_custkey % 70) * 1e0 END AS pct_college_educated FROM orders"
)
ENV_SQL = "SELECT l_orderkey AS parcel_id, sum(l_quantity) / 100e0 AS overlap_acres FROM lineitem GROUP BY l_orderkey"


def od_table(t: Tables):
    return (
        t.lineitem.groupBy(
            F.col("l_orderkey").alias("origin"),
            (F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("dest"),
        )
        .agg(F.min(F.col("l_quantity") / 10.0).alias("network_distance_km"))
    )


def _trips(t: Tables):
    def build(wide):
        zones = wide.select(
            "parcel_id",
            F.col("trip_generation.trips_total").alias("trips"),
            M.es("employment_total").alias("emp"),
            M.es("dwelling_units_total").alias("du"),
        )
        return transport.gravity(od_table(t), zones)

    return build


def _food(t: Tables):
    healthy = F.count_if(F.col("l_returnflag") == "A")
    unhealthy = F.count_if(F.col("l_returnflag") != "A")
    return (
        t.lineitem.groupBy(F.col("l_orderkey").alias("parcel_id"))
        .agg(healthy.alias("healthy_count"), unhealthy.alias("unhealthy_count"))
        .withColumn(
            "mrfei",
            X.ratio("healthy_count", F.col("healthy_count") + F.col("unhealthy_count")) * 100.0,
        )
    )


def _equity(t: Tables):
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    raw = t.orders.select(
        ok.alias("parcel_id"),
        F.when(ok % 9 != 0, 20000.0 + ck * 7 % 60000).alias("median_income"),
        ((ok % 60) * 1.0).alias("rent_burden_pct"),
        ((ck % 100) * 1.0).alias("pct_minority"),
        F.when(ok % 4 == 0, 0.0).otherwise((ck % 70) * 1.0).alias("pct_college_educated"),
    )
    return M.acs_equity(raw, None)


def constraint_table(t: Tables):
    overlaps = t.lineitem.groupBy(F.col("l_orderkey").alias("parcel_id")).agg(
        (F.sum("l_quantity") / 100.0).alias("overlap_acres")
    )
    return M.env_constraint(t.parcels.select("parcel_id", "gross_acres"), overlaps, 40.0)


def inputs(t: Tables) -> M.Inputs:
    return M.Inputs(
        parcels=t.parcels.select(
            "parcel_id", "gross_acres", "built_form_key", "intersection_density", "x", "y"
        ),
        built_forms=t.built_forms,
        constraints=constraint_table(t).select("parcel_id", "acres_developable"),
        equity=_equity(t),
        food=_food(t),
        trips=_trips(t),
    )


P = DEFAULTS
CORE = {
    "od": OD_SQL,
    "ov": ENV_SQL,
    "env": f"""SELECT p.parcel_id, gross_acres,
        greatest(0e0, gross_acres - coalesce(overlap_acres, 0e0) * 40e0 / 100e0) AS acres_developable,
        CASE WHEN gross_acres > 0 THEN greatest(0e0, gross_acres - coalesce(overlap_acres, 0e0) * 40e0 / 100e0) / gross_acres ELSE 0e0 END AS developable_proportion
        FROM parcels p LEFT JOIN ov ON ov.parcel_id = p.parcel_id""",
    "cb": """SELECT p.*, coalesce(e.acres_developable, p.gross_acres) AS acres_developable,
        coalesce(e.acres_developable, p.gross_acres) * 100e0 / 100e0 * 85e0 / 100e0 AS applied,
        coalesce(e.acres_developable, p.gross_acres) * 100e0 / 100e0 * 85e0 / 100e0 * 100e0 / 100e0 AS acres,
        b.id, b.du_per_acre, b.emp_per_acre, b.far, b.household_size, b.vacancy_rate, b.building_coverage,
        b.irrigable_area_fraction, b.indoor_water_rate, b.outdoor_water_rate, b.electricity_eui, b.gas_eui,
        b.trip_rate_override, b.pass_by_trip_pct
        FROM parcels p LEFT JOIN env e ON e.parcel_id = p.parcel_id LEFT JOIN built_forms b ON b.key = p.built_form_key""",
    "es": """SELECT parcel_id, gross_acres, acres_developable, applied AS acres_developed, x, y, id AS built_form_id,
        (CASE WHEN du_per_acre > 0 THEN acres * du_per_acre ELSE 0e0 END) * coalesce(household_size, 2.5e0) AS population,
        (CASE WHEN du_per_acre > 0 THEN acres * du_per_acre ELSE 0e0 END) * (1e0 - coalesce(vacancy_rate, 5e0) / 100e0) AS households,
        acres * du_per_acre AS dwelling_units_total,
        CASE WHEN emp_per_acre > 0 THEN acres * emp_per_acre ELSE 0e0 END AS employment_total,
        acres * 43560e0 * far AS building_sqft_total,
        CASE WHEN du_per_acre > 0 THEN acres * 43560e0 * (1e0 - coalesce(building_coverage, 30e0) / 100e0) * coalesce(irrigable_area_fraction, 0e0) ELSE 0e0 END AS res_irrigated_sqft,
        CASE WHEN emp_per_acre > 0 THEN acres * 43560e0 * (1e0 - coalesce(building_coverage, 30e0) / 100e0) * coalesce(irrigable_area_fraction, 0e0) ELSE 0e0 END AS com_irrigated_sqft,
        coalesce(intersection_density, 0e0) AS intersection_density,
        CASE WHEN du_per_acre >= 10 THEN 'urban' WHEN du_per_acre >= 5 THEN 'compact' WHEN du_per_acre >= 1 THEN 'standard' ELSE 'rural' END AS land_dev_category,
        coalesce(indoor_water_rate, 0e0) AS indoor_water_rate, coalesce(outdoor_water_rate, 0e0) AS outdoor_water_rate,
        coalesce(electricity_eui, 0e0) AS electricity_eui, coalesce(gas_eui, 0e0) AS gas_eui,
        household_size, trip_rate_override, pass_by_trip_pct FROM cb""",
    "water": """SELECT *, ri + ro + ni + no AS total FROM (SELECT *,
        households * household_size * indoor_water_rate * 365e0 AS ri,
        res_irrigated_sqft * 0.092903e0 * outdoor_water_rate AS ro,
        employment_total * 0e0 * 365e0 AS ni, com_irrigated_sqft * 0.092903e0 * outdoor_water_rate AS no FROM es)""",
    "energy": """SELECT *, er + gr + en + gn AS total FROM (SELECT *,
        coalesce(CASE WHEN dwelling_units_total <> 0 THEN acres_developed * 43560e0 * 0.5e0 * 0.092903e0 * electricity_eui END, 0e0) AS er,
        coalesce(CASE WHEN dwelling_units_total <> 0 THEN acres_developed * 43560e0 * 0.5e0 * 0.092903e0 * gas_eui END, 0e0) AS gr,
        coalesce(building_sqft_total * 0.092903e0 * electricity_eui, 0e0) AS en,
        coalesce(building_sqft_total * 0.092903e0 * gas_eui, 0e0) AS gn FROM es)""",
    "land": """SELECT *, impervious_sqft / 43560e0 AS impervious_acres,
        CASE WHEN gross_acres > 0 THEN greatest(0e0, gross_acres - impervious_sqft / 43560e0) ELSE 0e0 END AS pervious_acres,
        CASE WHEN gross_acres > 0 THEN impervious_sqft / 43560e0 / gross_acres * 100e0 ELSE 0e0 END AS impervious_pct
        FROM (SELECT parcel_id, gross_acres, built_form_id IS NOT NULL AND acres_developed > 0 AS dev, acres_developed, land_dev_category,
        coalesce(building_sqft_total * 0.6e0, 0e0) + coalesce((dwelling_units_total * 0.5e0 + employment_total * 0.2e0) * 300e0, 0e0)
        + coalesce(acres_developed * 0.15e0 * 43560e0, 0e0) AS impervious_sqft FROM es)""",
    "trips": """SELECT *, home + other AS trips_total FROM (SELECT *, coalesce(dwelling_units_total * trip_rate_override, 0e0) AS home,
        coalesce(building_sqft_total / 1000e0 * 42.94e0, 0e0) * (1e0 - coalesce(pass_by_trip_pct, 0e0)) AS other FROM es)""",
    "pull": """SELECT origin, dest, network_distance_km AS km,
        CASE WHEN network_distance_km > 1e-10 THEN greatest(coalesce(employment_total, 0e0) + coalesce(dwelling_units_total, 0e0) * 0.5e0, 0e0) * pow(network_distance_km, -2e0) ELSE 0e0 END AS pull
        FROM od JOIN trips ON parcel_id = dest""",
    "orig": """SELECT origin, sum(pull) AS pull, sum(CASE WHEN origin = dest THEN pull ELSE 0e0 END) AS own, sum(pull * km) AS pkm FROM pull GROUP BY origin""",
    "inb": """SELECT dest, sum(pull.pull * trips_total / orig.pull) AS inbound FROM pull JOIN orig ON orig.origin = pull.origin
        JOIN trips ON parcel_id = pull.origin WHERE orig.pull > 0 AND pull.origin <> dest GROUP BY dest""",
    "td0": """SELECT t.*, CASE WHEN pull > 0 THEN trips_total * own / pull ELSE trips_total END AS trips_internal,
        CASE WHEN pull > 0 THEN trips_total * (pull - own) / pull ELSE 0e0 END AS trips_outbound,
        CASE WHEN pull > 0 THEN trips_total * pkm / pull ELSE 0e0 END AS kmsum, coalesce(inbound, 0e0) AS trips_inbound
        FROM trips t LEFT JOIN orig ON origin = parcel_id LEFT JOIN inb ON dest = parcel_id""",
    "td": "SELECT *, CASE WHEN trips_outbound > 0 THEN kmsum / trips_outbound ELSE 0e0 END AS avg_trip_length_km FROM td0",
    "util": """SELECT *, -2e0 AS ut, -1.5e0 + (intersection_density * 0.05e0 - ln(greatest(coalesce(population / nullif(gross_acres, 0e0), 0e0), 1e0)) * 0.15e0) AS uw,
        -2.5e0 + (intersection_density * 0.05e0 - ln(greatest(coalesce(population / nullif(gross_acres, 0e0), 0e0), 1e0)) * 0.15e0) AS ub FROM td""",
    "ex": """SELECT *, exp(0e0 - top) AS ea, exp(ut - top) AS et, exp(uw - top) AS ew, exp(ub - top) AS eb FROM (SELECT *, greatest(0e0, ut, uw, ub) AS top FROM util)""",
    "mc": """SELECT *, ea / (ea + et + ew + eb) AS share_auto, et / (ea + et + ew + eb) AS share_transit, ew / (ea + et + ew + eb) AS share_walk,
        eb / (ea + et + ew + eb) AS share_bike FROM ex""",
    "vmt": """SELECT *, trips_outbound * share_auto AS trips_auto, trips_outbound * share_transit AS trips_transit, trips_outbound * share_walk AS trips_walk, trips_outbound * share_bike AS trips_bike,
        trips_outbound * share_auto * avg_trip_length_km * 0.621371e0 * 1.2e0 AS vmt_total FROM mc""",
    "bwg": """SELECT e.parcel_id, coalesce((er + en) * 0.417e0 + (gr + gn) * 0.181e0, 0e0) AS energy_kg,
        CASE WHEN w.total > 0 THEN w.total / 3785411.78e0 * 3338e0 * 0.417e0 ELSE 0e0 END AS water_kg, e.population
        FROM energy e JOIN water w ON w.parcel_id = e.parcel_id""",
    "met": """SELECT *, coalesce(trips_walk * (avg_trip_length_km / 4.8e0) * 3.5e0, 0e0) AS walk_met, coalesce(trips_bike * (avg_trip_length_km / 16e0) * 6e0, 0e0) AS bike_met,
        vmt_total * 0.411e0 AS kg FROM vmt""",
    "health": """SELECT *, CASE WHEN population > 0 AND walk_met + bike_met > 0 THEN population * 0.008e0 * least((walk_met + bike_met) / 52e0 / 11.25e0, 1e0) * 0.08e0 ELSE 0e0 END AS averted,
        CASE WHEN population > 0 AND coalesce(kg, 0e0) > 0 THEN population * 0.008e0 * least(kg / 1000e0 * 1.6e-6 * 0.0062e0 * 100e0, 1e0) ELSE 0e0 END AS added FROM met""",
    "eq": f"SELECT parcel_id, coalesce(nullif(median_income, 0e0), 50000e0) AS median_income, coalesce(nullif(rent_burden_pct, 0e0), 32e0) AS rent_burden_pct, coalesce(nullif(pct_minority, 0e0), 40e0) AS pct_minority, coalesce(nullif(pct_college_educated, 0e0), 30e0) AS pct_college_educated FROM ({EQUITY_SQL})",
    "risk": """SELECT es.parcel_id, gross_acres, population, households, eq.* EXCLUDE (parcel_id),
        cast(median_income < 50000 AS int) + cast(pct_minority > 50 AS int) + cast(rent_burden_pct > 30 AS int) + cast(pct_college_educated < 25 AS int) AS score
        FROM es JOIN eq ON eq.parcel_id = es.parcel_id""",
    "sprawl": """SELECT *, coalesce((dr + lr + mixed) / 3e0 * 100e0, 0e0) AS sprawl FROM (SELECT parcel_id, gross_acres, population, dens, intersection_density, land_dev_category, employment_total,
        percent_rank() OVER (ORDER BY dens) AS dr, percent_rank() OVER (ORDER BY intersection_density) AS lr,
        CASE WHEN population > 0 AND employment_total > 0 THEN 1e0 ELSE 0e0 END AS mixed
        FROM (SELECT *, coalesce(population / nullif(gross_acres, 0e0), 0e0) AS dens FROM es))""",
}
_ORDER = list(CORE)


def sql(select: str, upto: str) -> str:
    """``select`` over the module chain up to (and including) one link."""
    chain = {n: CORE[n] for n in _ORDER[: _ORDER.index(upto) + 1]}
    return ctes("parcels", "built_forms", **chain) + select


def num(text: str, name: str, digits: int = 4) -> str:
    return f"{rds(text, digits)} AS {name}"


def nums(**columns: str) -> str:
    return ", ".join(num(v, k) for k, v in columns.items())


def same(names: str) -> str:
    return ", ".join(num(n, n) for n in names.split())


def module_table(t: Tables, name: str):
    return rounded(M.table(M.run([name], inputs(t)), name))


def module_query(name: str, key: str, select: str, upto: str):
    @query(name, sql(select, upto))
    def _run(t: Tables):
        return module_table(t, key)


@query(
    "ANA01_env_constraint",
    ctes("parcels", **COVER_CTES)
    + f""", e AS (SELECT p.parcel_id, (xmax - xmin) * (ymax - ymin) / {SQM_PER_ACRE}e0 AS gross_acres, coalesce(covered, 0e0) / {SQM_PER_ACRE}e0 AS acres FROM parcels p LEFT JOIN cov ON cov.parcel_id = p.parcel_id),
    d AS (SELECT parcel_id, gross_acres, greatest(0e0, gross_acres - acres * 80e0 / 100e0) AS acres_developable FROM e)
    SELECT parcel_id, {num('gross_acres', 'gross_acres')}, {num('acres_developable', 'acres_developable')}, {num('CASE WHEN gross_acres > 0 THEN acres_developable / gross_acres ELSE 0e0 END', 'developable_proportion')} FROM d""",
)
def env_constraint(t: Tables):
    # by priority; the first one's discount holds for the whole union
    constraints = {"wetland": 80.0, "flood": 40.0}
    lots = lot_rings(t).withColumn("gross_acres", G.acres(F.col("ring")))
    overlaps = M.constraint_overlaps(lots, constraint_polygons(t), list(constraints), 100.0)
    return rounded(M.env_constraint(lots, overlaps, next(iter(constraints.values()))))


CORE_NUMS = (
    "gross_acres acres_developable acres_developed population households dwelling_units_total "
    "employment_total building_sqft_total res_irrigated_sqft com_irrigated_sqft intersection_density"
)


@query(
    "ANA02_core_end_state",
    sql(f"SELECT parcel_id, {same(CORE_NUMS)}, land_dev_category, built_form_id FROM es", "es"),
)
def core(t: Tables):
    wide = M.run(["core"], inputs(t))
    return rounded(M.table(wide, "core").select("parcel_id", *CORE_NUMS.split(), "land_dev_category", "built_form_id"))


_INC = [m for m in M.INCREMENT_MEASURES if m in TABLES["base"].columns]


@query(
    "ANA03_core_increment",
    ctes("parcels", "built_forms", "base", **{n: CORE[n] for n in _ORDER[: _ORDER.index("es") + 1]})
    + "SELECT coalesce(e.parcel_id, b.parcel_id) AS parcel_id, e.land_dev_category, "
    + ", ".join(
        num(
            "coalesce("
            + ("e.dwelling_units_total" if m == "dwelling_units_sf_ll" else "e." + m if m not in
               ("dwelling_units_sf_sl", "dwelling_units_attached_sf", "dwelling_units_mf_2_4", "dwelling_units_mf_5p") else "0e0")
            + f", 0e0) - coalesce(b.{m}, 0e0)",
            m,
        )
        for m in _INC
    )
    + " FROM es e FULL JOIN base b ON b.parcel_id = e.parcel_id",
)
def increment(t: Tables):
    end = M.table(M.run(["core"], inputs(t)), "core")
    base = t.base.withColumns(
        {m: X.typed_null("double") for m in M.INCREMENT_MEASURES if m not in TABLES["base"].columns}
    )
    out = M.core_increment(end, base)
    return rounded(out.select("parcel_id", "land_dev_category", *_INC))


module_query(
    "ANA04_water_demand", "water_demand",
    "SELECT parcel_id, " + nums(
        gross_acres="gross_acres", acres_developed="acres_developed", water_demand_res_indoor="ri",
        water_demand_res_outdoor="ro", water_demand_nonres_indoor="ni", water_demand_nonres_outdoor="no",
        water_demand_total="total", water_demand_per_unit="CASE WHEN population + employment_total > 0 THEN total / (population + employment_total) ELSE 0e0 END",
        population="population", employment_total="employment_total", dwelling_units_total="dwelling_units_total") + " FROM water",
    "water",
)
module_query(
    "ANA05_energy_demand", "energy_demand",
    "SELECT parcel_id, " + nums(
        gross_acres="gross_acres", acres_developed="acres_developed", energy_electricity_res="er", energy_gas_res="gr",
        energy_electricity_nonres="en", energy_gas_nonres="gn", energy_total="total",
        energy_intensity_kwh_per_sqft="CASE WHEN building_sqft_total > 0 THEN total / building_sqft_total ELSE 0e0 END",
        dwelling_units_total="dwelling_units_total", building_sqft_total="building_sqft_total", population="population",
        employment_total="employment_total") + " FROM energy",
    "energy",
)
module_query(
    "ANA06_land_consumption", "land_consumption",
    "SELECT parcel_id, CASE WHEN dev THEN concat('vacant_to_', land_dev_category) ELSE 'unchanged' END AS land_use_transition, "
    "land_dev_category AS development_type, " + nums(
        acres_consumed="CASE WHEN dev THEN acres_developed ELSE 0e0 END",
        acres_preserved="CASE WHEN dev THEN greatest(0e0, gross_acres - acres_developed) ELSE gross_acres END",
        gross_acres="gross_acres", impervious_sqft="impervious_sqft", impervious_acres="impervious_acres",
        pervious_acres="pervious_acres", impervious_pct="impervious_pct") + " FROM land",
    "land",
)
_A = "CASE WHEN land_dev_category = 'rural' AND acres_developed > 0 THEN acres_developed ELSE 0e0 END"
module_query(
    "ANA07_agriculture", "agriculture",
    "SELECT parcel_id, 'general_agriculture' AS crop_type, " + nums(
        acres_cultivated="a", crop_yield_tons="a * 8e0", market_value="a * 8e0 * 200e0", production_cost="a * 800e0",
        net_return="a * 8e0 * 200e0 - a * 800e0", water_consumption_af="a * 3e0", labor_hours="a * 15e0", truck_trips="a * 2e0")
    + f" FROM (SELECT parcel_id, {_A} AS a FROM es) WHERE a > 0",
    "es",
)
_RV = "12e0 * 0.9e0 * (0.05e0 + impervious_pct * 0.009e0) * gross_acres / 12e0"
module_query(
    "ANA08_stormwater_runoff", "stormwater_runoff",
    "SELECT parcel_id, " + nums(
        impervious_acres="impervious_acres", impervious_pct="impervious_pct", runoff_coefficient="0.05e0 + impervious_pct * 0.009e0",
        runoff_volume_acre_ft=_RV, runoff_baseline_acre_ft=_RV, runoff_change_acre_ft="0e0", runoff_change_pct="0e0") + " FROM land",
    "land",
)
module_query(
    "ANA09_tree_canopy", "tree_canopy",
    "SELECT parcel_id, " + nums(
        gross_acres="gross_acres", population="population", households="households", canopy_pct="c",
        surface_temp_f="95e0 - c / 10e0", heat_exposure_score="greatest(0e0, 100e0 - c * 4e0)")
    + " FROM (SELECT *, CASE land_dev_category WHEN 'compact' THEN 25e0 WHEN 'urban' THEN 15e0 WHEN 'standard' THEN 30e0 WHEN 'rural' THEN 45e0 ELSE 20e0 END AS c FROM es)",
    "es",
)
module_query(
    "ANA10_trip_generation", "trip_generation",
    "SELECT parcel_id, " + nums(
        gross_acres="gross_acres", trips_total="trips_total", trips_res="home", trips_nonres="other", trips_hbw="trips_total * 0.18e0",
        trips_hbo="trips_total * 0.42e0", trips_nhb="trips_total * 0.4e0") + " FROM trips",
    "trips",
)
module_query(
    "TRN01_trip_distribution", "trip_distribution",
    "SELECT parcel_id, " + same("trips_outbound trips_inbound trips_internal avg_trip_length_km") + " FROM td",
    "td",
)
module_query(
    "TRN03_mode_choice", "mode_choice",
    "SELECT parcel_id, " + same("trips_auto trips_transit trips_walk trips_bike share_auto share_transit share_walk share_bike") + " FROM vmt",
    "vmt",
)
module_query(
    "ANA11_vmt", "vmt",
    "SELECT parcel_id, " + nums(
        vmt_total="vmt_total", vmt_per_capita="CASE WHEN population > 0 THEN vmt_total / population ELSE 0e0 END",
        auto_trips="trips_auto", avg_trip_length_mi="avg_trip_length_km * 0.621371e0") + " FROM vmt",
    "vmt",
)
_AREA = ((2000.0, 2000.0), (30000.0, 1000.0), (34000.0, 3000.0), (5000.0, 12000.0))


def _ring_sql(ring) -> str:
    """Even-odd test of (x, y) as a sum over the edges."""
    terms = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        terms.append(
            f"(CASE WHEN ({ay!r}e0 > y) <> ({by!r}e0 > y) AND x < ({bx!r}e0 - {ax!r}e0) * (y - {ay!r}e0) / ({by!r}e0 - {ay!r}e0) + {ax!r}e0 THEN 1 ELSE 0 END)"
        )
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query(
    "ANA12_internal_capture",
    sql(
        f""", f AS (SELECT *, {_ring_sql(_AREA)} AS inside FROM td),
        a AS (SELECT count(CASE WHEN inside THEN 1 END) * 1e0 / count(*) AS fr, CASE WHEN count(CASE WHEN inside THEN 1 END) > 0 THEN sqrt(count(CASE WHEN inside THEN 1 END) * 1e0 / count(*)) * 10e0 ELSE 1e0 END AS radius FROM f),
        c AS (SELECT f.*, CASE WHEN NOT inside THEN 0e0 WHEN trips_total = 0 THEN 1e0 ELSE least(1e0, fr * exp(-0.15e0 * (avg_trip_length_km / nullif(radius, 0e0)))) END AS cap FROM f, a)
        SELECT parcel_id, """
        + nums(trips_internal="trips_internal + trips_outbound * cap", internal_capture_pct="cap",
               trips_external="greatest(0e0, trips_total - (trips_internal + trips_outbound * cap))") + " FROM c",
        "td",
    ),
)
def internal_capture(t: Tables):
    wide = M.run(["internal_capture"], inputs(t), DEFAULTS.with_(transport_study_area=_AREA))
    return rounded(M.table(wide, "internal_capture"))


module_query(
    "ANA13_transport_ghg", "transport_ghg",
    "SELECT parcel_id, " + nums(
        co2e_total_kg="kg", co2e_per_capita_kg="CASE WHEN population > 0 THEN kg / population ELSE 0e0 END", vmt_total="vmt_total",
        avg_trip_length_mi="avg_trip_length_km * 0.621371e0", auto_trips="trips_auto") + " FROM met",
    "met",
)
module_query(
    "ANA14_building_water_ghg", "building_water_ghg",
    "SELECT parcel_id, " + nums(
        co2e_energy_total_kg="energy_kg", co2e_water_total_kg="water_kg", co2e_total_kg="energy_kg + water_kg",
        co2e_per_capita_kg="CASE WHEN population > 0 THEN (energy_kg + water_kg) / population ELSE 0e0 END") + " FROM bwg",
    "bwg",
)
_GHG = nums(co2e_transport="coalesce(kg, 0e0)", co2e_buildings="coalesce(energy_kg, 0e0)", co2e_water="coalesce(water_kg, 0e0)",
            co2e_total="coalesce(kg, 0e0) + coalesce(energy_kg + water_kg, 0e0)")
module_query(
    "ANA15_total_ghg", "total_ghg",
    f"SELECT met.parcel_id, {_GHG} FROM met JOIN bwg ON bwg.parcel_id = met.parcel_id", "met",
)


@query(
    "JOI03_full_outer",
    sql(f"SELECT coalesce(m.parcel_id, b.parcel_id) AS parcel_id, {_GHG} FROM (SELECT parcel_id + 50 AS parcel_id, kg FROM met) m FULL JOIN bwg b ON b.parcel_id = m.parcel_id", "met"),
)
def full_outer(t: Tables):
    wide = M.run(["total_ghg"], inputs(t))
    transport_side = M.table(wide, "transport_ghg").withColumn("parcel_id", F.col("parcel_id") + 50)
    return rounded(M.total_ghg_tables(transport_side, M.table(wide, "building_water_ghg")))


module_query(
    "ANA16_physical_activity", "physical_activity",
    "SELECT parcel_id, " + nums(
        walk_met_hours="walk_met", bike_met_hours="bike_met", total_met_hours="walk_met + bike_met", walk_trips="trips_walk", bike_trips="trips_bike",
        active_trip_share="coalesce((trips_walk + trips_bike) / nullif(trips_walk + trips_bike + (trips_auto + trips_transit), 0e0), 0e0)") + " FROM met",
    "met",
)
module_query(
    "ANA17_health_impacts", "health_impacts",
    "SELECT parcel_id, " + nums(
        dalys_averted_pa="averted * 1.625e0", dalys_added_air_quality="added * 1.625e0",
        net_dalys="CASE WHEN population > 0 THEN (averted - added) * 1.625e0 ELSE 0e0 END",
        deaths_averted_pa="averted", deaths_added_air_quality="added") + " FROM health",
    "health",
)


@query(
    "ANA18_food_access",
    sql(
        f""", f AS (SELECT *, healthy_count * 1e0 / nullif(healthy_count + unhealthy_count, 0) * 100e0 AS m FROM ({FOOD_SQL}))
        SELECT es.parcel_id, {same('gross_acres population households')}, coalesce(healthy_count, 0) AS healthy_count, coalesce(unhealthy_count, 0) AS unhealthy_count,
        {num('m', 'mrfei')}, coalesce(m < 25, false) AS food_desert,
        CASE WHEN m < 25 THEN 'food_desert' WHEN m < 50 THEN 'low_access' WHEN m < 75 THEN 'moderate_access' WHEN m >= 75 THEN 'high_access' END AS food_access_category
        FROM es LEFT JOIN f ON f.parcel_id = es.parcel_id""",
        "es",
    ),
)
def food_access(t: Tables):
    return module_table(t, "food_access")


module_query(
    "ANA20_sprawl_index", "sprawl_index",
    "SELECT parcel_id, land_dev_category, " + nums(
        gross_acres="gross_acres", population="population", population_density="dens", intersection_density="intersection_density",
        employment_total="employment_total", density_score="dr", connectivity_score="lr", mixed_use_score="mixed", sprawl_index="sprawl") + " FROM sprawl",
    "sprawl",
)
_HC = "households * 0.3e0 / nullif(households, 0e0) * 100e0"
module_query(
    "ANA21_housing_cost_burden", "housing_cost_burden",
    "SELECT parcel_id, " + nums(
        gross_acres="gross_acres", population="population", households="households", dwelling_units_total="dwelling_units_total",
        cost_burdened_hh="coalesce(households * 0.3e0, 0e0)", severely_cost_burdened_hh="coalesce(households * 0.5e0, 0e0)",
        cost_burden_pct=f"coalesce({_HC}, 0e0)")
    + f", CASE WHEN coalesce(households, 0e0) = 0 THEN 'low_burden' WHEN {_HC} < 30 THEN 'low_burden' WHEN {_HC} <= 50 THEN 'cost_burdened' ELSE 'severely_cost_burdened' END AS cost_burden_category FROM es",
    "es",
)
_RISK = "CASE WHEN score = 0 THEN 'stable' WHEN score <= 2 THEN 'vulnerable' WHEN score = 3 THEN 'at_risk' ELSE 'displacement_pressure' END AS displacement_risk_category"
module_query(
    "ANA23_displacement_risk", "displacement_risk",
    f"SELECT parcel_id, {same('gross_acres population households median_income rent_burden_pct pct_minority pct_college_educated')}, score AS vulnerability_score, {_RISK} FROM risk",
    "risk",
)
module_query(
    "ANA24_displacement_risk_dynamic", "displacement_risk_dynamic",
    f"SELECT parcel_id, {same('gross_acres population households')}, score AS vulnerability_score, {_RISK}, 'same' AS risk_change_vs_base, 0 AS vulnerability_change FROM risk",
    "risk",
)
_TAX = "coalesce((dwelling_units_total * 350000e0 + building_sqft_total * 150e0) * 1e0 / 100e0, 0e0)"
_SALES = "coalesce(employment_total * 15e0 / 100e0 * 100000e0 * 1e0 / 100e0, 0e0)"
_COST = "coalesce(dwelling_units_total * 5000e0, 0e0) + coalesce(population * 2000e0, 0e0) + coalesce(employment_total * 1500e0, 0e0)"
module_query(
    "ANA25_fiscal_property_tax", "fiscal_property_tax",
    "SELECT parcel_id, " + nums(assessed_value_res="coalesce(dwelling_units_total * 350000e0, 0e0)",
                                assessed_value_nonres="coalesce(building_sqft_total * 150e0, 0e0)", property_tax_revenue=_TAX) + " FROM es", "es",
)
module_query(
    "ANA26_fiscal_sales_tax", "fiscal_sales_tax",
    "SELECT parcel_id, " + nums(retail_sales="coalesce(employment_total * 15e0 / 100e0 * 100000e0, 0e0)", sales_tax_revenue=_SALES) + " FROM es", "es",
)
module_query(
    "ANA27_fiscal_service_costs", "fiscal_service_costs",
    "SELECT parcel_id, " + nums(service_cost_schools="coalesce(dwelling_units_total * 5000e0, 0e0)", service_cost_public_safety="coalesce(population * 2000e0, 0e0)",
                                service_cost_roads="coalesce(employment_total * 1500e0, 0e0)", service_cost_total=_COST) + " FROM es", "es",
)
module_query(
    "ANA28_fiscal_net_impact", "fiscal_net_impact",
    "SELECT parcel_id, " + nums(property_tax_revenue=_TAX, sales_tax_revenue=_SALES, service_cost_total=_COST,
                                net_fiscal_impact=f"{_TAX} + {_SALES} - ({_COST})") + " FROM es", "es",
)


@query(
    "JOI04_chained_full_outer",
    sql(
        f""", a AS (SELECT parcel_id, {_TAX} AS v FROM es), b AS (SELECT parcel_id + 20 AS parcel_id, {_SALES} AS v FROM es), c AS (SELECT parcel_id + 40 AS parcel_id, {_COST} AS v FROM es),
        u AS (SELECT parcel_id, v AS tax, NULL AS sales, NULL AS cost FROM a UNION ALL SELECT parcel_id, NULL, v, NULL FROM b UNION ALL SELECT parcel_id, NULL, NULL, v FROM c),
        g AS (SELECT parcel_id, coalesce(max(tax), 0e0) AS tax, coalesce(max(sales), 0e0) AS sales, coalesce(max(cost), 0e0) AS cost FROM u GROUP BY parcel_id)
        SELECT parcel_id, """ + nums(property_tax_revenue="tax", sales_tax_revenue="sales", service_cost_total="cost", net_fiscal_impact="tax + sales - cost") + " FROM g",
        "es",
    ),
)
def chained_full_outer(t: Tables):
    wide = M.run(["fiscal_net_impact"], inputs(t))

    def shifted(name: str, by: int):
        return M.table(wide, name).withColumn("parcel_id", F.col("parcel_id") + by)

    return rounded(
        M.fiscal_net_tables(
            shifted("fiscal_property_tax", 0), shifted("fiscal_sales_tax", 20), shifted("fiscal_service_costs", 40)
        )
    )


module_query(
    "ANA29_vmt_fee", "vmt_fee",
    "SELECT parcel_id, " + nums(gross_acres="gross_acres", population="population", households="households", vmt_total="vmt_total",
                                fee_rate_dollars_per_vmt="295e0", vmt_exempt="0e0", fee_revenue_total="round(vmt_total * 295e0, 2)",
                                revenue_forgone="0e0", net_revenue="round(vmt_total * 295e0, 2)") + " FROM vmt",
    "vmt",
)
module_query(
    "ANA30_sprawl_cost", "sprawl_cost",
    "SELECT parcel_id, " + nums(gross_acres="gross_acres", population="population", households="households", dwelling_units_total="dwelling_units_total",
                                infrastructure_cost_per_du_annual="15000e0", capital_cost_per_du="50000e0",
                                infrastructure_cost_annual="round(dwelling_units_total * 15000e0, 2)", capital_cost="round(dwelling_units_total * 50000e0, 2)",
                                infrastructure_cost_per_hh_annual="round((round(dwelling_units_total * 15000e0, 2) + round(dwelling_units_total * 50000e0, 2) / 30e0) / nullif(households, 0e0), 2)")
    + " FROM es",
    "es",
)


@query(
    "ANA31_scenario_summary",
    sql(
        """, s1 AS (SELECT sum(population) AS pop, sum(households) AS hh, sum(dwelling_units_total) AS du, sum(employment_total) AS emp FROM es),
        s2 AS (SELECT sum(vmt_total) AS vmt, sum(kg) AS kg, sum(CASE WHEN population > 0 THEN (averted - added) * 1.625e0 ELSE 0e0 END) AS dalys FROM health),
        s3 AS (SELECT sum(energy_kg + water_kg) AS kg FROM bwg),
        s4 AS (SELECT sum(total) / 1233481.84e0 AS af FROM water), s5 AS (SELECT sum(total) / 1000e0 AS mwh FROM energy),
        s6 AS (SELECT sum(CASE WHEN dev THEN acres_developed ELSE 0e0 END) AS acres, avg(CASE WHEN gross_acres > 0 THEN impervious_pct END) AS pct FROM land),
        s7 AS (SELECT avg(coalesce(households * 0.3e0 / nullif(households, 0e0) * 100e0, 0e0)) AS burden FROM es),
        s8 AS (SELECT avg(sprawl) AS sprawl FROM sprawl),
        s9 AS (SELECT count(CASE WHEN score >= 3 THEN 1 END) * 100e0 / count(*) AS risk FROM risk)
        SELECT 'blueprint' AS scenario_id, """
        + nums(total_population="pop", total_households="hh", dwelling_units_total="du", total_employment="emp")
        + ", " + num("vmt", "vmt_total", 2) + ", " + num("vmt / pop", "vmt_per_capita", 2)
        + ", " + num("s2.kg + s3.kg", "co2e_total_kg", 2) + ", " + num("(s2.kg + s3.kg) / pop", "co2e_per_capita_kg", 2)
        + ", " + num("burden", "cost_burdened_hh_pct", 1) + ", " + num("sprawl", "avg_sprawl_index", 2)
        + ", " + num("af", "water_demand_total_af", 2) + ", " + num("mwh", "energy_demand_total_mwh", 2)
        + ", " + num("acres", "land_consumed_acres", 2) + ", " + num("pct", "land_consumed_pct", 1)
        + ", " + num("dalys", "net_dalys", 2) + ", " + num("risk", "displacement_risk_pct", 1)
        + " FROM s1, s2, s3, s4, s5, s6, s7, s8, s9",
        "sprawl",
    ),
)
def scenario_summary(t: Tables):
    out = M.scenario_summary(M.run(M.SUMMARY_NEEDS, inputs(t)))
    four = {"total_population", "total_households", "dwelling_units_total", "total_employment"}
    return out.select(
        "scenario_id", *[rd(c, 4 if c in four else 2).alias(c) for c in out.columns[1:]]
    )


@query(
    "PIP01_scenario_run",
    sql(
        "SELECT v.parcel_id, " + nums(vmt_total="v.vmt_total", co2e_total="coalesce(v.kg, 0e0) + coalesce(energy_kg + water_kg, 0e0)",
                                      net_fiscal_impact=f"{_TAX} + {_SALES} - ({_COST})".replace("dwelling_units_total", "v.dwelling_units_total").replace("building_sqft_total", "v.building_sqft_total").replace("employment_total", "v.employment_total").replace("population", "v.population"))
        + " FROM met v JOIN bwg ON bwg.parcel_id = v.parcel_id", "met",
    ),
)
def scenario_run(t: Tables):
    wide = M.run(["vmt", "total_ghg", "fiscal_net_impact"], inputs(t))
    return rounded(wide.select("parcel_id", "vmt.vmt_total", "total_ghg.co2e_total", "fiscal_net_impact.net_fiscal_impact"))


@query(
    "PIP02_preflight",
    "SELECT 'built_forms: column vintage not found' AS problem UNION ALL SELECT 'constraints: table not found' "
    "FROM (SELECT count(*) AS n FROM orders) WHERE n > 0",
)
def preflight(t: Tables):
    problems = M.preflight(
        {"parcels": t.parcels, "built_forms": t.built_forms, "constraints": None},
        {"parcels": ["parcel_id", "gross_acres"], "built_forms": ["key", "vintage"], "constraints": ["geometry"]},
    )
    return t.spark.createDataFrame([(x,) for x in problems], "problem string")


@query(
    "ALC01_07_allocation_formulas",
    ctes("parcels", "built_forms")
    + "SELECT parcel_id, " + nums(
        applied_acres="a", dwelling_units="a * du_per_acre", population="a * du_per_acre * household_size",
        households="a * du_per_acre * (1e0 - vacancy_rate / 100e0)", employment="a * emp_per_acre", floor_area="a * 43560e0 * far")
    + ", CASE WHEN du_per_acre >= 10 THEN 'urban' WHEN du_per_acre >= 5 THEN 'compact' WHEN du_per_acre >= 1 THEN 'standard' ELSE 'rural' END AS land_dev_category "
    "FROM (SELECT *, gross_acres * 80e0 / 100e0 * 75e0 / 100e0 AS a FROM parcels LEFT JOIN built_forms ON key = built_form_key)",
)
def allocation_formulas(t: Tables):
    bf = t.built_forms.withColumnRenamed("key", "built_form_key")
    units = X.dwelling_units("a", "du_per_acre")
    out = t.parcels.join(bf, "built_form_key", "left").withColumn("a", X.applied_acres("gross_acres", F.lit(80.0), F.lit(75.0)))
    return rounded(
        out.select(
            "parcel_id",
            F.col("a").alias("applied_acres"),
            units.alias("dwelling_units"),
            X.population(units, "household_size").alias("population"),
            X.households(units, "vacancy_rate").alias("households"),
            X.employment("a", "emp_per_acre").alias("employment"),
            X.floor_area("a", "far").alias("floor_area"),
            X.land_dev_category("du_per_acre").alias("land_dev_category"),
        )
    )
