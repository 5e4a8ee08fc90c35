"""Analysis modules as struct columns on one wide parcel row.

Every module that is a pure function of a parcel adds one struct column to the
wide row, so a whole scenario run is a single scan with no join and no shuffle;
Catalyst drops the struct fields nobody reads.  Only the modules that need other
parcels (trip distribution, percent ranks, area totals) shuffle.

``run`` resolves prerequisites and composes the wide row; ``table`` turns one
module's struct back into its own table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.functions import geometry as G
from landspan.operators import overlay, ranking
from landspan.params import (
    DEFAULTS,
    KWH_PER_MWH,
    LITERS_PER_ACRE_FOOT,
    SQFT_PER_ACRE,
    SQFT_TO_SQM,
    SQM_PER_ACRE,
    Params,
)


@dataclass
class Inputs:
    """Tables a scenario run may read, all keyed by ``parcel_id``."""

    parcels: DataFrame
    built_forms: DataFrame
    constraints: DataFrame | None = None  # parcel_id, acres_developable
    base_canvas: DataFrame | None = None
    equity: DataFrame | None = None
    trips: Callable[[DataFrame], DataFrame] | None = None
    food: DataFrame | None = None


@dataclass(frozen=True)
class Module:
    name: str
    needs: tuple[str, ...]
    build: Callable[[DataFrame, Inputs, Params], DataFrame] = field(compare=False)


MODULES: dict[str, Module] = {}


def module(name: str, *needs: str):
    def keep(fn):
        MODULES[name] = Module(name, needs, fn)
        return fn

    return keep


def row_module(name: str, *needs: str):
    """A module whose outputs are expressions over the same wide row."""

    def keep(fn):
        def build(wide: DataFrame, _inputs: Inputs, p: Params) -> DataFrame:
            return wide.withColumn(name, pack(fn(p)))

        MODULES[name] = Module(name, needs, build)
        return fn

    return keep


def pack(columns: Mapping[str, Column]) -> Column:
    return F.struct(*[X.c(v).alias(k) for k, v in columns.items()])


def es(name: str) -> Column:
    return F.col("core_end_state." + name)


# --- core --------------------------------------------------------------------

# Uses whose floor area an untouched parcel reports as 0.
ZERO_SQFT = (
    "residential", "commercial", "office", "industrial", "public", "retail", "wholesale", "education",
    "healthcare", "hotel_lodging", "entertainment", "other",
)
INCREMENT_MEASURES = (
    [
        "dwelling_units_total", "dwelling_units_sf_ll", "dwelling_units_sf_sl",
        "dwelling_units_attached_sf", "dwelling_units_mf_2_4", "dwelling_units_mf_5p",
        "population", "households", "employment_total", "building_sqft_total",
    ]
    + ["building_sqft_" + s for s in ZERO_SQFT]
    + [
        "res_irrigated_sqft", "com_irrigated_sqft", "parcel_acres_developed",
        "parcel_acres_agriculture", "parcel_acres_open_space", "parcel_acres_vacant",
        "intersection_density",
    ]
)


def constraint_overlaps(parcels: DataFrame, constraints: DataFrame, types: Sequence[str], cell: float) -> DataFrame:
    """ANA01: (parcel_id, overlap_acres) of the union of the constraint polygons of the given types.

    ``parcels``: parcel_id and ring; ``constraints``: constraint_type and ring, of any shape.
    """
    wanted = constraints.where(F.col("constraint_type").isin(list(types)))
    found = overlay.covered(parcels.select("parcel_id", "ring"), wanted, ["parcel_id"], cell)
    return found.select("parcel_id", (F.col("covered") / SQM_PER_ACRE).alias("overlap_acres"))


def env_constraint(parcels: DataFrame, overlaps: DataFrame | None, discount_pct: float) -> DataFrame:
    """ANA01: developable acres after a discount on the constrained overlap.

    ``overlaps`` holds (parcel_id, overlap_acres), the area of the union of all
    constraint polygons inside each parcel (see ``constraint_overlaps``).
    """
    if overlaps is None:
        joined = parcels.withColumn("overlap_acres", F.lit(0.0))
    else:
        joined = parcels.join(overlaps.select("parcel_id", "overlap_acres"), "parcel_id", "left")
    left = X.non_negative(F.col("gross_acres") - X.or_zero("overlap_acres") * discount_pct / 100.0)
    return joined.select(
        "parcel_id",
        "gross_acres",
        left.alias("acres_developable"),
        F.when(F.col("gross_acres") > 0, left / F.col("gross_acres"))
        .otherwise(0.0)
        .alias("developable_proportion"),
    )


@module("core")
def core_end_state(wide: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    """ANA02.  Parcels and built forms meet on the built-form key.

    The built-form table is a dimension; no broadcast hint is given, so Spark
    broadcasts it only when its measured size is below the threshold.
    """
    bf = inputs.built_forms.select(
        F.col("key").alias("bf_key"), F.struct(*inputs.built_forms.columns).alias("bf")
    )
    wide = wide.join(bf, F.col("built_form_key") == F.col("bf_key"), "left").drop("bf_key")
    if inputs.constraints is not None:
        wide = wide.join(
            inputs.constraints.select(
                "parcel_id", F.col("acres_developable").alias("_developable")
            ),
            "parcel_id",
            "left",
        )
    else:
        wide = wide.withColumn("_developable", X.typed_null("double"))
    developable = F.coalesce("_developable", "gross_acres")
    wide = wide.withColumn("_applied", X.applied_acres(developable, p.dev_pct, p.gross_net_pct))
    acres = F.col("_applied") * p.density_pct / 100.0
    du_rate, emp_rate = F.col("bf.du_per_acre"), F.col("bf.emp_per_acre")
    residential, working = X.positive(du_rate), X.positive(emp_rate)
    units = X.dwelling_units(acres, du_rate)
    used_units = F.when(residential, units).otherwise(0.0)
    irrigated = (
        acres
        * SQFT_PER_ACRE
        * (1.0 - F.coalesce("bf.building_coverage", F.lit(30.0)) / 100.0)
        * X.or_zero("bf.irrigable_area_fraction")
    )
    out: dict[str, Column] = {
        "gross_acres": F.col("gross_acres"),
        "acres_developable": developable,
        "acres_developed": F.col("_applied"),
        "population": X.population(used_units, F.coalesce("bf.household_size", F.lit(2.5))),
        "households": X.households(used_units, F.coalesce("bf.vacancy_rate", F.lit(5.0))),
        "dwelling_units_sf_ll": units,
        "dwelling_units_sf_sl": 0.0,
        "dwelling_units_attached_sf": 0.0,
        "dwelling_units_mf_2_4": 0.0,
        "dwelling_units_mf_5p": 0.0,
        "dwelling_units_total": units,
        "employment_total": F.when(working, X.employment(acres, emp_rate)).otherwise(0.0),
        "building_sqft_total": X.floor_area(acres, F.col("bf.far")),
    }
    out |= {"building_sqft_" + s: 0.0 for s in ZERO_SQFT}
    out |= {
        "res_irrigated_sqft": F.when(residential, irrigated).otherwise(0.0),
        "com_irrigated_sqft": F.when(working, irrigated).otherwise(0.0),
        "parcel_acres_developed": F.col("_applied"),
        "parcel_acres_agriculture": 0.0,
        "parcel_acres_open_space": 0.0,
        "parcel_acres_vacant": 0.0,
        "intersection_density": X.or_zero("intersection_density"),
        "land_dev_category": X.land_dev_category(du_rate),
        "built_form_id": F.col("bf.id"),
        "indoor_water_rate": X.or_zero("bf.indoor_water_rate"),
        "outdoor_water_rate": X.or_zero("bf.outdoor_water_rate"),
        "electricity_eui": X.or_zero("bf.electricity_eui"),
        "gas_eui": X.or_zero("bf.gas_eui"),
        "household_size": F.col("bf.household_size"),
        "trip_rate": F.col("bf.trip_rate_override"),
        "pass_by_pct": F.col("bf.pass_by_trip_pct"),
        "x": F.col("x"),
        "y": F.col("y"),
    }
    return wide.select("parcel_id", pack(out).alias("core_end_state"))


def core_increment(end_state: DataFrame, base: DataFrame) -> DataFrame:
    """ANA03: end state minus base canvas over the full outer join."""
    e, b = end_state.alias("e"), base.alias("b")
    return e.join(b, F.col("e.parcel_id") == F.col("b.parcel_id"), "full").select(
        F.coalesce("e.parcel_id", "b.parcel_id").alias("parcel_id"),
        F.col("b.gross_acres"),
        F.col("e.acres_developable"),
        F.col("e.acres_developed"),
        F.col("e.land_dev_category"),
        *X.deltas("e", "b", INCREMENT_MEASURES),
    )


# --- demand ------------------------------------------------------------------


@row_module("water_demand", "core")
def water_demand(p: Params) -> dict[str, Column]:
    """ANA04: litres per year."""
    res_in = es("households") * es("household_size") * es("indoor_water_rate") * 365.0
    res_out = es("res_irrigated_sqft") * SQFT_TO_SQM * es("outdoor_water_rate")
    job_in = es("employment_total") * p.nonres_indoor_water_rate * 365.0
    job_out = es("com_irrigated_sqft") * SQFT_TO_SQM * es("outdoor_water_rate")
    total = res_in + res_out + job_in + job_out
    users = es("population") + es("employment_total")
    return {
        "gross_acres": es("gross_acres"),
        "acres_developed": es("acres_developed"),
        "water_demand_res_indoor": res_in,
        "water_demand_res_outdoor": res_out,
        "water_demand_nonres_indoor": job_in,
        "water_demand_nonres_outdoor": job_out,
        "water_demand_total": total,
        "water_demand_per_unit": F.when(users > 0, total / users).otherwise(0.0),
        "population": es("population"),
        "employment_total": es("employment_total"),
        "dwelling_units_total": es("dwelling_units_total"),
    }


@row_module("energy_demand", "core")
def energy_demand(p: Params) -> dict[str, Column]:
    """ANA05: residential floor area from acres and FAR, the rest from sqft (kWh)."""
    home_m2 = es("acres_developed") * SQFT_PER_ACRE * p.res_far_default * SQFT_TO_SQM
    work_m2 = es("building_sqft_total") * SQFT_TO_SQM
    has_homes = F.nullif(es("dwelling_units_total"), F.lit(0.0)).isNotNull()

    def home(eui: str) -> Column:
        return X.or_zero(F.when(has_homes, home_m2 * es(eui)))

    parts = {
        "energy_electricity_res": home("electricity_eui"),
        "energy_gas_res": home("gas_eui"),
        "energy_electricity_nonres": X.or_zero(work_m2 * es("electricity_eui")),
        "energy_gas_nonres": X.or_zero(work_m2 * es("gas_eui")),
    }
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    sqft = es("building_sqft_total")
    return {
        "gross_acres": es("gross_acres"),
        "acres_developed": es("acres_developed"),
        **parts,
        "energy_total": total,
        "energy_intensity_kwh_per_sqft": F.when(sqft > 0, total / sqft).otherwise(0.0),
        "dwelling_units_total": es("dwelling_units_total"),
        "building_sqft_total": sqft,
        "population": es("population"),
        "employment_total": es("employment_total"),
    }


@row_module("land_consumption", "core")
def land_consumption(p: Params) -> dict[str, Column]:
    """ANA06: what was built on, what stays, and the sealed surface."""
    developed = es("built_form_id").isNotNull() & X.positive(es("acres_developed"))
    gross, category = es("gross_acres"), es("land_dev_category")
    sealed = (
        X.or_zero(es("building_sqft_total") * p.ground_coverage_factor)
        + X.or_zero(
            (
                es("dwelling_units_total") * p.parking_per_unit
                + es("employment_total") * p.parking_per_employee
            )
            * p.parking_space_sqft
        )
        + X.or_zero(es("acres_developed") * p.row_fraction * SQFT_PER_ACRE)
    )
    sealed_acres = sealed / SQFT_PER_ACRE
    known = category.isin("urban", "compact", "standard", "rural")
    return {
        "land_use_transition": X.ladder(
            [
                (developed & known, F.concat(F.lit("vacant_to_"), category)),
                (developed, "vacant_to_developed"),
            ],
            "unchanged",
        ),
        "acres_consumed": F.when(developed, es("acres_developed")).otherwise(0.0),
        "acres_preserved": F.when(
            developed, X.non_negative(gross - es("acres_developed"))
        ).otherwise(gross),
        "development_type": F.coalesce(category, F.lit("undeveloped")),
        "gross_acres": gross,
        "impervious_sqft": sealed,
        "impervious_acres": sealed_acres,
        "pervious_acres": F.when(gross > 0, X.non_negative(gross - sealed_acres)).otherwise(0.0),
        "impervious_pct": F.when(gross > 0, sealed_acres / gross * 100.0).otherwise(0.0),
    }


def cultivated_acres() -> Column:
    farmed = es("parcel_acres_agriculture")
    rural = (es("land_dev_category") == "rural") & (es("acres_developed") > 0)
    return X.ladder([(farmed > 0, farmed), (rural, es("acres_developed"))], 0.0)


@row_module("agriculture", "core")
def agriculture(p: Params) -> dict[str, Column]:
    """ANA07: every measure is a rate on the cultivated acres (0 where none)."""
    acres = cultivated_acres()
    value = acres * p.crop_yield_per_acre * p.crop_market_price_per_ton
    cost = acres * p.crop_production_cost_per_acre
    return {
        "crop_type": F.lit("general_agriculture"),
        "acres_cultivated": acres,
        "crop_yield_tons": acres * p.crop_yield_per_acre,
        "market_value": value,
        "production_cost": cost,
        "net_return": value - cost,
        "water_consumption_af": acres * p.crop_water_per_acre_af,
        "labor_hours": acres * p.crop_labor_hours_per_acre,
        "truck_trips": acres * p.crop_truck_trips_per_acre,
    }


@row_module("stormwater_runoff", "land_consumption")
def stormwater_runoff(p: Params) -> dict[str, Column]:
    """ANA08: Simple Method against a baseline without sealed surface change."""
    pct, gross = F.col("land_consumption.impervious_pct"), F.col("land_consumption.gross_acres")
    baseline_pct = X.non_negative(pct)  # baseline impervious acres are 0

    def coefficient(share: Column) -> Column:
        return 0.05 + share * 0.009

    def volume(share: Column) -> Column:
        return p.stormwater_annual_precipitation_in * 0.9 * coefficient(share) * gross / 12.0

    change = volume(pct) - volume(baseline_pct)
    return {
        "impervious_acres": F.col("land_consumption.impervious_acres"),
        "impervious_pct": pct,
        "runoff_coefficient": coefficient(pct),
        "runoff_volume_acre_ft": volume(pct),
        "runoff_baseline_acre_ft": volume(baseline_pct),
        "runoff_change_acre_ft": change,
        "runoff_change_pct": F.when(
            volume(baseline_pct) > 0, change / volume(baseline_pct) * 100.0
        ).otherwise(0.0),
    }


# Canopy percent by land development category, and for the rest.
CANOPY_PCT = {"compact": 25.0, "urban": 15.0, "standard": 30.0, "rural": 45.0}
CANOPY_PCT_OTHER = 20.0


@row_module("tree_canopy", "core")
def tree_canopy(p: Params) -> dict[str, Column]:
    """ANA09."""
    canopy = X.ladder(
        [(es("land_dev_category") == k, v) for k, v in CANOPY_PCT.items()], CANOPY_PCT_OTHER
    )
    return {
        "gross_acres": es("gross_acres"),
        "population": es("population"),
        "households": es("households"),
        "canopy_pct": canopy,
        "surface_temp_f": F.round(
            p.tree_canopy_baseline_temp - canopy / 10.0 * p.tree_canopy_temp_per_10pct, 1
        ),
        "heat_exposure_score": F.round(X.non_negative(100.0 - canopy * 4.0), 1),
    }


# --- transport ---------------------------------------------------------------


@row_module("trip_generation", "core")
def trip_generation(p: Params) -> dict[str, Column]:
    """ANA10: home trips per unit, other trips per 1000 sqft less pass-by."""
    home = X.or_zero(es("dwelling_units_total") * es("trip_rate"))
    pass_by = F.coalesce(es("pass_by_pct"), F.lit(p.transport_pass_by_pct))
    other = X.or_zero(es("building_sqft_total") / 1000.0 * p.transport_nonres_trip_rate) * (
        1.0 - pass_by
    )
    total = home + other
    return {
        "gross_acres": es("gross_acres"),
        "trips_total": total,
        "trips_res": home,
        "trips_nonres": other,
        "trips_hbw": total * p.transport_hbw_pct,
        "trips_hbo": total * p.transport_hbo_pct,
        "trips_nhb": total * p.transport_nhb_pct,
    }


@module("trip_distribution", "trip_generation")
def trip_distribution(wide: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    """TRN01 inside a run: ``inputs.trips`` maps the wide row to the OD result."""
    if inputs.trips is None:
        raise ValueError("trip_distribution needs inputs.trips")
    od = inputs.trips(wide)
    fields = ["trips_outbound", "trips_inbound", "trips_internal", "avg_trip_length_km"]
    return wide.join(
        od.select("parcel_id", F.struct(*fields).alias("trip_distribution")), "parcel_id", "left"
    )


# Logit constants.
ASC_TRANSIT, ASC_WALK, ASC_BIKE = -2.0, -1.5, -2.5
BETA_DENSITY, BETA_DESIGN_WALK, BETA_TRANSIT = 0.15, 0.05, 0.02


def logit_shares(ln_density: Column, intersections: Column, transit: Column) -> dict[str, Column]:
    """TRN03: multinomial logit shares, shifted by the largest utility."""
    design = intersections * BETA_DESIGN_WALK - ln_density * BETA_DENSITY
    utility = {
        "auto": F.lit(0.0),
        "transit": ASC_TRANSIT + transit * BETA_TRANSIT,
        "walk": ASC_WALK + design,
        "bike": ASC_BIKE + design,
    }
    top = F.greatest(*utility.values())
    weight = {m: F.exp(u - top) for m, u in utility.items()}
    whole = weight["auto"] + weight["transit"] + weight["walk"] + weight["bike"]
    return {m: w / whole for m, w in weight.items()}


@row_module("mode_choice", "trip_distribution")
def mode_choice(p: Params) -> dict[str, Column]:
    """TRN03 on the outbound trips; density is persons per gross acre, at least 1."""
    density = X.or_zero(X.ratio(es("population"), es("gross_acres")))
    shares = logit_shares(
        F.log(F.greatest(density, F.lit(1.0))), es("intersection_density"), F.lit(0.0)
    )
    out = F.col("trip_distribution.trips_outbound")
    return {f"trips_{m}": out * s for m, s in shares.items()} | {
        f"share_{m}": s for m, s in shares.items()
    }


@row_module("vmt", "mode_choice")
def vmt(p: Params) -> dict[str, Column]:
    """ANA11."""
    length = F.col("trip_distribution.avg_trip_length_km")
    auto = F.col("mode_choice.trips_auto")
    miles = auto * length * p.transport_km_to_mi * p.transport_circuity_factor
    return {
        "vmt_total": miles,
        "vmt_per_capita": F.when(es("population") > 0, miles / es("population")).otherwise(0.0),
        "auto_trips": auto,
        "avg_trip_length_mi": length * p.transport_km_to_mi,
    }


@module("internal_capture", "trip_distribution")
def internal_capture(wide: DataFrame, _inputs: Inputs, p: Params) -> DataFrame:
    """ANA12: study-area totals come as one row through a scalar subquery."""
    trips = F.col("trip_generation.trips_total")

    def od(name: str) -> Column:
        return X.or_zero("trip_distribution." + name)

    if p.transport_study_area:
        inside = F.coalesce(
            G.point_in_ring(es("x"), es("y"), G.ring_literal(p.transport_study_area)),
            F.lit(False),
        )
    else:
        inside = F.lit(True)
    flagged = wide.withColumn("_inside", inside)
    area = flagged.agg(F.count("*").alias("n"), F.count_if("_inside").alias("n_in"))
    share = X.or_zero(X.ratio("n_in", "n"))
    area = area.select(
        F.struct(
            share.alias("fraction"),
            F.when(F.col("n_in") > 0, F.sqrt(share) * 10.0).otherwise(1.0).alias("radius_km"),
        )
    ).scalar()
    flagged = flagged.withColumn("_area", area)
    decay = F.exp(
        F.lit(-p.transport_intrazonal_friction)
        * X.ratio(od("avg_trip_length_km"), "_area.radius_km")
    )
    captured = X.ladder(
        [(~F.col("_inside"), 0.0), (trips == 0, 1.0)],
        F.least(F.lit(1.0), F.col("_area.fraction") * decay),
    )
    flagged = flagged.withColumn("_captured", captured)
    inner = od("trips_internal") + od("trips_outbound") * F.col("_captured")
    return flagged.withColumn(
        "internal_capture",
        pack(
            {
                "trips_internal": F.round(inner, 4),
                "internal_capture_pct": F.round("_captured", 4),
                "trips_external": F.round(X.non_negative(trips - inner), 4),
            }
        ),
    ).drop("_inside", "_area", "_captured")


# --- emissions and health ------------------------------------------------------


@row_module("transport_ghg", "vmt")
def transport_ghg(p: Params) -> dict[str, Column]:
    """ANA13."""
    adjust = 1.15 if p.transport_ghg_speed_adjust else 1.0
    kg = F.col("vmt.vmt_total") * p.transport_ghg_co2_per_mile * adjust
    return {
        "co2e_total_kg": kg,
        "co2e_per_capita_kg": F.when(es("population") > 0, kg / es("population")).otherwise(0.0),
        "vmt_total": F.col("vmt.vmt_total"),
        "avg_trip_length_mi": F.col("vmt.avg_trip_length_mi"),
        "auto_trips": F.col("vmt.auto_trips"),
    }


@row_module("building_water_ghg", "energy_demand", "water_demand")
def building_water_ghg(p: Params) -> dict[str, Column]:
    """ANA14."""

    def use(fuel: str) -> Column:
        return F.col(f"energy_demand.energy_{fuel}_res") + F.col(
            f"energy_demand.energy_{fuel}_nonres"
        )

    energy = X.or_zero(
        use("electricity") * p.ghg_egrid_co2_per_kwh + use("gas") * p.ghg_gas_co2_per_kwh
    )
    litres = F.col("water_demand.water_demand_total")
    kwh_per_mg = p.ghg_water_supply_kwh_per_mg + p.ghg_wastewater_kwh_per_mg
    water = F.when(
        litres > 0,
        litres / p.ghg_liters_per_million_gallons * kwh_per_mg * p.ghg_egrid_co2_per_kwh,
    ).otherwise(0.0)
    return {
        "co2e_energy_total_kg": energy,
        "co2e_water_total_kg": water,
        "co2e_total_kg": energy + water,
        "co2e_per_capita_kg": F.when(
            es("population") > 0, (energy + water) / es("population")
        ).otherwise(0.0),
    }


def _ghg_parts(transport: str, building: str) -> dict[str, Column]:
    """ANA15 outputs from the two sides' prefixes."""
    t = X.or_zero(f"{transport}.co2e_total_kg")
    return {
        "co2e_transport": t,
        "co2e_buildings": X.or_zero(f"{building}.co2e_energy_total_kg"),
        "co2e_water": X.or_zero(f"{building}.co2e_water_total_kg"),
        "co2e_total": t + X.or_zero(f"{building}.co2e_total_kg"),
    }


@row_module("total_ghg", "transport_ghg", "building_water_ghg")
def total_ghg(p: Params) -> dict[str, Column]:
    """ANA15 on the wide row."""
    return _ghg_parts("transport_ghg", "building_water_ghg")


def total_ghg_tables(transport: DataFrame, building: DataFrame) -> DataFrame:
    """ANA15 / JOI03 for two separate tables: full outer, coalesced key."""
    t, b = transport.alias("t"), building.alias("b")
    return t.join(b, F.col("t.parcel_id") == F.col("b.parcel_id"), "full").select(
        F.coalesce("t.parcel_id", "b.parcel_id").alias("parcel_id"),
        *[v.alias(k) for k, v in _ghg_parts("t", "b").items()],
    )


@row_module("physical_activity", "mode_choice")
def physical_activity(p: Params) -> dict[str, Column]:
    """ANA16: MET-hours of walking and cycling."""
    length = F.col("trip_distribution.avg_trip_length_km")

    def trips(mode: str) -> Column:
        return F.col("mode_choice.trips_" + mode)

    def met(mode: str, speed: float, effort: float) -> Column:
        return X.or_zero(trips(mode) * (length / speed) * effort)

    walk = met("walk", p.health_walk_speed_kmh, p.health_walk_met)
    bike = met("bike", p.health_bike_speed_kmh, p.health_bike_met)
    active = X.or_zero(trips("walk")) + X.or_zero(trips("bike"))
    motor = X.or_zero(trips("auto")) + X.or_zero(trips("transit"))
    return {
        "walk_met_hours": walk,
        "bike_met_hours": bike,
        "total_met_hours": walk + bike,
        "walk_trips": trips("walk"),
        "bike_trips": trips("bike"),
        "active_trip_share": X.or_zero(X.ratio(active, active + motor)),
    }


@row_module("health_impacts", "physical_activity", "transport_ghg")
def health_impacts(p: Params) -> dict[str, Column]:
    """ANA17: deaths averted by activity, added by particulates, in DALYs."""
    people = es("population")
    met = F.col("physical_activity.total_met_hours")
    kg = X.or_zero("transport_ghg.co2e_total_kg")
    base_deaths = people * p.health_background_death_rate
    averted = F.when(
        (people > 0) & X.positive(met),
        base_deaths
        * F.least(
            met / p.health_weeks_per_year / p.health_heat_baseline_met_hours_per_week, F.lit(1.0)
        )
        * (p.health_heat_mortality_reduction_pct / 100.0),
    ).otherwise(0.0)
    added = F.when(
        (people > 0) & (kg > 0),
        base_deaths
        * F.least(
            kg
            / 1000.0
            * p.health_pm25_intake_fraction
            * p.health_pm25_concentration_response
            * 100.0,
            F.lit(1.0),
        ),
    ).otherwise(0.0)
    dalys = p.health_background_dalys_per_capita / p.health_background_death_rate
    return {
        "dalys_averted_pa": averted * dalys,
        "dalys_added_air_quality": added * dalys,
        "net_dalys": F.when(people > 0, (averted - added) * dalys).otherwise(0.0),
        "deaths_averted_pa": averted,
        "deaths_added_air_quality": added,
    }


# --- equity --------------------------------------------------------------------


@module("food_access", "core")
def food_access(wide: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    """ANA18 over the shop counts of ANA19 (``inputs.food``)."""
    if inputs.food is None:
        raise ValueError("food_access needs inputs.food")
    score = F.col("_food.mrfei")
    wide = wide.join(
        inputs.food.select(
            "parcel_id", F.struct("healthy_count", "unhealthy_count", "mrfei").alias("_food")
        ),
        "parcel_id",
        "left",
    )
    zero = F.lit(0).cast("bigint")
    return wide.withColumn(
        "food_access",
        pack(
            {
                "gross_acres": es("gross_acres"),
                "population": es("population"),
                "households": es("households"),
                "healthy_count": F.coalesce("_food.healthy_count", zero),
                "unhealthy_count": F.coalesce("_food.unhealthy_count", zero),
                "mrfei": score,
                "food_desert": F.coalesce(score < 25, F.lit(False)),
                "food_access_category": X.ladder(
                    [
                        (score < 25, "food_desert"),
                        (score < 50, "low_access"),
                        (score < 75, "moderate_access"),
                        (score >= 75, "high_access"),
                    ]
                ),
            }
        ),
    ).drop("_food")


@module("sprawl_index", "core")
def sprawl_index(wide: DataFrame, _inputs: Inputs, p: Params) -> DataFrame:
    """ANA20: mean of two percent ranks and a mixed-use flag.

    Percent ranks over the whole table come from operators.ranking, which never
    sorts the table in one task.
    """
    scored = wide.withColumns(
        {
            "_density": X.or_zero(X.ratio(es("population"), es("gross_acres"))),
            "_links": X.or_zero(es("intersection_density")),
        }
    )
    scored = ranking.with_percent_ranks(
        scored, {"_density": "_density_rank", "_links": "_links_rank"}
    )
    mixed = F.when(
        X.positive(es("population")) & X.positive(es("employment_total")), 1.0
    ).otherwise(0.0)
    return scored.withColumn(
        "sprawl_index",
        pack(
            {
                "gross_acres": es("gross_acres"),
                "population": es("population"),
                "population_density": F.col("_density"),
                "intersection_density": es("intersection_density"),
                "land_dev_category": es("land_dev_category"),
                "employment_total": es("employment_total"),
                "density_score": F.col("_density_rank"),
                "connectivity_score": F.col("_links_rank"),
                "mixed_use_score": mixed,
                "sprawl_index": X.or_zero(
                    (F.col("_density_rank") + F.col("_links_rank") + mixed) / 3.0 * 100.0
                ),
            }
        ),
    ).drop("_density", "_links", "_density_rank", "_links_rank")


@row_module("housing_cost_burden", "core")
def housing_cost_burden(p: Params) -> dict[str, Column]:
    """ANA21."""
    hh = es("households")
    pct = X.ratio(hh * p.housing_cost_burden_rate, hh) * 100.0
    return {
        "gross_acres": es("gross_acres"),
        "population": es("population"),
        "households": hh,
        "dwelling_units_total": es("dwelling_units_total"),
        "cost_burdened_hh": X.or_zero(hh * p.housing_cost_burden_rate),
        "severely_cost_burdened_hh": X.or_zero(hh * p.housing_severe_burden_rate),
        "cost_burden_pct": X.or_zero(pct),
        "cost_burden_category": X.ladder(
            [
                (X.or_zero(hh) == 0, "low_burden"),
                (pct < 30.0, "low_burden"),
                (pct <= 50.0, "cost_burdened"),
            ],
            "severely_cost_burdened",
        ),
    }


# Equity defaults where no zone value is known.
EQUITY_DEFAULTS = {
    "median_income": 50000.0,
    "rent_burden_pct": 32.0,
    "pct_minority": 40.0,
    "pct_college_educated": 30.0,
}


def acs_equity(canvas: DataFrame, zones: DataFrame | None) -> DataFrame:
    """ANA22: keep a known non-zero value, else the zone's, else the default.

    ``zones`` holds one row per parcel (parcel_id + the four columns), the result
    of a point-in-polygon join.
    """
    names = list(EQUITY_DEFAULTS)
    if zones is None:
        joined = canvas.withColumns({"_z_" + n: X.typed_null("double") for n in names})
    else:
        joined = canvas.join(
            zones.select("parcel_id", *[F.col(n).alias("_z_" + n) for n in names]),
            "parcel_id",
            "left",
        )
    filled = {
        n: F.coalesce(
            F.nullif(F.col(n), F.lit(0.0)), F.nullif(F.col("_z_" + n), F.lit(0.0)), F.lit(d)
        )
        for n, d in EQUITY_DEFAULTS.items()
    }
    return joined.withColumns(filled).drop(*["_z_" + n for n in names])


def vulnerability(prefix: str, p: Params) -> Column:
    """Number of raised flags, 0 to 4 (unknown counts as 0 percent / 0 income)."""

    def flag(cond: Column) -> Column:
        return cond.cast("int")

    return (
        flag(X.or_zero(prefix + "median_income") < p.displacement_income_threshold)
        + flag(X.or_zero(prefix + "pct_minority") > p.displacement_minority_threshold)
        + flag(X.or_zero(prefix + "rent_burden_pct") > p.displacement_rent_burden_threshold)
        + flag(
            X.or_zero(prefix + "pct_college_educated")
            < p.displacement_college_education_threshold
        )
    )


def risk_category(score: Column) -> Column:
    return X.ladder(
        [
            (score == 0, "stable"),
            (score <= 2, "vulnerable"),
            (score == 3, "at_risk"),
            (score == 4, "displacement_pressure"),
        ]
    )


def _with_equity(wide: DataFrame, inputs: Inputs) -> DataFrame:
    if "_equity" in wide.columns:
        return wide
    if inputs.equity is None:
        raise ValueError("displacement_risk needs inputs.equity")
    return wide.join(
        inputs.equity.select("parcel_id", F.struct(*EQUITY_DEFAULTS).alias("_equity")),
        "parcel_id",
        "left",
    )


@module("displacement_risk", "core")
def displacement_risk(wide: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    """ANA23."""
    wide = _with_equity(wide, inputs)
    score = vulnerability("_equity.", p)
    return wide.withColumn(
        "displacement_risk",
        pack(
            {n: es(n) for n in ("gross_acres", "population", "households")}
            | {n: F.col("_equity." + n) for n in EQUITY_DEFAULTS}
            | {"vulnerability_score": score, "displacement_risk_category": risk_category(score)}
        ),
    )


@module("displacement_risk_dynamic", "displacement_risk")
def displacement_risk_dynamic(wide: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    """ANA24: the same score with constant change columns."""
    score = F.col("displacement_risk.vulnerability_score")
    return wide.withColumn(
        "displacement_risk_dynamic",
        pack(
            {n: es(n) for n in ("gross_acres", "population", "households")}
            | {
                "vulnerability_score": score,
                "displacement_risk_category": risk_category(score),
                "risk_change_vs_base": F.lit("same"),
                "vulnerability_change": F.lit(0),
            }
        ),
    )


# --- fiscal ----------------------------------------------------------------------


@row_module("fiscal_property_tax", "core")
def fiscal_property_tax(p: Params) -> dict[str, Column]:
    """ANA25."""
    homes = es("dwelling_units_total") * p.res_assessed_value_per_du
    other = es("building_sqft_total") * p.nonres_assessed_value_per_sqft
    return {
        "assessed_value_res": X.or_zero(homes),
        "assessed_value_nonres": X.or_zero(other),
        "property_tax_revenue": X.or_zero((homes + other) * p.property_tax_rate / 100.0),
    }


@row_module("fiscal_sales_tax", "core")
def fiscal_sales_tax(p: Params) -> dict[str, Column]:
    """ANA26."""
    sales = es("employment_total") * p.retail_employment_share / 100.0 * p.sales_per_employee
    return {
        "retail_sales": X.or_zero(sales),
        "sales_tax_revenue": X.or_zero(sales * p.sales_tax_rate / 100.0),
    }


@row_module("fiscal_service_costs", "core")
def fiscal_service_costs(p: Params) -> dict[str, Column]:
    """ANA27."""
    schools = X.or_zero(es("dwelling_units_total") * p.cost_per_du)
    safety = X.or_zero(es("population") * p.cost_per_capita)
    roads = X.or_zero(es("employment_total") * p.cost_per_employee)
    return {
        "service_cost_schools": schools,
        "service_cost_public_safety": safety,
        "service_cost_roads": roads,
        "service_cost_total": schools + safety + roads,
    }


def _net_fiscal(tax: str, sales: str, costs: str) -> dict[str, Column]:
    a = X.or_zero(f"{tax}.property_tax_revenue")
    b = X.or_zero(f"{sales}.sales_tax_revenue")
    s = X.or_zero(f"{costs}.service_cost_total")
    return {
        "property_tax_revenue": a,
        "sales_tax_revenue": b,
        "service_cost_total": s,
        "net_fiscal_impact": a + b - s,
    }


@row_module("fiscal_net_impact", "fiscal_property_tax", "fiscal_sales_tax", "fiscal_service_costs")
def fiscal_net_impact(p: Params) -> dict[str, Column]:
    """ANA28 on the wide row."""
    return _net_fiscal("fiscal_property_tax", "fiscal_sales_tax", "fiscal_service_costs")


def fiscal_net_tables(tax: DataFrame, sales: DataFrame, costs: DataFrame) -> DataFrame:
    """ANA28 / JOI04 for separate tables: chained full outer on the coalesced key."""
    joined = tax.alias("f1").join(
        sales.alias("f2"), F.col("f1.parcel_id") == F.col("f2.parcel_id"), "full"
    )
    key = F.coalesce("f1.parcel_id", "f2.parcel_id")
    joined = joined.join(costs.alias("f3"), key == F.col("f3.parcel_id"), "full")
    return joined.select(
        F.coalesce("f1.parcel_id", "f2.parcel_id", "f3.parcel_id").alias("parcel_id"),
        *[v.alias(k) for k, v in _net_fiscal("f1", "f2", "f3").items()],
    )


@row_module("vmt_fee", "vmt")
def vmt_fee(p: Params) -> dict[str, Column]:
    """ANA29."""
    miles = F.col("vmt.vmt_total")
    exempt = p.vmt_exempt_pct / 100.0
    revenue = F.round(miles * (1.0 - exempt) * p.vmt_fee_rate_dollars_per_vmt, 2)
    return {
        "gross_acres": es("gross_acres"),
        "population": es("population"),
        "households": es("households"),
        "vmt_total": miles,
        "fee_rate_dollars_per_vmt": F.lit(p.vmt_fee_rate_dollars_per_vmt),
        "vmt_exempt": F.round(miles * exempt, 2),
        "fee_revenue_total": revenue,
        "revenue_forgone": F.round(miles * exempt * p.vmt_fee_rate_dollars_per_vmt, 2),
        "net_revenue": revenue,
    }


@row_module("sprawl_cost", "core")
def sprawl_cost(p: Params) -> dict[str, Column]:
    """ANA30: capital is paid off over 30 years."""
    units, hh = es("dwelling_units_total"), es("households")
    annual = F.round(units * p.sprawl_infrastructure_cost_per_du, 2)
    capital = F.round(units * p.sprawl_capital_cost_per_du, 2)
    return {
        "gross_acres": es("gross_acres"),
        "population": es("population"),
        "households": hh,
        "dwelling_units_total": units,
        "infrastructure_cost_per_du_annual": F.lit(p.sprawl_infrastructure_cost_per_du),
        "capital_cost_per_du": F.lit(p.sprawl_capital_cost_per_du),
        "infrastructure_cost_annual": annual,
        "capital_cost": capital,
        "infrastructure_cost_per_hh_annual": F.round(X.ratio(annual + capital / 30.0, hh), 2),
    }


# --- summary and run -----------------------------------------------------------

SUMMARY_NEEDS = (
    "vmt", "total_ghg", "water_demand", "land_consumption", "health_impacts",
    "energy_demand", "housing_cost_burden", "sprawl_index", "displacement_risk",
)


def scenario_summary(wide: DataFrame, scenario_id: str = "blueprint") -> DataFrame:
    """ANA31: all measures of one scenario in one pass over the wide row."""

    def total(name: str) -> Column:
        return X.or_zero(F.sum(name))

    located = F.sum(F.when(es("x").isNotNull(), es("population")))
    people = F.sum(es("population"))
    risky = F.col("displacement_risk.displacement_risk_category").isin(
        "at_risk", "displacement_pressure"
    )
    known_gross = F.col("land_consumption.gross_acres") > 0
    return wide.agg(
        X.or_zero(people).alias("total_population"),
        total("core_end_state.households").alias("total_households"),
        total("core_end_state.dwelling_units_total").alias("dwelling_units_total"),
        total("core_end_state.employment_total").alias("total_employment"),
        total("vmt.vmt_total").alias("vmt_total"),
        F.round(X.ratio(total("vmt.vmt_total"), people), 2).alias("vmt_per_capita"),
        total("total_ghg.co2e_total").alias("co2e_total_kg"),
        F.round(X.ratio(total("total_ghg.co2e_total"), located), 2).alias("co2e_per_capita_kg"),
        F.round(X.or_zero(F.avg("housing_cost_burden.cost_burden_pct")), 1).alias(
            "cost_burdened_hh_pct"
        ),
        X.or_zero(F.avg("sprawl_index.sprawl_index")).alias("avg_sprawl_index"),
        X.or_zero(F.sum("water_demand.water_demand_total") / LITERS_PER_ACRE_FOOT).alias(
            "water_demand_total_af"
        ),
        X.or_zero(F.sum("energy_demand.energy_total") / KWH_PER_MWH).alias(
            "energy_demand_total_mwh"
        ),
        total("land_consumption.acres_consumed").alias("land_consumed_acres"),
        F.round(
            X.or_zero(F.avg(F.when(known_gross, F.col("land_consumption.impervious_pct")))), 1
        ).alias("land_consumed_pct"),
        total("health_impacts.net_dalys").alias("net_dalys"),
        F.round(X.or_zero(X.ratio(F.count_if(risky) * 100.0, F.count("*"))), 1).alias(
            "displacement_risk_pct"
        ),
    ).select(F.lit(scenario_id).alias("scenario_id"), "*")


def resolve(requested: Iterable[str], registry: Mapping[str, Module] | None = None) -> list[str]:
    """PIP01: requested modules plus prerequisites, prerequisites first."""
    registry = MODULES if registry is None else registry
    order: list[str] = []
    open_names: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        if name in open_names:
            raise ValueError(f"modules need each other: {' -> '.join([*open_names, name])}")
        if name not in registry:
            raise ValueError(f"unknown module: {name}")
        open_names.append(name)
        for need in registry[name].needs:
            visit(need)
        open_names.pop()
        order.append(name)

    for name in requested:
        visit(name)
    return order


def run(requested: Iterable[str], inputs: Inputs, params: Params = DEFAULTS) -> DataFrame:
    """PIP01: one lazy wide row per parcel with a struct per module."""
    wide = inputs.parcels
    for name in resolve(["core", *requested]):
        wide = MODULES[name].build(wide, inputs, params)
    return wide


def table(wide: DataFrame, name: str) -> DataFrame:
    """One module's own table out of the wide row."""
    if name == "core":
        name = "core_end_state"
    out = wide.select("parcel_id", name + ".*")
    if name == "agriculture":
        out = out.where("acres_cultivated > 0")  # FLT08: only where it applies
    return out


def preflight(
    inputs: Mapping[str, DataFrame | None], required: Mapping[str, Iterable[str]]
) -> list[str]:
    """PIP02: missing tables, missing columns, empty tables.

    Emptiness reads at most one row per table.
    """
    problems = []
    for name, columns in required.items():
        df = inputs.get(name)
        if df is None:
            problems.append(f"{name}: table not found")
            continue
        have = {x.lower() for x in df.columns}
        lacking = [x for x in columns if x.lower() not in have]
        problems += [f"{name}: column {x} not found" for x in lacking]
        if df.isEmpty():
            problems.append(f"{name}: table is empty")
    return problems
