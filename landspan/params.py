"""Named scalars of the analysis modules."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """Module parameters.  Fixed values: defaults that results depend on."""

    res_assessed_value_per_du: float = 350000.0
    nonres_assessed_value_per_sqft: float = 150.0
    cost_per_du: float = 5000.0
    cost_per_capita: float = 2000.0
    cost_per_employee: float = 1500.0
    property_tax_rate: float = 1.0
    retail_employment_share: float = 15.0
    sales_per_employee: float = 100000.0
    sales_tax_rate: float = 1.0
    dev_pct: float = 100.0
    gross_net_pct: float = 85.0
    density_pct: float = 100.0
    transport_nonres_trip_rate: float = 42.94
    transport_pass_by_pct: float = 0.0
    transport_hbw_pct: float = 0.18
    transport_hbo_pct: float = 0.42
    transport_nhb_pct: float = 0.40
    transport_circuity_factor: float = 1.2
    transport_ghg_co2_per_mile: float = 0.411
    transport_ghg_speed_adjust: bool = False
    transport_intrazonal_friction: float = 0.15
    transport_study_area: tuple[tuple[float, float], ...] = ()
    transport_km_to_mi: float = 0.621371
    ghg_egrid_co2_per_kwh: float = 0.417
    ghg_gas_co2_per_kwh: float = 0.181
    ghg_water_supply_kwh_per_mg: float = 1427.0
    ghg_wastewater_kwh_per_mg: float = 1911.0
    ghg_liters_per_million_gallons: float = 3785411.78
    health_walk_met: float = 3.5
    health_bike_met: float = 6.0
    health_walk_speed_kmh: float = 4.8
    health_bike_speed_kmh: float = 16.0
    health_heat_mortality_reduction_pct: float = 8.0
    health_heat_baseline_met_hours_per_week: float = 11.25
    health_pm25_intake_fraction: float = 1.6e-6
    health_pm25_concentration_response: float = 0.0062
    health_background_dalys_per_capita: float = 0.013
    health_background_death_rate: float = 0.008
    health_weeks_per_year: float = 52.0
    parking_per_unit: float = 0.5
    parking_per_employee: float = 0.2
    ground_coverage_factor: float = 0.6
    parking_space_sqft: float = 300.0
    row_fraction: float = 0.15
    stormwater_annual_precipitation_in: float = 12.0
    tree_canopy_baseline_temp: float = 95.0
    tree_canopy_temp_per_10pct: float = 1.0
    vmt_fee_rate_dollars_per_vmt: float = 295.0
    vmt_exempt_pct: float = 0.0
    sprawl_infrastructure_cost_per_du: float = 15000.0
    sprawl_capital_cost_per_du: float = 50000.0
    crop_yield_per_acre: float = 8.0
    crop_market_price_per_ton: float = 200.0
    crop_production_cost_per_acre: float = 800.0
    crop_water_per_acre_af: float = 3.0
    crop_labor_hours_per_acre: float = 15.0
    crop_truck_trips_per_acre: float = 2.0
    housing_cost_burden_rate: float = 0.30
    housing_severe_burden_rate: float = 0.50
    # Thresholds on percentages are given in percent, like the data.
    displacement_income_threshold: float = 50000.0
    displacement_minority_threshold: float = 50.0
    displacement_rent_burden_threshold: float = 30.0
    displacement_college_education_threshold: float = 25.0
    res_far_default: float = 0.5
    nonres_indoor_water_rate: float = 0.0

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULTS = Params()

# Unit conversions.
SQFT_PER_ACRE = 43560.0
SQFT_TO_SQM = 0.092903
SQM_TO_SQFT = 10.7639
SQM_PER_ACRE = 4046.86
SQM_PER_SQMI = 2589988.11
LITERS_PER_ACRE_FOOT = 1233481.84
KWH_PER_MWH = 1000.0
QUARTER_MILE_M = 402.336
