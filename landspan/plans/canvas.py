"""Assembly of the base table: geometry, attributes, imputation, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators.allocate import SECTORS, SUB_SECTORS
from landspan.operators.ranking import with_group_totals
from landspan.params import SQFT_PER_ACRE, SQM_PER_ACRE
from landspan.plans.assessor import use_code_category

# Calibration per land category: floor area per unit and per job
# (retail, office, public, industrial), irrigated shares, intersection density.
CALIBRATION_COLUMNS = (
    "sqft_per_du", "sqft_per_emp_retail", "sqft_per_emp_office", "sqft_per_emp_public",
    "sqft_per_emp_industrial", "res_irrigation_frac", "com_irrigation_frac", "calib_density",
)
CALIBRATION = {
    "urban": (3000.0, 706.0, 408.0, 909.0, 267.0, 0.064, 0.035, 25.0),
    "agricultural": (3000.0, 706.0, 408.0, 909.0, 267.0, 0.10, 0.03, 2.0),
    "industrial": (3000.0, 706.0, 408.0, 909.0, 267.0, 0.05, 0.035, 8.0),
    "undeveloped": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0),
    "mixed_use": (3000.0, 706.0, 408.0, 909.0, 267.0, 0.05, 0.035, 20.0),
}
# Land-use labels by category.
LAND_USE_LABELS = {
    "urban": [
        "Low Density Detached Residential", "Medium Density Detached Residential", "Medium-High Density Detached Residential",
        "Medium Density Attached Residential", "Medium-High Density Attached Residential", "High Density Attached Residential",
        "Very High Density Attached Residential", "Mobile Home Park", "Urban Attached Residential", "Urban Mid-Rise Residential",
        "Blank Place Type", "Rural Residential", "Very Low Density Detached Residential", "Farm Home",
    ],
    "industrial": [
        "Community/Neighborhood Retail", "Community/Neighborhood Commercial", "Community/Neighborhood Commercial/Office",
        "Regional Retail", "Moderate-Intensity Office", "High-Intensity Office", "CBD Office", "Light Industrial",
        "Heavy Industrial", "Light Industrial-Office", "Medical Facility", "Hotel", "Public/Quasi-Public", "Civic/Institution",
        "K-12 School", "Colleges and Universities", "Airport", "Agricultural Processing/Retail Employment",
    ],
    "mixed_use": ["Residential/Retail Mixed Use Low", "Residential/Retail Mixed Use High"],
    "undeveloped": ["Agriculture", "Park and/or Open Space", "Parking Lot", "Parking Structure", "Water", "Road"],
}
DEV_SHARE, ROW_SHARE = 0.7, 0.15
DEFAULT_FORM, DEFAULT_DENSITY = "mixed_use", 12.5
SUBTYPES = ("detsf_sl", "detsf_ll", "attsf", "mf2to4", "mf5p")


def label_category(label) -> Column:
    """Category of a land-use label, NULL if unknown."""
    t = F.trim(X.c(label))
    return X.ladder([(t.isin(names), cat) for cat, names in LAND_USE_LABELS.items()])


def geometry(parcels: DataFrame, enrichment: DataFrame | None, enriched: Sequence[str] = ()) -> DataFrame:
    """BAS34: areas in acres, category fill, values of the crosswalk first.

    ``parcels``: parcel_id, area_m2, land_development_category, built_form_key,
    assessor_use_code, intersection_density and more; ``enriched`` names the columns
    of ``enrichment`` that go before the parcel's own.
    """
    acres = X.round_decimal(F.col("area_m2") / SQM_PER_ACRE, 4)
    category = F.coalesce(
        F.nullif(F.col("land_development_category"), F.lit("")),
        use_code_category(F.coalesce("assessor_use_code", F.lit(""))),
        F.lit(""),
    )
    out = parcels.withColumns({"area_gross": acres, "land_development_category": category})
    out = out.withColumns(
        {
            "area_gross_acres": F.col("area_gross"),
            "area_parcel_acres": F.col("area_gross"),
            "area_dev_condition_acres": X.round_decimal(F.col("area_gross") * DEV_SHARE, 4),
            "area_row_acres": X.round_decimal(F.col("area_gross") * ROW_SHARE, 4),
        }
    )
    if enrichment is None:
        return out
    e = enrichment.withColumnsRenamed({n: "_e_" + n for n in enriched})
    out = out.join(e, "parcel_id", "left")
    mine = {n: F.col(n) if n in parcels.columns else X.typed_null("double") for n in enriched}
    return out.withColumns({n: F.coalesce("_e_" + n, v) for n, v in mine.items()}).drop(
        *["_e_" + n for n in enriched]
    )


def with_calibration(df: DataFrame) -> DataFrame:
    """Calibration values of the row's category (blank counts as urban)."""
    key = F.coalesce(F.nullif(F.col("land_development_category"), F.lit("")), F.lit("urban"))
    return df.withColumns(
        {
            name: X.ladder([(key == cat, v[i]) for cat, v in CALIBRATION.items()])
            for i, name in enumerate(CALIBRATION_COLUMNS)
        }
    )


# Floor-area columns, the jobs behind them, the sector that divides the
# measured floor area, its source column, and the rate with its default.
JOB_AREAS = {
    "retail_services": ("ret", "commercial_building_sqft", "sqft_per_emp_retail", 706.0),
    "restaurant": ("ret", "commercial_building_sqft", "sqft_per_emp_retail", 706.0),
    "accommodation": ("ret", "commercial_building_sqft", "sqft_per_emp_retail", 706.0),
    "arts_entertainment": ("ret", "commercial_building_sqft", "sqft_per_emp_retail", 706.0),
    "other_services": ("ret", "commercial_building_sqft", "sqft_per_emp_retail", 706.0),
    "office_services": ("off", "commercial_building_sqft", "sqft_per_emp_office", 408.0),
    "medical_services": ("off", "commercial_building_sqft", "sqft_per_emp_office", 408.0),
    "public_admin": ("pub", "other_building_sqft", "sqft_per_emp_public", 909.0),
    "education": ("pub", "other_building_sqft", "sqft_per_emp_public", 909.0),
    "transport_warehousing": ("ind", "industrial_building_sqft", "sqft_per_emp_industrial", 267.0),
    "wholesale": ("ind", "industrial_building_sqft", "sqft_per_emp_industrial", 267.0),
}
HOME_AREAS = {"detsf_sl": 3000.0, "detsf_ll": 3000.0, "attsf": 1500.0}
MF_SQFT = 1500.0
SECTOR_SHARES = {"ret": 0.302, "off": 0.478, "pub": 0.082, "ind": 0.138}


def attributes(df: DataFrame) -> DataFrame:
    """BAS35: building areas, category cascade, area by use, irrigation, density.

    Steps are chained projections over one row; no join, no shuffle.  Optional
    inputs (overture_category, impervious_fraction, dasym_impervious_fraction) may be
    missing.
    """
    for name, kind in {
        "overture_category": "string",
        "impervious_fraction": "double",
        "dasym_impervious_fraction": "double",
    }.items():
        if name not in df.columns:
            df = df.withColumn(name, X.typed_null(kind))
    df = with_calibration(df)
    units = {"du_" + s: X.or_zero("du_" + s) for s in SUBTYPES}
    sectors = {
        "emp_" + s: X.non_negative(F.coalesce(F.col("emp_" + s), F.col("emp") * share))
        for s, share in SECTOR_SHARES.items()
    }
    df = df.withColumns(units | sectors)
    df = df.withColumns(
        {
            "du_detsf": F.col("du_detsf_sl") + F.col("du_detsf_ll"),
            "du_mf": F.col("du_mf2to4") + F.col("du_mf5p"),
        }
    )
    areas = {
        "bldg_area_" + s: F.coalesce(
            F.col("bldg_area_" + s), F.col("du_" + s) * F.coalesce("sqft_per_du", F.lit(d))
        )
        for s, d in HOME_AREAS.items()
    }
    areas["bldg_area_mf"] = F.coalesce("bldg_area_mf", F.col("du_mf") * MF_SQFT)
    for sub, (sector, sqft, rate, default) in JOB_AREAS.items():
        jobs = F.col("emp_" + sub)
        measured = F.when(
            F.col(sqft) > 0, F.col(sqft) * X.ratio(X.or_zero(jobs), "emp_" + sector)
        )
        areas["bldg_area_" + sub] = F.coalesce(
            F.col("bldg_area_" + sub), measured, jobs * F.coalesce(rate, F.lit(default))
        )
    df = df.withColumns(areas)
    df = df.withColumns(
        {
            "land_development_category": F.coalesce(
                F.nullif(F.col("land_development_category"), F.lit("")),
                use_code_category(F.coalesce("assessor_use_code", F.lit(""))),
                label_category(F.coalesce("land_use", F.lit(""))),
                "overture_category",
                F.lit("urban"),
            ),
            "built_form_key": F.coalesce(F.nullif(F.col("built_form_key"), F.lit("")), F.lit(DEFAULT_FORM)),
        }
    )
    df = area_by_use(df)
    sealed = [F.nullif(F.col(n), F.lit(0.0)) for n in ("impervious_fraction", "dasym_impervious_fraction")]

    def irrigated(own: str, area: str, rate: str, default: float) -> Column:
        base = F.coalesce(area, "area_gross_acres", "area_gross", F.lit(0.0))
        return F.coalesce(F.col(own), base * F.coalesce(*sealed, rate, F.lit(default)))

    return df.withColumns(
        {
            "residential_irrigated_area": irrigated("residential_irrigated_area", "area_parcel_res", "res_irrigation_frac", 0.064),
            "commercial_irrigated_area": irrigated("commercial_irrigated_area", "area_parcel_emp", "com_irrigation_frac", 0.035),
            "intersection_density": X.round_decimal(
                F.coalesce(F.nullif(F.col("intersection_density"), F.lit(0.0)), "calib_density", F.lit(DEFAULT_DENSITY)), 2
            ),
            "occupied_du": X.round_decimal(X.or_zero("du") * (1.0 - X.or_zero("vacancy_rate")), 2),
        }
    ).drop(*CALIBRATION_COLUMNS)


def area_by_use(df: DataFrame) -> DataFrame:
    """BAS35: acres by use from category, modelled units and measured floor area."""
    lot = F.coalesce("area_parcel_acres", "area_gross_acres", "area_gross", F.lit(0.0))
    home = X.or_zero("residential_building_sqft")
    work = F.col("commercial_building_sqft") + F.col("industrial_building_sqft") + F.col("other_building_sqft")
    built = home + X.or_zero("commercial_building_sqft") + X.or_zero("industrial_building_sqft") + X.or_zero("other_building_sqft")
    df = df.withColumns({"_lot": lot, "_built": built, "_work": X.or_zero(work), "_home": home})
    cat = F.col("land_development_category")
    town = cat.isin("urban", "mixed_use")
    lived_in = (X.or_zero("du_total") > 0) & (F.col("_home") > 0) & town
    dense = (F.col("_built") > 0) & F.coalesce(
        X.ratio("_built", F.col("_lot") * SQFT_PER_ACRE) >= 0.05, F.lit(False)
    )
    share = F.col("_lot") / F.nullif(F.col("_built"), F.lit(0.0))
    out = {
        "area_parcel_res": X.ladder(
            [
                (lived_in, F.col("_lot")),
                (cat.isin("industrial", "agricultural", "undeveloped"), F.lit(0.0)),
                (town & dense, F.col("_home") * share),
                (town, F.lit(0.0)),
            ],
            F.col("area_parcel_res"),
        ),
        "area_parcel_emp_ag": F.when(cat == "agricultural", F.col("_lot")).otherwise(F.col("area_parcel_emp_ag")),
        "area_parcel_emp": X.ladder(
            [
                (lived_in, F.lit(0.0)),
                (dense, F.col("_work") * share),
                (cat == "industrial", F.col("_lot")),
                (town | cat.isin("agricultural", "undeveloped"), F.lit(0.0)),
            ],
            X.or_zero("area_parcel_emp"),
        ),
        "area_parcel_mixed_use": F.when(cat == "mixed_use", F.col("_lot")).otherwise(F.col("area_parcel_mixed_use")),
        "area_parcel_no_use": X.ladder(
            [
                (lived_in | dense, F.lit(0.0)),
                (town | (cat == "undeveloped"), F.col("_lot")),
            ],
            F.col("area_parcel_no_use"),
        ),
    }
    return df.withColumns(out).drop("_lot", "_built", "_work", "_home")


def impute(df: DataFrame, county: str = "county") -> DataFrame:
    """BAS36: missing values from the county mean, then 0; unit subtypes from the county mix.

    Both county tables come from one aggregation joined back by county.
    """
    mix = F.when((F.col("du") > 0) & F.col("du_detsf_sl").isNotNull(), F.lit(1))
    aggs = [F.avg(n).alias("_a_" + n) for n in ("pop", "hh", "du", "emp", "intersection_density")]
    aggs += [
        X.ratio(F.sum(mix * F.col("du_" + s)), F.sum(mix * F.col("du"))).alias("_p_" + s) for s in SUBTYPES
    ]
    df = with_group_totals(df, [county], aggs)
    du = F.coalesce("du", "_a_du", F.lit(0.0))
    blank = F.col("du") > 0
    for s in SUBTYPES:
        blank = blank & (X.or_zero("du_" + s) == 0)
    blank = F.coalesce(blank, F.lit(False))

    def subtype(s: str) -> Column:
        share = F.col("_p_" + s)
        return F.when(blank, X.or_zero(share * F.col("du"))).otherwise(
            F.coalesce(F.col("du_" + s), share * du, F.lit(0.0))
        )

    out = {n: F.coalesce(F.col(n), F.col("_a_" + n), F.lit(0.0)) for n in ("pop", "hh", "du", "emp")}
    out["intersection_density"] = X.round_decimal(
        F.coalesce("intersection_density", "_a_intersection_density", F.lit(DEFAULT_DENSITY)), 2
    )
    out["du_detsf"] = F.coalesce(F.col("du_detsf"), F.col("_p_detsf_sl") * du + F.col("_p_detsf_ll") * du, F.lit(0.0))
    out["du_mf"] = F.coalesce(F.col("du_mf"), F.col("_p_mf2to4") * du + F.col("_p_mf5p") * du, F.lit(0.0))
    out |= {"du_" + s: subtype(s) for s in SUBTYPES}
    drop = [c for c in df.columns if c.startswith(("_a_", "_p_"))]
    return df.withColumns(out).drop(*drop)


def reconcile(df: DataFrame) -> DataFrame:
    """BAS37: subtypes scaled to the unit total; sectors and the job total rebuilt."""
    parts = F.lit(0.0)
    for s in SUBTYPES:
        parts = parts + F.col("du_" + s)
    scale = F.when(X.or_zero(parts) == 0, 1.0).otherwise(X.ratio("du", parts))
    df = df.withColumn("_scale", scale)

    def scaled(v: Column) -> Column:
        return X.round_decimal(X.or_zero(v) * F.col("_scale"), 4)

    out = {"du_" + s: scaled(F.col("du_" + s)) for s in SUBTYPES}
    out["du_detsf"] = scaled(F.col("du_detsf_sl") + F.col("du_detsf_ll"))
    out["du_mf"] = scaled(F.col("du_mf2to4") + F.col("du_mf5p"))
    total = X.or_zero("emp_military")
    for sector, subs in SECTORS.items():
        whole = X.or_zero("emp_" + subs[0])
        for s in subs[1:]:
            whole = whole + X.or_zero("emp_" + s)
        out["emp_" + sector] = whole
        total = total + whole
    out["emp"] = total
    return df.withColumns(out).drop("_scale")


# --- the step-by-step variant (BAS38) -------------------------------------------------

# Fixed values of the variant: floor area per unit and per job, irrigated shares, density.
VARIANT = {
    "urban": (1200.0, 400.0, 0.25, 0.035, 25.0),
    "agricultural": (1200.0, 300.0, 0.34, 0.029, 2.0),
    "industrial": (1200.0, 500.0, 0.25, 0.035, 8.0),
    "undeveloped": (0.0, 0.0, 0.0, 0.0, 1.0),
    "mixed_use": (1500.0, 400.0, 0.25, 0.035, 20.0),
}
VARIANT_DEFAULT = (1200.0, 300.0, 0.25, 0.035, 12.5)
HOME_FACTORS = {"detsf_sl": 0.8, "detsf_ll": 1.2, "attsf": 0.9, "mf": 0.7}
USE_AREAS = {
    "urban": "area_parcel_res",
    "agricultural": "area_parcel_emp_ag",
    "industrial": "area_parcel_emp",
    "mixed_use": "area_parcel_mixed_use",
    "undeveloped": "area_parcel_no_use",
}


def step_by_step(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """BAS38: areas, building areas, category, irrigation, density, defaults, sums, check.

    Expects already allocated units and jobs.  ``columns`` maps each measure to its
    default; a wanted column that does not exist is an error.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"base table is missing columns: {missing}")
    acres = X.round_decimal(F.col("area_m2") / SQM_PER_ACRE, 4)
    df = df.withColumns(
        {
            "area_gross": acres,
            "area_parcel": acres,
            "area_dev_condition": X.round_decimal(F.col("area_m2") / SQM_PER_ACRE * DEV_SHARE, 4),
            "area_row": X.round_decimal(F.col("area_m2") / SQM_PER_ACRE * ROW_SHARE, 4),
        }
    )

    def rate(i: int) -> Column:
        key = F.coalesce("land_development_category", F.lit("urban"))
        return X.ladder([(key == c, v[i]) for c, v in VARIANT.items()], VARIANT_DEFAULT[i])

    areas = {
        "bldg_area_" + s: F.coalesce(F.col("bldg_area_" + s), F.col("du_" + s) * rate(0) * f)
        for s, f in HOME_FACTORS.items()
    }
    areas |= {
        "bldg_area_" + s: F.coalesce(F.col("bldg_area_" + s), F.col("emp_" + s) * rate(1)) for s in JOB_AREAS
    }
    df = df.withColumns(areas)
    df = df.withColumns(
        {
            "land_development_category": F.coalesce(
                "land_development_category",
                use_code_category(F.coalesce("assessor_use_code", F.lit(""))),
                label_category(F.coalesce("land_use", F.lit(""))),
                F.lit("urban"),
            ),
            "built_form_key": F.coalesce("built_form_key", F.lit(DEFAULT_FORM)),
        }
    )
    lot = F.coalesce("area_parcel", "area_gross", F.lit(0.0))
    df = df.withColumns(
        {
            c: F.when(F.col("land_development_category") == cat, F.coalesce(F.col(c), lot)).otherwise(F.col(c))
            for cat, c in USE_AREAS.items()
        }
    )
    df = df.withColumns(
        {
            "residential_irrigated_area": F.coalesce(
                "residential_irrigated_area", F.coalesce("area_parcel_res", "area_gross", F.lit(0.0)) * rate(2)
            ),
            "commercial_irrigated_area": F.coalesce(
                "commercial_irrigated_area", F.coalesce("area_parcel_emp", "area_gross", F.lit(0.0)) * rate(3)
            ),
            "intersection_density": X.round_decimal(F.coalesce("intersection_density", rate(4)), 2),
        }
    )
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(float(d))) for c, d in columns.items()})
    sums = {"du_detsf": ["du_detsf_sl", "du_detsf_ll"], "du_mf": ["du_mf2to4", "du_mf5p"], "du": ["du_detsf", "du_attsf", "du_mf"]}
    sums |= {"emp_" + k: ["emp_" + s for s in subs] for k, subs in SECTORS.items()}
    sums["emp"] = ["emp_" + k for k in SECTORS] + ["emp_military"]
    for total, subs in sums.items():
        have = [s for s in subs if s in df.columns]
        if not have:
            continue
        whole = X.or_zero(have[0])
        for s in have[1:]:
            whole = whole + X.or_zero(s)
        df = df.withColumn(total, F.when(whole > 0, whole).otherwise(F.col(total)))
    return df
