"""Census zones and jobs (BAS17-29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspan.functions import geometry as G
from landspan.operators.allocate import SECTORS, SUB_SECTORS
from landspan.plans import census as C
from landspan.plans import employment as E
from landspan.queries.analysis import num, nums
from landspan.queries.binding import Tables, ctes
from landspan.queries.registry import query, rd, rds, rounded

# --- zones -------------------------------------------------------------------------

_CELLS = sorted(
    set(
        ["b01001_001_e", "b25003_001_e", "b25024_001_e", "b25024_002_e", "b25024_003_e", "b25024_004_e", "b25024_005_e",
         "b25024_006_e", "b25024_007_e", "b25024_008_e", "b25024_009_e", "b25003_002_e", "b25003_003_e", "b19013_001_e",
         "b25070_001_e", "b03002_001_e", "b03002_002_e", "b15003_001_e", *C.RENT_BURDEN, *C.OWNER_BURDEN, *C.COLLEGE]
    )
)
ACS = {"geoid": "c_custkey", "area_m2": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE (1 + c_custkey % 40) * 40468.6e0 END"}
ACS |= {
    c: f"CASE WHEN c_custkey % {11 + i} = 0 THEN NULL ELSE (c_custkey * {i + 3} % {97 + i}) * 1e0 END" for i, c in enumerate(_CELLS)
}


def _sel(cols: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


def _s(names) -> str:
    return "(" + " + ".join(f"coalesce({n}, 0e0)" for n in names) + ")"


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round({part} / nullif({whole}, 0e0) * 100e0, 2) ELSE 0e0 END"


_MF1, _MF2 = _s(["b25024_004_e", "b25024_005_e"]), _s(["b25024_006_e", "b25024_007_e", "b25024_008_e", "b25024_009_e"])
_P = "coalesce(b03002_001_e, 0e0)"


@query(
    "BAS17_acs_block_group",
    f"""WITH a AS (SELECT {_sel(ACS)} FROM customer), s AS (SELECT *, CASE WHEN coalesce(b25024_002_e, 0e0) > 0 AND area_m2 IS NOT NULL
      THEN least(greatest(1e0 / (1e0 + exp(0e0 - (coalesce(b25024_002_e, 0e0) / nullif(area_m2 / 4046.86e0, 0e0) - 8e0) * 0.5e0)), 0e0), 1e0) ELSE 0.4e0 END AS sl FROM a)
    SELECT geoid, '2022-01-01' AS data_year, """
    + nums(pop="coalesce(b01001_001_e, 0e0)", hh="coalesce(b25003_001_e, 0e0)", du="coalesce(b25024_001_e, 0e0)", du_detsf="coalesce(b25024_002_e, 0e0)",
           du_attsf="coalesce(b25024_003_e, 0e0)", du_mf2to4=_MF1, du_mf5p=_MF2, du_mf=f"{_MF1} + {_MF2}",
           du_detsf_sl="round(coalesce(b25024_002_e, 0e0) * sl, 1)", du_detsf_ll="round(coalesce(b25024_002_e, 0e0) * (1 - sl), 1)",
           owner_occupied="coalesce(b25003_002_e, 0e0)", renter_occupied="coalesce(b25003_003_e, 0e0)", median_income="coalesce(b19013_001_e, 0e0)",
           rent_burden_pct=_pct(_s(C.RENT_BURDEN), "coalesce(b25070_001_e, 0e0)"), cost_burden_pct=_pct(f"({_s(C.OWNER_BURDEN)} + {_s(C.RENT_BURDEN)})", "coalesce(b25003_001_e, 0e0)"),
           total_population=_P, pct_minority=_pct(f"({_P} - coalesce(b03002_002_e, 0e0))", _P), pct_college_educated=_pct(_s(C.COLLEGE), "coalesce(b15003_001_e, 0e0)"))
    + " FROM s",
)
def acs_block_group(t: Tables):
    out = C.block_groups(t.customer.selectExpr(*[f"{v} AS {k}" for k, v in ACS.items()]))
    return rounded(out.withColumn("data_year", F.col("data_year").cast("string")))


PDB = {
    "gidbg": "c_custkey", "tot_vacant_units_acs_18_22": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 50) * 1e0 END",
    "tot_housing_units_acs_18_22": "(c_custkey % 40) * 1e0", "tot_gq_cen_2020": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 12) * 1e0 END",
    "low_response_score": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal / 50e0 END", "pct_renter_occp_hu_acs_18_22": "(c_custkey % 130) * 1e0",
    "pct_prs_blw_pov_lev_acs_18_22": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 70) * 1e0 END",
}


def _frac(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c} / 100e0, 0e0), 1e0) END"


@query(
    "BAS18_pdb_block_group",
    f"WITH p AS (SELECT {_sel(PDB)} FROM customer) SELECT gidbg AS geoid, '2024-01-01' AS data_year, "
    + nums(vacancy_rate="CASE WHEN tot_housing_units_acs_18_22 > 0 THEN least(greatest(coalesce(tot_vacant_units_acs_18_22, 0e0) / tot_housing_units_acs_18_22, 0e0), 1e0) ELSE 0e0 END",
           group_quarters_pop="coalesce(tot_gq_cen_2020, 0e0)", low_response_score=_frac("low_response_score"),
           renter_occupied_pct=_frac("pct_renter_occp_hu_acs_18_22"), below_poverty_pct=_frac("pct_prs_blw_pov_lev_acs_18_22")) + " FROM p",
)
def pdb_block_group(t: Tables):
    out = C.planning_rates(t.customer.selectExpr(*[f"{v} AS {k}" for k, v in PDB.items()]))
    return rounded(out.withColumn("data_year", F.col("data_year").cast("string")))


@query(
    "BAS19_census_blocks",
    f"""SELECT p_partkey AS geoid, {num('coalesce(CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size END, 0) * 1e0', 'total_population')}, {num('p_size * 2e0', 'total_housing_units')}, 0e0 AS total_group_quarters,
    {num('(-120e0 + p_partkey % 50 * 0.01e0) * pi() / 180e0 * 6378137e0', 'xmin', 3)}, {num('((-120e0 + p_partkey % 50 * 0.01e0) + 0.01e0) * pi() / 180e0 * 6378137e0', 'xmax', 3)} FROM part WHERE p_partkey % 4 <> 3""",
)
def census_blocks(t: Tables):
    k = F.col("p_partkey")
    lon, lat = F.lit(-120.0) + k % 50 * 0.01, F.lit(37.0) + k % 30 * 0.01
    ring = G.box_ring(G.box(lon, lat, lon + 0.01, lat + 0.01))
    outlines = t.part.where("p_partkey % 4 <> 3").select(k.alias("geoid"), ring.alias("ring"))
    counts = t.part.select(k.alias("geoid"), F.when(F.col("p_size") % 9 != 0, F.col("p_size")).alias("total_population"), (F.col("p_size") * 2).alias("total_housing_units"))
    out = C.projected(C.blocks(counts, outlines), 3857)
    four = ("total_population", "total_housing_units", "total_group_quarters")
    return out.select("geoid", *[rd(n).alias(n) for n in four], rd("xmin", 3).alias("xmin"), rd("xmax", 3).alias("xmax"))


# --- jobs --------------------------------------------------------------------------

SHARES = {"11": 0.05, "21": 0.02, "23": 0.93, "22": 0.02, "42": 0.1, "44": 0.54, "45": 0.28, "48": 0.04, "49": 0.02, "721": 0.4, "722": 0.6}
LODES = {"geoid": "lpad(cast(p_partkey AS string), 15, '0')"}
LODES |= {f"cns{i:02d}": f"CASE WHEN p_partkey % {7 + i} = 0 THEN NULL ELSE p_size * {i} % {13 + i} * (CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE 1 END) END" for i in range(1, 21)}
LODES["c000"] = "p_size * 10"


def _cns(i: int) -> str:
    return f"coalesce(cns{i:02d}, 0) * 1e0"


def _r1(text: str) -> str:
    return f"round(round({text}, 9), 1)"


def _split_sql() -> dict[str, str]:
    c1, c3, c13 = _cns(1), _cns(3), _cns(13)
    tw, ut, wh = _r1(f"{c3} * 0.06e0"), _r1(f"{c3} * 0.02e0"), _r1(f"{c3} * 0.1e0")
    return {
        "agriculture": _r1(f"{c1} * 0.05e0"), "extraction": _r1(f"{c1} * 0.02e0"),
        "construction": f"greatest({c1} - {_r1(c1 + ' * 0.05e0')} - {_r1(c1 + ' * 0.02e0')}, 0e0)", "manufacturing": _cns(2),
        "transport_warehousing": tw, "utilities": ut, "wholesale": wh, "retail_services": f"greatest({c3} - {tw} - {ut} - {wh}, 0e0)",
        "office_services": " + ".join(_cns(i) for i in range(4, 10)), "education": _cns(10), "medical_services": _cns(11), "arts_entertainment": _cns(12),
        "accommodation": _r1(f"{c13} * 0.4e0"), "restaurant": f"greatest({c13} - {_r1(c13 + ' * 0.4e0')}, 0e0)", "other_services": _cns(14),
        "public_admin": _cns(15), "military": _cns(17),
    }


_ALL = " + ".join("emp_" + s for s in SUB_SECTORS)


def _sector(names) -> str:
    return " + ".join("emp_" + n for n in names)


RAW_SQL = f"""lo AS (SELECT {_sel(LODES)} FROM part), sp AS (SELECT geoid, c000 * 1e0 AS emp, {_cns(16)} AS u, {_cns(18)} + {_cns(19)} + {_cns(20)} AS gov, {', '.join(f'{v} AS emp_{k}' for k, v in _split_sql().items())} FROM lo),
    st AS (SELECT *, {_ALL} AS known FROM sp), sa AS (SELECT geoid, emp, gov, emp_agriculture AS emp_ag, {_sector(SECTORS['ret'])} AS emp_ret, {_sector(SECTORS['off'])} AS emp_off, {_sector(SECTORS['pub'])} AS emp_pub, {_sector(SECTORS['ind'])} AS emp_ind,
    {', '.join(_r1(f'emp_{s} + CASE WHEN u > 0 AND known > 0 THEN u * emp_{s} / known WHEN u > 0 THEN u / 17e0 ELSE 0e0 END') + f' AS emp_{s}' for s in SUB_SECTORS)} FROM st),
    raw AS (SELECT geoid, emp, emp_ag, emp_ret, emp_off, emp_pub, emp_ind, {', '.join(_r1(f'emp_{s} + gov * {E.GOVERNMENT_SPLIT[s]}e0') + f' AS emp_{s}' if s in E.GOVERNMENT_SPLIT else f'emp_{s}' for s in SUB_SECTORS)} FROM sa)"""
_GAP = f"""gap0 AS (SELECT *, {_ALL} AS known, emp - ({_ALL}) AS gap FROM raw), gap AS (SELECT geoid, emp,
    {', '.join(f'emp_{s} + CASE WHEN gap > 0 AND known > 0 THEN gap * emp_{s} / known WHEN gap > 0 THEN gap / 17e0 ELSE 0e0 END AS emp_{s}' for s in SUB_SECTORS)} FROM gap0)"""
CONTROLS = {"emp_agriculture": 400000.0, "emp_utilities": 5.0, "emp_restaurant": 900000.0, "emp_military": 1e9}


def lodes(t: Tables):
    return E.lodes_blocks(t.part.selectExpr(*[f"{v} AS {k}" for k, v in LODES.items()]), SHARES)


SUB_COLS = ["emp_" + s for s in SUB_SECTORS]
SEC_COLS = ["emp_" + s for s in SECTORS]


@query("BAS20_lodes_split", f"WITH {RAW_SQL} SELECT geoid, '2021-01-01' AS data_year, " + ", ".join(num(c, c) for c in ["emp", *SEC_COLS, *SUB_COLS]) + " FROM raw")
def lodes_split(t: Tables):
    return rounded(lodes(t).select("geoid", F.col("data_year").cast("string").alias("data_year"), "emp", *SEC_COLS, *SUB_COLS))


@query("BAS21_gap_fill", f"WITH {RAW_SQL}, {_GAP} SELECT geoid, " + ", ".join(num(c, c) for c in ["emp", *SUB_COLS]) + " FROM gap")
def gap_fill(t: Tables):
    return rounded(E.fill_gap(lodes(t)).select("geoid", "emp", *SUB_COLS))


def _scale_sql(col: str) -> str:
    c = CONTROLS.get(col)
    if not c or col == "emp_military":
        return f"{col} AS {col}"
    spread = f"{c!r}e0 * 0.5e0 * emp / nullif(t_all, 0e0)"
    return f"CASE WHEN {c!r}e0 <= t_{col} THEN {col} WHEN t_{col} > 0 THEN CASE WHEN {col} > 0 THEN {col} * ({c!r}e0 * 0.5e0 / nullif(t_{col}, 0e0)) + {spread} ELSE {spread} END WHEN t_all > 0 THEN {c!r}e0 * emp / t_all ELSE {col} END AS {col}"


_SCALED = f"tt AS (SELECT {', '.join(f'coalesce(sum({c}), 0e0) AS t_{c}' for c in SUB_COLS)}, coalesce(sum(emp), 0e0) AS t_all FROM gap), scaled AS (SELECT geoid, emp, {', '.join(map(_scale_sql, SUB_COLS))} FROM gap, tt)"


def scaled(t: Tables):
    return E.scale_to_county(E.fill_gap(lodes(t)), CONTROLS)


@query("BAS22_county_scaling", f"WITH {RAW_SQL}, {_GAP}, {_SCALED} SELECT geoid, " + ", ".join(num(c, c, 7) for c in SUB_COLS) + " FROM scaled")
def county_scaling(t: Tables):
    return rounded(scaled(t).select("geoid", *SUB_COLS), 7)


@query(
    "BAS23_sector_totals",
    f"WITH {RAW_SQL}, {_GAP}, {_SCALED} SELECT geoid, " + ", ".join(num(" + ".join(f"coalesce(emp_{s}, 0e0)" for s in subs), "emp_" + k, 7) for k, subs in SECTORS.items())
    + f", {num(_ALL, 'emp', 7)} FROM scaled",
)
def sector_totals(t: Tables):
    return rounded(E.sector_totals(scaled(t)).select("geoid", *SEC_COLS, "emp"), 7)


@query(
    "BAS24_fallback_fractions",
    f"WITH {RAW_SQL}, {_GAP} SELECT " + ", ".join(
        num(f"coalesce(sum(emp_{s}) / nullif({' + '.join(f'sum(emp_{x})' for x in subs)}, 0e0), 0e0)", f"emp_{s}_frac", 6) for subs in SECTORS.values() for s in subs
    ) + " FROM gap",
)
def fallback_fractions(t: Tables):
    return rounded(E.fallback_fractions(E.fill_gap(lodes(t))), 6)


# county industry rows: every part is one code of its county (size)
CODES = ["11----", "21----", "22----", "23----", "236---", "3133--", "42----", "4445--", "4849--", "51----", "52----", "61----", "62----", "71----", "721///", "722", "81----", "92----", "------"]
_CODE_ARRAY = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_CLEAN = "replace(replace(naics, '-', ''), ' ', '')"
CBP_SQL = f"""cb AS (SELECT p_size AS county, ({_CODE_ARRAY})[1 + p_partkey % {len(CODES)}] AS naics, CASE WHEN p_partkey % 10 = 3 THEN 'D' ELSE cast(p_partkey % 500 AS varchar) END AS e FROM part),
    cu AS (SELECT county, {_CLEAN} AS code, max(cast(e AS double)) AS e FROM cb WHERE e <> 'D' AND {_CLEAN} <> '' GROUP BY county, {_CLEAN}),
    cj AS (SELECT county, CASE WHEN code IN ('3133', '4445', '4849') THEN left(code, 2) WHEN length(code) IN (2, 3) THEN code END AS prefix, e FROM cu),
    jobs AS (SELECT county, prefix, sum(e) AS e FROM cj WHERE prefix IS NOT NULL GROUP BY county, prefix)"""


def industry(t: Tables):
    k = F.col("p_partkey")
    raw = t.part.select(
        F.col("p_size").alias("county"), F.element_at(F.array(*map(F.lit, CODES)), (k % len(CODES) + 1).cast("int")).alias("naics"),
        F.when(k % 10 == 3, "D").otherwise((k % 500).cast("string")).alias("emp"),
    )
    return E.industry_jobs(raw)


_MEMBERS = " UNION ALL ".join(f"SELECT '{p}' AS parent, '{c}' AS prefix, {d}e0 AS national" for p, g in E.PARENTS.items() for c, d in g.items())


@query(
    "BAS25_industry_shares",
    f"""WITH {CBP_SQL}, mem AS ({_MEMBERS}), w AS (SELECT county, parent, sum(e) AS whole FROM jobs JOIN mem USING (prefix) GROUP BY county, parent)
    SELECT c.county, m.prefix, {num('CASE WHEN whole > 0 THEN coalesce(e, 0e0) / whole ELSE national END', 'share', 6)} FROM (SELECT DISTINCT county FROM jobs) c CROSS JOIN mem m
    LEFT JOIN w ON w.county = c.county AND w.parent = m.parent LEFT JOIN jobs j ON j.county = c.county AND j.prefix = m.prefix""",
)
def industry_shares(t: Tables):
    return rounded(E.industry_shares(industry(t)), 6)


@query(
    "BAS26_county_totals",
    f"WITH {CBP_SQL} SELECT county, " + ", ".join(
        f"coalesce(sum(CASE WHEN prefix IN ({', '.join(repr(c) for c in codes)}) THEN e END), 0e0) AS emp_{s}" for s, codes in E.SUB_SECTOR_CODES.items()
    ) + " FROM jobs GROUP BY county",
)
def county_totals(t: Tables):
    return E.county_totals(industry(t))


@query(
    "BAS27_split_rules",
    f"""WITH lo AS (SELECT {_sel(LODES)} FROM part) SELECT geoid, """
    + ", ".join(num(v.replace("round(round(", "((").replace(", 9), 1)", "))"), "emp_" + k) for k, v in _split_sql().items()) + " FROM lo",
)
def split_rules(t: Tables):
    out = E.split_jobs(t.part.selectExpr(*[f"{v} AS {k}" for k, v in LODES.items()]), SHARES)
    return rounded(out.select("geoid", *SUB_COLS))


QCEW = {
    "county": "p_size", "own_code": "cast(p_partkey % 5 AS string)", "agglvl_code": "CASE WHEN p_partkey % 7 = 0 THEN '77' ELSE '78' END",
    "industry_code": "CASE WHEN p_partkey % 4 = 0 THEN '6111' WHEN p_partkey % 4 = 1 THEN '6221' WHEN p_partkey % 4 = 2 THEN '921' ELSE '11' END",
    "month1_emplvl": "CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE cast(p_partkey % 300 AS string) END",
}


@query(
    "BAS28_government_shares",
    f"""WITH q AS (SELECT {_sel(QCEW)} FROM part), g AS (SELECT county, coalesce(sum(CASE WHEN industry_code LIKE '611%' THEN e END), 0e0) AS edu, coalesce(sum(CASE WHEN industry_code LIKE '622%' THEN e END), 0e0) AS med,
    coalesce(sum(CASE WHEN industry_code LIKE '92%' THEN e END), 0e0) AS pub FROM (SELECT *, try_cast(month1_emplvl AS double) AS e FROM q WHERE own_code IN ('1', '2', '3') AND agglvl_code = '78') GROUP BY county)
    SELECT county, """ + nums(edu_frac="edu / (edu + med + pub)", med_frac="med / (edu + med + pub)", pub_frac="pub / (edu + med + pub)") + " FROM g WHERE edu + med + pub > 0",
)
def government_shares(t: Tables):
    return rounded(E.government_shares(t.part.selectExpr(*[f"{v} AS {k}" for k, v in QCEW.items()])))


@query(
    "BAS29_calibrated_split",
    f"WITH {RAW_SQL} SELECT geoid, " + ", ".join(
        num(f"CASE WHEN emp_{k} > 0 THEN emp_{k} * ({n} / {float(sum(g.values()))}e0) ELSE emp_{s} END", "emp_" + s) for k, g in E.CALIBRATED.items() for s, n in g.items()
    ) + " FROM raw",
)
def calibrated_split(t: Tables):
    out = E.calibrated_split(lodes(t))
    return rounded(out.select("geoid", *["emp_" + s for g in E.CALIBRATED.values() for s in g]))
