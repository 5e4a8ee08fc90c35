"""Domain tables over the driver's TPC-H-like tables.

Each table is a plain projection (or one grouping) whose expressions mean the same
in Spark SQL and in DuckDB, so one definition gives the DataFrame and the common
table expression of the check SQL.  Nothing is filtered or cut: every domain table
has as many rows as the table it is made from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Table:
    source: str
    columns: dict[str, str]
    group: str | None = None

    def select_list(self) -> list[str]:
        return [f"{text} AS {name}" for name, text in self.columns.items()]

    def sql(self) -> str:
        tail = f" GROUP BY {self.group}" if self.group else ""
        return f"SELECT {', '.join(self.select_list())} FROM {self.source}{tail}"


def _null_every(n: int, key: str, text: str) -> str:
    return f"CASE WHEN {key} % {n} = 0 THEN NULL ELSE {text} END"


def square(name_x: str, name_y: str, half: str) -> dict[str, str]:
    return {
        "xmin": f"({name_x}) - ({half})",
        "ymin": f"({name_y}) - ({half})",
        "xmax": f"({name_x}) + ({half})",
        "ymax": f"({name_y}) + ({half})",
    }


# parcels lie on a grid of 100 m cells, 400 to a row
PX = "(o_orderkey % 400) * 100e0 + 50e0"
PY = "floor(o_orderkey / 400) * 100e0 + 50e0"
# buildings lie on the lot of their parcel, a few of them across its edge
BX = "(l_orderkey % 400) * 100e0 + 20e0 + (l_linenumber % 7) * 10e0"
BY = "floor(l_orderkey / 400) * 100e0 + 30e0 + (l_suppkey % 5) * 10e0"
# block groups are 2 km squares, 20 to a row; blocks are 400 m squares, 100 to a row
GX = "(s_suppkey % 20) * 2000e0 + 1000e0"
GY = "floor(s_suppkey / 20) * 2000e0 + 1000e0"
KX = "(p_partkey % 100) * 400e0 + 200e0"
KY = "floor(p_partkey / 100) * 400e0 + 200e0"

TABLES: dict[str, Table] = {
    "built_forms": Table(
        "part",
        {
            "key": "p_brand",
            "id": "max(cast(substring(p_brand, 7, 4) AS int))",
            "du_per_acre": "max(CASE WHEN cast(substring(p_brand, 7, 4) AS int) % 4 = 0 THEN 0e0"
            " ELSE (cast(substring(p_brand, 7, 4) AS int) % 13) * 1.5e0 END)",
            "emp_per_acre": "max(CASE WHEN cast(substring(p_brand, 7, 4) AS int) % 3 = 0 THEN 0e0"
            " ELSE (cast(substring(p_brand, 7, 4) AS int) % 7) * 4e0 END)",
            "far": "max((cast(substring(p_brand, 7, 4) AS int) % 5) * 0.25e0)",
            "household_size": "max(2e0 + (cast(substring(p_brand, 7, 4) AS int) % 3) * 0.5e0)",
            "vacancy_rate": "max((cast(substring(p_brand, 7, 4) AS int) % 9) * 1e0)",
            "building_coverage": "max(CASE WHEN cast(substring(p_brand, 7, 4) AS int) % 6 = 0"
            " THEN NULL ELSE 20e0 + cast(substring(p_brand, 7, 4) AS int) END)",
            "irrigable_area_fraction": "max((cast(substring(p_brand, 7, 4) AS int) % 8) / 16e0)",
            "indoor_water_rate": "max(150e0 + cast(substring(p_brand, 7, 4) AS int))",
            "outdoor_water_rate": "max(300e0 + 2 * cast(substring(p_brand, 7, 4) AS int))",
            "electricity_eui": "max(40e0 + cast(substring(p_brand, 7, 4) AS int))",
            "gas_eui": "max(20e0 + cast(substring(p_brand, 7, 4) AS int) % 11)",
            "trip_rate_override": "max(5e0 + cast(substring(p_brand, 7, 4) AS int) % 6)",
            "pass_by_trip_pct": "max(CASE WHEN cast(substring(p_brand, 7, 4) AS int) % 5 = 0"
            " THEN NULL ELSE (cast(substring(p_brand, 7, 4) AS int) % 5) * 0.0625e0 END)",
        },
        "p_brand",
    ),
    "parcels": Table(
        "orders",
        {
            "parcel_id": "o_orderkey",
            "gross_acres": "floor(o_totalprice / 1e3) / 1e2",
            "built_form_key": "concat('Brand#', cast(1 + o_custkey % 27 AS string))",
            "intersection_density": _null_every(11, "o_orderkey", "(o_orderkey % 97) * 2.5e0"),
            "county_id": "o_custkey % 25",
            "land_use": "o_orderpriority",
            "status": "o_orderstatus",
            "value": "o_totalprice",
            "seen_at": "o_orderdate",
            "x": PX,
            "y": PY,
            **square(PX, PY, "30e0 + (o_orderkey % 5) * 5e0"),
        },
    ),
    "base": Table(
        "orders",
        {
            "parcel_id": "o_orderkey + 100",
            "gross_acres": "floor(o_totalprice / 1e3) / 1e2",
            "dwelling_units_total": "(o_custkey % 9) * 1e0",
            "dwelling_units_sf_ll": _null_every(7, "o_custkey", "(o_custkey % 9) * 0.5e0"),
            "dwelling_units_sf_sl": "(o_custkey % 9) * 0.25e0",
            "dwelling_units_attached_sf": "(o_custkey % 9) * 0.125e0",
            "dwelling_units_mf_2_4": "0e0",
            "dwelling_units_mf_5p": "(o_custkey % 9) * 0.125e0",
            "population": "(o_custkey % 9) * 2.5e0",
            "households": "(o_custkey % 9) * 0.75e0",
            "employment_total": _null_every(5, "o_custkey", "(o_custkey % 17) * 1e0"),
            "building_sqft_total": "(o_custkey % 31) * 100e0",
            "intersection_density": "(o_orderkey % 50) * 1e0",
        },
    ),
    "block_groups": Table(
        "supplier",
        {
            "geoid": "s_suppkey",
            "county_id": "s_nationkey",
            "pop": "cast(floor(abs(s_acctbal) / 2e0) AS double)",
            "hh": "cast(floor(abs(s_acctbal) / 5e0) AS double)",
            "du": "cast(floor(abs(s_acctbal) / 4.5e0) AS double)",
            "emp": "cast(floor(abs(s_acctbal) / 3e0) AS double)",
            "median_income": _null_every(9, "s_suppkey", "20000e0 + floor(abs(s_acctbal) * 8e0)"),
            "rent_burden_pct": _null_every(7, "s_suppkey", "20e0 + (s_suppkey % 30)"),
            "pct_minority": "(s_suppkey * 7 % 100) * 1e0",
            "pct_college_educated": _null_every(6, "s_suppkey", "(s_suppkey * 3 % 80) * 1e0"),
            "x": GX,
            "y": GY,
            **square(GX, GY, "1000e0"),
        },
    ),
    "blocks": Table(
        "part",
        {
            "geoid": "p_partkey",
            "block_group": "p_partkey % 100",
            "county_id": "p_partkey % 25",
            "emp": "p_size * 40",
            "size": "p_size",
            "category": "p_type",
            "price": "p_retailprice",
            "x": KX,
            "y": KY,
            **square(KX, KY, "200e0"),
        },
    ),
    "pairs": Table(
        "lineitem",
        {
            "parcel_id": "l_orderkey",
            "zone_id": "l_suppkey",
            "overlap": "sum(l_extendedprice)",
            "weight": "sum(l_quantity)",
        },
        "l_orderkey, l_suppkey",
    ),
    "buildings": Table(
        "lineitem",
        {
            "parcel_id": "l_orderkey",
            "line": "l_linenumber",
            "supplier": "l_suppkey",
            "part": "l_partkey",
            "class": "CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 6 = 0 THEN 'retail'"
            " WHEN l_partkey % 6 = 1 THEN 'house' WHEN l_partkey % 6 = 2 THEN 'apartments'"
            " WHEN l_partkey % 6 = 3 THEN 'warehouse' WHEN l_partkey % 6 = 4 THEN 'office'"
            " ELSE 'shed' END",
            "levels": _null_every(4, "l_suppkey", "cast(l_partkey % 5 AS int)"),
            "height": _null_every(3, "l_suppkey", "l_quantity / 4e0"),
            "bf_source": "CASE WHEN l_returnflag = 'A' THEN 'google' WHEN l_returnflag = 'R'"
            " THEN 'microsoft' END",
            "confidence": "l_discount * 10e0",
            "footprint_sqft": "l_quantity * 100e0",
            "x": BX,
            "y": BY,
            **square(BX, BY, "4e0 + (l_linenumber % 3) * 2e0"),
        },
    ),
    "sales": Table(
        "lineitem",
        {
            "apn": "l_orderkey",
            "sale_id": "l_partkey * 1000000 + l_suppkey * 100 + l_linenumber",
            "living_area": _null_every(3, "l_partkey", "cast(floor(l_extendedprice / 20e0) AS double)"),
            "building_sf": _null_every(4, "l_partkey", "cast(floor(l_extendedprice / 15e0) AS double)"),
            "units": _null_every(5, "l_suppkey", "cast(l_quantity AS int) % 6"),
            "year_built": _null_every(11, "l_partkey", "1950 + l_partkey % 70"),
            "lot_size_acres": "l_quantity / 50e0",
            "property_type": "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 7 = 1 THEN ' '"
            " WHEN l_returnflag = 'A' THEN 'Single Family' WHEN l_returnflag = 'R' THEN 'Multi Family'"
            " ELSE 'Commercial' END",
        },
    ),
    "paint": Table(
        "events",
        {
            "event_id": "event_id",
            "scenario_id": "event_id % 3",
            "feature_id": "user_id",
            "column_name": "CASE WHEN event_type = 'click' THEN 'du' WHEN event_type = 'view' THEN 'pop'"
            " WHEN event_type = 'error' THEN 'emp' ELSE 'hh' END",
            "new_value": "value",
            "op": "CASE WHEN event_id % 29 = 0 THEN 'clear' ELSE 'paint' END",
            "batch_id": "cast(floor(event_id / 20) AS bigint)",
            "painted_at": "ts",
        },
    ),
    "shops": Table(
        "supplier",
        {
            "poi_id": "s_suppkey",
            "healthy": "s_nationkey % 2 = 0",
            "x": "(s_suppkey * 37 % 400) * 100e0 + 13e0",
            "y": "(s_suppkey * 11 % 40) * 100e0 + 29e0",
        },
    ),
    "roads": Table(
        "lineitem",
        {
            "road_id": "l_orderkey",
            "line": "l_linenumber",
            "surface": "CASE WHEN l_returnflag = 'A' THEN 'asphalt' WHEN l_returnflag = 'R' THEN 'gravel' END",
            "x1": "(l_suppkey % 100) * 300e0 + (l_partkey % 3)",
            "y1": "floor(l_suppkey / 100) * 300e0 + (l_partkey % 20) * 300e0",
            "x2": "(l_suppkey % 100) * 300e0 + 300e0 - (l_partkey % 2)",
            "y2": "floor(l_suppkey / 100) * 300e0 + (l_partkey % 20) * 300e0",
        },
    ),
    "od": Table(
        "lineitem",
        {
            "origin": "l_partkey",
            "dest": "l_suppkey",
            "network_distance_km": "min(l_quantity / 10e0)",
        },
        "l_partkey, l_suppkey",
    ),
}


class Tables:
    """Raw and bound tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.raw(name)
        if name not in TABLES:
            raise AttributeError(name)
        t = TABLES[name]
        source = self.raw(t.source)
        if not t.group:
            return source.selectExpr(*t.select_list())
        return source.groupBy(*[g.strip() for g in t.group.split(",")]).agg(
            *_aggregates(t)
        ).selectExpr(*_keys(t), *[n for n in t.columns if not _is_key(t, n)])


def _is_key(t: Table, name: str) -> bool:
    return t.columns[name] in [g.strip() for g in t.group.split(",")]


def _keys(t: Table) -> list[str]:
    return [f"{t.columns[n]} AS {n}" for n in t.columns if _is_key(t, n)]


def _aggregates(t: Table):
    from pyspark.sql import functions as F

    return [F.expr(text).alias(n) for n, text in t.columns.items() if not _is_key(t, n)]


def ctes(*names: str, **more: str) -> str:
    """``WITH`` clause of the named domain tables plus further named queries."""
    parts = [f"{n} AS ({TABLES[n].sql()})" for n in names]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
