"""Readers: landed files to typed tables.

Every reader declares its columns; nothing is inferred, so codes keep leading
zeros.  Box filters compare nested fields of a ``bbox`` struct, which parquet prunes
by row group.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landspan.functions import expr as X

# --- GeoParquet scans ------------------------------------------------------------


def bbox_filter(xmin: float, ymin: float, xmax: float, ymax: float, bbox: str = "bbox") -> Column:
    """FLT06: rows whose box struct meets the window (four pushed comparisons)."""
    return (
        (F.col(bbox + ".xmin") < float(xmax))
        & (F.col(bbox + ".xmax") > float(xmin))
        & (F.col(bbox + ".ymin") < float(ymax))
        & (F.col(bbox + ".ymax") > float(ymin))
    )


def in_bbox(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """FLT06 for plain box columns."""
    return (
        (F.col("xmin") < float(xmax))
        & (F.col("xmax") > float(xmin))
        & (F.col("ymin") < float(ymax))
        & (F.col("ymax") > float(ymin))
    )


Window = tuple[float, float, float, float]


def buildings(spark: SparkSession, path: str, window: Window) -> DataFrame:
    """SRC01: footprints in a window; NaN height and floors become NULL."""
    return spark.read.parquet(path).where(bbox_filter(*window)).select(
        "id",
        "geometry",
        X.nan_to_null(F.col("height").cast("double")).alias("height"),
        X.nan_to_null(F.col("num_floors").cast("double")).cast("int").alias("levels"),
        F.col("class").cast("string").alias("class"),
        "bbox",
    )


def land_cover(spark: SparkSession, path: str, window: Window) -> DataFrame:
    """SRC02."""
    return spark.read.parquet(path).where(bbox_filter(*window)).select("id", "geometry", "subtype")


def land_use(spark: SparkSession, path: str, window: Window) -> DataFrame:
    """SRC03."""
    return spark.read.parquet(path).where(bbox_filter(*window)).select(
        "id", "geometry", "subtype", "class"
    )


def roads(spark: SparkSession, path: str, window: Window) -> DataFrame:
    """SRC04: surface and width come from the first rule of their lists."""
    return spark.read.parquet(path).where(bbox_filter(*window)).select(
        "id",
        "geometry",
        X.first_field("road_surface", "value").cast("string").alias("surface"),
        "class",
        "subclass",
        "subtype",
        X.first_field("width_rules", "value").cast("double").alias("width"),
    )


def source_buildings(
    spark: SparkSession, path: str, sources: Sequence[str] = ("google", "microsoft")
) -> DataFrame:
    """SRC05: second building layer, limited to its two footprint sources."""
    return spark.read.parquet(path).where(F.col("bf_source").isin(list(sources))).select(
        "id", "geometry", "bf_source", "confidence", "area_in_meters"
    )


# --- text files --------------------------------------------------------------------


def seed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """SRC06: typed CSV lookup; empty text is NULL."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="")


LODES_SCHEMA = T.StructType(
    [T.StructField("w_geocode", T.StringType()), T.StructField("C000", T.LongType())]
    + [T.StructField(f"CNS{i:02d}", T.LongType()) for i in range(1, 21)]
)


def lodes(spark: SparkSession, path: str, year: int) -> DataFrame:
    """SRC07: gzipped jobs CSV; names and values trimmed, the year added."""
    raw = spark.read.csv(path, header=True)
    kept = {c.strip().lower(): c for c in raw.columns}
    return raw.select(
        F.trim(F.col(f"`{kept['w_geocode']}`")).alias("w_geocode"),
        *[
            F.trim(F.col(f"`{kept[f.name.lower()]}`")).try_cast("bigint").alias(f.name.lower())
            for f in LODES_SCHEMA.fields[1:]
        ],
        F.lit(year).alias("year"),
    )


# Codes that mean "no value" in census tables.
SENTINELS = (
    "-999999999", "-888888888", "-666666666", "-555555555", "-333333333", "-222222222", "-111111111",
)


def census_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC08-SRC10: array-of-arrays JSON to rows of (file, values map).

    The first array of a file names the columns.  Both layouts are read: one array
    per line (splittable) and a whole file on one line.  Sentinels become NULL.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.rtrim(F.trim("value")).alias("line")
    )
    body = F.regexp_replace("line", r",$", "")
    body = F.when(body.startswith("[["), body).otherwise(F.concat(F.lit("["), body))
    body = F.when(body.endswith("]]"), body).otherwise(F.concat(body, F.lit("]")))
    rows = (
        lines.where(F.length("line") > 2)
        .select("file", F.col("line").startswith("[[").alias("top"), F.from_json(body, "array<array<string>>").alias("a"))
        .select("file", "top", F.posexplode("a").alias("pos", "row"))
    )
    is_head = F.col("top") & (F.col("pos") == 0)
    heads = rows.where(is_head).select("file", F.col("row").alias("head"))
    clean = F.transform("row", lambda v: F.when(~v.isin(list(SENTINELS)), v))
    return (
        rows.where(~is_head)
        .join(heads, "file")
        .select("file", F.map_from_arrays("head", clean).alias("values"))
    )


def census_column(name: str, kind: str = "string") -> Column:
    """One column of a ``census_table`` row; unreadable numbers are NULL."""
    return F.try_element_at("values", F.lit(name)).try_cast(kind).alias(name)


def acs(spark: SparkSession, path: str, variables: Sequence[str], year: int) -> DataFrame:
    """SRC08: block-group table with text keys and double measures."""
    return census_table(spark, path).select(
        *[census_column(k) for k in ("state", "county", "tract", "block group")],
        *[census_column(v, "double") for v in variables],
        F.lit(year).alias("year"),
    )


def census_blocks(spark: SparkSession, path: str) -> DataFrame:
    """SRC09: block counts with the 15-digit key."""
    keys = [census_column(k) for k in ("state", "county", "tract", "block")]
    return census_table(spark, path).select(
        F.concat(*keys).alias("geoid"),
        census_column("P1_001N", "int").alias("total_population"),
        census_column("H1_001N", "int").alias("total_housing_units"),
        keys[0],
        keys[1],
    )


# Planning-database names.
PDB_COLUMNS = (
    "Tot_Vacant_Units_ACS_18_22", "Tot_Housing_Units_ACS_18_22", "Tot_Occp_Units_ACS_18_22",
    "Tot_GQ_CEN_2020", "Inst_GQ_CEN_2020", "Non_Inst_GQ_CEN_2020", "Low_Response_Score",
    "pct_Renter_Occp_HU_ACS_18_22", "pct_Prs_Blw_Pov_Lev_ACS_18_22", "Tot_Population_ACS_18_22",
)


def planning_database(spark: SparkSession, path: str, year: int = 2024) -> DataFrame:
    """SRC10."""
    return census_table(spark, path).select(
        census_column("GIDBG").alias("gidbg"),
        *[census_column(n, "double").alias(n.lower()) for n in PDB_COLUMNS],
        F.lit(year).alias("data_year"),
    )


def tiger(raw: DataFrame, parts: Mapping[str, int], vintage: int) -> DataFrame:
    """SRC11: zone outlines with a zero-padded key; ``parts`` maps column to width."""
    return raw.select(
        F.concat(*[X.zero_pad(c, w) for c, w in parts.items()]).alias("geoid"),
        F.col("geometry"),
        F.lit(vintage).alias("vintage"),
    )


BLOCK_GROUP_PARTS = {"STATEFP": 2, "COUNTYFP": 3, "TRACTCE": 6, "BLKGRPCE": 1}
BLOCK_PARTS = {"STATEFP20": 2, "COUNTYFP20": 3, "TRACTCE20": 6, "BLOCKCE20": 4}

# --- JSON features -----------------------------------------------------------------

POI_SCHEMA = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,lng:double,"
    "center:struct<lat:double,lon:double,lng:double>,tags:map<string,string>>>"
)


def points_of_interest(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: elements of all pages; ways use their centre; ``lon`` and ``lng`` both count."""
    e = spark.read.schema(POI_SCHEMA).json(path).select(F.explode("elements").alias("e"))
    return e.select(
        F.col("e.id").alias("osm_id"),
        F.col("e.type").alias("osm_type"),
        F.coalesce("e.lon", "e.lng", "e.center.lon", "e.center.lng").alias("x"),
        F.coalesce("e.lat", "e.center.lat").alias("y"),
        F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"),
    )


def features(spark: SparkSession, path: str, properties: str, multi_line: bool = False) -> DataFrame:
    """SRC13 / SRC14: GeoJSON features of all pages; property names lower-cased.

    ``properties`` declares the properties as written in the files.
    """
    schema = f"features array<struct<properties:struct<{properties}>,geometry:string>>"
    f = (
        spark.read.schema(schema)
        .json(path, multiLine=multi_line)
        .select(F.explode("features").alias("f"))
        .select("f.properties.*", "f.geometry")
    )
    return f.toDF(*[c.lower() for c in f.columns])


# --- rasters -------------------------------------------------------------------------


def pixels(tiles: DataFrame, size: float) -> DataFrame:
    """SRC15: tiles (tile_id, x0, y0 upper left, width, data array) to pixel centres."""
    p = tiles.select("tile_id", "x0", "y0", "width", F.posexplode("data").alias("i", "value"))
    row, col = F.floor(F.col("i") / F.col("width")), F.col("i") % F.col("width")
    return p.select(
        "tile_id",
        row.cast("int").alias("row"),
        col.cast("int").alias("col"),
        (F.col("x0") + (col + 0.5) * size).alias("x"),
        (F.col("y0") - (row + 0.5) * size).alias("y"),
        "value",
    ).where("value IS NOT NULL")


def npy_tiles(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: landed ``<x0>_<y0>.npy`` tiles to (tile_id, x0, y0, width, data)."""

    def decode(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content):
                stem = name.rsplit("/", 1)[-1].removesuffix(".npy")
                grid = np.load(io.BytesIO(content)).astype("float64")
                x0, y0 = (float(v) for v in stem.split("_"))
                rows.append((stem, x0, y0, grid.shape[1], grid.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["tile_id", "x0", "y0", "width", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(
        decode, "tile_id string, x0 double, y0 double, width int, data array<double>"
    )


def tile_of(size: float, width: int = 256) -> Column:
    """Tile number text of a pixel centre (x, y)."""
    return F.concat_ws(
        "_",
        F.floor(F.col("x") / (size * width)).cast("string"),
        F.floor(F.col("y") / (size * width)).cast("string"),
    )


# --- tables ----------------------------------------------------------------------------


def present(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """SRC16: keep the wanted columns that exist."""
    return df.select([c for c in wanted if c in df.columns])


def extent_of(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG13: box around all boxes of a key."""
    return df.groupBy(*keys).agg(
        F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"),
        F.max("ymax").alias("ymax"),
    )


def padded_extent(df: DataFrame, share: float = 0.05) -> DataFrame:
    """SRC18: the fetch window of a table: its extent plus 5 percent on each side."""
    dx, dy = (F.col("xmax") - F.col("xmin")) * share, (F.col("ymax") - F.col("ymin")) * share
    return extent_of(df).select(
        (F.col("xmin") - dx).alias("xmin"),
        (F.col("ymin") - dy).alias("ymin"),
        (F.col("xmax") + dx).alias("xmax"),
        (F.col("ymax") + dy).alias("ymax"),
    )


def road_edges(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """SRC19: edges with the names id, source, target, length; rows without ends dropped."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()]).where(
        "source IS NOT NULL AND target IS NOT NULL"
    )


def shim(df: DataFrame, contract: Mapping[str, str], given: Mapping[str, Column | str]) -> DataFrame:
    """SRC21: raw table to contract columns; what the source lacks is a typed NULL."""
    return df.select(
        [
            X.c(given[name]).cast(kind).alias(name) if name in given else X.typed_null(kind).alias(name)
            for name, kind in contract.items()
        ]
    )


def check_contract(df: DataFrame, contract: Mapping[str, str]) -> list[str]:
    """SRC22: differences between a table and its declared columns (empty = fits)."""
    have = {n.lower(): t for n, t in df.dtypes}
    problems = [f"missing column {n}" for n in contract if n.lower() not in have]
    problems += [
        f"column {n} is {have[n.lower()]}, declared {t}"
        for n, t in contract.items()
        if n.lower() in have and have[n.lower()] != t
    ]
    return problems


# --- synthetic parcels -------------------------------------------------------------------

M31 = 2147483647


def uniform(key: Column, seed: int, stream: int) -> Column:
    """Repeatable number in [0, 1) from a key: two rounds of a linear generator."""
    first = ((key % M31) * 48271 + seed * 7919 + stream * 104729) % M31
    return (((first * 69621 + stream * 15485863) % M31).cast("double")) / M31


# Area, extent and category mix of synthetic parcels.
SYNTHETIC_BOX = (-122.5, 36.5, -121.5, 37.5)
KM2_PER_DEG2, ACRES_PER_KM2 = 89.0 * 111.0, 247.105


def synthetic(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """SRC23: one made-up parcel per id (0..n-1) on a jittered grid."""
    xmin, ymin, xmax, ymax = SYNTHETIC_BOX
    cols = max(1, int(-(-(n**0.5) // 1)))
    rows = -(-n // cols)
    w, h = (xmax - xmin) / cols, (ymax - ymin) / rows
    i = F.col("id")

    def u(stream: int) -> Column:
        return uniform(i, seed, stream)

    side = (w * h) ** 0.5 * (u(1) * 0.5 + 0.5)
    acres = F.least(
        F.greatest(side * side * KM2_PER_DEG2 * ACRES_PER_KM2, F.lit(0.01)), F.lit(640.0)
    )
    category = X.ladder([(u(2) < 0.6, "urban"), (u(2) < 0.8, "agricultural"), (u(2) < 0.9, "industrial")], "undeveloped")
    pop = acres * (5.0 + u(3) * 30.0)
    hh = pop / (2.0 + u(4) * 1.5)
    jobs = pop * F.when(category == "urban", u(5) * 0.6).otherwise(u(5) * 0.3)
    out = ids.select("id").withColumns({"_side": side, "area_gross": acres, "land_development_category": category})
    return out.select(
        "id",
        F.concat(F.lit("synthetic_"), i.cast("string")).alias("id_source"),
        (xmin + (i % cols + 0.5) * w).alias("x"),
        (ymin + (F.floor(i / cols) + 0.5) * h).alias("y"),
        F.col("_side").alias("side_deg"),
        "area_gross",
        (F.col("area_gross") * 0.85).alias("area_parcel"),
        (F.col("area_gross") * 0.15).alias("area_row"),
        "land_development_category",
        (u(6) * 25.0).alias("intersection_density"),
        pop.alias("pop"),
        hh.alias("hh"),
        (hh * (0.95 + u(7) * 0.1)).alias("du"),
        jobs.alias("emp"),
    )


def synthetic_parcels(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """SRC23 for a wanted number of rows."""
    return synthetic(spark.range(n), n, seed)
