"""Regressors for units, floor area and jobs per acre, on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.functions import expr as X
from landspan.operators.ranking import first_per
from landspan.session import cut
from landspan.sources import sinks

DU_TARGETS = ("du_detsf_sl", "du_detsf_ll", "du_attsf", "du_mf2to4", "du_mf5p")
JOB_TARGETS = tuple(f"emp_{s}_per_acre" for s in ("ret", "off", "pub", "ind", "ag"))
NUMERIC = (
    "lot_size_acres", "residential_building_sqft", "commercial_building_sqft", "industrial_building_sqft",
    "other_building_sqft", "total_footprint_sqft", "building_count", "footprint_ratio", "max_levels",
    "intersection_density", "highway_intersection_density", "path_intersection_density",
)
LEAST_ROWS, TOP_CODES, TWEEDIE_POWER, SEED = 100, 20, 1.3, 42
COMPONENTS, PARALLEL = 32, 4


def training_set(reference: DataFrame, crosswalk: DataFrame, parcels: DataFrame, features: Mapping[str, DataFrame], targets: Sequence[str]) -> DataFrame:
    """ML01: one row per parcel number: targets of its largest overlap, known features.

    ``crosswalk``: parcel_id, apn, intersect_area_m2.  Missing features are 0, missing
    levels 1.
    """
    pairs = reference.select("parcel_id", *targets).join(crosswalk, "parcel_id")
    one = first_per(pairs, ["apn"], [F.desc("intersect_area_m2"), F.asc("parcel_id")]).drop("parcel_id", "intersect_area_m2")
    out = one.join(parcels, "apn")
    for df in features.values():
        out = out.join(df, "apn", "left")
    numeric = [n for n in out.columns if n in NUMERIC or n.startswith("pc_")]
    filled = {n: F.coalesce(F.col(n).cast("double"), F.lit(1.0 if n == "max_levels" else 0.0)) for n in numeric}
    filled["land_development_category"] = F.coalesce("land_development_category", F.lit("standard"))
    # the encoding, the fingerprint and every model read these rows again: the joins run once
    return cut(out.withColumns(filled))


@dataclass(frozen=True)
class Encoding:
    """ML02: feature columns learned from the training rows; reused for every region."""

    codes: tuple[str, ...]
    zones: tuple[str, ...]
    categories: tuple[str, ...]
    numeric: tuple[str, ...] = field(default=NUMERIC)

    @property
    def columns(self) -> list[str]:
        # numbered: values may differ in case only, column names may not
        return [
            *["n_" + n for n in self.numeric],
            *[f"lu_{i}" for i in range(len(self.codes))],
            *[f"zone_{i}" for i in range(len(self.zones))],
            *[f"ldc_{i}" for i in range(len(self.categories))],
        ]


def _code():
    return F.substring(F.coalesce("landuse", F.lit("XX")), 1, 2)


def _zone():
    return F.substring(F.coalesce("zone", F.lit("X")), 1, 1)


def learn_encoding(train: DataFrame) -> Encoding:
    """ML02: the 20 most frequent code prefixes, all zone letters and categories.

    Only these short lists reach the driver.
    """

    def values(col, limit: int | None = None) -> tuple[str, ...]:
        counts = train.groupBy(col.alias("v")).agg(F.count("*").alias("n"))
        if limit:
            counts = counts.orderBy(F.desc("n"), F.asc("v")).limit(limit)
        return tuple(sorted(r["v"] for r in counts.where("v IS NOT NULL").collect()))

    numeric = tuple(n for n in train.columns if n in NUMERIC or n.startswith("pc_"))
    return Encoding(values(_code(), TOP_CODES), values(_zone()), values(F.col("land_development_category")), numeric)


def encode(df: DataFrame, e: Encoding) -> DataFrame:
    """ML02 / ML06: feature columns; a column the region lacks counts as 0."""

    def number(n: str):
        v = F.col(n).cast("double") if n in df.columns else F.lit(0.0)
        v = F.coalesce(v, F.lit(1.0 if n == "max_levels" else 0.0))
        return X.clamp(v, 0.0, 50.0) if n == "building_count" else v

    out = {"n_" + n: number(n).cast("float").cast("double") for n in e.numeric}
    out |= {f"lu_{i}": (_code() == c).cast("double") for i, c in enumerate(e.codes)}
    out |= {f"zone_{i}": (_zone() == c).cast("double") for i, c in enumerate(e.zones)}
    category = F.coalesce("land_development_category", F.lit("standard"))
    out |= {f"ldc_{i}": (category == c).cast("double") for i, c in enumerate(e.categories)}
    return df.withColumns(out)


def regressor(target: str, kind: str = "trees", **options):
    """Boosted trees, or a Tweedie GLM (variance power 1.3) for many zeros."""
    if kind == "tweedie":
        return GeneralizedLinearRegression(
            family="tweedie", variancePower=TWEEDIE_POWER, linkPower=0.0, regParam=1.0, labelCol=target,
            predictionCol="p_" + target, **options,
        )
    options = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.6} | options
    return GBTRegressor(labelCol=target, predictionCol="p_" + target, seed=SEED, **options)


def fit(train: DataFrame, targets: Sequence[str], e: Encoding, kind: str = "trees", **options) -> PipelineModel | None:
    """ML03-ML05: one model per target on the same features; None below 100 rows.

    A fit reads its rows many times, so features and targets are written once.  The models
    know nothing of each other and are fitted ``PARALLEL`` at a time.
    """
    if train.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return None
    assembler = VectorAssembler(inputCols=e.columns, outputCol="features")
    rows = cut(assembler.transform(encode(train, e)).select("features", *targets))
    fit_one = inheritable_thread_target(train.sparkSession)(lambda t: regressor(t, kind, **options).fit(rows))
    with ThreadPool(PARALLEL) as pool:
        return PipelineModel([assembler, *pool.map(fit_one, targets, chunksize=1)])


def predict(
    model: PipelineModel | None, df: DataFrame, e: Encoding, targets: Sequence[str], total: str | None = None, whole: bool = False
) -> DataFrame:
    """ML03-ML07: predictions of all rows, at least 0; ``whole`` rounds to whole numbers.

    Without a model every prediction is 0.
    """
    if model is None:
        out = df.select("apn", *[F.lit(0.0).alias(t) for t in targets])
    else:
        raw = model.transform(encode(df, e))

        def value(t: str):
            v = X.non_negative(F.col("p_" + t))
            return F.round(v) if whole else v

        out = raw.select("apn", *[value(t).alias(t) for t in targets])
    if total:
        summed = F.col(targets[0])
        for t in targets[1:]:
            summed = summed + F.col(t)
        out = out.withColumn(total, summed)
    return out


def holdout_scores(train: DataFrame, targets: Sequence[str], e: Encoding, kind: str = "trees", **options) -> dict[str, float]:
    """ML08: R2 per target and their mean on a fifth held out."""
    fit_rows, test_rows = train.randomSplit([0.8, 0.2], seed=SEED)
    model = fit(fit_rows, targets, e, kind, **options)
    if model is None:
        return {}
    scored = model.transform(encode(test_rows, e))
    scores = {
        t: RegressionEvaluator(labelCol=t, predictionCol="p_" + t, metricName="r2").evaluate(scored) for t in targets
    }
    return scores | {"mean": sum(scores.values()) / len(scores)}


def fingerprint(df: DataFrame) -> DataFrame:
    """ML09: order-free content hash of a table: rows, sum and xor of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count("*").alias("n"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"),
        F.bit_xor(h).alias("mixed"),
    )


def cached_fit(train: DataFrame, targets: Sequence[str], e: Encoding, folder: str, kind: str = "trees", **options) -> tuple[PipelineModel | None, bool]:
    """ML09: train only when the data changed; returns (model, was it cached)."""
    row = fingerprint(train.select(*sorted(train.columns))).first()
    tag = f"{kind}-{row['n']}-{row['total']}-{row['mixed']}".replace("--", "-m")
    path = f"{folder}/{tag}"
    # the metadata folder is written first, the last stage last
    if sinks.exists(train.sparkSession, f"{path}/done"):
        return PipelineModel.load(f"{path}/model"), True
    model = fit(train, targets, e, kind, **options)
    if model is not None:
        model.write().overwrite().save(f"{path}/model")
        train.sparkSession.createDataFrame([(tag,)], "tag string").write.mode("overwrite").text(f"{path}/done")
    return model, False


def embedding_features(embeddings: DataFrame, apns: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, PipelineModel]:
    """ML10: last embedding per parcel, k principal components, joined to parcel numbers.

    ``embeddings``: parcel_id, seq, embedding array; ``apns``: parcel_id, apn.
    """
    last = first_per(embeddings, ["parcel_id"], [F.desc("seq")])
    vectors = last.select("parcel_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = Pipeline(stages=[PCA(k=k, inputCol="v", outputCol="pca")]).fit(vectors)
    parts = model.transform(vectors).withColumn("a", vector_to_array("pca"))
    out = parts.select("parcel_id", *[F.col("a")[i].cast("float").alias(f"pc_{i}") for i in range(k)])
    return out.join(apns.select("parcel_id", "apn").distinct(), "parcel_id", "left"), model


def search(
    train: DataFrame, target: str, e: Encoding, grid: Mapping[str, Sequence], folds: int = 3, rounds: int = 100, parallelism: int = 4
) -> tuple[dict, float]:
    """ML11: cross-validated search by root mean square error: best setting and score.

    ``grid``: values of any parameters of the boosted trees; those of ``maxIter`` come
    before ``rounds``.  Settings are fitted ``parallelism`` at a time.
    """
    model = GBTRegressor(labelCol=target, seed=SEED, maxIter=rounds)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(model, name), list(values))
    maps = builder.build()
    pipe = Pipeline(stages=[VectorAssembler(inputCols=e.columns, outputCol="features"), model])
    cv = CrossValidator(
        estimator=pipe, estimatorParamMaps=maps, numFolds=folds, seed=SEED, parallelism=parallelism,
        evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"),
    )
    fitted = cv.fit(encode(train, e))
    i = min(range(len(maps)), key=lambda j: fitted.avgMetrics[j])
    return {p.name: v for p, v in maps[i].items()}, fitted.avgMetrics[i]

