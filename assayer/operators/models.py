"""Probes that train a model to ask whether a pool gives its classes away, and learners to compare."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import finite
from assayer.operators.pool import stratified_holdout
from assayer.operators.ranks import auc
from assayer.session import Scratch


def split_rows(df: DataFrame, id_col: str, keys: list[str], fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """df with `train`: false for the given share of each key's rows, the first by hash."""
    scratch = Scratch(df.sparkSession, "probe")
    df = scratch.write(df)
    held = stratified_holdout(df, keys, id_col, fraction, seed).select(F.col(id_col).alias("_id"), F.lit(True).alias("_held"))
    rows = df.join(held, F.col(id_col) == F.col("_id"), "left").withColumn("train", F.col("_held").isNull()).drop("_id", "_held")
    return scratch.write(rows)  # learners read it once for each of their passes


def boosted(iterations: int = 20) -> GBTClassifier:
    return GBTClassifier(featuresCol="x", labelCol="label", maxIter=iterations, maxDepth=5, seed=42)


def learners() -> dict:
    """The learners that are compared with each other, all with a binary label."""
    return {
        "logistic": LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=0.01, maxIter=50),
        "linear_svm": LinearSVC(featuresCol="x", labelCol="label", regParam=0.01, maxIter=50),
        "random_forest": RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=100, maxDepth=8, seed=42),
        "boosted": boosted(),
    }


def fit_and_score(rows: DataFrame, cols: list[str], learner) -> DataFrame:
    """(label, p) of the rows with train = false, scored by a standard scaler and the learner fitted on the others."""
    vec = VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="skip").transform(rows)
    model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="x", withMean=True), learner]).fit(vec.where("train"))
    got = model.transform(vec.where("not train"))
    return got.select("label", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("p"))


def save_model(model, path: str) -> None:
    """A fitted pipeline as a folder, which PipelineModel.load reads."""
    model.write().overwrite().save(path)


METADATA, COMPRESSION = ["w", "h", "aspect", "bpp", "square"], ["bpp"]


def metadata_rows(pool: DataFrame) -> DataFrame:
    return pool.where("label in (0, 1) and w is not null and h is not null").where(finite(F.col("bpp"))).select(
        "pool_id", "label", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"), (F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1))).alias("aspect"),
        "bpp", F.coalesce("square", F.lit(0)).cast("double").alias("square"),
    )


def metadata_probe(pool: DataFrame, iterations: int = 20) -> DataFrame:
    """(features, n_test, auc, flag): can size, shape and compression alone tell the classes apart?

    Boosted trees, as medians and ratios miss what they find; 70 % of each class train, the rest judge. Flagged above
    0.75, for compression alone above 0.6. A pool of one class gives a null AUC.
    """
    rows = split_rows(metadata_rows(pool), "pool_id", ["label"])
    out = None
    for name, cols, limit in (("metadata", METADATA, 0.75), ("ratio", COMPRESSION, 0.6)):
        scored = fit_and_score(rows, cols, boosted(iterations)).withColumn("features", F.lit(name))
        a = auc(scored, ["features"], "p", "label").select("features", (F.col("n_neg") + F.col("n_pos")).alias("n_test"), "auc", (F.col("auc") > limit).alias("flag"))
        out = a if out is None else out.union(a)
    return out


def probe_folds(pool: DataFrame, folds: int = 5, iterations: int = 10) -> DataFrame:
    """(fold, n_test, auc): the metadata probe on each of `folds` parts by hash, trained on the others."""
    rows = metadata_rows(pool).withColumn("fold", F.pmod(F.xxhash64(F.lit(42), "pool_id"), F.lit(folds)).cast("int"))
    rows, out = Scratch(pool.sparkSession, "probe").write(rows), None
    for k in range(folds):
        scored = fit_and_score(rows.withColumn("train", F.col("fold") != k), METADATA, boosted(iterations)).withColumn("fold", F.lit(k))
        a = auc(scored, ["fold"], "p", "label").select("fold", (F.col("n_neg") + F.col("n_pos")).alias("n_test"), "auc")
        out = a if out is None else out.union(a)
    return out


def embedding_probes(embeddings: DataFrame, positive: int = 5) -> DataFrame:
    """(learner, n_test, auc): each learner on embeddings, classes at or above `positive` against the others, weighted
    so that both count alike; 70 % of each class train, the rest judge."""
    rows = embeddings.select("vec_id", (F.col("label") >= positive).cast("int").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    share = rows.agg(F.avg("label")).first()[0] or 0.5
    rows = split_rows(rows, "vec_id", ["label"]).withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    out = None
    for name, learner in learners().items():
        scored = fit_and_score(rows, ["v"], learner).withColumn("learner", F.lit(name))
        a = auc(scored, ["learner"], "p", "label").select("learner", (F.col("n_neg") + F.col("n_pos")).alias("n_test"), "auc")
        out = a if out is None else out.union(a)
    return out


def shortcut_probe(tiles: DataFrame, wide: int = 600) -> DataFrame:
    """(n_test, auc): do a picture's texture and compression give away that it is wider than `wide`?"""
    cols = ["texture_mean", "texture_p50", "texture_p90", "bytes_per_pixel"]
    rows = tiles.where("width is not null").dropDuplicates(["path"]).select("path", (F.col("width") > wide).cast("int").alias("label"), *cols)
    for c in cols:
        rows = rows.where(finite(F.col(c)))
    learner = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.01, maxIter=50)
    scored = fit_and_score(split_rows(rows, "path", ["label"]), cols, learner).withColumn("one", F.lit(1))
    return auc(scored, ["one"], "p", "label").select((F.col("n_neg") + F.col("n_pos")).alias("n_test"), "auc")


def gate_passes(metadata: Column, metadata_gain: Column, texture_control: Column, gain: Column) -> Column:
    """Whether a new arm may be trusted: the class can't be told from metadata (below 0.65) nor gains from it (below 0.10), the
    control on texture fails (below 0.70), and the arm itself gains at least 0.10."""
    return (metadata < 0.65) & (metadata_gain < 0.10) & (texture_control < 0.70) & (gain >= 0.10)


def cluster_report(embeddings: DataFrame, k: int = 2) -> DataFrame:
    """(cluster, n, top_label, purity) of a k-means clustering."""
    rows = embeddings.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    got = KMeans(k=k, seed=42, maxIter=20).fit(rows).transform(rows)
    c = got.groupBy(F.col("prediction").alias("cluster"), "label").agg(F.count("*").alias("c"))
    return c.groupBy("cluster").agg(F.sum("c").alias("n"), F.max_by("label", F.struct("c", "label")).alias("top_label"), (F.max("c") / F.sum("c")).alias("purity"))
