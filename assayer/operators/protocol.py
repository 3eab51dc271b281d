"""The evaluation protocol: records, stable halves, thresholds at a false-positive budget, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.text import canonical_source, finite
from assayer.operators.ranks import kth_values

SEED, FRACTION, BUDGET = 2026, 0.5, 0.1
POP = ["detector_id", "dataset", "source", "label"]


def records(image_scores: DataFrame) -> DataFrame:
    """The record of each (detector_id, path): the latest scoring wins, then the larger score_id.

    The key is shuffled and sorted as 128 bits instead of as text, and rows that lose are dropped before the shuffle.
    """
    keyed = image_scores.withColumns({"_k1": F.xxhash64("detector_id", "path"), "_k2": F.xxhash64(F.lit("key"), "path", "detector_id")})
    last = W.partitionBy("_k1", "_k2").orderBy(F.desc("scored_at"), F.desc("score_id"))
    best = keyed.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_k1", "_k2")
    return best.withColumn("source", canonical_source(F.col("source")))


def populations(image_scores: DataFrame) -> DataFrame:
    """Records that belong to a population: with a source, a label of 0 or 1 and a finite score."""
    r = records(image_scores)
    return r.where(F.col("source").isNotNull() & F.col("label").isin(0, 1) & finite(F.col("image_score"))).withColumn(
        "score", F.col("image_score") + F.lit(0.0)
    )


def calibration_size(n: Column, fraction: float) -> Column:
    """min(n-1, max(1, round-half-even(n*fraction))), and 0 for a single row."""
    return F.when(n < 2, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("bigint"))))


def stable_halves(df: DataFrame, keys: list[str] | None = None, key: str = "path", seed: int = SEED, fraction: float = FRACTION) -> DataFrame:
    """df with `half`: the first rows of each population by SHA-256 of "seed:key" are for calibration.

    The cut is the order statistic of the digest's first 60 bits, so no population is sorted as a whole.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    keys = keys or POP
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), 1, 15), 16, 10).cast("bigint")
    rows = df.withColumn("_h", h)
    cut = kth_values(rows, keys, "_h", lambda n: [calibration_size(n, fraction)]).select(*keys, F.col("y").alias("_cut"))
    joined = rows.join(cut, keys, "left")
    return joined.withColumn("half", F.when(F.col("_h") <= F.col("_cut"), "calibration").otherwise("evaluation")).drop("_h", "_cut")


def threshold_at_fpr(reals: DataFrame, keys: list[str], budget: float = BUDGET, score: str = "score") -> DataFrame:
    """(keys, n, cut): scores above the cut are at most floor(n*budget) of the real ones, however many tie.

    A verdict is `score > cut`, which is the same as `score >= nextUp(cut)`.
    """
    if not 0 <= budget < 1:
        raise ValueError("budget must lie in [0, 1)")
    got = kth_values(reals, keys, score, lambda n: [n - F.floor(n * F.lit(budget))])
    return got.select(*keys, "n", F.col("y").alias("cut"))


def next_up(cut: str) -> Column:
    """The least double above, as a threshold for `>=`; keep it in the last projection."""
    return F.expr(f"cast(java_method('java.lang.Math', 'nextUp', {cut}) as double)")


def rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def worst_source_cut(cal_reals: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(detector_id, cut): the strictest of the per-source cuts."""
    per = threshold_at_fpr(cal_reals, ["detector_id", "dataset", "source"], budget)
    return per.groupBy("detector_id").agg(F.max("cut").alias("cut"))


def worst_source_report(sp: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Evaluation rates of each population under its detector's worst-source cut."""
    cut = worst_source_cut(sp.where("half = 'calibration' and label = 0"), budget)
    ev = sp.where("half = 'evaluation'").join(cut, "detector_id")
    return ev.groupBy(*POP).agg(F.count("*").alias("n"), F.round(rate(F.col("score") > F.col("cut")), 9).alias("flagged_rate"))
