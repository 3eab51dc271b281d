"""Studies on tile vectors: choosing an aggregation rule, thinning, localisation against masks, probing new generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import arrays
from assayer.functions.text import canonical_source
from assayer.operators.protocol import BUDGET, rate, stable_halves, threshold_at_fpr, worst_source_cut
from assayer.operators.ranks import auc, percentiles


def _scored(tiles: DataFrame, extra: list[str], rules=arrays.RULES) -> DataFrame:
    """One row for each record and rule, without those that no finite tile is left of."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("rule"), F.round(arrays.aggregate_rule(F.col("tile_scores"), r), 9).alias("score")) for i, r in enumerate(rules)])).alias("s")
    return tiles.select(*extra, each).select(*extra, "s.*").where("score is not null")


def select_rule(tiles: DataFrame, anchor: str, dataset: str, budget: float = BUDGET) -> DataFrame:
    """(rule, cut, macro_recall, calibration_fp, evaluation_fp, evaluation_recall, evaluation_auc, macro_fp, worst_fp, chosen).

    The anchor's real records and each generator of its dataset are split in halves. The cut is fitted on the anchor's calibration half;
    the rule with the best mean calibration recall over generators is chosen, ties to the earlier rule. Evaluation
    halves and all other real sources are only reported. Repeated records count once.
    """
    rows = tiles.where("label in (0, 1)").withColumn("source", canonical_source(F.col("source"))).where("source is not null").distinct()
    halves = stable_halves(rows.select("path", "dataset", "source", "label", "tile_scores"), ["dataset", "source", "label"])
    s = _scored(halves, ["dataset", "source", "label", "half"])
    here = F.col("dataset") == dataset
    real, ai = (F.col("label") == 0) & here & (F.col("source") == anchor), (F.col("label") == 1) & here
    s = s.withColumn("role", F.when(real, "real").when(ai, "ai").when(F.col("label") == 0, "other")).where("role is not null")
    cut = threshold_at_fpr(s.where("role = 'real' and half = 'calibration'"), ["rule"], budget).select("rule", "cut")
    per = s.join(cut, "rule").groupBy("pos", "rule", "cut", "role", "half", "source").agg(F.count("*").alias("n"), F.count_if(F.col("score") > F.col("cut")).alias("hits"))
    both = F.col("role") == "other"
    per = per.withColumn("half", F.when(both, F.lit("all")).otherwise(F.col("half"))).groupBy("pos", "rule", "cut", "role", "half", "source").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    is_ = lambda r, h: (F.col("role") == r) & (F.col("half") == h)
    share = lambda c: F.sum(F.when(c, F.col("hits"))) / F.sum(F.when(c, F.col("n")))
    mean = lambda c: F.avg(F.when(c, F.col("hits") / F.col("n")))
    out = per.groupBy("pos", "rule", "cut").agg(
        F.round(mean(is_("ai", "calibration")), 9).alias("macro_recall"), F.round(share(is_("real", "calibration")), 9).alias("calibration_fp"),
        F.round(share(is_("real", "evaluation")), 9).alias("evaluation_fp"), F.round(share(is_("ai", "evaluation")), 9).alias("evaluation_recall"),
        F.round(mean(both), 9).alias("macro_fp"), F.round(F.max(F.when(both, F.col("hits") / F.col("n"))), 9).alias("worst_fp"),
    )
    area = auc(s.where("half = 'evaluation' and role in ('real', 'ai')"), ["rule"], "score", "label").select("rule", F.round("auc", 9).alias("evaluation_auc"))
    best = out.agg(F.max_by("rule", F.struct("macro_recall", -F.col("pos"))).alias("best"))
    return out.join(area, "rule", "left").crossJoin(F.broadcast(best)).select(
        "rule", "cut", "macro_recall", "calibration_fp", "evaluation_fp", "evaluation_recall", "evaluation_auc", "macro_fp", "worst_fp", (F.col("rule") == F.col("best")).alias("chosen")
    )


def rule_grid(tiles: DataFrame, sizes: list[int]) -> DataFrame:
    """(rule, k, n_neg, n_pos, auc): each rule on the finite tiles thinned to k evenly spaced ones, k = 0 for all of them."""
    rows, out = tiles.where("label in (0, 1)").distinct(), None
    for k in [0, *sizes]:
        a = arrays.finite_only(F.col("tile_scores"))
        part = _scored(rows.withColumn("tile_scores", arrays.thin(a, k) if k else a), ["label"]).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return auc(out, ["rule", "k"], "score", "label").select("rule", "k", "n_neg", "n_pos", F.round("auc", 9).alias("auc"))


def localisation(mask_tiles: DataFrame) -> DataFrame:
    """(dataset, n_images, mask_frac, iou, chance, n_inside, n_outside, tile_auc) of (dataset, image, tile_idx, score, coverage, mask_frac).

    A tile is inside from half coverage. Images without a tile clearly in or clearly out are left out. Flagged are the
    tiles at or above the image's (1 - mask_frac) percentile, so flagging at random already has an overlap of f/(2-f).
    Only one picture's tiles are ever gathered.
    """
    tile = F.struct("score", (F.col("coverage") >= 0.5).alias("inside"))
    per = mask_tiles.groupBy("dataset", "image").agg(F.collect_list(tile).alias("t"), F.max("mask_frac").alias("f"), F.max("coverage").alias("hi"), F.min("coverage").alias("lo"))
    per = per.where("hi >= 0.5 and lo <= 0.5")
    at = (1 - F.col("f")) * (F.size("t") - 1)
    low, high = F.get("v", F.floor(at).cast("int")), F.get("v", F.ceil(at).cast("int"))
    per = per.withColumn("v", F.array_sort(F.transform("t", lambda x: x["score"])))
    per = per.withColumn("cut", F.when(F.col("f") > 0, low + (high - low) * (at - F.floor(at))).otherwise(F.lit(1.0)))
    count = lambda c: F.size(F.filter("t", c))
    both = count(lambda x: (x["score"] >= F.col("cut")) & x["inside"])
    either = count(lambda x: (x["score"] >= F.col("cut")) | x["inside"])
    per = per.withColumn("iou", F.when(either > 0, both / either))
    out = per.groupBy("dataset").agg(F.count("*").alias("n_images"), F.avg("f").alias("f"), F.avg("iou").alias("iou"))
    tiles = per.select("dataset", F.explode("t").alias("x")).select("dataset", "x.score", F.col("x.inside").cast("int").alias("inside"))
    area = auc(tiles, ["dataset"], "score", "inside").select("dataset", F.col("n_pos").alias("n_inside"), F.col("n_neg").alias("n_outside"), F.round("auc", 9).alias("tile_auc"))
    f = F.col("f")
    return out.join(area, "dataset").select("dataset", "n_images", F.round("f", 9).alias("mask_frac"), F.round("iou", 9).alias("iou"), F.round(f / (2 - f), 9).alias("chance"), "n_inside", "n_outside", "tile_auc")


def generator_probe(sp: DataFrame, dataset: str, area: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(detector_id, source, n, median_score, flagged_rate, auc): how new generators fare under the worst-source cut, with
    the AUC against the anchor that `area` holds."""
    cut = worst_source_cut(sp.where("half = 'calibration' and label = 0"), budget)
    new = sp.where((F.col("label") == 1) & (F.col("dataset") == dataset))
    keys = ["detector_id", "source"]
    out = new.join(cut, "detector_id").groupBy(*keys).agg(F.count("*").alias("n"), F.round(rate(F.col("score") > F.col("cut")), 9).alias("flagged_rate"))
    med = percentiles(new, keys, "score", {"m": 0.5}).select(*keys, F.round("m", 9).alias("median_score"))
    return out.join(med, keys).join(area.select(*keys, "auc"), keys, "left")


def overridden(records: DataFrame, override: DataFrame, source: str) -> DataFrame:
    """records with the scores of `override` (detector_id, stem, score) in place of those of one source's files of the
    same stem; all others keep their own."""
    hit = override.select("detector_id", F.col("stem").alias("_stem"), F.col("score").alias("_score")).groupBy("detector_id", "_stem").agg(F.max("_score").alias("_score"))
    j = records.withColumn("_stem", F.when(F.col("source") == source, F.col("stem"))).join(hit, ["detector_id", "_stem"], "left")
    return j.withColumns({"was_overridden": F.col("_score").isNotNull(), "score": F.coalesce("_score", "score")}).drop("_stem", "_score")
