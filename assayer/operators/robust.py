"""Robustness studies on top of the protocol: leave one source out, abstention, frontier, union, bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.digests import PIECE, numbered_heads
from assayer.operators.protocol import BUDGET, POP, SEED, rate, stable_halves, threshold_at_fpr, worst_source_cut
from assayer.operators.ranks import auc, kth_values, kth_without, percentiles, positions, running
from assayer.session import Scratch, let_workers_import

SRC = ["detector_id", "dataset", "source"]
#: Draws held at once by a worker, and draws that one task makes.
CHUNK, TASK_DRAWS = 4_000_000, 50_000_000
#: Parts that the replicates of a hashed bootstrap are dealt to, at least and at most; each is sent the scores once.
SLICES, MOST_SLICES = 8, 20


def auc_by_generator(sp: DataFrame, anchor: str) -> DataFrame:
    """AUC of each generator's evaluation half against the anchor's real evaluation half.

    The anchor's scores are counted once for each detector, in one line with those of all generators; no copy of them
    is made for a generator.
    """
    ev = sp.where("half = 'evaluation'")
    is_real = (F.col("label") == 0) & (F.col("source") == anchor)
    seen = ev.where(is_real | (F.col("label") == 1))
    line = seen.groupBy("detector_id", "score").agg(F.count(F.when(is_real, 1)).alias("q"))
    line = running(line, ["detector_id"], "score", ["q"])
    ai = ev.where("label = 1").groupBy("detector_id", "source", "score").agg(F.count("*").alias("p"))
    u = ai.join(line, ["detector_id", "score"]).groupBy("detector_id", "source").agg(
        F.sum("p").alias("n_pos"), F.sum(F.col("p") * (F.col("before_q") + F.col("q") / F.lit(2.0))).alias("u")
    )
    real = line.groupBy("detector_id").agg(F.sum("q").alias("n_neg"))
    area = F.when(F.col("n_neg") > 0, F.round(F.col("u") / (F.col("n_pos") * F.col("n_neg")), 9))
    return u.join(real, "detector_id").select("detector_id", "source", "n_neg", "n_pos", area.alias("auc"))


def operating_point(sp: DataFrame, anchor: str, budget: float = BUDGET) -> DataFrame:
    """Fit on the anchor's real calibration half; its false positives on both halves, recall on all generators."""
    real = sp.where((F.col("label") == 0) & (F.col("source") == anchor))
    cut = threshold_at_fpr(real.where("half = 'calibration'"), ["detector_id"], budget).select("detector_id", "cut")
    over = F.col("score") > F.col("cut")
    seen = sp.join(cut, "detector_id").withColumn("anchor_real", (F.col("label") == 0) & (F.col("source") == anchor))
    pick = lambda c: F.round(F.avg(F.when(c, over.cast("double"))), 9)
    return seen.groupBy("detector_id", "cut").agg(
        pick(F.col("anchor_real") & (F.col("half") == "calibration")).alias("calibration_fp"),
        pick(F.col("anchor_real") & (F.col("half") == "evaluation")).alias("evaluation_fp"),
        pick((F.col("label") == 1) & (F.col("half") == "evaluation")).alias("evaluation_recall"),
    )


def protocol_report(sp: DataFrame, anchor: str, budget: float = BUDGET) -> DataFrame:
    """(detector_id, metric, dataset, source, value): per-source false positives, per-generator recall, their
    macro mean and worst, and the pooled AUC of the evaluation halves."""
    real = sp.where((F.col("label") == 0) & (F.col("source") == anchor) & (F.col("half") == "calibration"))
    cut = threshold_at_fpr(real, ["detector_id"], budget).select("detector_id", "cut")
    ev = sp.where("half = 'evaluation'").join(cut, "detector_id")
    per = ev.groupBy(*POP).agg(rate(F.col("score") > F.col("cut")).alias("r"))
    one = per.select("detector_id", F.when(F.col("label") == 0, "source_fp").otherwise("generator_recall").alias("metric"), "dataset", "source", F.round("r", 9).alias("value"))
    none = F.lit(None).cast("string")
    two = per.where("label = 0").groupBy("detector_id").agg(F.avg("r").alias("macro_fp"), F.max("r").alias("worst_fp"), F.max_by("source", F.struct("r", "source")).alias("w"))
    macro = two.select("detector_id", F.lit("macro_fp").alias("metric"), none.alias("dataset"), none.alias("source"), F.round("macro_fp", 9).alias("value"))
    worst = two.select("detector_id", F.lit("worst_fp").alias("metric"), none.alias("dataset"), F.col("w").alias("source"), F.round("worst_fp", 9).alias("value"))
    recall = per.where("label = 1").groupBy("detector_id").agg(F.round(F.avg("r"), 9).alias("value")).select("detector_id", F.lit("macro_recall").alias("metric"), none.alias("dataset"), none.alias("source"), "value")
    area = auc(ev, ["detector_id"], "score", "label").select("detector_id", F.lit("auc").alias("metric"), none.alias("dataset"), none.alias("source"), F.round("auc", 9).alias("value"))
    return one.unionByName(macro).unionByName(worst).unionByName(recall).unionByName(area)


def loso(sp: DataFrame, rule: str, anchor: str, budget: float = BUDGET) -> DataFrame:
    """(detector_id, dataset, source, cut, n, fp): each real source judged by a cut fitted without it.

    worst_source takes the largest cut of the others, which the two largest cuts give in one pass; pooled fits
    all other sources together, by taking the held-out source's counts from those of all; anchor_only fits the
    anchor alone, which is then not held out.
    """
    cal, ev = sp.where("half = 'calibration' and label = 0"), sp.where("half = 'evaluation' and label = 0")
    if rule == "worst_source":
        cuts = threshold_at_fpr(cal, SRC, budget)
        top = cuts.groupBy("detector_id").agg(F.slice(F.sort_array(F.collect_list("cut"), asc=False), 1, 2).alias("top"))
        held = cuts.join(top, "detector_id").select(*SRC, F.when(F.col("cut") == F.get("top", F.lit(0)), F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0))).alias("cut"))
    elif rule == "pooled":
        held = kth_without(cal, ["detector_id"], ["dataset", "source"], "score", lambda n: n - F.floor(n * F.lit(budget)))
        held = held.select(*SRC, F.col("y").alias("cut"))
    elif rule == "anchor_only":
        one = threshold_at_fpr(cal.where(F.col("source") == anchor), ["detector_id"], budget).select("detector_id", "cut")
        held = cal.select(*SRC).distinct().where(F.col("source") != anchor).join(one, "detector_id")
    else:
        raise ValueError(f"unknown rule {rule}")
    return ev.join(held.where("cut is not null"), SRC).groupBy(*SRC, "cut").agg(F.count("*").alias("n"), F.round(rate(F.col("score") > F.col("cut")), 9).alias("fp"))


def miss_cuts(sp: DataFrame, misses: list[float]) -> DataFrame:
    """(detector_id, miss, t_real): at most a share `miss` of the calibration AI scores lie at or below it."""
    ai = sp.where("half = 'calibration' and label = 1")
    got = kth_values(ai, ["detector_id"], "score", lambda n: [F.floor(n * F.lit(m)) + 1 for m in misses])
    wanted = F.explode(F.array(*[F.struct(F.lit(m).alias("miss"), (F.floor(F.col("n") * F.lit(m)) + 1).alias("want")) for m in misses])).alias("w")
    each = got.select("detector_id", "n", "k", "y", wanted).where("k = w.want")
    return each.select("detector_id", F.col("w.miss").alias("miss"), F.col("y").alias("t_real"))


def verdict_mix(sp: DataFrame, misses: list[float | None], budget: float = BUDGET) -> DataFrame:
    """(detector_id, miss, dataset, source, label, n, ai, abstain, real): shares of the three verdicts on the
    evaluation halves, between the worst-source cut and each miss budget's cut (never above it). Under the miss
    budget None nothing is called real."""
    worst = worst_source_cut(sp.where("half = 'calibration' and label = 0"), budget)
    cuts = miss_cuts(sp, [m for m in misses if m is not None]).join(worst, "detector_id")
    cuts = cuts.select("detector_id", "miss", "cut", F.least("t_real", "cut").alias("t_real"))
    if None in misses:
        none = F.lit(None).cast("double")
        cuts = cuts.unionByName(worst.select("detector_id", none.alias("miss"), "cut", F.lit(float("-inf")).alias("t_real")))
    ev = sp.where("half = 'evaluation'").join(cuts, "detector_id")
    s, hi, lo = F.col("score"), F.col("cut"), F.col("t_real")
    return ev.groupBy("detector_id", "miss", "dataset", "source", "label").agg(
        F.count("*").alias("n"), F.round(rate(s > hi), 9).alias("ai"), F.round(rate((s > lo) & (s <= hi)), 9).alias("abstain"), F.round(rate(s <= lo), 9).alias("real")
    )


def miss_budget_frontier(sp: DataFrame, misses: list[float | None], budget: float = BUDGET) -> DataFrame:
    """(detector_id, miss, worst_fp, macro_recall, macro_abstain, macro_wrongly_real) over all populations."""
    mix = verdict_mix(sp, misses, budget)
    over = lambda c, lab: F.avg(F.when(F.col("label") == lab, F.col(c)))
    return mix.groupBy("detector_id", "miss").agg(
        F.round(F.max(F.when(F.col("label") == 0, F.col("ai"))), 8).alias("worst_fp"), F.round(over("ai", 1), 8).alias("macro_recall"),
        F.round(F.avg("abstain"), 8).alias("macro_abstain"), F.round(over("real", 1), 8).alias("macro_wrongly_real"),
    )


def union_gate(sp: DataFrame, base: list[str], extra: str, budget: float = BUDGET, step: float = 0.5, steps: int = 60) -> DataFrame:
    """(k, threshold, worst_fp, baseline_worst, passes): raise the extra arm's threshold until the union with the
    base arms has no source above max(budget, baseline); the row that passes first is the gate."""
    cut = worst_source_cut(sp.where("half = 'calibration' and label = 0"), budget)
    key = ["dataset", "source", "label", "path"]
    real = sp.where("half = 'evaluation' and label = 0").join(cut, "detector_id")
    arms = real.groupBy(*key).agg(
        F.max(F.when(F.col("detector_id").isin(base), F.col("score") > F.col("cut"))).alias("base_hit"),
        F.max(F.when(F.col("detector_id") == extra, F.col("score"))).alias("x"),
    ).where("base_hit is not null and x is not null")
    start = cut.where(F.col("detector_id") == extra).select(F.col("cut").alias("t0"))
    grid = start.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.col("t0") + k * F.lit(step))).alias("k", "threshold"))
    # counts by source and by the first step whose threshold a score no longer passes: the grid never meets the rows
    first = F.greatest(F.lit(0), F.ceil((F.col("x") - F.col("t0")) / F.lit(step)))
    bins = arms.crossJoin(F.broadcast(start)).groupBy("dataset", "source", F.least(first, F.lit(steps + 1)).cast("int").alias("first")).agg(
        F.count("*").alias("n"), F.sum(F.col("base_hit").cast("int")).alias("b")
    )
    tot = bins.groupBy("dataset", "source").agg(F.sum("n").alias("total"), F.sum("b").alias("hits"))
    joined = bins.join(tot, ["dataset", "source"]).crossJoin(F.broadcast(grid))
    per = joined.groupBy("k", "threshold", "dataset", "source", "total", "hits").agg(
        (F.col("hits") + F.sum(F.when(F.col("first") > F.col("k"), F.col("n") - F.col("b")).otherwise(0))).alias("u")
    )
    out = per.groupBy("k", "threshold").agg(F.max(F.col("u") / F.col("total")).alias("w"), F.max(F.col("hits") / F.col("total")).alias("bw"))
    return out.select("k", F.round("threshold", 9).alias("threshold"), F.round("w", 9).alias("worst_fp"), F.round("bw", 9).alias("baseline_worst"), (F.col("w") <= F.greatest(F.lit(budget), F.col("bw")) + 1e-12).alias("passes"))


def with_copies(pop: DataFrame) -> DataFrame:
    """Records that are no degraded copies, with copy_score: the score of the copy that names them, the latest by
    scored_at, then the larger score_id; null where there is none."""
    clean = F.coalesce(F.lower(F.trim("variant")), F.lit("none")).isin("none", "")
    copies = pop.where(~clean & F.col("orig_path").isNotNull()).groupBy("detector_id", F.col("orig_path").alias("path")).agg(
        F.max_by("score", F.struct("scored_at", "score_id")).alias("copy_score")
    )
    return pop.where(clean).join(copies, ["detector_id", "path"], "left")


def frozen_vs_refit(pop: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(detector_id, setting, cut, macro_fp, worst_fp, worst_source, macro_recall, auc): what degrading the pictures does.

    A degraded score stands in for its original's and so keeps the original's half. clean: original scores under the cut of
    the originals; frozen: degraded scores under the same cut; refit: degraded scores under the worst-source cut
    of the degraded calibration scores alone. Rates are of the evaluation halves, the AUC of all records of a setting. Settings without
    any score have no row.
    """
    scratch = Scratch(pop.sparkSession, "copies")
    sp = scratch.write(stable_halves(scratch.write(with_copies(pop), "records")), "halves")
    cal = sp.where("half = 'calibration' and label = 0")
    fitted = worst_source_cut(cal, budget).withColumnRenamed("cut", "first")
    again = worst_source_cut(cal.where("copy_score is not null").withColumn("score", F.col("copy_score")), budget).withColumnRenamed("cut", "second")
    cuts = scratch.write(fitted.join(again, "detector_id", "full"), "cuts")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), F.col(x).alias("x"), F.col(t).alias("cut")) for n, x, t in (("clean", "score", "first"), ("frozen", "copy_score", "first"), ("refit", "copy_score", "second"))])).alias("e")
    seen = sp.join(cuts, "detector_id").select(*POP, "half", each).select(*POP, "half", "e.*").where("x is not null and cut is not null")
    per = seen.where("half = 'evaluation'").groupBy(*POP, "setting", "cut").agg(rate(F.col("x") > F.col("cut")).alias("r"))
    of = lambda lab, c: F.when(F.col("label") == lab, c)
    out = per.groupBy("detector_id", "setting", "cut").agg(
        F.round(F.avg(of(0, F.col("r"))), 9).alias("macro_fp"), F.round(F.max(of(0, F.col("r"))), 9).alias("worst_fp"),
        F.max_by("source", of(0, F.struct("r", "source"))).alias("worst_source"), F.round(F.avg(of(1, F.col("r"))), 9).alias("macro_recall"),
    )
    area = auc(seen, ["detector_id", "setting"], "x", "label").select("detector_id", "setting", F.round("auc", 9).alias("auc"))
    return out.join(area, ["detector_id", "setting"], "left")


def source_diagnostic(pop: DataFrame) -> DataFrame:
    """Medians of size, bytes per pixel and score of each population."""
    rows = pop.withColumn("mpx", F.col("width").cast("double") * F.col("height") / F.lit(1e6))
    out = rows.groupBy(*POP).agg(F.count("*").alias("n"))
    for col, name in (("mpx", "median_mpx"), ("bytes_per_pixel", "median_bpp"), ("score", "median_score")):
        ok = rows.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
        out = out.join(percentiles(ok, POP, col, {name: 0.5}).select(*POP, F.round(name, 9).alias(name)), POP, "left")
    return out


def subgroup_profile(sp: DataFrame, generator: str, anchor: str, miss: float) -> DataFrame:
    """(detector_id, part, source, n, median_side, median_bpp, median_score): who is wrongly called real?

    Parts wrongly_real and not_real: one generator's evaluation pictures at or below and above the miss cut; parts
    generator and anchor, with the score alone: every generator's and the anchor's evaluation half.
    """
    lo = miss_cuts(sp, [miss]).select("detector_id", "t_real")
    ev = sp.where("half = 'evaluation'")
    one = ev.where((F.col("label") == 1) & (F.col("source") == generator)).join(lo, "detector_id")
    one = one.withColumn("part", F.when(F.col("score") <= F.col("t_real"), "wrongly_real").otherwise("not_real"))
    one = one.withColumn("side", F.greatest("width", "height"))
    every = ev.where((F.col("label") == 1) | (F.col("source") == anchor)).withColumn("part", F.when(F.col("label") == 1, "generator").otherwise("anchor"))
    keys, none = ["detector_id", "part", "source"], F.lit(None).cast("double")
    cols = ["part", "detector_id", "source", "score", "side", "bytes_per_pixel"]
    rows = one.select(*cols).unionByName(every.select("part", "detector_id", "source", "score", F.lit(None).cast("int").alias("side"), none.alias("bytes_per_pixel")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    for col, name in (("side", "median_side"), ("bytes_per_pixel", "median_bpp"), ("score", "median_score")):
        ok = rows.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
        out = out.join(percentiles(ok, keys, col, {name: 0.5}).select(*keys, F.round(name, 9).alias(name)), keys, "left")
    return out


def _drawn(table: DataFrame, replicates: int, fn: Callable[[np.ndarray, np.ndarray, float | None], float], cuts: DataFrame | None, slices: int, tasks: int) -> DataFrame:
    """(SRC, rep, got): fn(scores by place, places drawn, cut or None) of each replicate of each half in `table`, whose rows are
    pieces of halves. A task draws one population's places in one slice of the replicates, for all detectors at once."""
    keys = ["dataset", "source", "half", "slice"]
    cut = F.create_map().cast("map<int,double>").alias("cuts")
    given = table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    if cuts is not None:
        cuts = cuts.groupBy("detector_id", (F.col("rep") % slices).alias("slice")).agg(F.map_from_entries(F.collect_list(F.struct("rep", "cut"))).alias("cuts"))
        given, cut = given.join(cuts, ["detector_id", "slice"]), F.col("cuts")
    given = given.select("detector_id", *keys, "n", "piece", "scores", cut)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dataset, source, half, part = (k.as_py() for k in key)
        arms: dict[str, tuple[np.ndarray, dict[int, float]]] = {}
        for row, piece in enumerate(t["piece"].to_pylist()):
            arm = t["detector_id"][row].as_py()
            if arm not in arms:
                arms[arm] = np.empty(t["n"][row].as_py()), dict(t["cuts"][row].as_py())
            values = t["scores"][row].values.to_numpy(zero_copy_only=False)
            arms[arm][0][piece * PIECE : piece * PIECE + len(values)] = values
        most, out = max(len(x) for x, _ in arms.values()), []
        for rep in range(part, replicates, slices):
            heads = numbered_heads(f"{rep}:{half}:{dataset}:{source}:".encode(), most)
            out += [(arm, dataset, source, rep, float(fn(x, heads[: len(x)] % np.uint32(len(x)), cut.get(rep)))) for arm, (x, cut) in arms.items()]
        return pa.table(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    schema = pa.schema([*((c, pa.string()) for c in SRC), ("rep", pa.int32()), ("got", pa.float64())])
    return given.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, "detector_id string, dataset string, source string, rep int, got double")


def bootstrap_ci(sp: DataFrame, replicates: int, budget: float = BUDGET) -> DataFrame:
    """(detector_id, worst_fp_lo, worst_fp_hi, macro_fp_lo, macro_fp_hi): 95 % intervals over resamples of every
    real population's halves, the worst-source cut fitted anew in each.

    The draw of row i in replicate r is a hash of (r, half, population, i), so it needs no state and repeats
    exactly; no detector is part of it, so detectors share the hashes. Draws stay in the task that makes them: it holds the scores
    of one half of a population, 8 bytes a row and detector, and gives one value for each replicate.
    """
    let_workers_import(sp.sparkSession)
    real = sp.where("label = 0 and detector_id is not null and dataset is not null").select(*SRC, "half", "score", "path", F.col("path").isNull().alias("last"))
    scratch = Scratch(sp.sparkSession, "bootstrap")
    idx = positions(real, [*SRC, "half"], ["last", "path"], scratch, "i").withColumnRenamed("i_n", "n")
    pieces = idx.groupBy(*SRC, "half", "n", F.floor(F.col("i") / PIECE).cast("int").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("i", "score"))).alias("s"))
    pieces = scratch.write(pieces.select(*SRC, "half", "n", "piece", F.col("s.score").alias("scores")), "pieces")
    rows = pieces.agg(F.sum(F.size("scores"))).first()[0] or 0
    slices = min(replicates, MOST_SLICES, max(SLICES, -(-rows * replicates // (16 * TASK_DRAWS))))
    tasks = min(replicates, max(24, -(-rows * replicates // TASK_DRAWS)))
    kth = lambda x, at, _: np.partition(x[at], (k := len(x) - int(len(x) * budget) - 1))[k]
    beyond = lambda x, at, cut: np.count_nonzero(x[at] > cut) / len(x)
    cal, ev = (pieces.where(F.col("half") == h) for h in ("calibration", "evaluation"))
    cuts = _drawn(cal, replicates, kth, None, slices, tasks).groupBy("detector_id", "rep").agg(F.max("got").alias("cut"))
    one = _drawn(ev, replicates, beyond, cuts, slices, tasks).groupBy("detector_id", "rep").agg(F.max("got").alias("worst_fp"), F.avg("got").alias("macro_fp"))
    ends = [F.round(F.percentile(c, F.lit(p)), 9).alias(f"{c}_{e}") for c in ("worst_fp", "macro_fp") for e, p in (("lo", 0.025), ("hi", 0.975))]
    return one.groupBy("detector_id").agg(*ends)


def _draws(seed: int, n: int, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """n draws with replacement from 0..n-1, in chunks."""
    rng = np.random.Generator(np.random.SFC64(seed % 2**64))
    for at in range(0, n, chunk):
        yield rng.integers(0, n, min(chunk, n - at), dtype=np.uint32 if n < 2**32 else np.uint64)


def _kth_largest(seed: int, n: int, k: int, chunk: int = CHUNK) -> int:
    """The k-th largest of the n draws; only the k largest so far are kept between chunks."""
    top = None
    for x in _draws(seed, n, chunk):
        top = x if top is None else np.concatenate([top, x[x > top.min()] if len(top) == k else x])
        if len(top) > k:
            top = np.partition(top, len(top) - k)[len(top) - k :]
    return int(top.min())


def _count_from(seed: int, n: int, place: int, chunk: int = CHUNK) -> int:
    """How many of the n draws are at `place` or beyond."""
    return sum(int(np.count_nonzero(x >= place)) for x in _draws(seed, n, chunk))


def _resampled(df: DataFrame, keys: list[str], fn: Callable[[int, int, int], int], tasks: int) -> DataFrame:
    """(keys, n, got) of rows (keys, seed, n, at): fn(seed, n, at) of each, spread over tasks by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fn(*x) for x in zip(b["seed"].tolist(), b["n"].tolist(), b["at"].tolist(), strict=True)]
            yield b[[*keys, "n"]].assign(got=np.array(got, dtype=np.int64))

    types = dict(df.dtypes)
    return df.select(*keys, "seed", "n", "at").repartition(tasks, *keys).mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*keys, "n"]) + ", got bigint")


def bootstrap_intervals(sp: DataFrame, replicates: int, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """(detector_id, replicates, lo and hi of worst_fp, macro_fp and macro_recall): 95 % intervals over resamples of
    every population's halves, real and AI, the worst-source cut fitted anew in each.

    Every row of a half is one draw from the half in each replicate, as in the reference. A draw is a place in the
    half's order by score, so tasks draw knowing only sizes: the cut is the score at the k-th largest place
    drawn, and a rate is the share of draws beyond the places up to the cut. Draws are seeded by replicate, half and
    population, so they repeat exactly. A detector without AI pictures has a null recall.
    """
    let_workers_import(sp.sparkSession)
    tasks = int(max(8, -(-sp.count() * replicates // (2 * TASK_DRAWS))))
    rep = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    seeded = lambda half: F.xxhash64(F.lit(seed), F.lit(half), "rep", *POP).alias("seed")
    cal = sp.where("half = 'calibration' and label = 0")
    sizes = cal.groupBy(*POP).agg(F.count("*").alias("n")).select(*POP, "n", rep)
    places = sizes.select(*SRC, "rep", seeded("calibration"), "n", (F.floor(F.col("n") * F.lit(budget)) + 1).alias("at"))
    places = _resampled(places, [*SRC, "rep"], _kth_largest, tasks).withColumnRenamed("got", "place")
    ranked = positions(cal.select(*SRC, "score"), SRC, ["score"], Scratch(sp.sparkSession, "bootstrap"))
    worst = ranked.join(places.hint("merge"), [*SRC, "place"]).groupBy("detector_id", "rep").agg(F.max("score").alias("cut"))
    ev = sp.where("half = 'evaluation'")
    # how many of a detector's cuts lie below each row: counted, not sorted, rows meet at most `replicates` cuts
    line = worst.groupBy("detector_id").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    step = isqrt(replicates) + 1
    ends = F.transform(F.sequence(F.lit(0), F.ceil(F.size("cuts") / step).cast("int") - 1), lambda i: F.get("cuts", (i + 1) * step - 1))
    less = lambda c: c < F.col("score")
    first = F.size(F.filter(ends, less)) * step
    slot = first + F.when(first >= F.size("cuts"), 0).otherwise(F.size(F.filter(F.slice("cuts", first + 1, F.lit(step)), less)))
    bins = ev.join(line, "detector_id").groupBy(*POP, slot.alias("slot")).agg(F.count("*").alias("c"))
    halves = ev.groupBy(*POP).agg(F.count("*").alias("n"))
    known = worst.join(line, "detector_id").select("detector_id", "rep", (F.array_position("cuts", F.col("cut")) - 1).cast("int").alias("at_cut"))
    # rows in slots up to the cut's own don't exceed it
    grid = halves.join(known.select("detector_id", F.col("at_cut").alias("slot")).distinct(), "detector_id").select(*POP, "slot", F.lit(0).cast("bigint").alias("c"), F.lit(1).alias("asked"))
    upto = F.sum("c").over(W.partitionBy(*POP).orderBy("slot").rangeBetween(W.unboundedPreceding, W.currentRow))
    sums = bins.select(*POP, "slot", "c", F.lit(0).alias("asked")).unionByName(grid).withColumn("at", upto).where("asked = 1")
    beyond = sums.select(*POP, F.col("slot").alias("at_cut"), "at").join(known, ["detector_id", "at_cut"]).join(halves, POP).select(*POP, "rep", seeded("evaluation"), "n", "at")
    rates = _resampled(beyond, [*POP, "rep"], _count_from, tasks).withColumn("r", F.col("got") / F.col("n"))
    of = lambda lab: F.when(F.col("label") == lab, F.col("r"))
    one = rates.groupBy("detector_id", "rep").agg(F.max(of(0)).alias("worst_fp"), F.avg(of(0)).alias("macro_fp"), F.avg(of(1)).alias("macro_recall"))
    ends = [F.round(F.percentile(c, F.lit(p)), 9).alias(f"{c}_{e}") for c in ("worst_fp", "macro_fp", "macro_recall") for e, p in (("lo", 0.025), ("hi", 0.975))]
    return one.groupBy("detector_id").agg(F.count("*").alias("replicates"), *ends)
