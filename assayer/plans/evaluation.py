"""Evaluation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import scalars
from assayer.operators import protocol, ranks, robust, studies
from assayer.session import Scratch, load, shared

ANCHOR = "benchyard_real"
#: The generator that subgroup_profile looks into.
GENERATOR = "lumen_xl"
#: The source whose scores capped_override replaces.
LARGEST = "harbor_phone"
MISSES = [0.1, 0.05, 0.02, None]
#: Replicates of bootstrap_ci, whose SQL draws as many, and of bootstrap_intervals, as many as the reference draws.
REPLICATES, ALL_REPLICATES = 200, 2000
EXTRA = "tramline_cam"
SEEDS = (42, 1337, 2024)
COLUMNS = ["score_id", "detector_id", "dataset", "source", "label", "path", "orig_path", "variant", "width", "height", "bytes_per_pixel", "score", "scored_at"]


def _pop(s: SparkSession, d: str) -> DataFrame:
    """Written once in a session: every study reads the populations several times."""
    return shared(s, d, "image_scores", "populations", lambda t: protocol.populations(t).select(*COLUMNS))


def _sp(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "image_scores", "halves", lambda t: protocol.stable_halves(_pop(s, d)))


def _cal(s: SparkSession, d: str) -> DataFrame:
    return _sp(s, d).where("half = 'calibration' and label = 0")


def worst_source_report(s, d):
    return protocol.worst_source_report(_sp(s, d))


def stable_split_members(s, d):
    return _sp(s, d).select("score_id", "half")


def stable_split_counts(s, d):
    return _sp(s, d).groupBy(*protocol.POP).agg(F.count(F.when(F.col("half") == "calibration", 1)).alias("n_cal"), F.count(F.when(F.col("half") == "evaluation", 1)).alias("n_eval"))


def threshold_at_fpr_by_source(s, d):
    got = protocol.threshold_at_fpr(_cal(s, d), robust.SRC)
    return got.select(*robust.SRC, "n", "cut", protocol.next_up("cut").alias("threshold"))


def pooled_threshold(s, d):
    return protocol.threshold_at_fpr(_cal(s, d), ["detector_id"])


def operating_point(s, d):
    return robust.operating_point(_sp(s, d), ANCHOR)


def auc_by_generator(s, d):
    return robust.auc_by_generator(_sp(s, d), ANCHOR)


def protocol_report(s, d):
    return robust.protocol_report(_sp(s, d), ANCHOR)


def loso_anchor_only(s, d):
    return robust.loso(_sp(s, d), "anchor_only", ANCHOR)


def loso_pooled(s, d):
    return robust.loso(_sp(s, d), "pooled", ANCHOR)


def loso_worst_source(s, d):
    return robust.loso(_sp(s, d), "worst_source", ANCHOR)


def abstention_band(s, d):
    return robust.verdict_mix(_sp(s, d), [0.05])


def miss_budget_frontier(s, d):
    return robust.miss_budget_frontier(_sp(s, d), MISSES)


def union_gate(s, d):
    return robust.union_gate(_sp(s, d), ["tilenet_a", "freqarm_c"], "vitscore_b")


def frozen_vs_refit(s, d):
    return robust.frozen_vs_refit(_pop(s, d))


def source_diagnostic(s, d):
    return robust.source_diagnostic(_pop(s, d))


def subgroup_profile(s, d):
    return robust.subgroup_profile(_sp(s, d), GENERATOR, ANCHOR, 0.05)


def _real(s: SparkSession, d: str) -> DataFrame:
    """The real populations with their halves, and only the columns that a resampling needs."""
    few = lambda t: protocol.populations(t).where("label = 0").select(*protocol.POP, "path", "score")
    return shared(s, d, "image_scores", "real-halves", lambda t: protocol.stable_halves(shared(s, d, "image_scores", "real", few)))


def bootstrap_ci(s, d):
    return robust.bootstrap_ci(_real(s, d), REPLICATES)


def bootstrap_intervals(s, d):
    return robust.bootstrap_intervals(_sp(s, d), ALL_REPLICATES)


def roc_curve(s, d):
    """Points of each detector's ROC curve, one for each distinct score: rates at or above it."""
    g = _pop(s, d).groupBy("detector_id", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    whole = g.groupBy("detector_id").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    line = ranks.running(g, ["detector_id"], "score", ["p", "q"]).join(whole, "detector_id")
    tpr, fpr = ((F.col(n) - F.col(f"before_{c}")) / F.when(F.col(n) > 0, F.col(n)) for c, n in (("p", "np"), ("q", "nq")))
    return line.select("detector_id", "score", F.round(tpr, 9).alias("tpr"), F.round(fpr, 9).alias("fpr"))


def score_histogram(s, d):
    """43 equal bins over [0, 1] of each detector's scores by label; scores outside are counted apart."""
    b = F.expr("width_bucket(score, 0D, 1D, 43)").cast("bigint")
    return _pop(s, d).groupBy("detector_id", "label", b.alias("bin")).agg(F.count("*").alias("n"))


def detector_auc(s, d):
    return ranks.auc(_pop(s, d), ["detector_id"], "score", "label").select("detector_id", "n_neg", "n_pos", F.round("auc", 9).alias("auc"))


def confusion(s, d):
    """The four counts of each detector at its pooled cut."""
    sp = _sp(s, d)
    cut = protocol.threshold_at_fpr(sp.where("half = 'calibration' and label = 0"), ["detector_id"]).select("detector_id", "cut")
    ev = sp.where("half = 'evaluation'").join(cut, "detector_id").withColumn("hit", F.col("score") > F.col("cut"))
    c = lambda lab, hit: F.count(F.when((F.col("label") == lab) & (F.col("hit") == hit), 1))
    return ev.groupBy("detector_id").agg(c(1, True).alias("tp"), c(0, True).alias("fp"), c(0, False).alias("tn"), c(1, False).alias("fn"))


def classification_report(s, d):
    """Accuracy, precision, recall and F1 of each detector at its pooled cut; 0 where undefined."""
    c = confusion(s, d)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("detector_id", F.round(div(tp + tn, tp + fp + tn + fn), 9).alias("accuracy"), F.round(div(tp, tp + fp), 9).alias("precision"), F.round(div(tp, tp + fn), 9).alias("recall"), F.round(div(2 * tp, 2 * tp + fp + fn), 9).alias("f1"))


def fp_profile(s, d):
    """Median and 95th percentile of each real source's scores and its share above fixed scores, by detector, with a
    row ALL over all sources."""
    pop = _pop(s, d).where("label = 0")
    rows = pop.select("detector_id", "score", F.explode(F.array(F.struct("dataset", "source"), F.struct(F.lit("ALL").alias("dataset"), F.lit("ALL").alias("source")))).alias("k")).select("detector_id", "k.*", "score")
    out = rows.groupBy(*robust.SRC).agg(F.count("*").alias("n"), *[F.round(protocol.rate(F.col("score") >= t), 9).alias(f"at_{int(t * 100)}") for t in (0.5, 0.9, 0.99)])
    ps = ranks.percentiles(rows, robust.SRC, "score", {"median": 0.5, "p95": 0.95})
    return out.join(ps.select(*robust.SRC, F.round("median", 9).alias("median"), F.round("p95", 9).alias("p95")), robust.SRC)


def multi_arm_alignment(s, d):
    """Pictures scored by all three detectors, their scores side by side."""
    pop = _pop(s, d)
    arm = lambda name: pop.where(F.col("detector_id") == name).select("path", F.col("score").alias(name))
    return arm("tilenet_a").join(arm("vitscore_b"), "path").join(arm("freqarm_c"), "path")


def degraded_pairs(s, d):
    """Copies beside the record of the original they name, where the table has it."""
    pop = _pop(s, d)
    copy = pop.where("orig_path is not null and orig_path <> path").select("score_id", "detector_id", F.col("orig_path").alias("path"), F.col("score").alias("copy_score"))
    return copy.join(pop.select("detector_id", "path", F.col("score").alias("clean_score")), ["detector_id", "path"], "left").select("score_id", "copy_score", "clean_score")


def input_policy(s, d):
    """Copies against the originals they name, by detector, variant and label: medians before and after, how far and
    how often scores move up, and the shares above the detector's worst-source cut before and after."""
    pop = _pop(s, d)
    copy = pop.where("orig_path is not null and orig_path <> path and variant is not null").select("detector_id", "label", "variant", F.col("orig_path").alias("path"), F.col("score").alias("after"))
    j = copy.join(pop.select("detector_id", "path", F.col("score").alias("before")), ["detector_id", "path"])
    j = j.withColumn("variant", F.lower(F.trim("variant"))).withColumn("move", F.col("after") - F.col("before"))
    j = j.join(protocol.worst_source_cut(_cal(s, d)), "detector_id")
    keys = ["detector_id", "variant", "label"]
    over = lambda c: F.round(protocol.rate(F.col(c) > F.col("cut")), 9)
    out = j.groupBy(*keys).agg(F.count("*").alias("n"), F.round(protocol.rate(F.col("move") > 0), 9).alias("raised"), over("before").alias("flagged_before"), over("after").alias("flagged_after"))
    for c in ("before", "after", "move"):
        out = out.join(ranks.percentiles(j, keys, c, {"m": 0.5}).select(*keys, F.round("m", 9).alias(f"median_{c}")), keys)
    return out


def generator_probe(s, d):
    """The generators of one dataset under the worst-source cut, against the anchor's real pictures."""
    sp = _sp(s, d)
    return studies.generator_probe(sp, "wildprobe", robust.auc_by_generator(sp, ANCHOR))


def capped_override(s, d):
    """Rates of one source's pictures under the worst-source cut with the scores of resized copies in place of their own."""
    pop, sp = _pop(s, d), _sp(s, d)
    copies = pop.where("lower(trim(variant)) = 'resize_half' and orig_path is not null").select("detector_id", scalars.stem(F.col("orig_path")).alias("stem"), "score")
    ev = studies.overridden(sp.where("half = 'evaluation'").withColumn("stem", scalars.stem(F.col("path"))), copies, LARGEST)
    ev = ev.join(protocol.worst_source_cut(_cal(s, d)), "detector_id")
    return ev.groupBy(*protocol.POP).agg(F.count("*").alias("n"), F.count_if("was_overridden").alias("n_overridden"), F.round(protocol.rate(F.col("score") > F.col("cut")), 9).alias("flagged_rate"))


def library_promise(s, d):
    """False positives on one more real source under the cut of the others, and once it takes part in the fit."""
    sp = _sp(s, d)
    new = F.col("source") == EXTRA
    cal = sp.where("half = 'calibration' and label = 0")
    frozen = protocol.worst_source_cut(cal.where(~new)).withColumnRenamed("cut", "frozen")
    refit = protocol.worst_source_cut(cal).withColumnRenamed("cut", "refit")
    ev = sp.where("half = 'evaluation'").join(frozen, "detector_id").join(refit, "detector_id")
    pick = lambda c, t: F.round(F.avg(F.when(c, (F.col("score") > F.col(t)).cast("double"))), 9)
    real, ai = (F.col("label") == 0) & new, F.col("label") == 1
    return ev.groupBy("detector_id", "frozen", "refit").agg(pick(real, "frozen").alias("frozen_fp"), pick(real, "refit").alias("refit_fp"), pick(ai, "frozen").alias("frozen_recall"), pick(ai, "refit").alias("refit_recall"))


def seed_spread(s, d):
    """Mean and deviation over split seeds of each detector's AUC on its evaluation half."""
    pop, out = _pop(s, d), None
    for seed in SEEDS:
        ev = protocol.stable_halves(pop, seed=seed).where("half = 'evaluation'")
        a = ranks.auc(ev, ["detector_id"], "score", "label").select("detector_id", F.lit(seed).alias("seed"), "auc")
        out = a if out is None else out.unionByName(a)
    return out.groupBy("detector_id").agg(F.count("*").alias("n"), F.round(F.avg("auc"), 9).alias("mean"), F.round(F.stddev_pop("auc"), 9).alias("std"))


def stored_bytes(s, d):
    """Texts and their bytes by source, with the place by bytes, the largest first; equal ones by name, no source last."""
    g = load(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return ranks.positions(g.withColumns({"less": -F.coalesce("bytes", F.lit(0)), "none": F.col("source").isNull()}), [], ["less", "none", "source"], Scratch(s, "stored"), "r").select(
        "source", "n", "bytes", (F.col("r") + 1).alias("rank")
    )


REC = r"""rec AS (
  SELECT * REPLACE (nullif(regexp_replace(lower(trim(source)), '[-_\s]+', '_', 'g'), '') AS source) FROM image_scores
  QUALIFY row_number() OVER (PARTITION BY detector_id, path ORDER BY scored_at DESC, score_id DESC) = 1
),
pop AS (SELECT *, image_score + 0.0::DOUBLE AS score FROM rec WHERE source IS NOT NULL AND label IN (0, 1) AND NOT isnan(image_score) AND abs(image_score) < 'infinity'::DOUBLE)"""
SP = REC + """,
sp0 AS (SELECT *, row_number() OVER (PARTITION BY detector_id, dataset, source, label ORDER BY sha256('2026:' || path)) AS rk,
  count(*) OVER (PARTITION BY detector_id, dataset, source, label) AS pn FROM pop),
sp AS (SELECT *, CASE WHEN pn >= 2 AND rk <= least(pn - 1, greatest(1, round_even(pn * 0.5::DOUBLE, 0))) THEN 'calibration' ELSE 'evaluation' END AS half FROM sp0),
cal AS (SELECT * FROM sp WHERE half = 'calibration' AND label = 0),
ev AS (SELECT * FROM sp WHERE half = 'evaluation')"""


def _cut(name: str, rows: str, keys: str, budget: str = "0.1::DOUBLE") -> str:
    part = f"PARTITION BY {keys}"
    return f"""{name} AS (SELECT {keys}, n, score AS cut FROM (SELECT {keys}, score, row_number() OVER ({part} ORDER BY score DESC) AS r, count(*) OVER ({part}) AS n FROM {rows}) WHERE r = floor(n * {budget}) + 1)"""


SRC = "detector_id, dataset, source"
BY_SOURCE = _cut("bysrc", "cal", SRC)
WORST = BY_SOURCE + ", worst AS (SELECT detector_id, max(cut) AS cut FROM bysrc GROUP BY 1)"
ANCHOR_CAL = f"(SELECT * FROM cal WHERE source = '{ANCHOR}')"
RATE = "round(avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9)"
MISS = """miss AS (SELECT detector_id, miss, score AS t_real FROM (SELECT detector_id, score, row_number() OVER (PARTITION BY detector_id ORDER BY score) AS r, count(*) OVER (PARTITION BY detector_id) AS n FROM sp WHERE half = 'calibration' AND label = 1),
  (SELECT unnest([{}])::DOUBLE AS miss) WHERE r = floor(n * miss) + 1)"""
MIX = SP + ", " + WORST + ", " + MISS + """,
cuts AS (SELECT detector_id, miss, cut, least(t_real, cut) AS t_real FROM miss JOIN worst USING (detector_id){}),
mix AS (SELECT detector_id, miss, dataset, source, label, count(*) AS n, """ + RATE.format("score > cut") + " AS ai, " + RATE.format("score > t_real AND score <= cut") + " AS abstain, " + RATE.format("score <= t_real") + """ AS real
  FROM ev JOIN cuts USING (detector_id) GROUP BY ALL)"""


def _auc(rows: str, keys: str) -> str:
    """Mann-Whitney with average ranks over (keys, score, pos)."""
    return f"""SELECT {keys}, n_neg, n_pos, CASE WHEN n_neg > 0 AND n_pos > 0 THEN round((s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg), 9) END AS auc
    FROM (SELECT {keys}, sum(pos)::BIGINT AS n_pos, sum(1 - pos)::BIGINT AS n_neg, sum(CASE WHEN pos = 1 THEN rk END) AS s FROM (
      SELECT {keys}, pos, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS rk FROM {rows}) GROUP BY {keys})"""


CONF = SP + ", " + _cut("pooled", "cal", "detector_id") + ", c AS (SELECT detector_id, count(*) FILTER (label = 1 AND score > cut) AS tp, count(*) FILTER (label = 0 AND score > cut) AS fp, count(*) FILTER (label = 0 AND score <= cut) AS tn, count(*) FILTER (label = 1 AND score <= cut) AS fn FROM ev JOIN pooled USING (detector_id) GROUP BY 1)"
EMPTY = "NULL::VARCHAR"


def oracle_sql() -> dict[str, str]:
    loso = f"SELECT {SRC}, cut, count(*) AS n, {RATE.format('score > cut')} AS fp FROM ev JOIN held USING ({SRC}) WHERE label = 0 AND cut IS NOT NULL GROUP BY ALL"
    return {
        "worst_source_report": f"WITH {SP}, {WORST} SELECT {SRC}, label, count(*) AS n, {RATE.format('score > cut')} AS flagged_rate FROM ev JOIN worst USING (detector_id) GROUP BY ALL",
        "stable_split_members": f"WITH {SP} SELECT score_id, half FROM sp",
        "stable_split_counts": f"WITH {SP} SELECT {SRC}, label, count(*) FILTER (half = 'calibration') AS n_cal, count(*) FILTER (half = 'evaluation') AS n_eval FROM sp GROUP BY ALL",
        "threshold_at_fpr_by_source": f"WITH {SP}, {BY_SOURCE} SELECT {SRC}, n, cut, nextafter(cut, 'infinity'::DOUBLE) AS threshold FROM bysrc",
        "pooled_threshold": f"WITH {SP}, {_cut('pooled', 'cal', 'detector_id')} SELECT * FROM pooled",
        "operating_point": f"""WITH {SP}, {_cut('op', ANCHOR_CAL, 'detector_id')} SELECT detector_id, cut,
            round(avg((score > cut)::INT::DOUBLE) FILTER (label = 0 AND source = '{ANCHOR}' AND half = 'calibration'), 9) AS calibration_fp,
            round(avg((score > cut)::INT::DOUBLE) FILTER (label = 0 AND source = '{ANCHOR}' AND half = 'evaluation'), 9) AS evaluation_fp,
            round(avg((score > cut)::INT::DOUBLE) FILTER (label = 1 AND half = 'evaluation'), 9) AS evaluation_recall
            FROM sp JOIN op USING (detector_id) GROUP BY ALL""",
        "auc_by_generator": f"""WITH {SP}, ai AS (SELECT detector_id, source, score, 1 AS pos FROM ev WHERE label = 1),
            both_ AS (SELECT * FROM ai UNION ALL SELECT g.detector_id, g.source, ev.score, 0 FROM ev JOIN (SELECT DISTINCT detector_id, source FROM ai) g USING (detector_id) WHERE ev.label = 0 AND ev.source = '{ANCHOR}')
            {_auc('both_', 'detector_id, source')}""",
        "detector_auc": f"WITH {REC}, x AS (SELECT detector_id, score, label AS pos FROM pop) {_auc('x', 'detector_id')}",
        "protocol_report": f"""WITH {SP}, {_cut('op', ANCHOR_CAL, 'detector_id')},
            per AS (SELECT {SRC}, label, avg((score > cut)::INT::DOUBLE) AS r FROM ev JOIN op USING (detector_id) GROUP BY ALL),
            a AS ({_auc('(SELECT detector_id, score, label AS pos FROM ev JOIN op USING (detector_id))', 'detector_id')})
            SELECT detector_id, CASE label WHEN 0 THEN 'source_fp' ELSE 'generator_recall' END AS metric, dataset, source, round(r, 9) AS value FROM per
            UNION ALL SELECT detector_id, 'macro_fp', {EMPTY}, {EMPTY}, round(avg(r), 9) FROM per WHERE label = 0 GROUP BY 1
            UNION ALL SELECT detector_id, 'worst_fp', {EMPTY}, source, round(r, 9) FROM per WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY detector_id ORDER BY r DESC, source DESC) = 1
            UNION ALL SELECT detector_id, 'macro_recall', {EMPTY}, {EMPTY}, round(avg(r), 9) FROM per WHERE label = 1 GROUP BY 1
            UNION ALL SELECT detector_id, 'auc', {EMPTY}, {EMPTY}, auc FROM a""",
        "loso_worst_source": f"WITH {SP}, {BY_SOURCE}, held AS (SELECT a.detector_id, a.dataset, a.source, max(b.cut) AS cut FROM bysrc a JOIN bysrc b ON a.detector_id = b.detector_id AND (a.dataset <> b.dataset OR a.source <> b.source) GROUP BY ALL) {loso}",
        "loso_pooled": f"""WITH {SP}, fold AS (SELECT h.detector_id, h.dataset, h.source, c.score FROM cal c JOIN (SELECT DISTINCT {SRC} FROM cal) h ON c.detector_id = h.detector_id AND (c.dataset <> h.dataset OR c.source <> h.source)), {_cut('held', 'fold', SRC).replace('SELECT ' + SRC + ', n, score AS cut', 'SELECT ' + SRC + ', score AS cut')} {loso}""",
        "loso_anchor_only": f"WITH {SP}, {_cut('op', ANCHOR_CAL, 'detector_id')}, held AS (SELECT DISTINCT c.detector_id, c.dataset, c.source, op.cut FROM cal c JOIN op USING (detector_id) WHERE c.source <> '{ANCHOR}') {loso}",
        "abstention_band": f"WITH {MIX.format('0.05', '')} SELECT * FROM mix",
        "miss_budget_frontier": f"""WITH {MIX.format('0.1, 0.05, 0.02', " UNION ALL SELECT detector_id, NULL, cut, '-infinity'::DOUBLE FROM worst")} SELECT detector_id, miss, round(max(ai) FILTER (label = 0), 8) AS worst_fp, round(avg(ai) FILTER (label = 1), 8) AS macro_recall,
            round(avg(abstain), 8) AS macro_abstain, round(avg(real) FILTER (label = 1), 8) AS macro_wrongly_real FROM mix GROUP BY 1, 2""",
        "union_gate": f"""WITH {SP}, {WORST}, arms AS (SELECT dataset, source, label, path, bool_or(score > cut) FILTER (detector_id IN ('tilenet_a', 'freqarm_c')) AS base_hit, max(score) FILTER (detector_id = 'vitscore_b') AS x
              FROM ev JOIN worst USING (detector_id) WHERE label = 0 GROUP BY ALL),
            grid AS (SELECT k, cut + k * 0.5::DOUBLE AS threshold FROM worst, range(0, 61) t(k) WHERE detector_id = 'vitscore_b'),
            per AS (SELECT k, threshold, dataset, source, avg((base_hit OR x > threshold)::INT::DOUBLE) AS u, avg(base_hit::INT::DOUBLE) AS b FROM arms, grid WHERE base_hit IS NOT NULL AND x IS NOT NULL GROUP BY ALL)
            SELECT k, round(threshold, 9) AS threshold, round(max(u), 9) AS worst_fp, round(max(b), 9) AS baseline_worst, max(u) <= greatest(0.1::DOUBLE, max(b)) + 1e-12::DOUBLE AS passes FROM per GROUP BY k, threshold""",
        "frozen_vs_refit": f"""WITH {REC}, v AS (SELECT *, coalesce(lower(trim(variant)), 'none') IN ('none', '') AS clean FROM pop),
            cp AS (SELECT detector_id, orig_path AS path, arg_max(score, (scored_at, score_id)) AS copy_score FROM v WHERE NOT clean AND orig_path IS NOT NULL GROUP BY 1, 2),
            s0 AS (SELECT v.*, cp.copy_score, row_number() OVER (PARTITION BY v.detector_id, dataset, source, label ORDER BY sha256('2026:' || v.path)) AS rk,
              count(*) OVER (PARTITION BY v.detector_id, dataset, source, label) AS pn FROM v LEFT JOIN cp ON v.detector_id = cp.detector_id AND v.path = cp.path WHERE clean),
            s AS (SELECT *, pn >= 2 AND rk <= least(pn - 1, greatest(1, round_even(pn * 0.5::DOUBLE, 0))) AS is_cal FROM s0),
            {_cut('fz', "(SELECT * FROM s WHERE is_cal AND label = 0)", SRC)},
            {_cut('rf', "(SELECT detector_id, dataset, source, copy_score AS score FROM s WHERE is_cal AND label = 0 AND copy_score IS NOT NULL)", SRC)},
            f AS (SELECT detector_id, max(cut) AS cut FROM fz GROUP BY 1), g AS (SELECT detector_id, max(cut) AS cut FROM rf GROUP BY 1),
            e AS (SELECT s.*, 'clean' AS setting, score AS x, cut FROM s JOIN f USING (detector_id) UNION ALL SELECT s.*, 'frozen', copy_score, cut FROM s JOIN f USING (detector_id) WHERE copy_score IS NOT NULL
              UNION ALL SELECT s.*, 'refit', copy_score, cut FROM s JOIN g USING (detector_id) WHERE copy_score IS NOT NULL),
            per AS (SELECT detector_id, setting, cut, dataset, source, label, avg((x > cut)::INT::DOUBLE) AS r FROM e WHERE NOT is_cal GROUP BY ALL),
            a AS ({_auc('(SELECT detector_id, setting, x AS score, label AS pos FROM e)', 'detector_id, setting')})
            SELECT per.detector_id, per.setting, cut, round(avg(r) FILTER (label = 0), 9) AS macro_fp, round(max(r) FILTER (label = 0), 9) AS worst_fp,
            arg_max(source, (r, source)) FILTER (label = 0) AS worst_source, round(avg(r) FILTER (label = 1), 9) AS macro_recall, any_value(auc) AS auc
            FROM per LEFT JOIN a ON per.detector_id = a.detector_id AND per.setting = a.setting GROUP BY 1, 2, 3""",
        "source_diagnostic": f"""WITH {REC} SELECT {SRC}, label, count(*) AS n, round(quantile_cont(width::DOUBLE * height / 1e6::DOUBLE, 0.5), 9) AS median_mpx,
            round(quantile_cont(bytes_per_pixel, 0.5) FILTER (NOT isnan(bytes_per_pixel)), 9) AS median_bpp, round(quantile_cont(score, 0.5), 9) AS median_score FROM pop GROUP BY ALL""",
        "subgroup_profile": f"""WITH {SP}, {MISS.format('0.05')},
            one AS (SELECT CASE WHEN score <= t_real THEN 'wrongly_real' ELSE 'not_real' END AS part, detector_id, source, score, greatest(width, height)::DOUBLE AS side, bytes_per_pixel AS bpp FROM ev JOIN miss USING (detector_id)
              WHERE label = 1 AND source = '{GENERATOR}'
              UNION ALL SELECT CASE label WHEN 1 THEN 'generator' ELSE 'anchor' END, detector_id, source, score, NULL, NULL FROM ev WHERE label = 1 OR source = '{ANCHOR}')
            SELECT detector_id, part, source, count(*) AS n, round(quantile_cont(side, 0.5), 9) AS median_side, round(quantile_cont(bpp, 0.5) FILTER (NOT isnan(bpp)), 9) AS median_bpp,
            round(quantile_cont(score, 0.5), 9) AS median_score FROM one GROUP BY ALL""",
        "bootstrap_ci": f"""WITH {SP}, idx AS (SELECT {SRC}, half, score, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {SRC}, half) AS n FROM sp WHERE label = 0 WINDOW w AS (PARTITION BY {SRC}, half ORDER BY path)),
            dr AS (SELECT {SRC}, half, n, rep, ('0x' || substr(sha256(rep || ':' || half || ':' || dataset || ':' || source || ':' || i), 1, 8))::BIGINT % n AS j FROM idx, range(0, {REPLICATES}) t(rep)),
            dw AS (SELECT dr.*, idx.score FROM dr JOIN idx ON dr.detector_id = idx.detector_id AND dr.dataset = idx.dataset AND dr.source = idx.source AND dr.half = idx.half AND dr.j = idx.i),
            ct AS (SELECT rep, detector_id, max(score) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY rep, {SRC} ORDER BY score DESC) AS r FROM dw WHERE half = 'calibration') WHERE r = floor(n * 0.1::DOUBLE) + 1 GROUP BY ALL),
            fp AS (SELECT rep, {SRC}, avg((score > cut)::INT::DOUBLE) AS fp FROM dw JOIN ct USING (rep, detector_id) WHERE half = 'evaluation' GROUP BY ALL),
            o AS (SELECT rep, detector_id, max(fp) AS worst, avg(fp) AS macro FROM fp GROUP BY ALL)
            SELECT detector_id, round(quantile_cont(worst, 0.025), 9) AS worst_fp_lo, round(quantile_cont(worst, 0.975), 9) AS worst_fp_hi, round(quantile_cont(macro, 0.025), 9) AS macro_fp_lo, round(quantile_cont(macro, 0.975), 9) AS macro_fp_hi FROM o GROUP BY 1""",
        "roc_curve": f"""WITH {REC}, g AS (SELECT detector_id, score, sum(label) AS p, sum(1 - label) AS q FROM pop GROUP BY ALL)
            SELECT detector_id, score, round(sum(p) OVER d / sum(p) OVER (PARTITION BY detector_id), 9) AS tpr, round(sum(q) OVER d / sum(q) OVER (PARTITION BY detector_id), 9) AS fpr FROM g
            WINDOW d AS (PARTITION BY detector_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
        "score_histogram": f"WITH {REC} SELECT detector_id, label, CASE WHEN score < 0 THEN 0 WHEN score >= 1 THEN 44 ELSE floor(score * 43)::BIGINT + 1 END::BIGINT AS bin, count(*) AS n FROM pop GROUP BY ALL",
        "confusion": f"WITH {CONF} SELECT * FROM c",
        "classification_report": f"""WITH {CONF} SELECT detector_id, round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 9) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
            round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""",
        "fp_profile": f"""WITH {REC}, x AS (SELECT detector_id, dataset, source, score FROM pop WHERE label = 0 UNION ALL SELECT detector_id, 'ALL', 'ALL', score FROM pop WHERE label = 0)
            SELECT {SRC}, count(*) AS n, {RATE.format('score >= 0.5::DOUBLE')} AS at_50, {RATE.format('score >= 0.9::DOUBLE')} AS at_90, {RATE.format('score >= 0.99::DOUBLE')} AS at_99,
            round(quantile_cont(score, 0.5), 9) AS median, round(quantile_cont(score, 0.95), 9) AS p95 FROM x GROUP BY ALL""",
        "multi_arm_alignment": f"WITH {REC} SELECT a.path, a.score AS tilenet_a, b.score AS vitscore_b, c.score AS freqarm_c FROM pop a JOIN pop b USING (path) JOIN pop c USING (path) WHERE a.detector_id = 'tilenet_a' AND b.detector_id = 'vitscore_b' AND c.detector_id = 'freqarm_c'",
        "input_policy": f"""WITH {SP}, {WORST} SELECT a.detector_id, lower(trim(a.variant)) AS variant, a.label, count(*) AS n, round(avg((a.score - b.score > 0)::INT::DOUBLE), 9) AS raised,
            round(avg((b.score > cut)::INT::DOUBLE), 9) AS flagged_before, round(avg((a.score > cut)::INT::DOUBLE), 9) AS flagged_after,
            round(quantile_cont(b.score, 0.5), 9) AS median_before, round(quantile_cont(a.score, 0.5), 9) AS median_after, round(quantile_cont(a.score - b.score, 0.5), 9) AS median_move
            FROM pop a JOIN pop b ON a.detector_id = b.detector_id AND a.orig_path = b.path JOIN worst ON worst.detector_id = a.detector_id WHERE a.orig_path <> a.path AND a.variant IS NOT NULL GROUP BY 1, 2, 3""",
        "generator_probe": f"""WITH {SP}, {WORST}, ai AS (SELECT detector_id, source, score, 1 AS pos FROM ev WHERE label = 1),
            both_ AS (SELECT * FROM ai UNION ALL SELECT g.detector_id, g.source, ev.score, 0 FROM ev JOIN (SELECT DISTINCT detector_id, source FROM ai) g USING (detector_id) WHERE ev.label = 0 AND ev.source = '{ANCHOR}'),
            a AS ({_auc('both_', 'detector_id, source')})
            SELECT x.detector_id, x.source, count(*) AS n, {RATE.format('score > cut')} AS flagged_rate, round(quantile_cont(score, 0.5), 9) AS median_score, any_value(auc) AS auc
            FROM sp x JOIN worst USING (detector_id) LEFT JOIN a ON a.detector_id = x.detector_id AND a.source = x.source WHERE label = 1 AND dataset = 'wildprobe' GROUP BY 1, 2""",
        "capped_override": rf"""WITH {SP}, {WORST}, c AS (SELECT detector_id, regexp_replace(regexp_extract(orig_path, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, max(score) AS s FROM pop WHERE lower(trim(variant)) = 'resize_half' AND orig_path IS NOT NULL GROUP BY 1, 2),
            e AS (SELECT *, CASE WHEN source = '{LARGEST}' THEN regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') END AS stem FROM ev)
            SELECT e.detector_id, dataset, source, label, count(*) AS n, count(c.s) AS n_overridden, {RATE.format('coalesce(c.s, score) > cut')} AS flagged_rate
            FROM e JOIN worst USING (detector_id) LEFT JOIN c ON c.detector_id = e.detector_id AND c.stem = e.stem GROUP BY ALL""",
        "library_promise": f"""WITH {SP}, {BY_SOURCE}, f AS (SELECT detector_id, max(cut) FILTER (source <> '{EXTRA}') AS frozen, max(cut) AS refit FROM bysrc GROUP BY 1)
            SELECT detector_id, frozen, refit, {', '.join(f"round(avg((score > {t})::INT::DOUBLE) FILTER ({c}), 9) AS {t}_{n}" for n, c in (('fp', f"label = 0 AND source = '{EXTRA}'"), ('recall', 'label = 1')) for t in ('frozen', 'refit'))}
            FROM ev JOIN f USING (detector_id) WHERE frozen IS NOT NULL GROUP BY ALL""",
        "seed_spread": f"""WITH {REC}, s0 AS (SELECT detector_id, score, label, seed, row_number() OVER (PARTITION BY detector_id, dataset, source, label, seed ORDER BY sha256(seed || ':' || path)) AS rk,
              count(*) OVER (PARTITION BY detector_id, dataset, source, label, seed) AS pn FROM pop, (SELECT unnest([42, 1337, 2024]) AS seed)),
            e AS (SELECT detector_id, seed, score, label AS pos FROM s0 WHERE NOT (pn >= 2 AND rk <= least(pn - 1, greatest(1, round_even(pn * 0.5::DOUBLE, 0))))),
            a AS ({_auc('e', 'detector_id, seed').replace('round(', '(').replace(', 9) END', ') END')}) SELECT detector_id, count(*) AS n, round(avg(auc), 9) AS mean, round(stddev_pop(auc), 9) AS std FROM a GROUP BY 1""",
        "stored_bytes": "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes, row_number() OVER (ORDER BY coalesce(sum(strlen(text)), 0) DESC, source NULLS LAST) AS rank FROM documents GROUP BY 1",
        "degraded_pairs": f"WITH {REC} SELECT a.score_id, a.score AS copy_score, b.score AS clean_score FROM pop a LEFT JOIN pop b ON a.detector_id = b.detector_id AND a.orig_path = b.path WHERE a.orig_path IS NOT NULL AND a.orig_path <> a.path",
    }


def queries() -> dict:
    names = [*oracle_sql(), "bootstrap_intervals"]
    return {n: globals()[n] for n in names}
