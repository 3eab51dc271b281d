"""Pool, tile and verdict queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions import arrays, scalars
from assayer.functions.text import canonical_source, finite
from assayer.operators import pool, protocol, ranks, studies
from assayer.session import Scratch, load


def _ix(s: SparkSession, d: str) -> DataFrame:
    return pool.index(load(s, d, "pool_index"))


def _part(s, d, split):
    return _ix(s, d).where(F.col("split") == split)


def pool_index(s, d):
    cap, cw, ch = scalars.capped_size("w", "h")
    return _ix(s, d).select("pool_id", "source", "print", "side", F.round(scalars.aspect(), 9).alias("aspect"), F.round(F.col("w").cast("double") * F.col("h") / 1e6, 9).alias("mpx"), "side_band", "ratio_band", cap.alias("was_capped"), cw.alias("capped_w"), ch.alias("capped_h"))


def pool_audit(s, d):
    return pool.audit(_ix(s, d))


def audit_extended(s, d):
    return pool.extended_audit(_ix(s, d))


def audit_whole(s, d):
    return pool.whole_audit(_ix(s, d))


def audit_problems(s, d):
    return pool.audit_problems(_ix(s, d))


def class_gap(s, d):
    return pool.class_gap(_ix(s, d))


def shortcut_rules(s, d):
    return pool.shortcut_rules(_ix(s, d))


def pool_profile(s, d):
    return pool.profile(_ix(s, d))


def balance_report(s, d):
    return pool.balance_report(_ix(s, d))


def balanced_pool(s, d):
    return pool.balanced(_ix(s, d)).select("pool_id")


def dedupe_first_wins(s, d):
    return pool.first_wins(_ix(s, d))


def dedupe_last_wins(s, d):
    return pool.last_wins(_ix(s, d))


def duplicate_count(s, d):
    return pool.duplicate_count(_ix(s, d))


def refresh_flags(s, d):
    return pool.refresh_flags(_ix(s, d), load(s, d, "source_catalog"))


def contamination_anti(s, d):
    return pool.contamination_anti(_part(s, d, "train"), _part(s, d, "test")).select("pool_id")


def contamination_report(s, d):
    return pool.contamination_report(_part(s, d, "train"), _part(s, d, "test"))


def overlap_with_reference(s, d):
    return pool.overlap(_part(s, d, "train"), _part(s, d, "validation"))


def membership_mismatch(s, d):
    return pool.membership_mismatch(_part(s, d, "test"), _part(s, d, "train"))


def band_histogram(s, d):
    return _ix(s, d).groupBy("side_band", "ratio_band", "label").agg(F.count("*").alias("n"))


def pool_filters(s, d):
    """Safe for whole-image use, large enough, not of an excluded source, not a mask or a hidden file."""
    p = _ix(s, d)
    name = scalars.basename(F.col("location"))
    return p.where((F.col("whole_image_safe") == 1) & (F.col("side") >= 256) & ~F.col("source").isin("thumbnails", "glasshouse") & ~name.rlike(r"^\._|\.mask\.")).select("pool_id")


def stride_sample(s, d):
    return pool.stride(_ix(s, d).where("source is not null"), ["source"], ["location", "pool_id"], 10).select("pool_id")


def step_sample(s, d):
    return pool.stride(_ix(s, d).where("source is not null"), ["source"], ["location", "pool_id"], 10, "step").select("pool_id")


def per_source_cap(s, d):
    return pool.cap_per_key(_ix(s, d).where("source is not null"), ["source"], ["pool_id"], 25).select("pool_id")


def stratified_holdout(s, d):
    return pool.stratified_holdout(_ix(s, d).where("source is not null and label is not null"), ["source", "label"], "pool_id", 0.2).select("pool_id")


def equal_per_source(s, d):
    return pool.equal_per_source(_ix(s, d).where("source is not null and label = 0"), "pool_id", 20).select("pool_id")


def three_way_split(s, d):
    return pool.three_way(_ix(s, d).where("source is not null and label is not null"), ["source", "label"], "pool_id", 0.1, 0.1).select("pool_id", "part")


def matched_ai(s, d):
    return pool.matched_ai(_ix(s, d).where("source is not null"), "pool_id", 20).select("pool_id")


def min_population(s, d, least: int = 100):
    return _ix(s, d).where("label = 0 and source is not null").groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def format_sets(s, d):
    return _ix(s, d).where("label is not null and fmt is not null").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("fmt")), ",").alias("formats"))


def file_names(s, d):
    loc = F.col("location")
    return load(s, d, "pool_index").select("pool_id", scalars.basename(loc).alias("base"), scalars.stem(loc).alias("stem"), scalars.suffix(loc).alias("suffix"), scalars.class_guess(loc).alias("guess"), scalars.safe_name(loc).alias("safe"), scalars.hash_seed(loc).alias("seed"))


def label_contract(s, d):
    """Each catalog entry's raw labels mapped to the project's, and whether class 0's name says real."""
    c = load(s, d, "source_catalog")
    return c.select("source", F.explode(F.map_entries("label_map")).alias("e"), F.get("label_names", F.lit(0)).alias("class0")).select(
        "source", F.col("e.key").alias("raw"), F.col("e.value").alias("mapped"), F.lower("class0").contains("real").alias("class0_real"), (1 - F.col("e.value")).alias("inverted")
    )


def mapped_labels(s, d):
    """Every pool row with the project's label and what became of it: mapped, no label, unknown source, unmapped.

    pool.checked_label raises on the last two; only rows that it maps are given to it.
    """
    c = load(s, d, "source_catalog").select(canonical_source(F.col("source")).alias("source"), "label_map")
    m, lab = F.col("label_map"), F.col("label")
    what = F.when(lab.isNull(), "no label").when(m.isNull(), "unknown source").when(~F.map_contains_key(m, lab), "unmapped").otherwise("mapped")
    rows = _ix(s, d).join(c, "source", "left").withColumn("status", what)
    return rows.select("pool_id", "status", F.when(F.col("status") == "mapped", pool.checked_label(F.col("source"), m, lab)).alias("mapped"))


def source_by_print(s, d):
    """Sources of the held-out rows, looked up by fingerprint in the training rows; `?` where there is none."""
    known = _part(s, d, "train").where("print is not null").groupBy("print").agg(F.max_by(F.coalesce("source", F.lit("?")), "pool_id").alias("there"))
    return _part(s, d, "test").join(known, "print", "left").select("pool_id", F.coalesce("there", F.lit("?")).alias("there"))


def first_members(s, d):
    """Of each fingerprint of the test split that the training split knows, the first test row, with the label known there."""
    first = pool.first_wins(_part(s, d, "test"))
    known = pool.last_wins(_part(s, d, "train")).withColumnRenamed("label", "there")
    return first.join(known, "print").select("pool_id", "print", "there")


def content_anti(s, d):
    """Documents of other sources whose very bytes are not among those of one source."""
    docs = load(s, d, "documents").where("text is not null").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    held = docs.where("source = 'nightly_audit'").select("digest").distinct()
    return docs.where("source <> 'nightly_audit'").join(held, "digest", "left_anti").select("doc_id")


def picture_anti(s, d):
    """Pool rows whose fingerprint no evaluation split holds, rows without a valid one aside."""
    held = _ix(s, d).where("split in ('validation', 'test') and print is not null").select("print").distinct()
    return _ix(s, d).where("print is not null and split = 'train'").join(held, "print", "left_anti").select("pool_id")


def real_pipelines(s, d):
    """Records of the pipelines that must not be flagged: all of one dataset and the anchor's real pictures."""
    pop = _populations(s, d)
    keep = (F.col("dataset") == "lowland") | ((F.col("dataset") == "benchyard") & (F.col("source") == "benchyard_real"))
    return pop.where(keep).groupBy("detector_id", "dataset", "source").agg(F.count("*").alias("n"))


def evidence_floor(s, d):
    """Pictures too small to judge, by source: the longer side below 48 pixels."""
    ix = _ix(s, d).where("side is not null")
    return ix.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("side") < 48).alias("too_small"))


def geometry(s, d):
    """Bytes, size after degrading (three quarters, then the cap) and bounds in percent of the whole picture's left half."""
    dw, dh = scalars.degraded_size("w", "h")
    x0, y0, x1, y1 = scalars.percent_box(F.lit(0), F.lit(0), F.floor(F.col("w") / 2), F.col("h"), F.col("w"), F.col("h"))
    size = F.col("bpp") * F.col("w").cast("double") * F.col("h")
    p = _ix(s, d).where("w > 0 and h > 0")
    return p.select(
        "pool_id", dw.alias("dw"), dh.alias("dh"), F.round(scalars.bytes_per_pixel(size, "w", "h"), 6).alias("bpp_again"),
        F.round(x0, 6).alias("x0"), F.round(y0, 6).alias("y0"), F.round(x1, 6).alias("x1"), F.round(y1, 6).alias("y1"),
    )


def _populations(s, d):
    from assayer.plans.evaluation import _pop

    return _pop(s, d)


def moments(s, d):
    return pool.moments(_populations(s, d), ["detector_id", "label"], "score")


#: Pairs of detectors whose scores of the same pictures are compared.
PAIRS = (("tilenet_a", "vitscore_b"), ("tilenet_a", "freqarm_c"), ("vitscore_b", "freqarm_c"))


def _arms(s, d):
    """Both scores of each picture, for every pair of detectors."""
    pop = _populations(s, d)
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS])
    wide = pop.select("path", "dataset", "label", "detector_id", "score").withColumn("p", F.explode(names))
    left = wide.where("detector_id = p.a").select("path", "p", "dataset", "label", F.col("score").alias("x"))
    right = wide.where("detector_id = p.b").select("path", "p", F.col("score").alias("y"))
    return left.join(right, ["path", "p"]).select(F.concat("p.a", F.lit("+"), "p.b").alias("pair"), "path", "dataset", "label", "x", "y")


def spearman(s, d):
    return pool.spearman(_arms(s, d), ["pair", "dataset"], "x", "y")


def percent_rank_ensemble(s, d):
    """Mean of two arms' ranks within a dataset, scaled to [0, 1]; equal scores rank by path. For every pair of arms."""
    scratch, keys = Scratch(s, "ranks"), ["pair", "dataset"]
    a = ranks.positions(_arms(s, d), keys, ["x", "path"], scratch, "px")
    a = ranks.positions(a, keys, ["y", "path"], scratch, "py")
    rx, ry = (F.col(p) / F.greatest(F.col("px_n") - 1, F.lit(1)) for p in ("px", "py"))
    a = a.withColumns({"rx": rx, "ry": ry})
    return a.select("pair", "path", "dataset", "label", F.round((F.col("rx") + F.col("ry")) / 2, 9).alias("ensemble"), F.round(0.75 * F.col("rx") + 0.25 * F.col("ry"), 9).alias("weighted"), F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))


def rank_ensemble_auc(s, d):
    return ranks.auc(percent_rank_ensemble(s, d), ["pair", "dataset"], "ensemble", "label").select("pair", "dataset", "n_neg", "n_pos", F.round("auc", 9).alias("auc"))


def shortcut_auc(s, d):
    """How well size or compression alone tells the classes apart, in each detector's records of each dataset: max(auc, 1 - auc)."""
    rec = _populations(s, d)
    v = F.explode(F.array(F.struct(F.lit("bytes_per_pixel").alias("f"), F.col("bytes_per_pixel").alias("v")), F.struct(F.lit("longest").alias("f"), F.greatest("width", "height").cast("double").alias("v")))).alias("s")
    rows = rec.select("detector_id", "dataset", "label", v).select("detector_id", "dataset", "label", F.col("s.f").alias("feature"), F.col("s.v").alias("v")).where(finite(F.col("v")))
    a = ranks.auc(rows, ["detector_id", "dataset", "feature"], "v", "label")
    return a.select("detector_id", "dataset", "feature", F.round(F.greatest(F.col("auc"), 1 - F.col("auc")), 9).alias("auc"))


def _tiles(s, d):
    return load(s, d, "tile_scores")


def _tile_query(rule):
    def q(s, d):
        return _tiles(s, d).select("path", F.round(arrays.aggregate_rule(F.col("tile_scores"), rule), 9).alias("score"))

    return q


def tile_agg_legacy(s, d):
    a = F.col("tile_scores")
    return _tiles(s, d).select("path", arrays.aggregate_rule(a, "max").alias("max"), F.round(arrays.aggregate_rule(a, "median"), 9).alias("median"), F.round(arrays.aggregate_rule(a, "top_half"), 9).alias("top_half"))


def tile_z_scores(s, d):
    """Largest z-score within each picture."""
    a = arrays.finite_only(F.col("tile_scores"))
    return _tiles(s, d).select("path", F.round(F.array_max(arrays.z_scores(a)), 7).alias("max_z"))


def select_aggregation(s, d):
    """Every aggregation rule, chosen on calibration halves and judged on evaluation halves (studies.select_rule)."""
    return studies.select_rule(_tiles(s, d), "benchyard_real", "benchyard")


def rule_grid(s, d):
    """(rule, k, n_neg, n_pos, auc): every rule on tile vectors thinned to k tiles, and on all of them (k = 0)."""
    return studies.rule_grid(_tiles(s, d), [4, 8, 16, 32])


def tile_positions(s, d):
    xs, ys = arrays.origins(F.col("width")), arrays.origins(F.col("height"))
    return _tiles(s, d).where("width is not null and height is not null").select("path", F.size(xs).alias("nx"), F.size(ys).alias("ny"), F.array_join(xs, ",").alias("xs"))


def mask_tiles(s, d):
    """Tile scores with the coverage of a generated mask, as the tables hold none: a rectangle whose place and size come
    from a hash of the path. Tiles are numbered row by row; only places that the picture's grid has are used."""
    t = _tiles(s, d).where("width >= 128 and height >= 128 and label = 1").distinct().withColumn("seed", scalars.hash_seed(F.col("path")))
    xs, ys = arrays.origins(F.col("width")), arrays.origins(F.col("height"))
    t = t.withColumns({"xs": xs, "ys": ys, "mw": F.floor(F.col("width") * (20 + F.col("seed") % 60) / 100), "mh": F.floor(F.col("height") * (20 + F.floor(F.col("seed") / 60) % 60) / 100)})
    t = t.withColumns({"mx": F.floor((F.col("width") - F.col("mw")) * (F.floor(F.col("seed") / 3600) % 100) / 100), "my": F.floor((F.col("height") - F.col("mh")) * (F.floor(F.col("seed") / 360000) % 100) / 100)})
    t = t.select("*", F.posexplode("tile_scores").alias("tile_idx", "score")).where(finite(F.col("score")) & (F.col("tile_idx") < F.size("xs") * F.size("ys")))
    x, y = F.get("xs", F.col("tile_idx") % F.size("xs")), F.get("ys", F.floor(F.col("tile_idx") / F.size("xs")).cast("int"))
    inside = scalars.overlap_area(x, y, F.lit(128), F.lit(128), F.col("mx"), F.col("my"), F.col("mw"), F.col("mh"))
    frac = F.col("mw") * F.col("mh") / (F.col("width").cast("double") * F.col("height"))
    return t.select("dataset", F.col("path").alias("image"), "tile_idx", "score", (inside / F.lit(128.0 * 128.0)).alias("coverage"), frac.alias("mask_frac"))


def localisation_iou(s, d):
    """(dataset, n_images, mask_frac, iou, chance, n_inside, n_outside, tile_auc): see studies.localisation."""
    return studies.localisation(mask_tiles(s, d))


def verdict_or_rule(s, d):
    """OR over the three detectors at fixed thresholds, the arms that fired in order."""
    limits = {"tilenet_a": 0.9, "vitscore_b": 4.0, "freqarm_c": 0.95}
    pop = _populations(s, d)
    wide = pop.groupBy("path").agg(*[F.max(F.when(F.col("detector_id") == a, F.col("score"))).alias(a) for a in limits])
    bands = F.array(*[F.struct(F.lit(a).alias("name"), scalars.decide(F.col(a), F.lit(t)).alias("band")) for a, t in limits.items()])
    label, fired = scalars.combine(bands)
    return wide.select("path", label.alias("label"), F.array_join(fired, ",").alias("triggered_by"))


def verdict_caveats(s, d):
    r = protocol.records(load(s, d, "image_scores"))
    return r.select("score_id", F.array_join(scalars.caveats("width", "height", "bytes_per_pixel"), ",").alias("caveats"), scalars.route("width", "height").alias("method"))


def display_words(s, d):
    word, pct = scalars.display(F.col("score"))
    return _populations(s, d).select("score_id", word.alias("word"), F.round(pct, 9).alias("percent"))


def full_verdict(s, d):
    """The whole verdict of every picture: each arm's score, threshold and band in order, the extra arm before the one it
    hangs on, the OR of the bands, caveats, and the words to show."""
    limits = {"tilenet_a": 0.9, "freqarm_c": 0.95, "vitscore_b": 4.0}
    pop = _populations(s, d)
    wide = pop.groupBy("path").agg(*[F.max(F.when(F.col("detector_id") == a, F.col("score"))).alias(a) for a in limits], F.max("width").alias("width"), F.max("height").alias("height"), F.max("bytes_per_pixel").alias("bpp"))
    arm = lambda a, t: F.struct(F.lit(a).alias("name"), F.col(a).alias("score"), F.lit(t).alias("threshold"), scalars.decide(F.col(a), F.lit(t)).alias("band"))
    arms = F.filter(F.array(*[arm(a, t) for a, t in limits.items()]), lambda x: x["score"].isNotNull())
    label, fired = scalars.combine(arms)
    text = F.transform(arms, lambda x: F.concat_ws(":", x["name"], x["band"]))
    return wide.select("path", label.alias("label"), F.array_join(fired, ",").alias("triggered_by"), F.array_join(text, ",").alias("arms"), F.array_join(scalars.caveats("width", "height", "bpp"), ",").alias("caveats"), F.col("bpp").alias("bytes_per_pixel"))


def resume_work(s, d):
    """(detector_id, path) still to be scored: every picture of the pool of scored paths against each detector."""
    seen = load(s, d, "image_scores").where(finite(F.col("image_score"))).select("detector_id", "path").distinct()
    paths, arms = load(s, d, "image_scores").select("path").distinct(), seen.select("detector_id").distinct()
    return paths.crossJoin(F.broadcast(arms)).join(seen, ["detector_id", "path"], "left_anti").select("detector_id", "path")


def parse_props_json(s, d):
    return load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def linear_head(s, d):
    """Sigmoid of a fixed linear head over each whole embedding: weights 1, 1/2, 1/3 and so on."""
    at = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") / (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return load(s, d, "embeddings").select("vec_id", F.round(arrays.sigmoid(at + 0.1), 7).alias("p"))


def union_of_tables(s, d):
    """Records of both tables under one schema, counted by table and source."""
    a = load(s, d, "image_scores").select(F.lit("image_scores").alias("tbl"), canonical_source(F.col("source")).alias("source"))
    b = load(s, d, "tile_scores").select(F.lit("tile_scores").alias("tbl"), canonical_source(F.col("source")).alias("source"))
    return a.unionByName(b).groupBy("tbl", "source").agg(F.count("*").alias("n"))


def user_vectors(s, d):
    """Vectors of events, one for each user in time order, by their three largest values and by those of 16 evenly
    spaced ones. No user's events are gathered: places come first, then at most 16 values of each."""
    ev = load(s, d, "events").select("user_id", "ts", "event_id", "value")
    n = ev.groupBy("user_id").agg(F.count("*").alias("n"))
    ok = ev.where(finite(F.col("value")))
    mean_top = lambda df, name: pool.cap_per_key(df, ["user_id"], [F.desc("value"), "event_id"], 3).groupBy("user_id").agg(F.round(F.avg("value"), 9).alias(name))
    out = n.join(mean_top(ok, "top3"), "user_id", "left")
    return out.join(mean_top(pool.stride(ok, ["user_id"], ["ts", "event_id"], 16), "fixed16_top3"), "user_id", "left")


tile_agg_top3, tile_agg_top10pct, tile_agg_p90, tile_agg_mean, tile_agg_fixed16_top3 = (_tile_query(r) for r in arrays.RULES)

SRCX = r"nullif(regexp_replace(lower(trim(source)), '[-_\s]+', '_', 'g'), '')"
HEX = r"lower(regexp_extract(coalesce(phash, ''), '^\s*(?:0[xX])?([0-9a-fA-F]{16})\s*$', 1))"


def _band(x: str, edges: list[float]) -> str:
    k = " + ".join(f"({x} >= {e}::DOUBLE)::INT" for e in edges)
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {k} = 0 THEN {len(edges) - 1} ELSE {k} - 1 END"


RATIO = "CASE WHEN NOT isnan(bytes_per_pixel) AND abs(bytes_per_pixel) < 'infinity'::DOUBLE THEN bytes_per_pixel END"
IX = f"""ix AS (SELECT *, {_band('side', pool.SIDE_EDGES)} AS side_band, {_band('ratio', pool.BPP_EDGES)} AS ratio_band FROM (
  SELECT * REPLACE ({SRCX} AS source), CASE WHEN {HEX} NOT IN ('', '0000000000000000', 'ffffffffffffffff') THEN {HEX} END AS print, greatest(w, h) AS side, {RATIO} AS ratio FROM pool_index))"""
HASH60 = "substr(sha256('42:' || pool_id), 1, 15)"
FIN = "list_filter(tile_scores, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'infinity'::DOUBLE)"
TOP = "round(list_sum(list_reverse_sort({a})[1:{k}]) / len(list_reverse_sort({a})[1:{k}]), 9)"
THIN = "CASE WHEN len({a}) > 16 THEN list_transform(list_distinct(list_transform(range(0, 16), lambda i: round_even(i * ((len({a}) - 1) / 15.0::DOUBLE), 0)::INT)), lambda j: {a}[j + 1]) ELSE {a} END"


def _pct(a: str, p: str) -> str:
    at = f"({p}::DOUBLE * (len({a}) - 1))"
    return f"round(list_sort({a})[floor({at})::INT + 1] + (list_sort({a})[ceil({at})::INT + 1] - list_sort({a})[floor({at})::INT + 1]) * ({at} - floor({at})), 9)"


def _rule(a: str, rule: str) -> str:
    return {
        "top3": TOP.format(a=a, k=3), "top10pct": TOP.format(a=a, k=f"greatest(1, ceil(0.1::DOUBLE * len({a})))::INT"), "p90": _pct(a, "0.9"),
        "mean": f"round(list_sum({a}) / len({a}), 9)", "fixed16_top3": TOP.format(a="(" + THIN.format(a=a) + ")", k=3),
    }[rule]


T = f"t AS (SELECT *, {FIN} AS a FROM tile_scores)"
ARMS = """arms AS (SELECT pr.a || '+' || pr.b AS pair, p.path, p.dataset, p.label, p.score AS x, q.score AS y FROM (VALUES ('tilenet_a', 'vitscore_b'), ('tilenet_a', 'freqarm_c'), ('vitscore_b', 'freqarm_c')) pr(a, b)
    JOIN pop p ON p.detector_id = pr.a JOIN pop q ON q.detector_id = pr.b AND p.path = q.path)"""


def oracle_sql() -> dict[str, str]:
    from assayer.plans.evaluation import REC, _auc, _cut

    ens = f"""WITH {REC}, {ARMS}, r AS (SELECT *, (row_number() OVER (PARTITION BY pair, dataset ORDER BY x, path) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY pair, dataset) - 1, 1) AS rx,
        (row_number() OVER (PARTITION BY pair, dataset ORDER BY y, path) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY pair, dataset) - 1, 1) AS ry FROM arms),
        e AS (SELECT pair, path, dataset, label, round((rx + ry) / 2, 9) AS ensemble, round(0.75::DOUBLE * rx + 0.25::DOUBLE * ry, 9) AS weighted, greatest(x, y) AS hi, least(x, y) AS lo FROM r)"""
    avg_rank = "rank() OVER (PARTITION BY pair, dataset ORDER BY {0}) + (count(*) OVER (PARTITION BY pair, dataset, {0}) - 1) / 2.0::DOUBLE"
    aud = f"""{IX}, f AS (SELECT label, fmt, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, fmt) AS r FROM ix WHERE label IS NOT NULL AND fmt IS NOT NULL GROUP BY label, fmt),
        ft AS (SELECT label, string_agg(fmt, ',' ORDER BY r) AS formats FROM f WHERE r <= 3 GROUP BY 1),
        aud AS (SELECT label, count(*) AS n, round(avg(square) * 100, 6) AS square_pct, round(avg(ratio), 8) AS mean_ratio, quantile_cont(side, 0.5)::DOUBLE AS median_side FROM ix WHERE label IS NOT NULL GROUP BY 1)"""
    whole = f"""{IX}, r AS (SELECT * FROM ix WHERE label IS NOT NULL AND side IS NOT NULL),
        tops AS (SELECT label, string_agg(w || 'x' || h || '(' || c || ')', ', ' ORDER BY k) AS top_sizes FROM (SELECT label, w, h, count(*) AS c, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, w, h) AS k FROM r WHERE w IS NOT NULL AND h IS NOT NULL GROUP BY label, w, h) WHERE k <= 3 GROUP BY 1),
        wh AS (SELECT label, count(*) AS n, count(DISTINCT (w, h)) FILTER (w IS NOT NULL AND h IS NOT NULL) AS distinct_sizes, count(DISTINCT fmt) AS distinct_formats, floor(quantile_cont(side, 0.1))::BIGINT AS p10, floor(quantile_cont(side, 0.5))::BIGINT AS median, floor(quantile_cont(side, 0.9))::BIGINT AS p90,
          round(avg(CASE WHEN w = h THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 1) AS square_pct, round(avg(ratio), 3) AS mean_bpp, string_agg(DISTINCT coalesce(fmt, '?'), ',' ORDER BY coalesce(fmt, '?')) AS formats FROM r GROUP BY 1)"""
    bal = f"""{IX}, ce AS (SELECT * FROM ix WHERE label IN (0, 1) AND side_band IS NOT NULL AND ratio_band IS NOT NULL),
        bal AS (SELECT side_band, ratio_band, count(*) FILTER (label = 0) AS n_real, count(*) FILTER (label = 1) AS n_ai, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS take FROM ce GROUP BY 1, 2)"""
    axis = "CASE WHEN {0} <= 128 THEN [0] ELSE list_sort(list_distinct(list_transform(range(0, ceil({0} / 128.0::DOUBLE)::INT), lambda i: round_even(i * (({0} - 128) / greatest(ceil({0} / 128.0::DOUBLE) - 1, 1)::DOUBLE), 0)::INT))) END"
    rules = " UNION ALL ".join(f"SELECT {i} AS pos, '{r}' AS rule, label, {_rule('a', r)} AS score FROM td" for i, r in enumerate(arrays.RULES))
    sd = "('0x' || substr(sha256(path), 1, 8))::BIGINT"
    gx, gy = axis.format("width"), axis.format("height")
    ov = "greatest(0, least({0} + 128, {1} + {2}) - greatest({0}, {1}))::DOUBLE"
    mt = f"""WITH t AS (SELECT *, {sd} AS seed, {gx} AS xs, {gy} AS ys FROM (SELECT DISTINCT * FROM tile_scores) WHERE width >= 128 AND height >= 128 AND label = 1),
        m AS (SELECT *, floor(width * (20 + seed % 60) / 100.0::DOUBLE)::BIGINT AS mw, floor(height * (20 + (seed // 60) % 60) / 100.0::DOUBLE)::BIGINT AS mh FROM t),
        k AS (SELECT *, floor((width - mw) * ((seed // 3600) % 100) / 100.0::DOUBLE)::BIGINT AS mx, floor((height - mh) * ((seed // 360000) % 100) / 100.0::DOUBLE)::BIGINT AS my FROM m),
        u AS (SELECT *, unnest(tile_scores) AS score, generate_subscripts(tile_scores, 1) - 1 AS i FROM k),
        p AS (SELECT *, xs[i % len(xs) + 1] AS x, ys[i // len(xs) + 1] AS y FROM u WHERE NOT isnan(score) AND abs(score) < 'infinity'::DOUBLE AND i < len(xs) * len(ys)),
        mt AS (SELECT dataset, path AS image, i::INT AS tile_idx, score, {ov.format('x', 'mx', 'mw')} * {ov.format('y', 'my', 'mh')} / 16384.0::DOUBLE AS coverage, mw * mh / (width::DOUBLE * height) AS mask_frac FROM p)"""
    base = r"regexp_extract(location, '([^/\\]*)$', 1)"
    moment = lambda k: f"avg((score - m) ** {k})"
    cap = "CASE WHEN greatest(w, h) > 2048 THEN greatest(1, round_even({0} * (2048.0::DOUBLE / greatest(w, h)), 0)::INT) ELSE {0} END"
    return {
        "pool_index": f"WITH {IX} SELECT pool_id, source, print, side, round(greatest(w, h)::DOUBLE / greatest(least(w, h), 1), 9) AS aspect, round(w::DOUBLE * h / 1e6::DOUBLE, 9) AS mpx, side_band, ratio_band, greatest(w, h) > 2048 AS was_capped, {cap.format('w')} AS capped_w, {cap.format('h')} AS capped_h FROM ix",
        "pool_audit": f"WITH {aud} SELECT label, n, square_pct, mean_ratio, median_side, formats FROM aud LEFT JOIN ft USING (label)",
        "audit_extended": f"WITH {IX} SELECT label, count(*) AS n, count(DISTINCT (w, h)) FILTER (w IS NOT NULL AND h IS NOT NULL) AS distinct_sizes, count(DISTINCT fmt) AS distinct_formats, floor(quantile_cont(side, 0.1))::BIGINT AS p10, floor(quantile_cont(side, 0.5))::BIGINT AS median, floor(quantile_cont(side, 0.9))::BIGINT AS p90 FROM ix WHERE label IS NOT NULL AND side IS NOT NULL GROUP BY 1",
        "audit_whole": f"WITH {whole} SELECT wh.*, top_sizes FROM wh LEFT JOIN tops USING (label)",
        "audit_problems": f"""WITH {whole}, z AS (SELECT *, row_number() OVER (ORDER BY label) AS k FROM wh), c AS (SELECT count(*) AS classes FROM z)
            SELECT classes, classes < 2 AS single_class, classes >= 2 AND (SELECT bool_and(NOT contains(formats, ',')) AND count(DISTINCT formats) > 1 FROM z) AS format_trap, classes >= 2 AND (SELECT max(square_pct) - min(square_pct) > 60 FROM z) AS square_gap,
            classes >= 2 AND (SELECT max(median)::DOUBLE / greatest(min(median), 1) >= 2 FROM z) AS side_gap, classes >= 2 AND (SELECT a.p10 > b.p90 OR b.p10 > a.p90 FROM z a, z b WHERE a.k = 1 AND b.k = 2) AS ranges_apart,
            classes >= 2 AND (SELECT max(mean_bpp) / greatest(min(mean_bpp), 0.001::DOUBLE) > 3 FROM z) AS bpp_gap, classes >= 2 AND (SELECT max(n)::DOUBLE / min(n) > 3 FROM z) AS imbalance FROM c""",
        "class_gap": f"""WITH {IX}, m AS (SELECT label, quantile_cont(side, 0.5)::DOUBLE AS m FROM ix WHERE label IN (0, 1) AND side IS NOT NULL GROUP BY 1), g AS (SELECT CASE WHEN count(*) = 2 AND min(m) > 0 THEN max(m) / min(m) ELSE 'infinity'::DOUBLE END AS gap FROM m)
            SELECT round(gap, 9) AS gap, gap > 2 AS risk FROM g""",
        "shortcut_rules": f"""WITH {IX}, a AS (SELECT label, count(*) AS n, round(avg(square) * 100, 1) AS square, round(avg(bpp), 3) AS bpp, count(DISTINCT fmt) AS formats, min(fmt) AS fmt, floor(quantile_cont(side, 0.5))::BIGINT AS side FROM ix WHERE label IS NOT NULL GROUP BY 1)
            SELECT count(*) AS classes, coalesce(count(*) = 2 AND max(formats) = 1 AND min(formats) = 1 AND min(fmt) <> max(fmt), false) AS format_disjoint, coalesce(count(*) = 2 AND max(square) - min(square) > 60, false) AS square_gap,
            coalesce(count(*) = 2 AND max(side)::DOUBLE / greatest(min(side), 1) > 2.5, false) AS side_gap, coalesce(count(*) = 2 AND max(bpp) / greatest(min(bpp), 0.001::DOUBLE) > 3, false) AS ratio_gap,
            coalesce(count(*) = 2 AND max(n)::DOUBLE / greatest(min(n), 1) > 1.5, false) AS imbalance FROM a""",
        "pool_profile": f"""WITH {IX}, r AS (SELECT label, side, row_number() OVER (PARTITION BY label ORDER BY side) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM ix WHERE label IS NOT NULL AND side IS NOT NULL)
            SELECT label, n, max(side) FILTER (i = least(n - 1, floor(0.1::DOUBLE * n))) AS p10, max(side) FILTER (i = least(n - 1, floor(0.9::DOUBLE * n))) AS p90, quantile_cont(side, 0.5)::DOUBLE AS median FROM r GROUP BY label, n""",
        "balance_report": f"WITH {bal} SELECT * FROM bal",
        "balanced_pool": f"WITH {bal} SELECT pool_id FROM (SELECT pool_id, take, row_number() OVER (PARTITION BY side_band, ratio_band, label ORDER BY {HASH60}) AS r FROM ce JOIN bal USING (side_band, ratio_band)) WHERE r <= take",
        "dedupe_first_wins": f"WITH {IX} SELECT print, min(pool_id) AS pool_id FROM ix WHERE print IS NOT NULL GROUP BY 1",
        "dedupe_last_wins": f"WITH {IX} SELECT print, label FROM ix WHERE print IS NOT NULL QUALIFY row_number() OVER (PARTITION BY print ORDER BY pool_id DESC) = 1",
        "duplicate_count": f"WITH {IX} SELECT source, count(*) - count(DISTINCT print) AS duplicates FROM ix WHERE print IS NOT NULL AND source IS NOT NULL GROUP BY 1",
        "refresh_flags": f"WITH {IX} SELECT ix.source, count(*) AS n, count(*) FILTER (coalesce(c.whole_image_safe::INT, ix.whole_image_safe) IS DISTINCT FROM ix.whole_image_safe) AS n_changed FROM ix LEFT JOIN (SELECT {SRCX} AS source, whole_image_safe FROM source_catalog) c USING (source) GROUP BY 1",
        "contamination_anti": f"WITH {IX} SELECT pool_id FROM ix WHERE split = 'train' AND (print IS NULL OR print NOT IN (SELECT print FROM ix WHERE split = 'test' AND print IS NOT NULL))",
        "contamination_report": f"WITH {IX} SELECT ix.pool_id, v.victim FROM ix JOIN (SELECT print, max(pool_id) AS victim FROM ix WHERE split = 'test' AND print IS NOT NULL GROUP BY 1) v USING (print) WHERE split = 'train'",
        "overlap_with_reference": f"""WITH {IX}, a AS (SELECT DISTINCT print FROM ix WHERE split = 'train' AND print IS NOT NULL), b AS (SELECT DISTINCT print FROM ix WHERE split = 'validation' AND print IS NOT NULL)
            SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS n_shared, round(count(*) * 100.0::DOUBLE / nullif((SELECT count(*) FROM a), 0), 8) AS shared_pct FROM a JOIN b USING (print)""",
        "membership_mismatch": f"WITH {IX}, l AS (SELECT print, label AS there FROM ix WHERE split = 'train' AND print IS NOT NULL QUALIFY row_number() OVER (PARTITION BY print ORDER BY pool_id DESC) = 1) SELECT count(*) AS n_members, count(*) FILTER (label <> there) AS n_mismatch FROM ix JOIN l USING (print) WHERE split = 'test'",
        "band_histogram": f"WITH {IX} SELECT side_band, ratio_band, label, count(*) AS n FROM ix GROUP BY ALL",
        "pool_filters": rf"WITH {IX} SELECT pool_id FROM ix WHERE whole_image_safe = 1 AND side >= 256 AND source NOT IN ('thumbnails', 'glasshouse') AND NOT regexp_matches({base}, '^\._|\.mask\.')",
        "stride_sample": f"WITH {IX}, r AS (SELECT pool_id, row_number() OVER (PARTITION BY source ORDER BY location, pool_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM ix WHERE source IS NOT NULL) SELECT pool_id FROM r WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda i: round_even(i * (n - 1) / 9.0::DOUBLE, 0)::BIGINT), r)",
        "step_sample": f"WITH {IX}, r AS (SELECT pool_id, row_number() OVER (PARTITION BY source ORDER BY location, pool_id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY source) // 10) AS st FROM ix WHERE source IS NOT NULL) SELECT pool_id FROM r WHERE r % st = 0 AND r // st < 10",
        "per_source_cap": f"WITH {IX} SELECT pool_id FROM ix WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY pool_id) <= 25",
        "stratified_holdout": f"WITH {IX} SELECT pool_id FROM (SELECT pool_id, row_number() OVER (PARTITION BY source, label ORDER BY {HASH60}) AS r, count(*) OVER (PARTITION BY source, label) AS n FROM ix WHERE source IS NOT NULL AND label IS NOT NULL) WHERE n > 1 AND r <= greatest(1, floor(n * 0.2::DOUBLE))",
        "equal_per_source": f"WITH {IX}, k AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM ix WHERE source IS NOT NULL AND label = 0) SELECT pool_id FROM (SELECT pool_id, row_number() OVER (PARTITION BY source ORDER BY {HASH60}) AS r, min(n) OVER () AS m FROM k WHERE n >= 20) WHERE r <= m",
        "min_population": f"WITH {IX} SELECT source, count(*) AS n FROM ix WHERE label = 0 AND source IS NOT NULL GROUP BY 1 HAVING count(*) >= 100",
        "format_sets": f"WITH {IX} SELECT label, string_agg(DISTINCT fmt, ',' ORDER BY fmt) AS formats FROM ix WHERE label IS NOT NULL AND fmt IS NOT NULL GROUP BY 1",
        "file_names": rf"""SELECT pool_id, {base} AS base, regexp_replace({base}, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract({base}, '.(\.[^.]*)$', 1)) AS suffix,
            list_filter(list_transform(regexp_split_to_array(lower(location), '[/\\]')[1:-2], lambda f: CASE WHEN contains(f, 'real') THEN 'real' WHEN contains(f, 'ai') THEN 'ai' END), lambda g: g IS NOT NULL)[-1] AS guess,
            substr(sha256(location), 1, 16) AS safe, ('0x' || substr(sha256(location), 1, 8))::BIGINT AS seed FROM pool_index""",
        "label_contract": "SELECT source, e.key AS raw, e.value AS mapped, contains(lower(label_names[1]), 'real') AS class0_real, 1 - e.value AS inverted FROM (SELECT source, label_names, unnest(map_entries(label_map)) AS e FROM source_catalog)",
        "mapped_labels": f"""WITH {IX}, j AS (SELECT ix.pool_id, label, label_map FROM ix LEFT JOIN (SELECT {SRCX} AS source, label_map FROM source_catalog) c USING (source))
            SELECT pool_id, CASE WHEN label IS NULL THEN 'no label' WHEN label_map IS NULL THEN 'unknown source' WHEN NOT list_contains(map_keys(label_map), label) THEN 'unmapped' ELSE 'mapped' END AS status, label_map[label] AS mapped FROM j""",
        "three_way_split": f"""WITH {IX}, r AS (SELECT pool_id, row_number() OVER (PARTITION BY source, label ORDER BY {HASH60}) AS r, count(*) OVER (PARTITION BY source, label) AS n FROM ix WHERE source IS NOT NULL AND label IS NOT NULL),
            z AS (SELECT *, CASE WHEN n < 3 THEN floor(n * 0.1::DOUBLE) ELSE greatest(1, floor(n * 0.1::DOUBLE)) END AS k FROM r) SELECT pool_id, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'validation' ELSE 'train' END AS part FROM z""",
        "matched_ai": f"""WITH {IX}, k AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM ix WHERE source IS NOT NULL AND label = 0),
            re AS (SELECT pool_id FROM (SELECT pool_id, row_number() OVER (PARTITION BY source ORDER BY {HASH60}) AS r, min(n) OVER () AS m FROM k WHERE n >= 20) WHERE r <= m),
            a AS (SELECT pool_id, row_number() OVER (ORDER BY {HASH60}) AS r FROM ix WHERE source IS NOT NULL AND label = 1) SELECT pool_id FROM re UNION ALL SELECT pool_id FROM a WHERE r <= (SELECT count(*) FROM re)""",
        "source_by_print": f"WITH {IX}, k AS (SELECT print, arg_max(coalesce(source, '?'), pool_id) AS there FROM ix WHERE split = 'train' AND print IS NOT NULL GROUP BY 1) SELECT pool_id, coalesce(there, '?') AS there FROM ix LEFT JOIN k USING (print) WHERE split = 'test'",
        "first_members": f"""WITH {IX}, l AS (SELECT print, label AS there FROM ix WHERE split = 'train' AND print IS NOT NULL QUALIFY row_number() OVER (PARTITION BY print ORDER BY pool_id DESC) = 1)
            SELECT min(pool_id) AS pool_id, print, any_value(there) AS there FROM ix JOIN l USING (print) WHERE split = 'test' GROUP BY print""",
        "content_anti": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND source <> 'nightly_audit' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND source = 'nightly_audit')",
        "picture_anti": f"WITH {IX} SELECT pool_id FROM ix WHERE split = 'train' AND print IS NOT NULL AND print NOT IN (SELECT print FROM ix WHERE split IN ('validation', 'test') AND print IS NOT NULL)",
        "real_pipelines": f"WITH {REC} SELECT detector_id, dataset, source, count(*) AS n FROM pop WHERE dataset = 'lowland' OR (dataset = 'benchyard' AND source = 'benchyard_real') GROUP BY ALL",
        "evidence_floor": f"WITH {IX} SELECT source, count(*) AS n, count(*) FILTER (side < 48) AS too_small FROM ix WHERE side IS NOT NULL GROUP BY 1",
        "geometry": f"""WITH {IX}, g AS (SELECT *, greatest(1, round_even(w * 0.75::DOUBLE, 0)::INT) AS sw, greatest(1, round_even(h * 0.75::DOUBLE, 0)::INT) AS sh FROM ix WHERE w > 0 AND h > 0)
            SELECT pool_id, CASE WHEN greatest(sw, sh) > 2048 THEN greatest(1, round_even(sw * (2048.0::DOUBLE / greatest(sw, sh)), 0)::INT) ELSE sw END AS dw, CASE WHEN greatest(sw, sh) > 2048 THEN greatest(1, round_even(sh * (2048.0::DOUBLE / greatest(sw, sh)), 0)::INT) ELSE sh END AS dh,
            round(bpp * w::DOUBLE * h / greatest(w::DOUBLE * h, 1), 6) AS bpp_again, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, round(floor(w / 2.0::DOUBLE) * 100 / w, 6) AS x1, 100.0::DOUBLE AS y1 FROM g""",
        "moments": f"WITH {REC}, c AS (SELECT *, avg(score) OVER (PARTITION BY detector_id, label) AS m FROM pop) SELECT detector_id, label, count(*) AS n, round(avg(score), 7) AS mean, round(sqrt({moment(2)}), 7) AS std, round({moment(3)} / {moment(2)} ** 1.5, 6) AS skew, round({moment(4)} / {moment(2)} ** 2, 6) AS kurt FROM c GROUP BY 1, 2",
        "spearman": f"WITH {REC}, {ARMS} SELECT pair, dataset, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM (SELECT pair, dataset, {avg_rank.format('x')} AS rx, {avg_rank.format('y')} AS ry FROM arms) GROUP BY 1, 2",
        "percent_rank_ensemble": ens + " SELECT * FROM e",
        "rank_ensemble_auc": ens + ", p AS (SELECT pair, dataset, ensemble AS score, label AS pos FROM e) " + _auc("p", "pair, dataset"),
        "shortcut_auc": f"""WITH {REC}, v AS (SELECT detector_id, dataset, label AS pos, 'bytes_per_pixel' AS feature, bytes_per_pixel AS score FROM pop UNION ALL SELECT detector_id, dataset, label, 'longest', greatest(width, height)::DOUBLE FROM pop),
            f AS (SELECT * FROM v WHERE NOT isnan(score) AND abs(score) < 'infinity'::DOUBLE), a AS ({_auc('f', 'detector_id, dataset, feature')}) SELECT detector_id, dataset, feature, round(greatest(auc, 1 - auc), 9) AS auc FROM a""",
        **{f"tile_agg_{r}": f"WITH {T} SELECT path, {_rule('a', r)} AS score FROM t" for r in arrays.RULES},
        "tile_agg_legacy": f"WITH {T} SELECT path, list_max(a) AS max, {_pct('a', '0.5')} AS median, round(list_sum(list_sort(a)[(len(a) // 2 + 1):]) / len(list_sort(a)[(len(a) // 2 + 1):]), 9) AS top_half FROM t",
        "tile_z_scores": f"WITH {T}, m AS (SELECT path, a, list_avg(a) AS m FROM t) SELECT path, round((list_max(a) - m) / (sqrt(list_avg(list_transform(a, lambda x: (x - m) * (x - m)))) + 1e-6::DOUBLE), 7) AS max_z FROM m",
        "select_aggregation": f"""WITH td AS (SELECT *, {FIN} AS a FROM (SELECT DISTINCT * REPLACE ({SRCX} AS source) FROM tile_scores) WHERE label IN (0, 1) AND source IS NOT NULL),
            h0 AS (SELECT *, row_number() OVER (PARTITION BY dataset, source, label ORDER BY sha256('2026:' || path)) AS rk, count(*) OVER (PARTITION BY dataset, source, label) AS pn FROM td),
            h AS (SELECT *, CASE WHEN pn >= 2 AND rk <= least(pn - 1, greatest(1, round_even(pn * 0.5::DOUBLE, 0))) THEN 'calibration' ELSE 'evaluation' END AS half,
              CASE WHEN dataset = 'benchyard' AND source = 'benchyard_real' AND label = 0 THEN 'real' WHEN dataset = 'benchyard' AND label = 1 THEN 'ai' WHEN label = 0 THEN 'other' END AS role FROM h0),
            x AS (SELECT * FROM ({rules.replace('label, ', 'label, half, role, source, ').replace('FROM td', 'FROM h')}) WHERE score IS NOT NULL AND role IS NOT NULL),
            {_cut('c', "(SELECT * FROM x WHERE role = 'real' AND half = 'calibration')", 'rule')},
            per AS (SELECT pos, rule, cut, role, CASE role WHEN 'other' THEN 'all' ELSE half END AS half, source, count(*) AS n, count(*) FILTER (score > cut) AS hits FROM x JOIN c USING (rule) GROUP BY ALL),
            o AS (SELECT pos AS p, rule, cut, round(avg(hits::DOUBLE / per.n) FILTER (role = 'ai' AND half = 'calibration'), 9) AS macro_recall, round((sum(hits) FILTER (role = 'real' AND half = 'calibration'))::DOUBLE / sum(per.n) FILTER (role = 'real' AND half = 'calibration'), 9) AS calibration_fp,
              round((sum(hits) FILTER (role = 'real' AND half = 'evaluation'))::DOUBLE / sum(per.n) FILTER (role = 'real' AND half = 'evaluation'), 9) AS evaluation_fp, round((sum(hits) FILTER (role = 'ai' AND half = 'evaluation'))::DOUBLE / sum(per.n) FILTER (role = 'ai' AND half = 'evaluation'), 9) AS evaluation_recall,
              round(avg(hits::DOUBLE / per.n) FILTER (role = 'other'), 9) AS macro_fp, round(max(hits::DOUBLE / per.n) FILTER (role = 'other'), 9) AS worst_fp FROM per GROUP BY 1, 2, 3),
            a AS ({_auc("(SELECT rule, score, label AS pos FROM x WHERE half = 'evaluation' AND role IN ('real', 'ai'))", 'rule')})
            SELECT o.rule, cut, macro_recall, calibration_fp, evaluation_fp, evaluation_recall, a.auc AS evaluation_auc, macro_fp, worst_fp, o.rule = first_value(o.rule) OVER (ORDER BY macro_recall DESC NULLS LAST, p) AS chosen FROM o LEFT JOIN a ON a.rule = o.rule""",
        "rule_grid": f"""WITH td AS (SELECT label, {FIN} AS a0 FROM (SELECT DISTINCT * FROM tile_scores) WHERE label IN (0, 1)),
            th AS (SELECT label, k, CASE WHEN k > 0 AND len(a0) > k THEN list_transform(list_sort(list_distinct(list_transform(range(0, k), lambda i: round_even(i * ((len(a0) - 1) / (k - 1)::DOUBLE), 0)::INT))), lambda j: a0[j + 1]) ELSE a0 END AS a FROM td, (SELECT unnest([0, 4, 8, 16, 32]) AS k)),
            x AS (SELECT rule, k, score, label AS pos FROM ({rules.replace('label, ', 'label, k, ').replace('FROM td', 'FROM th')}) WHERE score IS NOT NULL) {_auc('x', 'rule, k')}""",
        "tile_positions": f"SELECT path, len({axis.format('width')}) AS nx, len({axis.format('height')}) AS ny, array_to_string({axis.format('width')}, ',') AS xs FROM tile_scores WHERE width IS NOT NULL AND height IS NOT NULL",
        "mask_tiles": f"{mt} SELECT * FROM mt",
        "localisation_iou": f"""{mt}, per AS (SELECT dataset, image, list(score) AS sc, list(coverage >= 0.5::DOUBLE) AS ins, list_sort(list(score)) AS v, max(mask_frac) AS f FROM mt GROUP BY 1, 2 HAVING max(coverage) >= 0.5 AND min(coverage) <= 0.5),
            q AS (SELECT *, (1 - f) * (len(v) - 1) AS place FROM per), c AS (SELECT *, v[floor(place)::INT + 1] + (v[ceil(place)::INT + 1] - v[floor(place)::INT + 1]) * (place - floor(place)) AS cut FROM q),
            n AS (SELECT dataset, f, len(list_filter(list_zip(sc, ins), lambda z: z[1] >= cut AND z[2])) AS b, len(list_filter(list_zip(sc, ins), lambda z: z[1] >= cut OR z[2])) AS e FROM c),
            o AS (SELECT dataset, count(*) AS n_images, avg(f) AS f, avg(CASE WHEN e > 0 THEN b::DOUBLE / e END) AS iou FROM n GROUP BY 1),
            tt AS (SELECT dataset, score, (coverage >= 0.5)::INT AS pos FROM mt JOIN (SELECT dataset, image FROM per) USING (dataset, image)), a AS ({_auc('tt', 'dataset')})
            SELECT dataset, n_images, round(f, 9) AS mask_frac, round(iou, 9) AS iou, round(f / (2 - f), 9) AS chance, n_pos AS n_inside, n_neg AS n_outside, auc AS tile_auc FROM o JOIN a USING (dataset)""",
        "verdict_or_rule": f"""WITH {REC}, w AS (SELECT path, max(score) FILTER (detector_id = 'tilenet_a') >= 0.9::DOUBLE AS a, max(score) FILTER (detector_id = 'vitscore_b') >= 4.0::DOUBLE AS b, max(score) FILTER (detector_id = 'freqarm_c') >= 0.95::DOUBLE AS c FROM pop GROUP BY 1)
            SELECT path, CASE WHEN coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false) THEN 'ai' ELSE 'insufficient' END AS label, concat_ws(',', CASE WHEN a THEN 'tilenet_a' END, CASE WHEN b THEN 'vitscore_b' END, CASE WHEN c THEN 'freqarm_c' END) AS triggered_by FROM w""",
        "verdict_caveats": f"WITH {REC} SELECT score_id, concat_ws(',', CASE WHEN greatest(width, height) > 2048 THEN 'capped' END, CASE WHEN bytes_per_pixel <= 0.30::DOUBLE THEN 'strong_compression' END) AS caveats, CASE WHEN greatest(width, height) >= 700 THEN 'tiles' WHEN greatest(width, height) < 128 THEN 'small' WHEN greatest(width, height) IS NOT NULL THEN 'cnn' END AS method FROM rec",
        "display_words": f"WITH {REC} SELECT score_id, CASE WHEN abs(score - 0.5::DOUBLE) < 0.1::DOUBLE THEN 'uncertain' WHEN score >= 0.5::DOUBLE THEN 'ai' ELSE 'real' END AS word, round(least(99.9::DOUBLE, greatest(0.1::DOUBLE, score * 100)), 9) AS percent FROM pop",
        "full_verdict": f"""WITH {REC}, w AS (SELECT path, max(score) FILTER (detector_id = 'tilenet_a') AS a, max(score) FILTER (detector_id = 'freqarm_c') AS b, max(score) FILTER (detector_id = 'vitscore_b') AS c, max(width) AS w, max(height) AS h, max(bytes_per_pixel) AS bpp FROM pop GROUP BY 1)
            SELECT path, CASE WHEN coalesce(a >= 0.9::DOUBLE, false) OR coalesce(b >= 0.95::DOUBLE, false) OR coalesce(c >= 4.0::DOUBLE, false) THEN 'ai' ELSE 'insufficient' END AS label, concat_ws(',', CASE WHEN a >= 0.9::DOUBLE THEN 'tilenet_a' END, CASE WHEN b >= 0.95::DOUBLE THEN 'freqarm_c' END, CASE WHEN c >= 4.0::DOUBLE THEN 'vitscore_b' END) AS triggered_by,
            concat_ws(',', 'tilenet_a:' || CASE WHEN a >= 0.9::DOUBLE THEN 'ai' WHEN a IS NOT NULL THEN 'insufficient' END, 'freqarm_c:' || CASE WHEN b >= 0.95::DOUBLE THEN 'ai' WHEN b IS NOT NULL THEN 'insufficient' END, 'vitscore_b:' || CASE WHEN c >= 4.0::DOUBLE THEN 'ai' WHEN c IS NOT NULL THEN 'insufficient' END) AS arms,
            concat_ws(',', CASE WHEN greatest(w, h) > 2048 THEN 'capped' END, CASE WHEN bpp <= 0.30::DOUBLE THEN 'strong_compression' END) AS caveats, bpp AS bytes_per_pixel FROM w""",
        "resume_work": "WITH seen AS (SELECT DISTINCT detector_id, path FROM image_scores WHERE NOT isnan(image_score) AND abs(image_score) < 'infinity'::DOUBLE) SELECT detector_id, path FROM (SELECT DISTINCT path FROM image_scores), (SELECT DISTINCT detector_id FROM seen) EXCEPT SELECT * FROM seen",
        "parse_props_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "linear_head": "SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE / i)) + 0.1::DOUBLE))), 7) AS p FROM embeddings",
        "union_of_tables": f"SELECT 'image_scores' AS tbl, {SRCX} AS source, count(*) AS n FROM image_scores GROUP BY ALL UNION ALL SELECT 'tile_scores', {SRCX}, count(*) FROM tile_scores GROUP BY ALL",
        "user_vectors": f"""WITH v AS (SELECT user_id, count(*) AS n, list(value ORDER BY ts, event_id) AS tile_scores FROM events GROUP BY 1), w AS (SELECT *, {FIN} AS a FROM v)
            SELECT user_id, n, {_rule('a', 'top3')} AS top3, {_rule('a', 'fixed16_top3')} AS fixed16_top3 FROM w""",
    }


def queries() -> dict:
    return {n: globals()[n] for n in oracle_sql()}
