"""Hand-computed cases of the studies, sharing no code with their SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import kernels
from assayer.operators import models, pool, ranks, robust, studies, tiles
from assayer.session import Scratch, release, shared_dir
from assayer.sources import readers, sinks
from assayer.streaming import resume

POP = "detector_id string, path string, dataset string, source string, label int, score double, variant string, orig_path string, scored_at int, score_id long"


def test_a_degraded_score_keeps_its_originals_half(spark):
    rows = [("d", f"{s}{i}", "x", s, lab, float(v), None, None, 0, n) for n, (s, lab, i, v) in enumerate((s, lab, i, i / 10 + lab) for s, lab in (("a", 0), ("b", 0), ("g", 1)) for i in range(6))]
    copies = [("d", f"copy-{r[1]}", "x", r[3], r[4], r[5] + 5.0, "jpeg40", r[1], 1, 100 + r[9]) for r in rows]
    got = {r["setting"]: r for r in robust.frozen_vs_refit(spark.createDataFrame([*rows, *copies], POP), 0.3).collect()}
    assert set(got) == {"clean", "frozen", "refit"}
    # every copy scores 5 more than its original, so the refit cut moves by as much and the frozen one flags all
    assert got["refit"]["cut"] == pytest.approx(got["clean"]["cut"] + 5) and got["frozen"]["cut"] == got["clean"]["cut"]
    assert got["refit"]["macro_fp"] == got["clean"]["macro_fp"] and got["refit"]["auc"] == got["clean"]["auc"] == got["frozen"]["auc"]
    assert got["frozen"]["worst_fp"] == 1.0 and got["frozen"]["macro_recall"] == 1.0


def test_localisation_by_hand(spark):
    # picture p: four tiles, the two best scores are inside; q has no tile clearly out; r flags one of two
    rows = [("d", "p", i, s, c, 0.5) for i, (s, c) in enumerate([(0.9, 1.0), (0.8, 0.5), (0.2, 0.4), (0.1, 0.0)])]
    rows += [("d", "q", i, 0.5, 0.9, 0.9) for i in range(3)]
    rows += [("d", "r", i, s, c, 0.25) for i, (s, c) in enumerate([(0.9, 0.0), (0.8, 1.0), (0.2, 0.0), (0.1, 0.0)])]
    got = studies.localisation(spark.createDataFrame(rows, "dataset string, image string, tile_idx int, score double, coverage double, mask_frac double")).collect()
    assert len(got) == 1 and got[0]["n_images"] == 2
    # p: cut at the median 0.5, flagged = inside; r: cut at 0.825, flagged the wrong tile: none of two
    assert got[0]["iou"] == pytest.approx(0.5) and got[0]["mask_frac"] == pytest.approx(0.375) and got[0]["chance"] == pytest.approx(0.375 / 1.625)
    pos, neg = [0.9, 0.8, 0.8], [0.2, 0.1, 0.9, 0.2, 0.1]
    assert got[0]["tile_auc"] == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_rule_selection_looks_at_calibration_only(spark):
    rows = [(f"{s}{i}", "x", s, lab, [v + i / 100] * 4) for s, lab, v in (("real", 0, 0.1), ("gen", 1, 0.9), ("other", 0, 0.95)) for i in range(10)]
    df = spark.createDataFrame(rows, "path string, dataset string, source string, label int, tile_scores array<double>")
    got = studies.select_rule(df, "real", "x").collect()
    assert [r["rule"] for r in got if r["chosen"]] == ["top3"]  # all rules tie, the first wins
    assert all(r["macro_recall"] == r["evaluation_recall"] == r["evaluation_auc"] == 1.0 and r["worst_fp"] == 1.0 for r in got)


def test_shortcut_rules_need_two_classes_with_one_format_each(spark):
    schema = "label int, fmt string, square int, w int, h int, side int, bpp double"
    flags = lambda rows: pool.shortcut_rules(spark.createDataFrame(rows, schema)).first()
    two = flags([(0, "png", 1, 10, 10, 1000, 4.0)] * 3 + [(1, "jpg", 0, 10, 10, 300, 1.0)] * 2)
    assert all(two[c] for c in ("format_disjoint", "square_gap", "side_gap", "ratio_gap")) and not two["imbalance"]
    mixed = flags([(0, "png", 1, 10, 10, 100, 1.0), (0, "gif", 1, 10, 10, 100, 1.0), (1, "jpg", 1, 10, 10, 100, 1.0)])
    assert not mixed["format_disjoint"] and mixed["imbalance"]
    assert flags([(k, "png", 1, 10, 10, 10 ** k, 1.0) for k in (1, 2, 3)])["side_gap"] is False


def test_labels_are_never_guessed(spark):
    df = spark.createDataFrame([("a", {0: 1, 1: 0}, 0), ("a", {0: 1, 1: 0}, None)], "source string, m map<int,int>, label int")
    one = lambda d: [r[0] for r in d.select(pool.checked_label(F.col("source"), F.col("m"), F.col("label"))).collect()]
    assert one(df) == [1, None]
    for bad in ([("a", {0: 1}, 7)], [("b", None, 0)], [("b", {}, 0)]):
        with pytest.raises(Exception, match="label"):
            one(spark.createDataFrame(bad, df.schema))


def test_running_sums_places_and_ranks_without(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(p), float(v)) for k, p, v in zip(rng.integers(0, 2, 900), rng.integers(0, 4, 900), rng.integers(0, 500, 900), strict=True)]
    df = spark.createDataFrame(rows, "k int, p int, v double")
    at = {(r["k"], r["p"], r["v"], r["place"]) for r in ranks.positions(df, ["k"], ["v", "p"], Scratch(spark, "t")).collect()}
    want = {(k, p, v, i) for key in (0, 1) for i, (k, v, p) in enumerate(sorted((k, v, p) for k, p, v in rows if k == key))}
    assert at == want
    counted = df.groupBy("k", "v").agg(F.count("*").alias("c"))
    for r in ranks.running(counted, ["k"], "v", ["c"]).collect():
        assert r["before_c"] == sum(1 for k, _, v in rows if k == r["k"] and v < r["v"])
    for r in ranks.kth_without(df, ["k"], ["p"], "v", lambda n: F.ceil(n * 0.3)).collect():
        rest = sorted(v for k, p, v in rows if k == r["k"] and p != r["p"])
        assert r["n"] == len(rest) and r["y"] == rest[int(np.ceil(len(rest) * 0.3)) - 1]
    assert ranks.kth_without(df.where("p = 0"), ["k"], ["p"], "v", lambda n: n).count() == 0
    assert ranks.positions(df.limit(0), ["k"], ["v"], Scratch(spark, "t")).count() == 0


def test_auc_by_generator_by_hand(spark):
    rows = [("d", "x", "anchor", 0, s) for s in (0.1, 0.4, 0.4, 0.8)] + [("d", "x", "g", 1, s) for s in (0.4, 0.9)] + [("d", "x", "h", 1, 0.05)]
    sp = spark.createDataFrame(rows, "detector_id string, dataset string, source string, label int, score double").withColumn("half", F.lit("evaluation"))
    got = {r["source"]: (r["n_neg"], r["n_pos"], r["auc"]) for r in robust.auc_by_generator(sp, "anchor").collect()}
    assert got == {"g": (4, 2, pytest.approx((2 + 4) / 8)), "h": (4, 1, 0.0)}


def test_overridden_scores(spark):
    rec = spark.createDataFrame([("d", "s", "a", 0.1), ("d", "t", "a", 0.2), ("d", "s", "b", 0.3)], "detector_id string, source string, stem string, score double")
    over = spark.createDataFrame([("d", "a", 0.9)], "detector_id string, stem string, score double")
    assert sorted((r["source"], r["stem"], r["score"]) for r in studies.overridden(rec, over, "s").collect()) == [("s", "a", 0.9), ("s", "b", 0.3), ("t", "a", 0.2)]


def test_tiles_of_pictures(spark):
    rng = np.random.default_rng(0)
    big = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    big[:16, :16] = 7
    rows = [("big", 50, 40, big.tobytes()), ("small", 5, 4, bytes(range(60))), ("broken", 9, 9, b"123"), ("none", None, 3, None), ("flat", 32, 32, bytes(32 * 32 * 3))]
    df = spark.createDataFrame([(a, b, c, bytearray(d) if d is not None else None) for a, b, c, d in rows], "path string, width int, height int, rgb binary")
    got = tiles.extract(df, tile=16).collect()
    places = sorted((r["x"], r["y"]) for r in got if r["path"] == "big")
    assert places == sorted({(x, y) for y in (0, 12, 24) for x in (0, 11, 23, 34)} - {(0, 0)})
    one = next(r for r in got if r["path"] == "big" and (r["x"], r["y"]) == (23, 12))
    assert np.allclose(one["features"], kernels.tile_features(big[12:28, 23:39][None] / np.float32(255))[0], atol=1e-5)
    assert [(r["x"], r["y"]) for r in got if r["path"] == "small"] == [(0, 0)]
    assert sorted(r["path"] for r in got if r["x"] is None) == ["broken", "none"]
    assert len([r for r in got if r["path"] == "flat"]) == 3  # nothing is textured: three tiles all the same
    assert tiles.grid(640, 640, 128, 9) == [(x, y) for y in (0, 256, 512) for x in (0, 256, 512)]
    assert len(tiles.grid(640, 640, 128, 1)) == 4 and tiles.grid(100, 300, 128) == [(0, 0), (0, 86), (0, 172)]


def test_trees_find_what_a_line_cannot(spark):
    rng = np.random.default_rng(2)
    w = rng.integers(100, 1000, 400)
    rows = [(i, int(300 < x < 700), int(x), 500, 0.5, 0) for i, x in enumerate(w)]
    df = spark.createDataFrame(rows, "pool_id long, label int, w int, h int, bpp double, square int")
    got = {r["features"]: r for r in models.metadata_probe(df, 5).collect()}
    assert got["metadata"]["auc"] > 0.95 and got["metadata"]["flag"] and not got["ratio"]["flag"]
    ok = lambda *x: spark.range(1).select(models.gate_passes(*[F.lit(v) for v in x])).first()[0]
    assert ok(0.6, 0.05, 0.6, 0.1) and not ok(0.65, 0.05, 0.6, 0.2) and not ok(0.6, 0.1, 0.6, 0.2) and not ok(0.6, 0.0, 0.6, 0.09)


def test_scans_and_sinks(spark, tmp_path):
    for sub in ("Real", "fake", "other"):
        (tmp_path / "in" / sub).mkdir(parents=True)
        (tmp_path / "in" / sub / "a.jpg").write_bytes(b"x" + sub.encode())
    scan = readers.folder_labels(readers.files(spark, str(tmp_path / "in")), {"real": 0, "fake": 1})
    assert sorted((r["path"].split("/")[-2], r["label"]) for r in scan.collect()) == [("Real", 0), ("fake", 1), ("other", None)]
    pair = readers.two_roots(spark, str(tmp_path / "in" / "Real"), str(tmp_path / "in" / "fake"))
    assert sorted((r["label"], bytes(r["content"])) for r in pair.collect()) == [(0, b"xReal"), (1, b"xfake")]
    named = pair.withColumn("name", F.lit("n.jpg"))
    assert {r["label"]: r["n"] for r in sinks.export_bytes(named, str(tmp_path / "out"), 5).collect()} == {"0": 1, "1": 1}
    assert (tmp_path / "out" / "1" / "n.jpg").read_bytes() == b"xfake"
    df = spark.range(1000).select(F.col("id").alias("Class"), F.lit(3).alias("W"), F.lit("z").alias("junk")).repartition(5)
    df.write.parquet(str(tmp_path / "pq"))
    got = readers.sampled_shards(spark, str(tmp_path / "pq"), 3, 10)
    assert set(got.columns) == {"label", "width", "file_path", "row_index"}
    assert [r["count"] for r in got.groupBy("file_path").count().collect()] == [10, 10, 10]
    assert readers.sampled_shards(spark, str(tmp_path / "pq"), None, None).count() == 1000
    tars = spark.createDataFrame([("x/coco-manip-0007.tar",), ("x/coco-other-1.tar",)], "path string")
    assert [tuple(r)[1:] for r in readers.tar_catalogue(tars).collect()] == [("coco", "manip", 7)]
    assert sinks.markdown(spark.range(3).toDF("a"), "t", 2).splitlines()[-1] == "Only the first 2 rows are shown."


def test_an_unfinished_score_is_work_again(spark):
    work = spark.createDataFrame([("d", "a", None), ("d", "b", None), ("d", "b", "x")], "detector_id string, path string, variant string")
    log = spark.createDataFrame([("d", "a", None, float("nan")), ("d", "b", None, 0.5)], "detector_id string, path string, variant string, image_score double")
    assert [r["path"] for r in resume.remaining(work, log).collect()] == ["a"]
    assert sorted((r["path"], r["variant"]) for r in resume.remaining(work, log, resume.VARIANT_KEY).collect()) == [("a", None), ("b", "x")]


def test_release_leaves_nothing(spark):
    scratch = Scratch(spark, "gone")
    held = scratch.write(spark.range(3))
    assert held.count() == 3
    assert scratch.root.startswith(shared_dir(spark))
    there = lambda: spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(scratch.root))
    assert there()
    release(spark)
    assert not there()
