import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import arrays, scalars
from assayer.operators import pool, protocol, ranks, robust


def vectors(spark, *rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "id int, a array<double>")


def scores(spark, values, **cols):
    return spark.createDataFrame([(f"image-{i}.png", float(v)) for i, v in enumerate(values)], "path string, score double").withColumns({k: F.lit(v) for k, v in cols.items()})


@pytest.mark.parametrize("rule", arrays.RULES)
def test_every_rule_is_finite(spark, rule):
    df = vectors(spark, np.linspace(0, 1, 32), [0.5], [0.1, math.nan, 0.3, math.inf])
    out = [r[0] for r in df.orderBy("id").select(arrays.aggregate_rule(F.col("a"), rule)).collect()]
    assert all(math.isfinite(x) for x in out)


def test_rules_of_nothing_are_null(spark):
    df = vectors(spark, [], [math.nan, math.inf])
    for rule in (*arrays.RULES, "top_half", "max", "median"):
        assert [r[0] for r in df.select(arrays.aggregate_rule(F.col("a"), rule)).collect()] == [None, None]
    with pytest.raises(ValueError):
        arrays.aggregate_rule(F.col("a"), "invented")


def test_fixed16_ignores_a_spike_between_places(spark):
    a = [0.0] * 64
    a[1] = 1.0
    r = vectors(spark, a).select(arrays.aggregate_rule(F.col("a"), "top3").alias("x"), arrays.aggregate_rule(F.col("a"), "fixed16_top3").alias("y")).first()
    assert r["x"] > 0 and r["y"] == 0


def test_thin_matches_linspace(spark):
    for n in (16, 17, 18, 31, 49, 64):
        got = vectors(spark, range(n)).select(arrays.thin(F.col("a"), 16)).first()[0]
        assert got == (list(range(n)) if n <= 16 else list(dict.fromkeys(np.linspace(0, n - 1, 16).round())))


def test_split_is_stable_and_disjoint(spark):
    df = scores(spark, range(10), g=1)
    a = {r["path"]: r["half"] for r in protocol.stable_halves(df, ["g"], fraction=0.4).collect()}
    b = {r["path"]: r["half"] for r in protocol.stable_halves(df.orderBy(F.desc("score")), ["g"], fraction=0.4).collect()}
    assert a == b and sorted(a.values()).count("calibration") == 4
    assert protocol.stable_halves(scores(spark, [1], g=1), ["g"]).first()["half"] == "evaluation"
    assert protocol.stable_halves(df.limit(0), ["g"]).count() == 0
    with pytest.raises(ValueError):
        protocol.stable_halves(df, ["g"], fraction=1.0)


def test_half_even_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 9, 13)], "n long")
    assert [r[0] for r in df.select(protocol.calibration_size(F.col("n"), 0.5)).collect()] == [0, 0, 1, 2, 4, 6]


@pytest.mark.parametrize("values,budget,cut", [([0.9, 0.8, 0.8, 0.8, 0.1], 0.4, 0.8), ([0.9, 0.1], 0.0, 0.9), ([0.5] * 7, 0.999, 0.5)])
def test_budget_holds_under_ties(spark, values, budget, cut):
    df = scores(spark, values, g=1)
    r = protocol.threshold_at_fpr(df, ["g"], budget).first()
    assert r["cut"] == cut
    assert sum(v > r["cut"] for v in values) <= budget * len(values)


def test_bad_budget_raises(spark):
    with pytest.raises(ValueError):
        protocol.threshold_at_fpr(scores(spark, [1], g=1), ["g"], 1.0)


def test_evaluation_rows_never_move_a_threshold(spark):
    df = scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5], g=1)
    more = df.withColumn("half", F.lit("calibration")).unionByName(scores(spark, [9, 8], g=1).withColumn("half", F.lit("evaluation")))
    assert protocol.threshold_at_fpr(more.where("half = 'calibration'"), ["g"], 0.2).first()["cut"] == protocol.threshold_at_fpr(df, ["g"], 0.2).first()["cut"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 2.5, -3.0, 1e9, 1e-9]), min_size=1, max_size=40))
def test_kth_values_match_sorting(spark, values):
    df = scores(spark, values, g=1)
    got = {r["k"]: r["y"] for r in ranks.kth_values(df, ["g"], "score", lambda n: [F.lit(1), F.ceil(n / 2), n]).collect()}
    s, n = sorted(values), len(values)
    assert got == {1: s[0], -(-n // 2): s[-(-n // 2) - 1], n: s[-1]}


def test_percentiles_are_linear(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    r = ranks.percentiles(scores(spark, x, g=1), ["g"], "score", {"a": 0.1, "m": 0.5, "b": 0.9}).first()
    assert np.allclose([r["a"], r["m"], r["b"]], np.percentile(x, [10, 50, 90]))


def test_auc_of_negated_scores(spark):
    df = scores(spark, [1, 2, 2, 3, 5, 8, 8, 9], g=1).withColumn("y", F.col("path").rlike("[1357].png").cast("int"))
    a = ranks.auc(df, ["g"], "score", "y").first()["auc"]
    b = ranks.auc(df.withColumn("score", -F.col("score")), ["g"], "score", "y").first()["auc"]
    assert abs(a + b - 1) < 1e-12
    assert ranks.auc(df.withColumn("y", F.lit(1)), ["g"], "score", "y").first()["auc"] is None


def test_verdict_band_is_asymmetric(spark):
    df = spark.createDataFrame([(5.0,), (1.0,), (0.99,), (-10.0,), (None,)], "s double")
    assert [r[0] for r in df.select(scalars.decide(F.col("s"), F.lit(1.0))).collect()] == ["ai", "ai", "insufficient", "insufficient", None]


def test_or_rule_keeps_order_and_ignores_missing_arms(spark):
    for bands, label, fired in ((["ai", "ai"], "ai", ["x", "y"]), (["insufficient", "ai"], "ai", ["y"]), (["insufficient", None], "insufficient", []), ([None, None], "insufficient", [])):
        arr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).cast("string").alias("band")) for n, b in zip("xy", bands, strict=True)])
        a, b = scalars.combine(arr)
        r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
        assert (r["a"], r["b"]) == (label, fired)


def test_cap_keeps_the_aspect(spark):
    df = spark.createDataFrame([(700, 500), (4032, 3024)], "w int, h int")
    got = [tuple(r) for r in df.select(*scalars.capped_size("w", "h")).collect()]
    assert got == [(False, 700, 500), (True, 2048, 1536)]


def test_below_the_first_edge_is_the_last_band(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (99.0,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.band_of(F.col("x"), [0, 5, 10])).collect()] == [2, 0, 1, 2, None]


def test_tile_origins(spark):
    df = spark.createDataFrame([(100,), (128,), (500,), (4032,)], "n int")
    got = [r[0] for r in df.select(arrays.origins(F.col("n"))).collect()]
    assert got[0] == got[1] == [0] and got[2] == [0, 124, 248, 372] and len(got[3]) == 32 and got[3][-1] == 4032 - 128


def test_texture_floor_falls_back_to_three(spark):
    t = [(0, 0, 0.01), (1, 0, 0.03), (2, 0, 0.02), (3, 0, 0.035)]
    df = spark.createDataFrame([(t,), ([(i, 0, 0.5) for i in range(5)],)], "t array<struct<x:int,y:int,texture:double>>")
    got = [[x["x"] for x in r[0]] for r in df.select(arrays.textured(F.col("t"))).collect()]
    assert got == [[1, 2, 3], [0, 1, 2, 3, 4]]


def test_difference_hash(spark):
    grid = [[float(x) for x in range(9)]] * 4 + [[float(-x) for x in range(9)]] * 4
    df = spark.createDataFrame([(grid,)], "g array<array<double>>")
    assert df.select(arrays.grid_hash(F.col("g"))).first()[0] == "ffffffff00000000"


def test_balance_handles_a_missing_class(spark):
    df = spark.createDataFrame([(i, 0, 1, 0) for i in range(3)] + [(9, 1, 1, 1)], "pool_id long, side_band int, ratio_band int, label int")
    assert {r["take"] for r in pool.balance_report(df).collect()} == {0}
    assert pool.balanced(df).count() == 0


def test_unknown_loso_rule(spark):
    with pytest.raises(ValueError):
        robust.loso(scores(spark, [1], half="x", label=0), "invented", "a")
