import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import robust
from assayer.plans import evaluation

ENDS = [f"{c}_{e}" for c in ("worst_fp", "macro_fp", "macro_recall") for e in ("lo", "hi")]


@pytest.mark.parametrize("n,k,chunk", [(1, 1, 10), (50, 6, 7), (1000, 101, 64), (1000, 1000, 300), (77, 8, 1000)])
def test_draws_in_chunks(n, k, chunk):
    x = np.concatenate(list(robust._draws(-5, n, chunk)))
    assert len(x) == n and x.max() < n
    assert robust._kth_largest(-5, n, k, chunk) == np.sort(x)[-k]
    assert robust._count_from(-5, n, n // 2, chunk) == (x >= n // 2).sum()


def halves(spark, pops):
    rows = [("d", "ds", s, lab, half, f"{i}", float(x)) for (s, lab, half), v in pops.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "detector_id string, dataset string, source string, label int, half string, path string, score double")


def test_intervals_against_a_plain_bootstrap(spark):
    rng = np.random.default_rng(4)
    pops = {(s, lab, half): rng.normal(m, 1, 60) for s, lab, m in (("a", 0, 0), ("b", 0, 0.4), ("x", 1, 1), ("y", 1, 3)) for half in ("calibration", "evaluation")}
    got = robust.bootstrap_intervals(halves(spark, pops), 2000).first()
    draw = lambda v: v[rng.integers(0, len(v), len(v))]
    runs = []
    for _ in range(2000):
        cut = max(np.sort(draw(v))[-7] for (_, lab, half), v in pops.items() if lab == 0 and half == "calibration")
        fp, recall = ([(draw(v) > cut).mean() for (_, at, half), v in pops.items() if at == lab and half == "evaluation"] for lab in (0, 1))
        runs.append((max(fp), np.mean(fp), np.mean(recall)))
    want = np.percentile(runs, [2.5, 97.5], axis=0).T.ravel()
    assert got["replicates"] == 2000
    assert np.abs(np.array([got[c] for c in ENDS]) - want).max() < 0.03


def test_ties_and_a_detector_without_generators(spark):
    same = {(s, lab, half): [x] * 5 for s, lab, x in (("a", 0, 0.5), ("b", 0, 0.1), ("x", 1, 0.9), ("y", 1, 0.5)) for half in ("calibration", "evaluation")}
    sp = halves(spark, same)
    assert [robust.bootstrap_intervals(sp, 20).first()[c] for c in ENDS] == [0, 0, 0, 0, 0.5, 0.5]
    assert [robust.bootstrap_intervals(sp.where(F.col("label") == 0), 20).first()[c] for c in ENDS] == [0, 0, 0, 0, None, None]


def test_the_query_runs_as_many_replicates_as_the_reference(spark):
    rows = evaluation.queries()["bootstrap_intervals"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["replicates"] == 2000 and 0 <= r["macro_recall_lo"] <= r["macro_recall_hi"] <= 1 for r in rows)
