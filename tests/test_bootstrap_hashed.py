from hashlib import sha256

import numpy as np
import pytest

from assayer.functions import digests
from assayer.operators import robust

COLS = ["worst_fp_lo", "worst_fp_hi", "macro_fp_lo", "macro_fp_hi"]


def frame(spark, pops):
    rows = [(d, "ds", s, 0, half, p, float(x)) for (d, s, half), v in pops.items() for p, x in v]
    return spark.createDataFrame(rows, "detector_id string, dataset string, source string, label int, half string, path string, score double")


def by_hand(pops, detector, replicates):
    def draw(key, rep):
        x = np.array([s for _, s in sorted(pops[key], key=lambda r: (r[0] is None, r[0] or ""))])
        at = [int(sha256(f"{rep}:{key[2]}:ds:{key[1]}:{i}".encode()).hexdigest()[:8], 16) % len(x) for i in range(len(x))]
        return x[at]

    runs = []
    for rep in range(replicates):
        own = [k for k in pops if k[0] == detector]
        cut = max(np.sort(x)[-(len(x) // 10 + 1)] for x in (draw(k, rep) for k in own if k[2] == "calibration"))
        fp = [(draw(k, rep) > cut).mean() for k in own if k[2] == "evaluation"]
        runs.append((max(fp), np.mean(fp)))
    return np.percentile(runs, [2.5, 97.5], axis=0).T.ravel()


@pytest.mark.parametrize("piece", [7, 65_536])
def test_draws_shared_by_detectors_of_unequal_sizes(spark, monkeypatch, piece):
    monkeypatch.setattr(robust, "PIECE", piece)
    rng = np.random.default_rng(1)
    sizes = {"d": {"a": 31, "b": 12}, "e": {"a": 20, "b": 1}}
    pops = {(d, s, h): [(f"p{i}", x) for i, x in enumerate(rng.normal(0, 1, n))] for d, of in sizes.items() for s, n in of.items() for h in ("calibration", "evaluation")}
    pops["d", "a", "evaluation"].insert(0, (None, 5.0))  # a null path comes last, as in the SQL
    got = {r["detector_id"]: [r[c] for c in COLS] for r in robust.bootstrap_ci(frame(spark, pops), 25).collect()}
    assert sorted(got) == ["d", "e"]
    for d in got:
        assert np.allclose(got[d], by_hand(pops, d, 25), atol=1e-8)


def test_no_row_for_each_draw(spark):
    pops = {("d", s, h): [(f"p{i}", i / 99) for i in range(99)] for s in "ab" for h in ("calibration", "evaluation")}
    plan = robust.bootstrap_ci(frame(spark, pops), 200)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "sequence(0, 199" not in plan and "199]" not in plan


def test_no_rows_at_all(spark):
    assert robust.bootstrap_ci(frame(spark, {("d", "a", "calibration"): [("p", 0.5)]}).where("label = 1"), 5).count() == 0


def test_heads_of_digests(monkeypatch):
    monkeypatch.setattr(digests, "PIECE", 64)
    for prefix in (b"", b"7:evaluation:", b"x" * 70):
        assert digests.numbered_heads(prefix, 150).tolist() == [int.from_bytes(sha256(prefix + b"%d" % i).digest()[:4], "big") for i in range(150)]
