import math

import pytest
from pyspark.sql import functions as F

from assayer.operators import pool


def table(spark, *classes):
    """classes: (label, fmt, ratio, sizes)."""
    rows = [(lab, w, h, max(w, h), fmt, ratio) for lab, fmt, ratio, sizes in classes for w, h in sizes]
    return spark.createDataFrame(rows, "label int, w int, h int, side int, fmt string, ratio double")


def flags(df):
    r = pool.audit_problems(df).first().asDict()
    return r.pop("classes"), {k for k, v in r.items() if v}


@pytest.mark.parametrize("sizes,found", [
    ([[(1024, 700)] * 4, [(512, 400)] * 4], {"side_gap", "ranges_apart"}),  # a ratio of exactly 2
    ([[(700, 600)] * 4, [(600, 500)] * 4], {"ranges_apart"}),
    ([[(700, 600), (500, 400)] * 4, [(600, 500)] * 4], set()),
    ([[(600, 600)] * 4, [(600, 500)] * 13], {"square_gap", "imbalance"}),
    ([[(600, 500)] * 4], {"single_class"}),
])
def test_problems(spark, sizes, found):
    df = table(spark, *[(lab, "JPEG", 0.5, s) for lab, s in enumerate(sizes)])
    assert flags(df) == (len(sizes), found)


def test_formats_and_bytes(spark):
    s = [(600, 500)] * 3
    assert flags(table(spark, (0, "JPEG", 0.2, s), (1, "PNG", 0.7, s)))[1] == {"format_trap", "bpp_gap"}
    assert flags(table(spark, (0, "JPEG", 0.2, s), (0, None, 0.2, s), (1, "PNG", 0.5, s)))[1] == set()
    assert flags(table(spark, (0, "JPEG", 0.2, s)).limit(0)) == (0, {"single_class"})


def test_whole_audit(spark):
    df = table(spark, (0, "JPEG", 0.25, [(9, 9)] * 3 + [(5, 4)] * 2 + [(4, 5)] * 2 + [(8, 1)]), (0, None, 0.75, [(9, 9)] * 8))
    r = pool.whole_audit(df).first()
    assert (r["n"], r["distinct_sizes"], r["top_sizes"], r["square_pct"], r["mean_bpp"], r["formats"]) == (16, 4, "9x9(11), 4x5(2), 5x4(2)", 68.8, 0.5, "?,JPEG")


def test_class_gap(spark):
    df = table(spark, (0, "JPEG", 0.5, [(1024, 9)] * 3), (1, "JPEG", 0.5, [(400, 9)] * 2), (None, "JPEG", 0.5, [(1, 1)]))
    assert tuple(pool.class_gap(df).first()) == (2.56, True)
    assert tuple(pool.class_gap(df.where(F.col("label") == 0)).first()) == (math.inf, True)
