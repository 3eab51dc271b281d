import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import digests
from assayer.operators import tiles
from assayer.plans import extras

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("lanes,size", [(16_384, 180_000), (700, 50_001), (16, 33), (16, 1)])
def test_counted_bytes(monkeypatch, lanes, size):
    monkeypatch.setattr(digests, "LANES", lanes)
    keys = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(5)]
    want = [b"".join(hashlib.sha256(f"{k}:{i}".encode()).digest() for i in range(-(-size // 32)))[:size] for k in keys]
    assert list(digests.counted_bytes([k.encode() for k in keys], size)) == want
    assert list(digests.counted_bytes([], size)) == []


def test_selected_tiles_are_the_extracted_ones(spark):
    big = np.random.default_rng(0).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    big[:16, :16] = 7
    rows = [("big", 50, 40, big.tobytes()), ("small", 5, 4, bytes(range(60))), ("broken", 9, 9, b"123"), ("none", None, 3, None), ("empty", 0, 0, b""), ("flat", 32, 32, bytes(32 * 32 * 3))]
    df = spark.createDataFrame([(a, b, c, bytearray(d) if d is not None else None) for a, b, c, d in rows], "path string, width int, height int, rgb binary")
    key = lambda r: (r["path"], r["x"] or 0, r["y"] or 0)
    want = sorted(tiles.extract(df, tile=16).drop("features").collect(), key=key)
    assert sorted(tiles.select(df, tile=16).collect(), key=key) == want
    assert sorted(tiles.select(df, tile=16, decode=lambda held: (v for v in held)).collect(), key=key) == want


def test_query_makes_no_values_that_it_does_not_return(spark):
    got = extras.tile_extraction(spark, SF)
    assert "features" not in got._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").limit(3)
    rgb = extras.text_bytes(F.col("text"), 300 * 200 * 3)
    whole = tiles.extract(docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(300).alias("width"), F.lit(200).alias("height"), rgb.alias("rgb")))
    want = {int(r["path"]): (r["n"], r["k"], r["m"]) for r in whole.groupBy("path").agg(F.max("n_tiles").alias("n"), F.count("*").alias("k"), F.round(F.avg("texture"), 6).alias("m")).collect()}
    rows = {r["doc_id"]: (r["n_tiles"], r["kept"], r["texture_mean"]) for r in got.where(F.col("doc_id").isin(list(want))).collect()}
    assert len(want) == 3 and rows == want
