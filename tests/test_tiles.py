import hashlib

import numpy as np
from pyspark.sql import functions as F

from assayer.functions import kernels
from assayer.plans import extras

SF = "/root/testdata/sf0.001"


def whole_tile(text):
    key = hashlib.sha256(text.encode()).hexdigest()
    return b"".join(hashlib.sha256(f"{key}:{i}".encode()).digest() for i in range(1536))


def test_tiles_have_full_size_and_no_period(spark):
    raw = bytes(spark.range(1).select(extras.text_tiles(F.lit("a text"))).first()[0])
    assert raw == whole_tile("a text") and len(raw) == 128 * 128 * 3
    assert len({raw[i : i + 32] for i in range(0, len(raw), 32)}) == 1536


def test_query_is_the_kernel_on_whole_tiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").limit(5).collect()
    ids = [r["doc_id"] for r in docs]
    got = {r["doc_id"]: r["features"] for r in extras.tile_features(spark, SF).where(F.col("doc_id").isin(ids)).collect()}
    x = np.stack([np.frombuffer(whole_tile(r["text"]), dtype=np.uint8).reshape(128, 128, 3) for r in docs]) / np.float32(255)
    assert np.allclose([got[i] for i in ids], kernels.tile_features(x), rtol=1e-4, atol=1e-5)


def test_residual_is_what_a_median_leaves():
    x = np.random.default_rng(0).integers(0, 9, (3, 20, 17)).astype(np.float32)
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    near = np.stack([p[:, i : i + 20, j : j + 17] for i in range(3) for j in range(3)])
    assert (kernels.residual(x) == x - np.median(near, axis=0)).all()
