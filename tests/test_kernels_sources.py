import io
import json
import math
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import kernels
from assayer.plans import extras
from assayer.sources import readers, sinks
from assayer.streaming import resume

SF = "/root/testdata/sf0.001"


def test_features_of_known_tiles():
    rng = np.random.default_rng(1)
    tiles = np.stack([np.full((16, 16, 3), 0.5), rng.random((16, 16, 3)), np.kron(rng.random((2, 2)), np.ones((8, 8)))[:, :, None] * np.ones(3)]).astype(np.float32)
    f = kernels.tile_features(tiles)
    names = kernels.feature_names()
    assert f.shape == (3, 68) and len(names) == 68 and np.isfinite(f).all()
    assert abs(f[0][names.index("channel_0")] - 0.5) < 1e-6 and f[0][names.index("noise_4")] == 0
    assert f[2][names.index("grid_0")] > 100  # steps only at block borders
    one = kernels.tile_features(tiles[1:2])[0]
    assert np.allclose(one, f[1])
    x = tiles[1][..., 0].astype(float)
    z = (x - x.mean()) / (x.std() + 1e-8)
    assert np.allclose(f[1][:4], [x.mean(), x.std(), (z**3).mean(), (z**4).mean()], atol=1e-4)


def test_residual_and_box_against_loops():
    x = np.random.default_rng(2).random((1, 10, 11))
    p = np.pad(x[0], 1, mode="symmetric")
    med = np.array([[np.median(p[i : i + 3, j : j + 3]) for j in range(11)] for i in range(10)])
    assert np.allclose(kernels.residual(x)[0], x[0] - med)
    q = np.pad(x[0], ((4, 3), (4, 3)), mode="symmetric")
    box = np.array([[q[i : i + 8, j : j + 8].mean() for j in range(11)] for i in range(10)])
    assert np.allclose(kernels.box_mean(x)[0], box)


def test_crop_and_hash():
    img = np.arange(5 * 7 * 3).reshape(5, 7, 3)
    assert (kernels.centre_crop(img, 3) == img[1:4, 2:5]).all() and kernels.centre_crop(img, 8).shape == (8, 8, 3)
    up, down = np.tile(np.arange(9.0), (8, 1)), np.tile(-np.arange(9.0), (8, 1))
    assert kernels.difference_hash(np.stack([up, down])) == ["f" * 16, "0" * 16]


def test_extra_queries(spark):
    assert {r["features"] for r in extras.metadata_probe(spark, SF).collect()} == {"metadata", "ratio"}
    assert sum(r["n"] for r in extras.cluster_report(spark, SF).collect()) == 500
    assert extras.tile_features(spark, SF).where(F.size("features") == 68).count() > 0
    bad = spark.createDataFrame([(None,), (bytearray(b"xy"),)], "t binary").select(kernels.features_column(F.col("t"), 4))
    assert [r[0] for r in bad.collect()] == [None, None]


def test_file_scan_and_archives(spark, tmp_path):
    (tmp_path / "a" / ".cache").mkdir(parents=True)
    for n in ("a/x.jpg", "a/._x.jpg", "a/.cache/y.jpg", "a/readme.txt"):
        (tmp_path / n).write_bytes(b"data")
    with zipfile.ZipFile(tmp_path / "a/z.zip", "w") as z:
        for n in ("in/1.jpg", "in/2.png", "in/._3.jpg", "../4.jpg", "note.txt"):
            z.writestr(n, n)
    with tarfile.open(tmp_path / "a/t.tar.gz", "w:gz") as t:
        for n in ("in/5.jpg", "/abs.jpg"):
            info = tarfile.TarInfo(n)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "a/broken.zip").write_bytes(b"no zip")
    got = {r["path"].rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path)).select("path").collect()}
    assert got == {"x.jpg", "readme.txt", "z.zip", "t.tar.gz", "broken.zip"}
    assert readers.files(spark, str(tmp_path), images_only=True).count() == 1
    got = readers.archive_members(readers.files(spark, str(tmp_path))).collect()
    assert {r["member"] for r in got if r["error"] is None} == {"in/1.jpg", "in/2.png", "in/5.jpg"}
    assert [r["archive"].rsplit("/", 1)[1] for r in got if r["error"] is not None] == ["broken.zip"]
    assert readers.archive_members(readers.files(spark, str(tmp_path)), None, None).where("error is null").count() == 3


def test_parquet_head_and_label_contract(spark, tmp_path):
    meta = {b"huggingface": json.dumps({"info": {"features": {"label": {"names": ["real", "ai"]}}}}).encode()}
    for k in range(2):
        pq.write_table(pa.table({"label": [0, 1, 0, 1], "extra": ["x"] * 4}).replace_schema_metadata(meta), tmp_path / f"s{k}.parquet")
    got = readers.parquet_head(spark, str(tmp_path), ["label"], 1, F.col("label") == 1).collect()
    assert [(r["label"], r["row_index"]) for r in got] == [(1, 1), (1, 1)]
    paths = [str(tmp_path / f"s{k}.parquet") for k in range(2)]
    readers.verify_labels(spark, paths, "label", ["real", "ai"])
    with pytest.raises(ValueError):
        readers.verify_labels(spark, paths, "label", ["ai", "real"])


def test_manifest_and_strict_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", 0, "l", None, "p", 1, 2, 3, "jpg", 0, 0.5)], schemas.POOL)
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert readers.csv_manifest(spark, str(tmp_path / "m")).collect() == df.collect()
    odd = spark.createDataFrame([(math.nan, [1.0, math.inf])], "x double, a array<double>")
    assert tuple(sinks.strict(odd).first()) == (None, [1.0, None])
    sinks.write_report(odd, str(tmp_path / "r"))
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    assert sinks.markdown(df.select("source", "label"), "Pool").splitlines()[-1] == "| s | 0 |"


def test_scoring_resumes_without_repeats(spark, tmp_path):
    work = str(tmp_path / "work")
    spark.createDataFrame([("d", f"p{i}") for i in range(4)], "detector_id string, path string").write.json(work)
    calls = []

    def score(df):
        calls.append(df.count())
        return df.withColumn("image_score", F.length("path") * 1.0)

    def go(n):
        stream = spark.readStream.schema("detector_id string, path string").json(work)
        resume.run(stream, score, str(tmp_path / "log"), str(tmp_path / f"cp{n}")).awaitTermination(60)

    go(1)
    spark.createDataFrame([("d", "p1"), ("d", "p9")], "detector_id string, path string").write.mode("append").json(work)
    go(2)  # a new checkpoint reads everything again, the log keeps it from being scored again
    log = readers.json_scores(spark, str(tmp_path / "log"))
    assert sorted(r["path"] for r in log.collect()) == ["p0", "p1", "p2", "p3", "p9"] and calls == [4, 1]
    assert resume.latest(log.withColumn("t", F.lit(1)), "t").count() == 5
