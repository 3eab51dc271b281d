"""Scans: files, Parquet shards, JSON lines, CSV manifests, archive members, label contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer import schemas

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")


def files(spark: SparkSession, folder: str, images_only: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder, without `._` files and .cache folders."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    df = df.where(~F.col("path").rlike(r"/\._[^/]*$|/\.cache/"))
    return df.where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")) if images_only else df


def parquet_head(spark: SparkSession, path: str, columns: list[str], per_file: int | None = None, keep=None) -> DataFrame:
    """Columns of Parquet shards, at most the first rows of each file that pass `keep`, in file order.

    Only the named columns are read. Unreadable shards are skipped.
    """
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    df = df.select(*columns, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
    if keep is not None:
        df = df.where(keep)
    if per_file is not None:
        r = F.row_number().over(W.partitionBy("file_path").orderBy("row_index"))
        df = df.withColumn("_r", r).where(F.col("_r") <= per_file).drop("_r")
    return df


def label_names(path: str, column: str) -> list[str] | None:
    """Class names in a shard's schema metadata, or null if it holds none. Reads only the footer."""
    import pyarrow.parquet as pq

    meta = (pq.read_schema(path).metadata or {}).get(b"huggingface")
    if meta is None:
        return None
    feature = json.loads(meta).get("info", {}).get("features", {}).get(column, {})
    return feature.get("names")


def verify_labels(spark: SparkSession, paths: list[str], column: str, expected: list[str]) -> None:
    """Raises if any shard names its classes otherwise: a silently inverted label poisons a whole pool. Footers are read in tasks."""

    def read(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "names": [label_names(p, column) for p in b["path"]]})

    found = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200))).mapInPandas(read, "path string, names array<string>")
    bad = found.where(F.col("names").isNotNull() & (F.col("names") != F.array(*[F.lit(n) for n in expected]))).orderBy("path").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: classes {bad['names']}, expected {expected}")


def json_scores(spark: SparkSession, path: str, schema: str = schemas.IMAGE_SCORE) -> DataFrame:
    """Score records, one JSON object a line; a bad line fails with its place."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_manifest(spark: SparkSession, path: str, schema: str = schemas.POOL) -> DataFrame:
    """A pool manifest with typed columns: flags are numbers, not text."""
    return spark.read.schema(schema).csv(path, header=True)


def folder_labels(scan: DataFrame, labels: dict[str, int]) -> DataFrame:
    """A files() frame with the label that the name of a file's own folder stands for; others have none."""
    table = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k.lower()), F.lit(v))])
    return scan.withColumn("label", F.try_element_at(table, F.lower(F.element_at(F.split("path", "/"), -2))))


def two_roots(spark: SparkSession, real: str, ai: str) -> DataFrame:
    """(path, label, content) of two folders of pictures: 0 below the one, 1 below the other."""
    part = lambda folder, label: files(spark, folder, images_only=True).select("path", F.lit(label).alias("label"), "content")
    return part(real, 0).unionByName(part(ai, 1))


def guess_columns(names: list[str]) -> dict[str, str | None]:
    """The columns of a table of unknown origin that hold the picture, the label, and its sizes, by usual names."""
    known = {"image": ("image", "img", "picture", "jpg", "png", "bytes"), "label": ("label", "labels", "class", "target", "is_ai", "fake"), "width": ("width", "w"), "height": ("height", "h")}
    low = {n.lower(): n for n in names}
    return {k: next((low[c] for c in cands if c in low), None) for k, cands in known.items()}


def sampled_shards(spark: SparkSession, folder: str, shards: int | None = 12, per_shard: int | None = 50) -> DataFrame:
    """Rows of a folder of Parquet shards of unknown origin, as (file_path, row_index, and the columns guess_columns finds).

    A sampling operator: evenly spaced shards in the order of their names, evenly spaced rows of each. None takes all.
    """
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(folder)
    named = {k: v for k, v in guess_columns(df.columns).items() if v}
    rows = df.select(*[F.col(v).alias(k) for k, v in named.items()], F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
    sizes = rows.groupBy("file_path").agg(F.max("row_index").alias("last"))
    if shards is not None:
        line = sizes.withColumn("r", F.row_number().over(W.orderBy("file_path")) - 1).crossJoin(F.broadcast(sizes.agg(F.count("*").alias("n"))))
        places = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(max(shards - 1, 1)))))
        sizes = line.where((F.col("n") <= shards) | F.array_contains(places, F.col("r").cast("double"))).select("file_path", "last")
    rows = rows.join(sizes, "file_path")
    if per_shard is not None:
        step = F.greatest(F.lit(1), F.floor((F.col("last") + 1) / per_shard))
        rows = rows.where((F.col("row_index") % step == 0) & (F.col("row_index") / step < per_shard))
    return rows.drop("last")


def tar_catalogue(archives: DataFrame) -> DataFrame:
    """(path, dataset, split, number) of archives named <dataset>-<split>-<number>.tar with a split manip or auth."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)-(manip|auth)-(\d+)\.tar$", i)
    return archives.select("path", part(1).alias("dataset"), part(2).alias("split"), part(3).cast("int").alias("number")).where("dataset <> ''")


def archive_members(archives: DataFrame, per_zip: int | None = 120, per_tar: int | None = 60) -> DataFrame:
    """(archive, member, content, error) of image members of zip and tar files, never unpacked to disk.

    archives is a files() frame. A zip is sampled at even steps, a tar from its start; None takes every member. Members
    with absolute paths, `..` or `._` names are left out. What is read before an archive breaks is kept, and the
    break is a row of its own, with a null member and the error. One member is held at a time.
    """

    def run(batches):
        import io
        import tarfile
        import zipfile

        import pandas as pd

        def good(name: str) -> bool:
            parts = name.replace("\\", "/").split("/")
            return not name.startswith("/") and ".." not in parts and not parts[-1].startswith("._") and name.lower().rsplit(".", 1)[-1] in IMAGE_SUFFIXES

        def members(path, raw):
            if path.lower().endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = [n for n in z.namelist() if good(n)]
                    for n in names if per_zip is None else names[:: max(1, len(names) // per_zip)][:per_zip]:
                        yield path, n, z.read(n)
            else:
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
                    taken = 0
                    for m in t:
                        if per_tar is not None and taken >= per_tar:
                            return
                        if m.isfile() and good(m.name):
                            taken += 1
                            yield path, m.name, t.extractfile(m).read()

        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                cols = ["archive", "member", "content", "error"]
                try:
                    for row in members(path, raw):
                        yield pd.DataFrame([(*row, None)], columns=cols)
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
                    yield pd.DataFrame([(path, None, None, f"{type(e).__name__}: {e}")], columns=cols)

    wanted = archives.where(F.lower("path").rlike(r"\.(zip|tar|tgz|tar\.gz)$")).select("path", "content")
    return wanted.mapInPandas(run, "archive string, member string, content binary, error string")


def paired(a: DataFrame, b: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """(pairs, rows of a without a partner), joined on the file stem."""
    return a.join(b, key), a.join(b.select(key), key, "left_anti")
