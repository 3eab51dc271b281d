"""Session helpers: table loading, the shared scratch folder and written intermediates."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_spark(app: str = "assayer", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for local work; on a cluster the submitted session is used instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, if they have no copy of their own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables of a data folder."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the checkpoint directory the session was given.

    Only where neither is set and the session runs in one process (tests, a laptop) is a temporary folder made, which
    goes with the process. A session on several machines without a shared folder is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="assayer-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir("file://" + folder)
    return sc.getCheckpointDir().rstrip("/")


class _Written:
    """What this session has written: the folders of all Scratch tables, and the tables that queries share."""

    def __init__(self):
        self.roots: list[str] = []
        self.shared: dict[tuple, tuple[str, StructType]] = {}


def _written(spark: SparkSession) -> _Written:
    sc = spark.sparkContext
    if not hasattr(sc, "_assayer_written"):
        sc._assayer_written = _Written()
    return sc._assayer_written


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables this package has written in the session. Results not yet read can't be read any more."""
    held = _written(spark)
    for root in held.roots:
        _delete(spark, root)
    held.roots, held.shared = [], {}


class Scratch:
    """Intermediate tables of one query, written as Parquet into the shared folder.

    A written table cuts the lineage and survives the loss of executors. Tables that a later
    step supersedes are dropped at once; the rest live until `release`, as the query's result may
    still be read.
    """

    def __init__(self, spark: SparkSession, tag: str):
        let_workers_import(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/assayer-{tag}-{uuid.uuid4().hex[:12]}"
        self.step = 0
        _written(spark).roots.append(self.root)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.step += 1
        path = f"{self.root}/{self.step:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._assayer_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_assayer_path", None)
        if path:
            _delete(self.spark, path)


def shared(spark: SparkSession, sf_dir: str, table: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(table), written once in a session and read by every later query over the same files.

    The files are known by path, time and total size, so a table that was written anew is built anew.
    """
    path = f"{sf_dir}/{table}.parquet"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.getContentSummary(p)
    key = (path, name, fs.getFileStatus(p).getModificationTime(), files.getLength(), files.getFileCount())
    held = _written(spark).shared
    if key in held:
        at, schema = held[key]
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
            return spark.read.schema(schema).parquet(at)
    out = Scratch(spark, name).write(build(load(spark, sf_dir, table)), name)
    held[key] = (out._assayer_path, out.schema)
    return out
