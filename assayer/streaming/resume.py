"""Resumable scoring: a stream of work items, each (detector_id, path) scored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions.text import finite
from assayer.sources.sinks import strict


#: What names a piece of work; with VARIANT_KEY a picture is scored once in each variant.
KEY, VARIANT_KEY = ("detector_id", "path"), ("detector_id", "variant", "path")


def latest(scores: DataFrame, order: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """The last record of each key in an append-only log."""
    cols = [c for c in scores.columns if c not in key]
    best = scores.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("r"))
    return best.select(*key, "r.*")


def remaining(work: DataFrame, scores: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Work items without a finite score yet; a null in the key is a value like any other."""
    done = scores.where(finite(F.col("image_score"))).select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return work.join(done, same, "left_anti")


def run(work: DataFrame, score: Callable[[DataFrame], DataFrame], log: str, checkpoint: str):
    """Starts the stream: each micro-batch is cut down to what the log lacks, scored and appended.

    A batch that is run again after a failure finds its own rows in the log, so every item is scored once. Repeats
    within a batch are dropped.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["detector_id", "path"])
        path = spark._jvm.org.apache.hadoop.fs.Path(log)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = remaining(fresh, spark.read.schema(schemas.IMAGE_SCORE).json(log))
        strict(score(fresh)).write.mode("append").json(log)

    return work.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
