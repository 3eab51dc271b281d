"""Problem 5: percentiles of very large columns from mergeable centroid digests, with certified rank errors."""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import canonical_source, finite
from assayer.operators.ranks import kth_values
from assayer.session import Scratch

#: Compression: a digest has at most DELTA/2 + 2 centroids, and a centroid at the median holds at most pi/DELTA of the rows.
DELTA = 500
#: Stated bound on the rank error of an estimate, as a share of the rows: more than a centroid's width at the median.
BOUND = 0.01
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Values that a task buffers before it clusters them.
BUFFER = 2_000_000

DIGEST = "means array<double>, weights array<bigint>, lo double, hi double"


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids (group, mean, weight) of many groups at once.

    Within each group the values are sorted and cut where k(q) = delta/(2 pi) asin(2q - 1) passes a whole
    number, q being the rank of a value's middle. Clustering centroids again is how digests are merged.
    """
    if not len(group):
        return group, mean, weight
    order = np.lexsort((mean, group))
    group, mean, weight = group[order], mean[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [len(group)])))
    cum = np.cumsum(weight)
    base = np.repeat(cum[first] - weight[first], size)
    total = np.repeat(np.add.reduceat(weight, first), size)
    q = (cum - base - weight / 2) / total
    k = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1)))
    cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (group[1:] != group[:-1]))))
    w = np.add.reduceat(weight, cut)
    # scaled by its largest value, so that sums of huge values stay finite
    scale = np.maximum(np.maximum.reduceat(np.abs(mean), cut), 1e-300)
    each = np.repeat(scale, np.diff(np.concatenate((cut, [len(mean)]))))
    m = np.add.reduceat(mean / each * weight, cut) / w * scale
    return group[cut], np.clip(m, np.minimum.reduceat(mean, cut), np.maximum.reduceat(mean, cut)), w


def _pack(names, keys, group, mean, weight, lo, hi):
    """A batch with one row for each group: its keys, its lists of centroids, least and largest value."""
    import pyarrow as pa

    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    offsets = pa.array(np.concatenate((first, [len(group)])).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [*keys, pa.ListArray.from_arrays(offsets, pa.array(mean)), pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.int64))), pa.array(lo), pa.array(hi)],
        names=[*names, "means", "weights", "lo", "hi"],
    )


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", "


def partial_digests(values: DataFrame, keys: list[str], value: str = "value", delta: int = DELTA) -> DataFrame:
    """One digest for each key and task: (keys, part, digest), built where the rows are, without a shuffle."""
    names = [*keys, "part"]

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            t = pa.Table.from_batches(held)
            gid, v = t.column("_gid").to_numpy(), t.column(value).to_numpy()
            uniq, at, code = np.unique(gid, return_index=True, return_inverse=True)
            g, m, w = cluster(code, v, np.ones(len(v), dtype=np.int64), delta)
            lo, hi = np.full(len(uniq), np.inf), np.full(len(uniq), -np.inf)
            np.minimum.at(lo, code, v)
            np.maximum.at(hi, code, v)
            kept = t.select(names).take(pa.array(at)).combine_chunks()
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns]
            return _pack(names, [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], g, m, w, lo, hi)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BUFFER:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    df = values.select(*keys, F.spark_partition_id().alias("part"), value, F.xxhash64(*keys).alias("_gid"))
    return df.mapInArrow(run, _schema(values, keys) + "part int, " + DIGEST)


def merge_digests(digests: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """One digest for each key: all centroids of its digests, clustered again."""

    def run(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        gid = t.column("_gid").to_numpy()
        uniq, at, code = np.unique(gid, return_index=True, return_inverse=True)
        means, weights = (pa.concat_arrays(t.column(c).chunks) for c in ("means", "weights"))
        row = np.repeat(code, means.value_lengths().to_numpy(zero_copy_only=False))
        g, m, w = cluster(row, means.flatten().to_numpy(), weights.flatten().to_numpy(), delta)
        lo, hi = np.full(len(uniq), np.inf), np.full(len(uniq), -np.inf)
        np.minimum.at(lo, code, t.column("lo").to_numpy())
        np.maximum.at(hi, code, t.column("hi").to_numpy())
        kept = t.select(keys).take(pa.array(at)).combine_chunks()
        yield _pack(keys, [pa.concat_arrays(c.chunks) for c in kept.columns], g, m, w, lo, hi)

    df = digests.select(*keys, "means", "weights", "lo", "hi", F.xxhash64(*keys).alias("_gid"))
    return df.repartition("_gid").mapInArrow(run, _schema(digests, keys) + DIGEST)


def day_summaries(values: DataFrame, keys: list[str], scratch: Scratch, value: str = "value", day: str = "day") -> DataFrame:
    """(keys, day, digest): one digest for each key and day, which may be kept and merged with those of other days.

    Digests are built in the scanning tasks and merged in two steps, so that no task merges more than the square
    root of their number for a key.
    """
    parts = partial_digests(values, [*keys, day], value)
    parts = parts.withColumn("part", F.pmod("part", F.lit(isqrt(values.rdd.getNumPartitions()) + 1)))
    parts = merge_digests(parts, [*keys, day, "part"])
    return scratch.write(merge_digests(parts, [*keys, day]), "days")


def estimates(digests: DataFrame, keys: list[str], percentiles=PERCENTILES) -> DataFrame:
    """(keys, est): for each digest the estimates at the percentiles, by interpolation between centroids."""
    ps = np.array(percentiles)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for means, weights, lo, hi in zip(*(b.column(c).to_pylist() for c in ("means", "weights", "lo", "hi")), strict=True):
                w = np.array(weights, dtype=float)
                mid = np.cumsum(w) - w / 2
                out.append(np.interp(ps * w.sum(), np.concatenate(([0.0], mid, [w.sum()])), np.concatenate(([lo], means, [hi]))).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "est"])

    return digests.mapInArrow(run, _schema(digests, keys) + "est array<double>")


def certified_percentiles(values: DataFrame, keys: list[str], days: DataFrame, scratch: Scratch, value: str = "value", percentiles=PERCENTILES, bound: float = BOUND) -> DataFrame:
    """(keys, p, estimate, n, rank_error, bound, within_bound).

    The day summaries are merged, and a second pass over the rows counts how many lie below and at each
    estimate. rank_error is then exact: how far p*n is outside of that range of ranks, as a share of n. An estimate
    that misses the bound is replaced by the exact percentile of its group, so within_bound always holds.
    values must hold finite values only, and no null keys.
    """
    est = scratch.write(estimates(merge_digests(days, keys), keys, percentiles), "estimates")
    at = lambda i: F.col("est")[i]
    counts = [F.count("*").alias("n")]
    for i in range(len(percentiles)):
        counts += [F.count(F.when(F.col(value) < at(i), 1)).alias(f"lt{i}"), F.count(F.when(F.col(value) <= at(i), 1)).alias(f"le{i}")]
    # one row for each key on the small side: the planner broadcasts it only below its size limit
    seen = values.select(*keys, value).join(est, keys).groupBy(*keys, "est").agg(*counts)
    rows = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), at(i).alias("estimate"), F.col(f"lt{i}").alias("lt"), F.col(f"le{i}").alias("le"))
        for i, p in enumerate(percentiles)
    ])
    out = seen.select(*keys, "n", F.inline(rows))
    target = F.col("p") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("lt") - target, target - F.col("le")) / F.col("n")
    out = out.select(*keys, "p", "estimate", "n", error.alias("rank_error"), F.lit(bound).alias("bound"))
    # with few rows one row alone is more than the bound
    out = scratch.write(out.withColumn("within_bound", F.col("rank_error") <= F.greatest("bound", 1 / F.col("n"))), "certified")
    missed = out.where("not within_bound")
    if not missed.limit(1).count():
        return out
    # an estimate beyond the bound gives way to the exact value, of its group alone
    at = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))).cast("bigint")
    wanted = missed.select(*keys, "p", at.alias("k"))
    again = values.select(*keys, value).join(missed.select(*keys).distinct(), keys, "left_semi")
    exact = kth_values(again, keys, value, lambda n: [F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * n)) for p in percentiles]).join(wanted, [*keys, "k"])
    exact = missed.drop("estimate").join(exact.select(*keys, "p", F.col("y").alias("estimate")), [*keys, "p"])
    return out.where("within_bound").unionByName(exact.withColumns({"rank_error": F.lit(0.0), "within_bound": F.lit(True)}))


NO = "\0"


def series(image_scores: DataFrame, pool_index: DataFrame) -> list[DataFrame]:
    """The three columns as (series, detector_id, source, day, value); finite values only; a null source is kept as one."""
    def take(df: DataFrame, name: str, column: str, detector: Column, when: str) -> DataFrame:
        return df.where(finite(F.col(column))).select(
            F.lit(name).alias("series"), F.coalesce(detector, F.lit(NO)).alias("detector_id"),
            F.coalesce(canonical_source(F.col("source")), F.lit(NO)).alias("source"),
            F.coalesce(F.col(when).cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), F.col(column).cast("double").alias("value"),
        )

    none = F.lit(None).cast("string")
    return [
        take(image_scores, "image_scores.image_score", "image_score", F.col("detector_id"), "scored_at"),
        take(image_scores, "image_scores.bytes_per_pixel", "bytes_per_pixel", none, "scored_at"),
        take(pool_index, "pool_index.bytes_per_pixel", "bytes_per_pixel", none, "seen_at"),
    ]


KEYS = ["series", "detector_id", "source"]


def unmasked(df: DataFrame) -> DataFrame:
    for k in ("detector_id", "source"):
        df = df.withColumn(k, F.when(F.col(k) != NO, F.col(k)))
    return df


def all_day_summaries(image_scores: DataFrame, pool_index: DataFrame, scratch: Scratch) -> DataFrame:
    """Day summaries of the three columns."""
    out = None
    for v in series(image_scores, pool_index):
        d = day_summaries(v, KEYS, scratch)
        out = d if out is None else out.union(d)
    return out


def all_percentiles(image_scores: DataFrame, pool_index: DataFrame, scratch: Scratch) -> DataFrame:
    """Certified percentiles of the three columns, from their day summaries. Empty tables give no rows."""
    out = None
    for v in series(image_scores, pool_index):
        p = certified_percentiles(v, KEYS, day_summaries(v, KEYS, scratch), scratch)
        out = p if out is None else out.union(p)
    return unmasked(out)
