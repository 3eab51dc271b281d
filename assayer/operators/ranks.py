"""Exact order statistics and percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.session import Scratch

#: Value ranges that a group is cut into, and how many of them a first look tells apart.
BUCKETS, COARSE = 256, 16


def _cuts(value: str) -> Column:
    """The ends of a group's value ranges, from a mergeable sketch; as many in sparse groups, some of them equal."""
    return F.percentile_approx(value, F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(4 * BUCKETS))


def _bucket(cuts: str, v: str) -> Column:
    """The number of cuts below v, found in two steps of COARSE comparisons."""
    below = lambda c: c < F.col(v)
    ends = F.transform(F.sequence(F.lit(COARSE), F.lit(BUCKETS - 1), F.lit(COARSE)), lambda i: F.get(cuts, i - 1))
    first = F.size(F.filter(ends, below)) * COARSE
    return first + F.size(F.filter(F.slice(cuts, first + 1, F.lit(COARSE)), below))


def kth_values(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(keys, n, k, y): for each group the k-th smallest value, for each rank k that `ranks` makes of the column n.

    No group is sorted as a whole. A mergeable sketch cuts each group into value ranges, the ranges are counted,
    and only the range that holds a wanted rank is ranked, after equal values are counted together. The sketch
    decides how even the ranges are, never the result. Ranks outside 1..n give no row. Keys must not be null.
    """
    rows = df.select(*keys, F.col(value).alias("_v"))
    if not keys:
        rows, keys, bare = rows.withColumn("_all", F.lit(1)), ["_all"], True
    else:
        bare = False
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), _cuts("_v").alias("_cuts"))
    tagged = rows.join(stats.select(*keys, "_cuts"), keys).select(*keys, "_v", _bucket("_cuts", "_v").alias("_b"))
    counts = tagged.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    wanted = stats.select(*keys, "n", F.explode(F.array_distinct(F.array(*[r.cast("bigint") for r in ranks(F.col("n"))]))).alias("k"))
    target = wanted.join(counts, keys).where("k > _before and k <= _before + _c").select(*keys, "_b", "n", "k", (F.col("k") - F.col("_before")).alias("_rest"))
    inner = tagged.join(target.select(*keys, "_b").distinct(), [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = inner.withColumn("_upto", upto).join(target, [*keys, "_b"]).where("_rest <= _upto and _rest > _upto - _c")
    return found.select(*([] if bare else keys), "n", "k", F.col("_v").alias("y"))


def kth_without(df: DataFrame, keys: list[str], part: list[str], value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """(keys, part, n, y): for each part of a key the rank-th smallest value of all other parts' rows, n of them.

    Counts by value range are taken once for the key and once for each part; the difference names the range that holds
    the rank, and only the rows of that range meet the part. Parts that are alone in their key have no row.
    """
    rows = df.select(*keys, *part, F.col(value).alias("_v"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("_n"), _cuts("_v").alias("_cuts"))
    tagged = rows.join(stats.select(*keys, "_cuts"), keys).select(*keys, *part, "_v", _bucket("_cuts", "_v").alias("_b"))
    own = tagged.groupBy(*keys, *part, "_b").agg(F.count("*").alias("_c"))
    every = own.groupBy(*keys, "_b").agg(F.sum("_c").alias("_all"))
    parts = own.groupBy(*keys, *part).agg(F.sum("_c").alias("_size")).join(stats.select(*keys, "_n"), keys)
    parts = parts.select(*keys, *part, (F.col("_n") - F.col("_size")).alias("n")).where("n > 0").withColumn("_k", rank(F.col("n")).cast("bigint"))
    grid = parts.join(every, keys).join(own, [*keys, *part, "_b"], "left").withColumn("_rest", F.col("_all") - F.coalesce("_c", F.lit(0)))
    before = F.sum("_rest").over(W.partitionBy(*keys, *part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    target = grid.withColumn("_before", F.coalesce(before, F.lit(0))).where("_k > _before and _k <= _before + _rest")
    target = target.select(*[F.col(p).alias(f"_h_{p}") for p in part], *keys, "_b", "n", (F.col("_k") - F.col("_before")).alias("_want"))
    counted = tagged.groupBy(*keys, *part, "_b", "_v").agg(F.count("*").alias("_c")).join(target, [*keys, "_b"])
    other = F.lit(False)
    for p in part:
        other |= F.col(p) != F.col(f"_h_{p}")
    held = [f"_h_{p}" for p in part]
    inner = counted.where(other).groupBy(*keys, *held, "n", "_want", "_v").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys, *held).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = inner.withColumn("_upto", upto).where("_want <= _upto and _want > _upto - _c")
    return found.select(*keys, *[F.col(f"_h_{p}").alias(p) for p in part], "n", F.col("_v").alias("y"))


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(keys, n, one column for each name in ps): linear percentiles, exact, of the non-null values."""
    rows = df.where(F.col(value).isNotNull())
    lo = lambda n, p: F.floor(F.lit(p) * (n - 1)) + 1
    hi = lambda n, p: F.ceil(F.lit(p) * (n - 1)) + 1
    got = kth_values(rows, keys, value, lambda n: [f(n, p) for p in ps.values() for f in (lo, hi)])
    cols = []
    for name, p in ps.items():
        n = F.col("n")
        a = F.max(F.when(F.col("k") == lo(n, p), F.col("y").cast("double")))
        b = F.max(F.when(F.col("k") == hi(n, p), F.col("y").cast("double")))
        w = F.max(F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1)))
        cols.append((a + (b - a) * w).alias(name))
    return got.groupBy(*keys, "n").agg(*cols)


def floor_percentile_rank(n: Column, q: float) -> Column:
    """Nearest-rank-floor percentile: position min(n-1, int(q/100*n)) of the sorted values, from 1."""
    return F.least(n - 1, F.floor(F.lit(q / 100) * n)) + 1


def running(counted: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """counted with `before_<w>` for each weight: its sum over the rows of the key with a smaller value.

    counted has one row for each (keys, value); values and keys must not be null. A key is cut into value ranges by a sketch,
    ranges are summed, and sums run only inside of a range, so no key is sorted as a whole.
    """
    rows = counted.withColumn("_v", F.col(value))
    stats = rows.groupBy(*keys).agg(_cuts("_v").alias("_cuts"))
    tagged = rows.join(stats, keys).withColumn("_b", _bucket("_cuts", "_v")).drop("_cuts", "_v")
    order = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = tagged.groupBy(*keys, "_b").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    sums = sums.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{w}").over(order), F.lit(0)).alias(f"_o_{w}") for w in weights])
    inner = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = tagged.join(sums, [*keys, "_b"])
    return out.select(*counted.columns, *[(F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0))).alias(f"before_{w}") for w in weights])


def positions(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch, name: str = "place") -> DataFrame:
    """df with the place of each row in its key, from 0, in the given order, and the key's number of rows `<name>_n`.

    One range shuffle over keys and order puts all rows in line, however uneven the keys; a row's place in its
    partition and the sizes of the partitions before give its place. Nulls sort first; equal rows keep any order.
    """
    cols = [c for c in df.columns]
    line = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    line = scratch.write(line.withColumn("_at", F.monotonically_increasing_id()), "in-line")
    part = F.shiftright("_at", 33).alias("_part")
    counts = line.groupBy(*keys, part).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    w = W.partitionBy(*keys)
    before = F.sum("_c").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(w).alias(f"{name}_n"))
    on = F.shiftright("_at", 33) == F.col("_part")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return line.join(counts, on).select(*cols, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name), f"{name}_n")


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, n_neg, n_pos, auc): area under the ROC curve, ties count half; null without both classes.

    Scores are counted together first, so the running sums see one row for each distinct score. Scores must be
    finite and keys not null.
    """
    s = df.groupBy(*keys, score).agg(
        F.sum(F.col(positive).cast("bigint")).alias("_p"), F.sum(1 - F.col(positive).cast("bigint")).alias("_q")
    )
    s = running(s, keys, score, ["_q"]).withColumn("_u", F.col("_p") * (F.col("before__q") + F.col("_q") / F.lit(2.0)))
    out = s.groupBy(*keys).agg(F.sum("_q").alias("n_neg"), F.sum("_p").alias("n_pos"), F.sum("_u").alias("_u"))
    return out.select(*keys, "n_neg", "n_pos", F.when((F.col("n_neg") > 0) & (F.col("n_pos") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))
