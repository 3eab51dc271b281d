"""Pool building: audits, contamination joins, de-duplication, balancing, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.scalars import band_of
from assayer.functions.text import canonical_source, finite
from assayer.operators.ranks import floor_percentile_rank, kth_values, percentiles, positions, running
from assayer.session import Scratch

SIDE_EDGES = [0.0, 256.0, 512.0, 1024.0, 2048.0]
BPP_EDGES = [0.0, 0.15, 0.3, 0.6, 1.2]


def hex_print(col: Column) -> Column:
    """The fingerprint as 16 lower-case hex digits; null if malformed or a constant."""
    h = F.lower(F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*(?:0[xX])?([0-9a-fA-F]{16})\s*$", 1))
    return F.when((h != "") & (h != "0" * 16) & (h != "f" * 16), h)


def index(pool: DataFrame) -> DataFrame:
    """The pool with canonical source, valid fingerprint, longest side, finite ratio and the two bands."""
    p = pool.withColumn("source", canonical_source(F.col("source"))).withColumn("print", hex_print(F.col("phash")))
    p = p.withColumn("side", F.greatest("w", "h")).withColumn("ratio", F.when(finite(F.col("bytes_per_pixel")), F.col("bytes_per_pixel")))
    return p.withColumn("side_band", band_of(F.col("side"), SIDE_EDGES)).withColumn("ratio_band", band_of(F.col("ratio"), BPP_EDGES))


def first_by_hash(df: DataFrame, keys: list[str], id_col: str, take: DataFrame, seed: int = 42) -> DataFrame:
    """The first `take` rows of each key by SHA-256 of "seed:id"; take has the keys and a column `take`.

    The cut is an order statistic of 60 bits of the digest, so no key's rows are sorted as a whole.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    rows = df.withColumn("_h", h).join(take, keys).where("take > 0")
    cut = kth_values(rows, [*keys, "take"], "_h", lambda n: [F.least(n, F.col("take"))])
    return rows.join(cut.select(*keys, F.col("y").alias("_cut")), keys).where("_h <= _cut").drop("_h", "_cut", "take")


def audit(pool: DataFrame) -> DataFrame:
    """(label, n, square_pct, median_side, mean_ratio, formats) of each class; formats are the three most frequent."""
    base = pool.where("label is not null").groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("square") * 100, 6).alias("square_pct"), F.round(F.avg("ratio"), 8).alias("mean_ratio")
    )
    med = percentiles(pool.where("label is not null"), ["label"], "side", {"median_side": 0.5}).select("label", "median_side")
    fmt = pool.where("label is not null and fmt is not null").groupBy("label", "fmt").agg(F.count("*").alias("c"))
    top = fmt.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("c"), "fmt"))).where("r <= 3")
    top = top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "fmt"))), lambda s: s["fmt"]), ",").alias("formats"))
    return base.join(med, "label", "left").join(top, "label", "left")


def extended_audit(pool: DataFrame) -> DataFrame:
    """(label, n, distinct_sizes, p10, median, p90, ...) with percentiles cut to whole numbers."""
    rows = pool.where("label is not null and side is not null")
    base = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("w", "h").alias("distinct_sizes"), F.count_distinct("fmt").alias("distinct_formats"))
    ps = percentiles(rows, ["label"], "side", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return base.join(ps.select("label", *[F.floor(c).cast("bigint").alias(c) for c in ("p10", "median", "p90")]), "label")


def whole_audit(pool: DataFrame) -> DataFrame:
    """extended_audit with (top_sizes, square_pct, mean_bpp, formats): the three most frequent sizes with their counts
    (equal counts by size), the share of square pictures, mean bytes per pixel, and all formats, `?` where unknown."""
    rows = pool.where("label is not null and side is not null")
    more = rows.groupBy("label").agg(
        F.round(F.avg(F.when(F.col("w") == F.col("h"), 100.0).otherwise(0.0)), 1).alias("square_pct"), F.round(F.avg("ratio"), 3).alias("mean_bpp"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("fmt", F.lit("?")))), ",").alias("formats"),
    )
    sizes = rows.where("w is not null and h is not null").groupBy("label", "w", "h").agg(F.count("*").alias("c"))
    top = sizes.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("c"), "w", "h"))).where("r <= 3")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w", "h", "c"))), lambda s: F.concat(s["w"], F.lit("x"), s["h"], F.lit("("), s["c"], F.lit(")"))), ", ")
    return extended_audit(pool).join(more, "label").join(top.groupBy("label").agg(text.alias("top_sizes")), "label", "left")


def audit_problems(pool: DataFrame) -> DataFrame:
    """One row: the problems of an audit. With fewer than two classes only single_class can be true; the ranges are
    those of the two least labels, and they are apart where p10 to p90 don't overlap."""
    a = whole_audit(pool)
    ratio = lambda c, least: F.max(c) / F.greatest(F.min(c), F.lit(least))
    span = F.array_sort(F.collect_list(F.struct("label", "p10", "p90")))
    one = a.agg(
        F.count("*").alias("classes"), span.alias("s"), ((F.max(F.instr("formats", ",")) == 0) & (F.count_distinct("formats") > 1)).alias("format_trap"),
        ((F.max("square_pct") - F.min("square_pct")) > 60).alias("square_gap"), (ratio("median", 1) >= 2.0).alias("side_gap"),
        (ratio("mean_bpp", 0.001) > 3).alias("bpp_gap"), (ratio("n", 1) > 3).alias("imbalance"),
    )
    x, y = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    one = one.withColumn("ranges_apart", (x["p10"] > y["p90"]) | (y["p10"] > x["p90"]))
    names = ("format_trap", "square_gap", "side_gap", "ranges_apart", "bpp_gap", "imbalance")
    return one.select("classes", (F.col("classes") < 2).alias("single_class"), *[F.when(F.col("classes") < 2, False).otherwise(F.col(c)).alias(c) for c in names])


def shortcut_rules(pool: DataFrame) -> DataFrame:
    """One row: can the class be told from the format, shape, size, compression or count alone?

    Only two classes are compared; with any other number no rule holds. Formats give a class away where each class has
    exactly one and they differ.
    """
    rows = pool.where("label is not null")
    a = rows.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("square") * 100, 1).alias("square"), F.round(F.avg("bpp"), 3).alias("bpp"),
        F.count_distinct("fmt").alias("formats"), F.min("fmt").alias("fmt"),
    )
    med = percentiles(rows, ["label"], "side", {"side": 0.5}).select("label", F.floor("side").alias("side"))
    a = a.join(med, "label", "left")
    ratio = lambda c, least: F.max(c) / F.greatest(F.min(c), F.lit(least))
    two = F.count("*") == 2
    flag = lambda c: F.coalesce(two & c, F.lit(False))
    return a.agg(
        F.count("*").alias("classes"), flag((F.max("formats") == 1) & (F.min("formats") == 1) & (F.min("fmt") != F.max("fmt"))).alias("format_disjoint"),
        flag(F.max("square") - F.min("square") > 60).alias("square_gap"), flag(ratio("side", 1) > 2.5).alias("side_gap"),
        flag(ratio("bpp", 1e-3) > 3).alias("ratio_gap"), flag(ratio("n", 1) > 1.5).alias("imbalance"),
    )


def profile(pool: DataFrame) -> DataFrame:
    """(label, n, p10, median, p90) of the longest side: nearest-rank-floor percentiles, the true median."""
    rows = pool.where("label is not null and side is not null")
    k10, k90 = floor_percentile_rank(F.col("n"), 10), floor_percentile_rank(F.col("n"), 90)
    got = kth_values(rows, ["label"], "side", lambda n: [floor_percentile_rank(n, 10), floor_percentile_rank(n, 90)])
    ends = got.groupBy("label", "n").agg(F.max(F.when(F.col("k") == k10, F.col("y"))).alias("p10"), F.max(F.when(F.col("k") == k90, F.col("y"))).alias("p90"))
    return ends.join(percentiles(rows, ["label"], "side", {"median": 0.5}).select("label", "median"), "label")


def class_gap(pool: DataFrame) -> DataFrame:
    """(gap, risk): ratio of the median longest sides of the classes 0 and 1, infinite where one is missing or zero;
    above 2 the size may give the class away."""
    med = profile(pool.where("label in (0, 1)")).agg(F.count("*").alias("c"), F.max("median").alias("hi"), F.min("median").alias("lo"))
    gap = F.when((F.col("c") == 2) & (F.col("lo") > 0), F.try_divide("hi", "lo")).otherwise(F.lit(float("inf")))
    return med.select(F.round(gap, 9).alias("gap"), (gap > 2.0).alias("risk"))


CELL = ["side_band", "ratio_band"]


def cells(pool: DataFrame) -> DataFrame:
    return pool.where("label in (0, 1) and side_band is not null and ratio_band is not null")


def balance_report(pool: DataFrame) -> DataFrame:
    """(cell, n_real, n_ai, take): how many of each class every cell can give."""
    g = cells(pool).groupBy(*CELL).agg(F.count(F.when(F.col("label") == 0, 1)).alias("n_real"), F.count(F.when(F.col("label") == 1, 1)).alias("n_ai"))
    return g.withColumn("take", F.least("n_real", "n_ai"))


def balanced(pool: DataFrame, seed: int = 42) -> DataFrame:
    """The same number of each class from every cell, chosen by hash order."""
    take = balance_report(pool).select(*CELL, "take")
    both = take.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).select(*CELL, "label", "take")
    return first_by_hash(cells(pool), [*CELL, "label"], "pool_id", both, seed)


def first_wins(pool: DataFrame) -> DataFrame:
    """(print, pool_id): the earliest row of each fingerprint."""
    return pool.where("print is not null").groupBy("print").agg(F.min("pool_id").alias("pool_id"))


def last_wins(pool: DataFrame) -> DataFrame:
    """(print, label): what a dictionary filled in row order would hold."""
    return pool.where("print is not null").groupBy("print").agg(F.max_by("label", "pool_id").alias("label"))


def duplicate_count(pool: DataFrame) -> DataFrame:
    return pool.where("print is not null and source is not null").groupBy("source").agg((F.count("*") - F.count_distinct("print")).alias("duplicates"))


def refresh_flags(pool: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source, n, n_changed): the safety flag as the catalog has it now, and the rows where that differs.

    Unknown sources keep their own flag. The planner broadcasts the catalog if it is below its size limit.
    """
    cat = catalog.select(canonical_source(F.col("source")).alias("source"), F.col("whole_image_safe").cast("int").alias("now"))
    j = pool.join(cat, "source", "left").withColumn("new", F.coalesce("now", "whole_image_safe"))
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("new").eqNullSafe(F.col("whole_image_safe"))).alias("n_changed"))


def contamination_anti(pool: DataFrame, held: DataFrame) -> DataFrame:
    """Rows whose fingerprint isn't in the held-out set; rows without a valid one stay."""
    return pool.join(held.where("print is not null").select("print").distinct(), "print", "left_anti")


def contamination_report(pool: DataFrame, held: DataFrame) -> DataFrame:
    """(pool_id, victim): contaminated rows with the last held-out row of their fingerprint."""
    last = held.where("print is not null").groupBy("print").agg(F.max("pool_id").alias("victim"))
    return pool.join(last, "print").select("pool_id", "victim")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, n_shared, shared_pct): distinct fingerprints of two tables."""
    side = lambda df, c: df.where("print is not null").select("print").distinct().withColumn(c, F.lit(1))
    j = side(a, "a").join(side(b, "b"), "print", "full")
    out = j.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_shared"))
    return out.withColumn("shared_pct", F.round(F.try_divide(F.col("n_shared") * 100.0, F.col("n_a")), 8))


def membership_mismatch(a: DataFrame, index_: DataFrame) -> DataFrame:
    """(n_members, n_mismatch): rows found in an index by fingerprint, and those whose label differs there."""
    j = a.join(last_wins(index_).withColumnRenamed("label", "there"), "print")
    return j.agg(F.count("*").alias("n_members"), F.count_if(F.col("label") != F.col("there")).alias("n_mismatch"))


def stride(df: DataFrame, keys: list[str], order: list[str], k: int, rule: str = "linspace") -> DataFrame:
    """k rows of each key, evenly spaced in the given order: at rounded linspace places, or every (n//k)-th one."""
    rows = positions(df, keys, order, Scratch(df.sparkSession, "stride"), "_r")
    if rule == "linspace":
        places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_r_n") - 1) / F.lit(float(max(k - 1, 1)))).cast("bigint"))
        keep = (F.col("_r_n") <= k) | F.array_contains(places, F.col("_r"))
    else:
        step = F.greatest(F.lit(1), F.floor(F.col("_r_n") / k))
        keep = (F.col("_r") % step == 0) & (F.col("_r") / step < k)
    return rows.where(keep).drop("_r", "_r_n")


def cap_per_key(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first rows of each key; the planner drops the rest of each task's rows before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def holdout_size(n: Column, fraction: float) -> Column:
    return F.when(n > 1, F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))).otherwise(0)


def stratified_holdout(df: DataFrame, keys: list[str], id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    take = df.groupBy(*keys).agg(holdout_size(F.count("*"), fraction).cast("bigint").alias("take"))
    return first_by_hash(df, keys, id_col, take, seed)


def equal_per_source(df: DataFrame, id_col: str, least: int, seed: int = 42) -> DataFrame:
    """As many rows of every source as the smallest of those with at least `least` rows has."""
    n = df.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    take = n.crossJoin(n.agg(F.min("n").alias("take"))).select("source", "take")
    return first_by_hash(df, ["source"], id_col, take, seed)


def moments(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Population mean, standard deviation, skewness and (not excess) kurtosis."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(x), 7).alias("mean"), F.round(F.stddev_pop(x), 7).alias("std"), F.round(F.skewness(x), 6).alias("skew"), F.round(F.kurtosis(x) + 3, 6).alias("kurt")
    )


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; equal values are counted together before they are ranked."""
    def ranked(c: str, out: str) -> DataFrame:
        g = running(df.groupBy(*keys, c).agg(F.count("*").alias("_c")), keys, c, ["_c"])
        return g.select(*keys, c, (F.col("before__c") + (F.col("_c") + 1) / F.lit(2.0)).alias(out))

    j = df.join(ranked(x, "_rx"), [*keys, x]).join(ranked(y, "_ry"), [*keys, y])
    return j.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.corr("_rx", "_ry"), 8).alias("rho"))


def checked_label(source: Column, label_map: Column, label: Column) -> Column:
    """A source's raw label as the project's. Raises where the source has no map or the map lacks the label; a null label
    is null. Nothing is ever guessed."""
    here = lambda what: F.raise_error(F.concat(F.lit(what), F.coalesce(source, F.lit("null")), F.lit(" "), label.cast("string"))).cast("int")
    return (
        F.when(label.isNull(), None).when(label_map.isNull() | (F.size(label_map) <= 0), here("no label map: "))
        .when(~F.map_contains_key(label_map, label), here("unmapped label: ")).otherwise(F.try_element_at(label_map, label))
    )


def three_way(df: DataFrame, keys: list[str], id_col: str, test: float, validation: float, seed: int = 42) -> DataFrame:
    """df with `part`: of each key the first rows by hash are test, the next validation, the rest train; shares of
    its rows, rounded down, at least one each where the key has three rows or more."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    rows = df.withColumn("_h", h)
    size = lambda n, share: F.when(n < 3, F.floor(n * F.lit(share))).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(share))))
    t, v = size(F.col("n"), test), size(F.col("n"), validation)
    got = kth_values(rows, keys, "_h", lambda n: [size(n, test), size(n, test) + size(n, validation)])
    cuts = got.groupBy(*keys, "n").agg(F.max(F.when(F.col("k") == t, F.col("y"))).alias("_t"), F.max(F.when(F.col("k") == t + v, F.col("y"))).alias("_v"))
    part = F.when(F.col("_h") <= F.col("_t"), "test").when(F.col("_h") <= F.col("_v"), "validation").otherwise("train")
    return rows.join(cuts.drop("n"), keys, "left").withColumn("part", part).drop("_h", "_t", "_v")


def matched_ai(df: DataFrame, id_col: str, least: int, seed: int = 42) -> DataFrame:
    """Equal numbers of real rows from every source with at least `least`, and as many AI rows in all, by hash order."""
    real = equal_per_source(df.where("label = 0"), id_col, least, seed)
    n = real.agg(F.count("*").alias("take"))
    ai = df.where("label = 1").withColumn("_all", F.lit(1))
    take = n.select(F.lit(1).alias("_all"), "take")
    return real.unionByName(first_by_hash(ai, ["_all"], id_col, take, seed).drop("_all"))
