"""Word sets of file names and the pairs of them that share most words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shards import FIRST, WHOLE, sorted_groups
from assayer.session import Scratch

MIN_WORDS = 4
#: Sets up to this size are joined on pairs of words, larger ones (paired with any) on single words.
SMALL = 16
#: Sets of a shard that are compared with each other; larger shards are cut up by one more word.
SHARD = 64
#: Words in more than this share of the sets come last in the order of words; there are at most
#: (mean set size) / HEAVY_SHARE of them, which is what the driver collects.
HEAVY_SHARE = 0.005


def name_words(location: Column) -> Column:
    """Sorted distinct words (runs of a-z, case aside) of the file name without its last extension; null has none."""
    name = F.regexp_extract(F.coalesce(location, F.lit("")), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(stem, F.lit(r"([A-Za-z]+)")), F.lower)))


def word_sets(rows: DataFrame, id_col: str, location: str) -> DataFrame:
    """(id, words) of the rows whose name has at least four words."""
    return rows.select(F.col(id_col).alias("id"), name_words(F.col(location)).alias("words")).where(F.size("words") >= MIN_WORDS)


def _keep(n: Column, threshold: float) -> Column:
    """Least number of shared words of a set of n words with any set that is similar enough."""
    return F.ceil(n * threshold - 1e-9)


def similar_links(sets: DataFrame, threshold: float, scratch: Scratch, limit: int = SHARD) -> DataFrame:
    """(a, b): links between word sets whose shared words are at least `threshold` of all their words, enough of
    them that everything connected by such pairs is connected by the links.

    sets has one row for each distinct set (id, words). Prefix filter: in one order of all words, rare before
    frequent, the m-th word that two similar sets share is among the first n - keep + m words of each, so pairs of
    those words are the shards (single words where a set has more than SMALL). Shards up to `limit` sets are compared
    outright, by a bitmap of the words first. In a larger shard of sets that share m words, every set that can't but
    be similar to the smallest one is linked to it, which connects all pairs whose sizes alone make them similar; for the
    others the shard is cut up by one more shared word, in the next round. So no shard gives all its pairs, and the
    rounds end with the largest set's size. Links are verified word by word at the end. The threshold must be above
    one half, so that similar sets share two words or more.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be above 0.5")
    spark = sets.sparkSession
    n_sets = sets.count()
    words = sets.select(F.explode("words").alias("w")).groupBy("w").count()
    heavy = [r["w"] for r in words.where(F.col("count") > max(2.0, HEAVY_SHARE * n_sets)).select("w").collect()] if n_sets else []
    table = F.broadcast(spark.createDataFrame([(heavy,)], "heavy array<string>"))
    rank = lambda w: F.struct(F.array_contains("heavy", w).alias("h"), F.xxhash64(w).alias("x"), w.alias("w"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int"))
    ordered = sets.crossJoin(table).select("id", F.transform(F.array_sort(F.transform("words", rank)), lambda s: s["x"]).alias("o"), F.size("words").alias("n"))
    ordered = scratch.write(ordered.select(
        "id", "o", "n", (F.col("n") - _keep(F.col("n"), threshold)).cast("int").alias("spare"),
        F.aggregate("o", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x))).alias("bits"),
    ), "ordered")
    # a shard's row: its key, how many words it stands for, the place of the last of them, the set's size and bitmap
    first = ordered.select("id", "o", "n", "spare", "bits", F.posexplode(F.slice("o", 1, F.least(F.col("n"), F.col("spare") + 2))).alias("i", "x"))
    ahead = F.least(F.col("n"), F.col("spare") + 2) - F.col("i") - 1
    rows = first.where(F.col("n") <= SMALL).select("id", "n", "bits", "x", F.col("i"), F.posexplode(F.slice("o", F.col("i") + 2, ahead)).alias("j", "y"))
    rows = rows.select(F.xxhash64(F.lit(2), "x", "y").alias("key"), "id", "bits", _meta(F.lit(2), F.col("i") + F.col("j") + 1, F.col("n")))
    if ordered.where(F.col("n") > SMALL).limit(1).count():
        single = ordered.where(F.col("n") >= F.lit(int(SMALL * threshold))).select("id", "n", "bits", F.posexplode(F.slice("o", 1, F.col("spare") + 1)).alias("i", "x"))
        single = single.select(F.xxhash64(F.lit(1), "x").alias("key"), "id", "bits", _meta(F.lit(1), F.col("i"), F.col("n")), "n")
        # shards without a large set have nothing to add to the pairs of words
        rows = rows.unionByName(single.join(single.where(F.col("n") > SMALL).select("key").distinct(), "key", "left_semi").drop("n"))
    search, out = _searcher(threshold, limit), None
    while True:
        got = rows.select("key", "id", "bits", "meta").repartition("key").sortWithinPartitions("key", F.col("meta").bitwiseAND(MASK), "id")
        got = scratch.write(got.mapInArrow(search, "a bigint, b bigint, key bigint, meta bigint"), "links")
        found = got.where("key is null").select("a", "b")
        out = found if out is None else out.union(found)
        hot = got.where("key is not null").select("key", F.col("a").alias("id"), F.shiftright("meta", 40).cast("int").alias("m"), F.shiftright("meta", 20).bitwiseAND(MASK).cast("int").alias("at"))
        if not hot.limit(1).count():
            break
        more = F.least(F.col("n"), F.col("spare") + F.col("m") + 1) - F.col("at") - 1
        rows = hot.join(ordered, "id").select("key", "id", "bits", "m", "at", "n", F.posexplode(F.slice("o", F.col("at") + 2, F.greatest(more, F.lit(0)))).alias("j", "y"))
        rows = rows.select(F.xxhash64(F.col("m") + 1, "key", "y").alias("key"), "id", "bits", _meta(F.col("m") + 1, F.col("at") + F.col("j") + 1, F.col("n")))
    body = sets.select("id", "words")
    shared = F.size(F.array_intersect("wa", "wb"))
    alike = shared >= _keep(F.size("wa") + F.size("wb") - shared, threshold)
    pairs = out.distinct().join(body.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    return pairs.join(body.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").where(alike).select("a", "b")


MASK = (1 << 20) - 1


def _meta(m: Column, at: Column, n: Column) -> Column:
    """Number of shared words, place of the last one and size of a set, twenty bits each."""
    big = lambda c: c.cast("bigint")
    return F.shiftleft(big(m), 40).bitwiseOR(F.shiftleft(big(F.least(at, F.lit(MASK))), 20)).bitwiseOR(big(F.least(n, F.lit(MASK)))).alias("meta")


def _searcher(threshold: float, limit: int):
    """Links (a, b) of a partition sorted by shard and set size, and the rows (a, key, meta) of shards to be cut up."""
    share = threshold / (1 + threshold)

    def search(batches):
        import pyarrow as pa

        def batch(a, b, key=None, meta=None):
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([none if c is None else pa.array(c) for c in (a, b, key, meta)], names=["a", "b", "key", "meta"])

        head = None
        for kind, t in sorted_groups(batches, "key", limit):
            key, ids, meta = t["key"], t["id"], t["meta"]
            n = meta & MASK
            if kind != WHOLE:
                if kind == FIRST:
                    head = (ids[0], n[0])
                # sets of these sizes that share m words are similar, whatever their other words
                sure = (n + head[1] <= np.floor((meta >> 40) / share + 1e-9)) & (ids != head[0])
                if sure.any():
                    yield batch(np.full(sure.sum(), head[0]), ids[sure])
                yield batch(ids, None, key, meta)
                continue
            bits = t["bits"].view(np.uint64)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            several = np.repeat(np.diff(np.concatenate((start, [len(key)]))) > 1, np.diff(np.concatenate((start, [len(key)]))))
            key, ids, n, bits = key[several], ids[several], n[several], bits[several]
            pairs = []
            for step in range(1, limit):
                i = np.flatnonzero(key[:-step] == key[step:])
                if not len(i):
                    break
                need = np.ceil(share * (n[i] + n[i + step]) - 1e-9)
                lost = np.bitwise_count(bits[i] & ~bits[i + step]), np.bitwise_count(bits[i + step] & ~bits[i])
                i = i[(n[i] - lost[0] >= need) & (n[i + step] - lost[1] >= need)]
                pairs.append(np.stack((np.minimum(ids[i], ids[i + step]), np.maximum(ids[i], ids[i + step])), axis=1))
            if pairs and sum(map(len, pairs)):
                p = np.unique(np.concatenate(pairs), axis=0)
                yield batch(np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1]))

    return search
