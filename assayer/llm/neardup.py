"""Problem 4: groups of pool rows that show one picture, by fingerprint or by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import connected_components
from assayer.llm.hamming import fingerprint, near_pairs
from assayer.llm.names import MIN_WORDS, name_words, similar_links
from assayer.session import Scratch

ERRORS, SHARED = 6, 0.6


def picture_groups(pool: DataFrame, scratch: Scratch, errors: int = ERRORS, shared: float = SHARED) -> DataFrame:
    """(pool_id, group_id, group_size) of every row; group_id is the least pool_id of the group.

    Fingerprints: each distinct one is put into shards that any near pair must share, and each shard is searched
    by vantage-point trees (hamming.near_pairs). Names: a prefix join on distinct word sets
    (names.similar_links). Equal fingerprints and equal word sets are one node, known by its least pool_id, so
    copies cost nothing; a row that has both ties its two nodes together. Invalid fingerprints and names of fewer
    than four words tie nothing. An empty table gives an empty result.
    """
    rows = pool.select("pool_id", fingerprint(F.col("phash")).alias("fp"), name_words(F.col("location")).alias("words"))
    rows = rows.withColumn("words", F.when(F.size("words") >= MIN_WORDS, F.col("words")))
    rows = rows.withColumn("name", F.unhex(F.md5(F.array_join("words", " "))))
    rows = scratch.write(rows, "rows")
    fps = scratch.write(rows.where("fp is not null").groupBy("fp").agg(F.min("pool_id").alias("fid")), "fps")
    sets = rows.where("name is not null").groupBy("name").agg(F.min("pool_id").alias("nid"), F.first("words").alias("words"))
    sets = scratch.write(sets, "sets")
    near = near_pairs(fps.select("fp"), errors, scratch, links=True)
    by_print = (
        near.join(fps.select(F.col("fp").alias("fa"), F.col("fid").alias("a")), "fa")
        .join(fps.select(F.col("fp").alias("fb"), F.col("fid").alias("b")), "fb").select("a", "b")
    )
    by_name = similar_links(sets.select(F.col("nid").alias("id"), "words"), shared, scratch)
    rows = rows.select("pool_id", "fp", "name").join(fps, "fp", "left").join(sets.select("name", "nid"), "name", "left")
    rows = scratch.write(rows.select("pool_id", "fid", "nid", F.coalesce("fid", "nid", "pool_id").alias("node")), "nodes")
    both = rows.where("fid <> nid").select(F.col("fid").alias("a"), F.col("nid").alias("b"))
    comp = connected_components(by_print.union(by_name).union(both), scratch)
    placed = rows.join(comp, "node", "left").select("pool_id", F.coalesce("comp", "node").alias("group_id"))
    placed = scratch.write(placed, "placed")
    sizes = placed.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return placed.join(sizes, "group_id").select("pool_id", "group_id", "group_size")
