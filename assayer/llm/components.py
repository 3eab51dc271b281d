"""Connected components of an edge table, without ever gathering a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import Scratch

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each node of the edge table; comp is the smallest node of its component.

    Alternates the large-star and small-star steps: each node's larger neighbours are hung on its
    smallest neighbour, then its smaller neighbours and itself are. The table of edges never grows,
    the number of rounds is logarithmic, and hubs are only ever aggregated (a minimum), joined back
    on a key that adaptive execution may split. Null ends and loops are ignored; an empty edge table
    gives an empty result.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    cur = scratch.write(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = _mark(cur)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (
            hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        nxt = scratch.write(small, "edges")
        scratch.drop(cur)
        cur, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
