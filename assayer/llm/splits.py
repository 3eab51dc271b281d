"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.text import canonical_source
from assayer.llm.components import connected_components
from assayer.session import Scratch

#: Components larger than this share of all rows are placed first, on the driver; there can be at most 1/share of them.
HEAVY_SHARE = 0.001
#: Components that one task anneals, proposals of one annealing chain, chains of a block and rounds over all blocks.
BLOCK, STEPS, CHAINS, ROUNDS = 20_000, 160_000, 3, 2
#: Distinct strata whose numbers are sent to every task at once; beyond that they are joined by a shuffle.
MAX_STRATA = 4_096


def file_and_credit(path: Column) -> tuple[Column, Column]:
    """(file key, contributor) of a path, both null for a null path.

    The key is what follows the mount (all up to the first segment `px`), with one kind of slash, no empty
    or `.` segments, in lower case, `%20` as a blank. A folder below dataset and source whose name has three
    parts credits a contributor: the parts in lower case, sorted; they also stand for the folder in the key.
    """
    p = F.lower(F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("%20"), F.lit(" ")))
    p = F.regexp_replace(F.concat(F.lit("/"), p), r"/(?:\.?/)+", "/")
    p = F.regexp_replace(p, r"^.*?/px/", "/")
    folder = F.regexp_extract(p, r"^/[^/]+/[^/]+.*/([^/]+)/[^/]+$", 1)
    parts = F.split(F.trim(F.regexp_replace(folder, r"[^\p{L}\p{M}]+", " ")), " ")
    credit = F.when(F.size(parts) == 3, F.array_join(F.array_sort(parts), " "))
    key = F.when(credit.isNull(), p).otherwise(
        F.concat(F.regexp_extract(p, r"^(.*/)[^/]+/[^/]+$", 1), credit, F.lit("/"), F.substring_index(p, "/", -1))
    )
    return key, credit


def _id(kind: str, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(kind), text)))


def tie_groups(records: DataFrame, scratch: Scratch, carry: list[Column] | None = None) -> DataFrame:
    """(score_id, group_id, group_size, carried columns) of every record; group_id is the group's least score_id.

    Each record belongs to one node at once, the contributor its path credits or else the file it names, so
    most ties need no edge. Edges come only from orig_path: to the node of the named file where the table has
    that file, else to a node of its own, which ties the copies of a missing original. Nodes are then known by
    their least score_id. A hot contributor or original is only ever aggregated, or joined on a key that
    adaptive execution may split. A null path ties its record to nothing but its orig_path; ids must be
    unique. An empty table gives an empty result.
    """
    key, credit = file_and_credit(F.col("path"))
    okey, ocredit = file_and_credit(F.col("orig_path"))
    rows = records.select("score_id", "path", "orig_path", *(carry or []))
    extra = rows.columns[3:]
    rows = (
        rows.withColumn("_k", key).withColumn("_c", credit).withColumn("_ok", okey).withColumn("_oc", ocredit)
        .select(
            "score_id",
            F.coalesce(_id("c", F.col("_c")), _id("f", F.col("_k")), _id("r", F.col("score_id").cast("string"))).alias("node"),
            _id("f", F.col("_k")).alias("fkey"), _id("f", F.col("_ok")).alias("okey"),
            F.coalesce(_id("c", F.col("_oc")), _id("f", F.col("_ok"))).alias("onode"), *extra,
        )
        .withColumn("okey", F.when(F.col("okey").eqNullSafe(F.col("fkey")), None).otherwise(F.col("okey")))
    )
    rows = scratch.write(rows, "records")
    nodes = scratch.write(rows.groupBy("node").agg(F.min("score_id").alias("rep"), F.count("*").alias("n")), "nodes")
    links = rows.where("okey is not null").select("node", "okey", "onode").distinct().join(nodes.select("node", "rep"), "node")
    links = scratch.write(links.select("rep", "okey", "onode"), "links")
    named = links.groupBy("okey").agg(F.first("onode").alias("onode"), F.min("rep").alias("least"))
    there = named.join(rows.select(F.col("fkey").alias("okey")), "okey", "left_semi").join(
        nodes.select(F.col("node").alias("onode"), F.col("rep").alias("orep")), "onode"
    ).select("okey", "orep")
    target = named.join(there, "okey", "left").select("okey", F.coalesce("orep", "least").alias("target"))
    edges = links.join(target, "okey").select(F.col("rep").alias("a"), F.col("target").alias("b"))
    comp = connected_components(edges, scratch)
    placed = nodes.join(comp, nodes["rep"] == comp["node"], "left").select(nodes["node"], F.coalesce("comp", "rep").alias("group_id"), "n")
    sizes = placed.groupBy("group_id").agg(F.sum("n").alias("group_size"))
    placed = placed.join(sizes, "group_id").select("node", "group_id", "group_size")
    return rows.join(placed, "node").select("score_id", "group_id", "group_size", *extra)


def _anneal(ids, start, comp, strat, num, goal, seed, chain, steps=STEPS, whole=None):
    """(cost, state) that one annealing chain ends with: the best state it saw.

    comp, strat, num: the profile in coordinates; goal: strata x splits; whole: the goal of all strata together, if it isn't their sum. Cost is the sum of squared
    deviations relative to the goal, by stratum and, with as much weight as all strata, for the totals. A move puts one component into
    another split, an exchange swaps two; both cost only the strata they touch.
    """
    k = goal.shape[1]
    order = np.argsort(comp, kind="stable")
    comp, strat, num = comp[order], strat[order], num[order]
    edge = np.searchsorted(comp, np.arange(len(ids) + 1))
    prof = [list(zip(strat[i:j].tolist(), num[i:j].tolist(), strict=True)) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    size = [sum(n for _, n in p) for p in prof]
    inv = 1.0 / np.maximum(goal, 1.0)
    whole = goal.sum(0) if whole is None else whole
    total_inv = len(goal) / np.maximum(whole, 1.0)
    rng = np.random.default_rng([seed, chain])
    at = list(start)
    dev = -goal.copy()
    for c, p in enumerate(prof):
        for s, n in p:
            dev[s, at[c]] += n
    tot = dev.sum(0) + goal.sum(0) - whole
    w, t, d, ti = inv.tolist(), tot.tolist(), dev.tolist(), total_inv.tolist()
    cost = float((dev * dev * inv).sum() + (tot * tot * total_inv).sum())
    least, since = cost, []  # moves since the best state, to be taken back at the end

    def delta(c, to):
        o, z, out = at[c], size[c], 0.0
        for s, n in prof[c]:
            r, q = d[s], w[s]
            out += q[to] * n * (2 * r[to] + n) + q[o] * n * (n - 2 * r[o])
        return out + ti[to] * z * (2 * t[to] + z) + ti[o] * z * (z - 2 * t[o])

    def put(c, to):
        o = at[c]
        for s, n in prof[c]:
            d[s][to] += n
            d[s][o] -= n
        t[to] += size[c]
        t[o] -= size[c]
        at[c] = to
        since.append((c, o))

    picks, others, tos, dice = rng.integers(len(ids), size=steps).tolist(), rng.integers(len(ids), size=steps).tolist(), rng.integers(1, max(k, 2), size=steps).tolist(), rng.random(steps).tolist()
    heat = max(cost / max(len(ids), 1), 1e-9)
    for i in range(steps):
        c, temp = picks[i], heat * (1 - i / steps) ** 2 + 1e-12
        if k > 1 and i % 3:
            to = (at[c] + tos[i]) % k
            x = delta(c, to)
            if x <= 0 or dice[i] < exp(-x / temp):
                put(c, to)
                cost += x
        elif at[o := others[i]] != at[c]:
            here, there = at[c], at[o]
            x = delta(c, there)
            put(c, there)
            x += delta(o, here)
            if x <= 0 or dice[i] < exp(-x / temp):
                put(o, here)
                cost += x
            else:
                put(c, here)
        if cost < least - 1e-9:
            least = cost
            since.clear()
    for c, o in reversed(since):
        at[c] = o
    return least, at


def _start(ids: np.ndarray, shares: np.ndarray, seed: int) -> list[int]:
    """Hashed assignment: the same component starts in the same split, whatever else is there."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.searchsorted(np.cumsum(shares)[:-1], (h >> np.uint64(11)).astype(float) / 2.0**53, side="right").tolist()


def assign_splits(records: DataFrame, proportions: dict[str, float] | None = None, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """(score_id, group_id, group_size, split): whole groups, in the given proportions within each source and label.

    Component swap search: a hashed start, then moves and exchanges of whole components by annealing.
    Components above a thousandth of all rows, of which there are at most a thousand, are placed first on
    the driver; what they leave of each stratum's goal is shared out among blocks of the other components.
    Each block is annealed by several chains, each a task of its own, and the best is kept; a second round does the same
    with other blocks, starting from what the first left. Null source or label is a stratum of
    its own. An empty table gives an empty result.
    """
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    names, shares = list(proportions), np.array(list(proportions.values()), dtype=float)
    if len(names) == 0 or (shares <= 0).any():
        raise ValueError("proportions must be positive")
    shares = shares / shares.sum()
    spark = records.sparkSession
    scratch = scratch or Scratch(spark, "splits")
    carry = [canonical_source(F.col("source")).alias("stratum_source"), F.col("label").alias("stratum_label")]
    grouped = scratch.write(tie_groups(records, scratch, carry), "grouped")
    strata = grouped.select("stratum_source", "stratum_label").distinct()
    number = (F.row_number().over(W.orderBy("stratum_source", "stratum_label")) - 1).alias("sid")
    table = scratch.write(strata.select(F.col("stratum_source").alias("ss"), F.col("stratum_label").alias("sl"), number), "strata")
    known = table.count()
    n_strata = max(known, 1)
    side = F.broadcast(table) if known <= MAX_STRATA else table
    prof = grouped.join(side, F.col("stratum_source").eqNullSafe(F.col("ss")) & F.col("stratum_label").eqNullSafe(F.col("sl")))
    prof = scratch.write(prof.groupBy("group_id", "group_size", "sid").agg(F.count("*").alias("n")), "profile")
    totals = np.zeros(n_strata)
    for r in prof.groupBy("sid").agg(F.sum("n").alias("n")).collect():
        totals[r["sid"]] = r["n"]
    rows = totals.sum()
    goal = totals[:, None] * shares[None, :]
    heavy = prof.where(F.col("group_size") > HEAVY_SHARE * rows).orderBy("group_id", "sid").toPandas()
    placed: dict[int, int] = {}
    rest, left = goal, goal.sum(0)
    if len(heavy):
        ids, comp = np.unique(heavy["group_id"].to_numpy(), return_inverse=True)
        sid, num = heavy["sid"].to_numpy(), heavy["n"].to_numpy()
        part = np.zeros(n_strata)
        np.add.at(part, sid, num)
        first = _start(ids, shares, seed)
        _, at = min((_anneal(ids, first, comp, sid, num, part[:, None] * shares[None, :], seed, chain) for chain in range(CHAINS)), key=lambda x: x[0])
        placed = dict(zip(ids.tolist(), at, strict=True))
        used = np.zeros_like(goal)
        np.add.at(used, (sid, np.array(at)[comp]), num)
        rest, left = np.maximum(goal - used, 0), np.maximum(goal.sum(0) - used.sum(0), 0)
    rate = np.divide(rest, np.maximum(rest.sum(1, keepdims=True), 1e-9), where=np.ones_like(rest, dtype=bool))
    others = prof.where(F.col("group_size") <= HEAVY_SHARE * rows)
    blocks = max(1, -(-others.select("group_id").distinct().count() // BLOCK))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_id", "sid"])
        ids, at, comp = np.unique(pdf["group_id"].to_numpy(), return_index=True, return_inverse=True)
        sid, num = pdf["sid"].to_numpy(), pdf["n"].to_numpy()
        part = np.zeros(n_strata)
        np.add.at(part, sid, num)
        used, local = np.unique(sid, return_inverse=True)
        held = pdf["part"].to_numpy()[at]
        start = held.tolist() if (held >= 0).all() else _start(ids, shares, seed)
        block, chain = int(pdf["block"].iloc[0]), int(pdf["chain"].iloc[0])
        # what the strata can't make up for among themselves, the whole of the block still can
        whole = left / max(left.sum(), 1e-9) * num.sum()
        cost, state = _anneal(ids, start, comp, local, num, (part[:, None] * rate)[used], seed + block, chain, whole=whole)
        return pd.DataFrame({"block": block, "chain": chain, "cost": cost, "group_id": ids, "part": np.array(state, dtype=np.int32)})

    done, chains = None, F.explode(F.sequence(F.lit(0), F.lit(CHAINS - 1))).alias("chain")
    for turn in range(ROUNDS):
        # other neighbours in each round, so that blocks exchange what they couldn't balance
        block = F.pmod(F.xxhash64(F.lit(turn), "group_id"), F.lit(blocks)).cast("int").alias("block")
        now = others.withColumn("part", F.lit(-1)) if done is None else others.join(done, "group_id")
        tried = now.select(block, "group_id", "sid", "n", "part", chains).groupBy("block", "chain").applyInPandas(
            run, "block int, chain int, cost double, group_id bigint, part int"
        )
        tried = scratch.write(tried, "chains")
        best = tried.groupBy("block").agg(F.min_by("chain", F.struct("cost", "chain")).alias("chain"))
        done = tried.join(best, ["block", "chain"]).select("group_id", "part")
    if placed:
        done = done.union(spark.createDataFrame(list(placed.items()), "group_id bigint, part int"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("part") + 1)
    return grouped.join(done, "group_id").select("score_id", "group_id", "group_size", name.alias("split"))


def split_report(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """(source, label, split, n_rows, share): how well each stratum's rows follow the proportions."""
    src = records.select("score_id", canonical_source(F.col("source")).alias("source"), "label")
    counted = src.join(assigned, "score_id").groupBy("source", "label", "split").agg(F.count("*").alias("n_rows"))
    whole = counted.groupBy("source", "label").agg(F.sum("n_rows").alias("n"))
    return (
        counted.alias("c").join(whole.alias("w"), F.col("c.source").eqNullSafe(F.col("w.source")) & F.col("c.label").eqNullSafe(F.col("w.label")))
        .select("c.source", "c.label", "split", "n_rows", F.round(F.col("n_rows") / F.col("n"), 6).alias("share"))
    )
