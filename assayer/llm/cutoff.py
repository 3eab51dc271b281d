"""Problem 3: for each group the score cutoff that keeps a target share of its records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.text import canonical_source, finite
from assayer.session import Scratch

MAX_ROUNDS = 200
#: Ranges of the sketch that gives the first trial points.
SKETCH = 200


def counted_scores(scores: DataFrame) -> DataFrame:
    """The rows that count: the latest scoring of each (detector_id, path), with a source and a finite score.

    Latest is by scored_at, then by the larger score_id; a null scored_at is the oldest. The key is
    shuffled as 128 bits, not as text.
    """
    key = scores.select(
        "score_id", "detector_id", "dataset", canonical_source(F.col("source")).alias("source"),
        F.col("image_score").cast("double").alias("score"), "scored_at",
        F.xxhash64("detector_id", "path").alias("_k1"), F.xxhash64(F.lit("key"), "path", "detector_id").alias("_k2"),
    )
    last = W.partitionBy("_k1", "_k2").orderBy(F.desc_nulls_last("scored_at"), F.desc("score_id"))
    return (
        key.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
        .where(F.col("source").isNotNull() & finite(F.col("score")))
        .select("score_id", "detector_id", "dataset", "source", (F.col("score") + F.lit(0.0)).alias("score"))
    )


def _trials() -> list:
    """Trial points of one round, inside [a, b): where the two cuts meet, and two more that halve the
    bracket by value and near the cut, so that a heavy tail can't stall the search. The first round tries what a sketch
    of the group gives around the rank."""
    a, b = F.col("a"), F.col("b")
    meet = (F.col("la") - F.col("lb") + F.col("gb") * b - F.col("ga") * a) / (F.col("gb") - F.col("ga"))
    mid = a / 2 + b / 2
    inside = lambda t: F.when(finite(t) & (t >= a) & (t < b), t).otherwise(a)
    cut = inside(meet)
    near = F.when(F.col("left"), cut / 2 + a / 2).otherwise(cut / 2 + b / 2)
    geo = F.signum(mid) * F.sqrt(F.abs(a)) * F.sqrt(F.abs(b))
    later = [cut, inside(F.when(F.col("round") % 2 == 0, mid).otherwise(geo)), inside(near)]
    at = lambda q: F.floor((F.col("tau") + q) * SKETCH).cast("int")
    guess = [inside(F.get("sketch", F.least(F.greatest(at(q), F.lit(0)), F.lit(SKETCH)))) for q in (0.0, -2 / SKETCH, 2 / SKETCH)]
    return [F.when(F.col("round") == 0, g).otherwise(t) for g, t in zip(guess, later, strict=True)]


def order_statistics(rows: DataFrame, keys: list[str], value: str, rank, scratch: Scratch) -> DataFrame:
    """(keys, n, rank, y) with y the rank-th smallest value of each group, exactly.

    Cutting planes on the pinball loss whose only minimiser is that value: each pass over the rows
    aggregates, at a few trial points for each group, the count and the sum of the values up to the
    point (hence loss and subgradient), and the neighbouring values on both sides. The bracket
    [a, b] always ends on values that occur, so the search ends on the exact one. State is one row
    for each group and stays in a table; the driver only sees how many groups are still open.

    A mergeable sketch gives the first trial points, so the first pass leaves a bracket of a few hundredths of the rows;
    then only the rows inside of open brackets are kept, with the count and the sum of those below, and later passes
    read those alone. The sketch decides how fast the bracket shrinks, never the result.

    rank is a function of the column n that gives a whole number from 1 to n. Groups are aggregated
    with partial sums, so a hot group costs no more than any other rows.
    """
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("a"), F.max(value).alias("b"),
        F.percentile_approx(value, F.array(*[F.lit(i / SKETCH) for i in range(SKETCH + 1)]), F.lit(4 * SKETCH)).alias("sketch"),
    )
    base = base.withColumn("rank", rank(F.col("n")).cast("bigint")).withColumn("tau", (F.col("rank") - 0.5) / F.col("n"))
    # at the least value the slope just below is -tau*n, at the largest it is (1-tau)*n just above
    state = base.select(
        *keys, "n", "rank", "tau", "total", "a", "b",
        (F.col("tau") * (F.col("total") - F.col("n") * F.col("a"))).alias("la"), (-F.col("tau") * F.col("n")).alias("ga"),
        (F.col("tau") * (F.col("total") - F.col("n") * F.col("b")) + F.col("n") * F.col("b") - F.col("total")).alias("lb"),
        ((1 - F.col("tau")) * F.col("n")).alias("gb"), F.lit(True).alias("left"), F.lit(0).alias("round"), "sketch",
        F.lit(0).cast("bigint").alias("below_n"), F.lit(0.0).alias("below_s"), F.lit(0).cast("bigint").alias("base_n"), F.lit(0.0).alias("base_s"),
    )
    state = scratch.write(state, "state")
    inside = rows.select(*keys, value)
    for turn in range(MAX_ROUNDS):
        if state.where("a < b").limit(1).count() == 0:
            break
        if turn == 1:
            kept = inside.join(state.where("a < b").select(*keys, "a", "b"), keys).where((F.col(value) >= F.col("a")) & (F.col(value) <= F.col("b")))
            inside = scratch.write(kept.select(*keys, value), "inside")
            state = state.withColumns({"base_n": F.col("below_n"), "base_s": F.col("below_s")})
        open_ = state.where("a < b")
        ts = _trials()
        tried = open_.select(*keys, *[t.alias(f"t{i}") for i, t in enumerate(ts)])
        v = F.col(value)
        aggs = []
        for i in range(len(ts)):
            at = F.col(f"t{i}")
            aggs += [
                F.count(F.when(v <= at, 1)).alias(f"c{i}"), F.sum(F.when(v <= at, v)).alias(f"s{i}"),
                F.max(F.when(v <= at, v)).alias(f"p{i}"), F.min(F.when(v > at, v)).alias(f"q{i}"),
            ]
        # one row for each group on the small side: the planner broadcasts it only below its size limit
        seen = inside.join(tried, keys).groupBy(*keys).agg(*aggs)
        st = state.join(seen, keys, "left")
        st = st.select("*", *[t.alias(f"t{i}") for i, t in enumerate(ts)])
        count = [F.col(f"c{i}") + F.col("base_n") for i in range(len(ts))]
        total = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.col("base_s") for i in range(len(ts))]
        enough = [c >= F.col("rank") for c in count]
        is_open = F.col("a") < F.col("b")
        loss = [F.col("tau") * (F.col("total") - F.col("n") * F.col(f"t{i}")) + count[i] * F.col(f"t{i}") - total[i] for i in range(len(ts))]
        slope = [count[i] - F.col("tau") * F.col("n") for i in range(len(ts))]
        cut = lambda x, i: F.struct(F.col(f"{x}{i}").alias("x"), loss[i].alias("l"), slope[i].alias("g"), count[i].alias("n"), total[i].alias("s"))
        above = [F.when(e & is_open, cut("p", i)) for i, e in enumerate(enough)]
        below = [F.when(~e & is_open, cut("q", i)) for i, e in enumerate(enough)]
        # the loss is linear between neighbouring values, so the cut at t also holds at the neighbour
        def shift(s, i):
            return F.struct(s["x"].alias("x"), (s["l"] + s["g"] * (s["x"] - F.col(f"t{i}"))).alias("l"), s["g"].alias("g"), s["n"].alias("n"), s["s"].alias("s"))

        hi = F.array_min(F.array_compact(F.array(*[F.when(s.isNotNull(), shift(s, i)) for i, s in enumerate(above)])))
        lo = F.array_max(F.array_compact(F.array(*[F.when(s.isNotNull(), shift(s, i)) for i, s in enumerate(below)])))
        st = st.withColumn("hi", hi).withColumn("lo", lo)
        nxt = st.select(
            *keys, "n", "rank", "tau", "total",
            F.coalesce(F.col("lo.x"), F.col("a")).alias("a"), F.coalesce(F.col("hi.x"), F.col("b")).alias("b"),
            F.coalesce(F.col("lo.l"), F.col("la")).alias("la"), F.coalesce(F.col("lo.g"), F.col("ga")).alias("ga"),
            F.coalesce(F.col("hi.l"), F.col("lb")).alias("lb"), F.coalesce(F.col("hi.g"), F.col("gb")).alias("gb"),
            F.coalesce(enough[0], F.lit(True)).alias("left"), (F.col("round") + 1).alias("round"), F.lit(None).cast("array<double>").alias("sketch"),
            F.coalesce(F.col("lo.n"), F.col("below_n")).alias("below_n"), F.coalesce(F.col("lo.s"), F.col("below_s")).alias("below_s"), "base_n", "base_s",
        )
        nxt = scratch.write(nxt, "state")
        scratch.drop(state)
        state = nxt
    else:
        raise RuntimeError("order statistics did not settle")
    return state.select(*keys, "n", "rank", F.col("a").alias("y"))


GROUP = ["detector_id", "dataset", "source"]


def _kept_share(share: str):
    """Rank of the largest value that is dropped: all but floor(share * n), in decimal arithmetic."""
    return lambda n: n - F.floor(n.cast("decimal(20,0)") * F.lit(share).cast("decimal(10,9)")).cast("bigint")


def cut_scores(scores: DataFrame, share: str = "0.1", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, cutoffs): see p3_found and p3_cutoffs.

    A row is kept if its score is above the value y of rank n - floor(share*n): then at most
    share*n rows are kept, and the cutoff is the least score above y. Ties at y are all dropped.
    Where nothing lies above y, the cutoff is null and nothing is kept. Nulls in source or score, NaN
    and infinite scores don't count; a null dataset or detector is a group of its own.
    """
    scratch = scratch or Scratch(scores.sparkSession, "cutoff")
    rows = counted_scores(scores)
    rows = rows.withColumn("detector_id", F.coalesce("detector_id", F.lit("\0"))).withColumn("dataset", F.coalesce("dataset", F.lit("\0")))
    rows = scratch.write(rows, "counted")
    stats = order_statistics(rows, GROUP, "score", _kept_share(share), scratch)
    joined = rows.join(stats, GROUP)
    unmask = [F.when(F.col(c) != "\0", F.col(c)).alias(c) if c != "source" else F.col(c) for c in GROUP]
    kept = joined.where(F.col("score") > F.col("y")).select("score_id", *unmask, "score")
    cuts = (
        joined.groupBy(*GROUP).agg(
            F.first("n").alias("n_counted"), F.min(F.when(F.col("score") > F.col("y"), F.col("score"))).alias("cutoff"),
            F.count(F.when(F.col("score") > F.col("y"), 1)).alias("n_kept"),
        ).select(*unmask, "cutoff", "n_counted", "n_kept")
    )
    return kept, cuts
