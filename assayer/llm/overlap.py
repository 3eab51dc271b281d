"""Problem 2: evaluation rows whose picture is also in the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import canonical_source
from assayer.llm.edits import edit_join
from assayer.llm.hamming import fingerprint, near_pairs
from assayer.llm.names import MIN_WORDS, name_words
from assayer.session import Scratch

ERRORS = 6


def cross_split_pairs(pool: DataFrame, scratch: Scratch, errors: int = ERRORS) -> DataFrame:
    """(eval_id, train_id): each pair of a validation or test row and a train row that show one picture, once.

    Segment join on the fingerprints, taken as strings of 64 bits: an evaluation string is cut into segments and
    matched with the training substrings at the only allowed position, the same one, since only substitutions
    count; then the band of the dynamic programme is its diagonal, and its sum is the number of differing bits.
    The k+1 segments of the classic join have nine bits here, so that each would match 1/512 of all training
    rows; the strings are therefore cut into more than k+1 segments, of which the same argument makes several
    agree (hamming.choose_agree). Names are compared by their set of words, the case k = 0 with one segment.

    Fingerprints are compared once each, however many rows share them; rows join back at the end. Rows of no split
    take part in nothing; invalid fingerprints and names of fewer than four words match nothing. An empty table
    gives an empty result.
    """
    rows = pool.select(
        "pool_id", F.lower(F.trim("split")).alias("split"), fingerprint(F.col("phash")).alias("fp"), name_words(F.col("location")).alias("words")
    ).where(F.col("split").isin("train", "validation", "test"))
    rows = scratch.write(rows.select(
        "pool_id", (F.col("split") == "train").alias("train"), "fp",
        F.when(F.size("words") >= MIN_WORDS, F.unhex(F.md5(F.array_join("words", " ")))).alias("name"),
    ), "rows")
    fps = rows.where("fp is not null").groupBy("fp").agg(F.max(~F.col("train")).alias("left"), F.max("train").alias("right"))
    fps = scratch.write(fps, "fps")
    near = near_pairs(fps, errors, scratch, sides=True).union(fps.where("left and right").select("fp", "fp"))
    held, train = rows.where("not train"), rows.where("train")
    by_print = (
        near.join(held.select(F.col("pool_id").alias("eval_id"), F.col("fp").alias("fa")), "fa")
        .join(train.select(F.col("pool_id").alias("train_id"), F.col("fp").alias("fb")), "fb")
    )
    by_name = held.where("name is not null").select(F.col("pool_id").alias("eval_id"), "name").join(
        train.select(F.col("pool_id").alias("train_id"), "name"), "name"
    )
    return by_print.select("eval_id", "train_id").union(by_name.select("eval_id", "train_id")).distinct()


NAME_EDITS = 2


def near_names(pool: DataFrame, scratch: Scratch, edits: int = NAME_EDITS) -> DataFrame:
    """(eval_id, train_id, distance): evaluation and training rows whose names are written alike but for a few letters.

    The edit-distance segment join (edits.edit_join) on the words of a name, sorted and put together; names of fewer
    than four words take no part.
    """
    name = F.array_join(name_words(F.col("location")), " ").alias("text")
    rows = pool.select("pool_id", F.lower(F.trim("split")).alias("split"), F.when(F.size(name_words(F.col("location"))) >= MIN_WORDS, name).alias("text"))
    rows = scratch.write(rows.where("text is not null and split in ('train', 'validation', 'test')"), "names")
    held, train = rows.where("split <> 'train'"), rows.where("split = 'train'")
    near = edit_join(held, train, edits, scratch)
    return (
        near.join(held.select(F.col("pool_id").alias("eval_id"), F.col("text").alias("a")), "a")
        .join(train.select(F.col("pool_id").alias("train_id"), F.col("text").alias("b")), "b").select("eval_id", "train_id", "distance")
    )


def overlap_report(pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, n_rows, n_overlapping) of the evaluation splits; a null source is reported as null."""
    hit = pairs.select(F.col("eval_id").alias("pool_id")).distinct().withColumn("hit", F.lit(1))
    rows = pool.select("pool_id", F.lower(F.trim("split")).alias("split"), canonical_source(F.col("source")).alias("source"))
    return (
        rows.where(F.col("split").isin("validation", "test")).join(hit, "pool_id", "left")
        .groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_overlapping"))
    )
