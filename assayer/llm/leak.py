"""Problem 7: documents that hold passages of evaluation texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.canon import canonical_sql, duckdb_map
from assayer.session import Scratch

#: Words in a row that make a passage.
WORDS = 10
#: Evaluation text that one pass over the corpus looks for; more of it is looked for in further passes.
PASS_CHARS = 4_000_000

WORDS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


class Grams:
    """The set of all runs of n words of the evaluation texts: exact word codes, found by a rolling hash."""

    def __init__(self, items: list[int], words: "pa.ListArray", n: int):
        import pyarrow.compute as pc

        self.n = n
        flat = words.flatten()
        coded = flat.dictionary_encode()
        self.words = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        width = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(width)), width)
        at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(owner) >= n else np.zeros(0, np.int64)
        windows = code[at[:, None] + np.arange(n)[None, :]]
        owners = np.asarray(items, dtype=np.int64)[owner[at]]
        for salt in range(100):
            self.base = np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
            h = self.hash(windows)
            order = np.lexsort((owners, h))
            h, windows, owners = h[order], windows[order], owners[order]
            same = h[1:] == h[:-1]
            if (windows[1:][same] == windows[:-1][same]).all():
                break
        else:
            raise RuntimeError("no hash tells the passages apart")
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (owners[1:] != owners[:-1]))) if len(h) else np.zeros(0, bool)
        h, windows, self.owners = h[once], windows[once], owners[once]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        self.hashes, self.codes = h[first], windows[first]
        self.starts = np.concatenate((first, [len(h)])).astype(np.int64)

    def hash(self, windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                h = (h + windows[:, k].astype(np.uint64) + np.uint64(1)) * self.base
        return h

    def find(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into doc, item) of every hit; codes are the words of all texts one after the other, -1 unknown."""
        n = self.n
        if len(codes) < n or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.concatenate(([0], np.cumsum(codes < 0)))
        at = np.flatnonzero((unknown[n:] == unknown[:-n]) & (doc[: len(doc) - n + 1] == doc[n - 1 :]))
        windows = codes[at[:, None] + np.arange(n)[None, :]]
        h = self.hash(windows)
        g = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = (self.hashes[g] == h) & (self.codes[g] == windows).all(axis=1)
        g, at = g[hit], at[hit]
        count = self.starts[g + 1] - self.starts[g]
        rows = np.repeat(at, count)
        pick = np.repeat(self.starts[g] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return doc[rows], self.owners[pick]


def leaking(docs: DataFrame, items: DataFrame, words: int = WORDS, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id): each document that holds at least `words` words in a row of an item, once for each item.

    Words are runs of letters and digits of the canonical form (canon), in lower case; what lies between them
    doesn't matter. The evaluation set is what is broadcast: its runs of words as a hash set, in several passes if
    it holds more than PASS_CHARS characters; so a broadcast has at most half as many windows, of some sixty bytes each. Each document's words are mapped to codes, windows of known words
    are looked up by rolling hash, and each hit is verified word by word. Null and short texts hold nothing;
    items of fewer words can't leak. Whole documents are scanned, whatever their length.
    """
    spark = docs.sparkSession
    sized = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).where("text is not null and item_id is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-total // PASS_CHARS) or 1
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    rows = duckdb_map(rows, f"SELECT doc_id, {WORDS_SQL.format(canonical_sql('text'))} AS words FROM batch", "doc_id bigint, words array<string>") if passes > 1 else rows
    if passes > 1:  # the words are made once for all passes
        rows = (scratch or Scratch(spark, "leak")).write(rows, "words")
    out = None
    for k in range(passes):
        part = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        got = duckdb_map(part, f"SELECT item_id, {WORDS_SQL.format(canonical_sql('text'))} AS words FROM batch", "item_id bigint, words array<string>").toArrow().combine_chunks()
        held = spark.sparkContext.broadcast(Grams(got.column("item_id").to_pylist(), _one(got.column("words")), words))

        def run(batches, held=held):
            import duckdb
            import pyarrow as pa
            import pyarrow.compute as pc

            grams = held.value
            vocabulary = grams.words
            con = duckdb.connect(config={"threads": 1})
            for b in batches:
                if not b.num_rows:
                    continue
                if "words" in b.schema.names:
                    got = pa.Table.from_batches([b])
                else:
                    con.register("batch", pa.Table.from_batches([b]))
                    got = con.sql(f"SELECT doc_id, {WORDS_SQL.format(canonical_sql('text'))} AS words FROM batch").to_arrow_table().combine_chunks()
                    con.unregister("batch")
                lists = _one(got.column("words"))
                flat = lists.flatten()
                codes = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                d, i = grams.find(codes, owner)
                if len(d):
                    pairs = np.unique(np.stack([d, i], axis=1), axis=0)
                    ids = got.column("doc_id").combine_chunks().take(pa.array(pairs[:, 0]))
                    yield pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else ids.combine_chunks(), pa.array(pairs[:, 1])], names=["doc_id", "item_id"])
            con.close()

        found = rows.mapInArrow(run, "doc_id bigint, item_id bigint")
        out = found if out is None else out.union(found)
    return out


def _one(column):
    """A column as one array."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def kept_documents(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents that hold no evaluation passage."""
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")


def leaked_items(items: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, suite, n_docs) of every item, with the number of documents it leaked into."""
    n = hits.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_docs"))
