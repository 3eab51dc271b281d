"""Problem 6: token ids of every text by a public tokenizer, through a table of distinct words."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import Scratch

# The white space of the tokenizer's pattern, spelled out because Java's \s is narrower.
SPACE = r"\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The tokenizer's word pattern.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A word is hot if it is at least this share of all words and not longer; so there are at most 1/HOT_SHARE hot words.
HOT_SHARE, HOT_CHARS = 0.000005, 32


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str):
    """The tokenizer of this Python worker, read once; special strings count as ordinary text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    held = globals().setdefault("_TOKENIZERS", {})
    if path not in held:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        held[path] = t
    return held[path]


def encode_texts(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """df with the ids of a short text column, encoded as it stands, by Arrow batches."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {out} array<int>"

    def run(batches):
        import pyarrow as pa

        t = _encoder(path)
        for b in batches:
            ids = [e.ids for e in t.encode_batch(b.column(text).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def _lookup(docs: DataFrame, hot: bytes) -> DataFrame:
    """(doc_id, at, ids, w) of (doc_id, words): one row with w null for a document whose words are all in the table;
    else its runs of known words, in order, and a row with the word itself for each of the others."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = globals().setdefault("_HOT", {})
        if table.get("of") is not held:
            t = pa.ipc.open_stream(held.value).read_all().combine_chunks()
            table.update(of=held, words=_one(t.column("w")), ids=_one(t.column("ids")))
        for b in batches:
            if not b.num_rows:
                continue
            lists, doc = b.column("words"), b.column("doc_id")
            flat = lists.flatten()
            code = pc.index_in(flat, value_set=table["words"])
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(n)), n)
            rare = code.is_null().to_numpy(zero_copy_only=False)
            ids = table["ids"].take(code)
            # a piece ends with its document and on both sides of a rare word
            first = np.ones(len(flat), dtype=bool)
            first[1:] = (owner[1:] != owner[:-1]) | rare[1:] | rare[:-1]
            start = np.flatnonzero(first)
            width = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(width)))
            offsets = ends[np.concatenate((start, [len(flat)]))].astype(np.int32)
            at = start - np.concatenate(([0], np.cumsum(n)))[owner[start]]
            word = pc.if_else(pa.array(rare[start]), flat.take(pa.array(start)), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(owner[start])), pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), ids.flatten()), word, pa.array((n[owner[start]]).astype(np.int32)), pa.array(np.diff(np.concatenate((start, [len(flat)]))).astype(np.int32))],
                names=["doc_id", "at", "ids", "w", "n", "width"],
            )

    held = docs.sparkSession.sparkContext.broadcast(hot)
    return docs.mapInArrow(run, "doc_id bigint, at int, ids array<int>, w string, n int, width int")


def _one(column):
    """A column as one array."""
    import pyarrow as pa

    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def token_ids(docs: DataFrame, scratch: Scratch, path: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids), one row for each document; null and empty texts have an empty list.

    Words are split in the JVM by the tokenizer's own pattern, each distinct word is encoded once, and the ids
    join back by word and are put together by position. The words that make up most of any corpus, of which
    there are at most 1/HOT_SHARE, each of at most HOT_CHARS characters, are a broadcast table that the scanning tasks
    look up; only the other words, and the runs of ids between them, leave their task, and join by word and then
    by document. Texts with characters that the JVM's Unicode tables don't know yet are encoded whole, as the
    pattern could split them elsewhere. Whole texts are used, however long; a document's own ids are the largest
    thing a task holds. doc_id must be unique.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    known = ~F.col("text").rlike(r"\p{Cn}")
    plain = rows.where((F.col("text") != "") & known).select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    # an inner explode would make Spark split every text twice, to filter out empty lists, which there are none of
    counted = scratch.write(plain.select(F.explode_outer("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    table = scratch.write(encode_texts(counted, "w", path), "word-ids")
    is_hot = (F.col("n") >= max(1.0, HOT_SHARE * total)) & (F.length("w") <= HOT_CHARS)
    found = scratch.write(_lookup(plain, _stream(table.where(is_hot).select("w", "ids"))), "found")
    whole = found.where("w is null and width = n").select("doc_id", "ids")
    parts = found.where("w is not null or width < n")
    rare = parts.where("w is not null").select("doc_id", "at", "w").join(table.where(~is_hot).select("w", "ids"), "w").select("doc_id", "at", "ids")
    parts = rare.union(parts.where("w is null").select("doc_id", "at", "ids"))
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts")).select(
        "doc_id", F.flatten(F.col("parts.ids")).alias("ids")
    )
    odd = encode_texts(rows.where((F.col("text") != "") & ~known), "text", path).select("doc_id", "ids")
    none = rows.where(F.col("text").isNull() | (F.col("text") == "")).select("doc_id", F.array().cast("array<int>").alias("ids"))
    return whole.union(joined).union(odd).union(none)


def _stream(table: DataFrame) -> bytes:
    """A small table as an Arrow stream."""
    import pyarrow as pa

    t = table.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of each id, from the tokenizer's rank file; as many rows as its vocabulary."""
    with open(path or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return spark.createDataFrame([(int(r), bytearray(base64.b64decode(b))) for b, r in pairs], "id int, piece binary")


def decode_ids(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, bytes) of (doc_id, ids), through a join with the id-to-piece table.

    The table is as large as the vocabulary, which is what bounds the broadcast. An id without a piece adds
    nothing; a null or empty list gives no bytes.
    """
    each = ids.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary), "id")
    text = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("x")))).alias("p"))
    text = text.select("doc_id", F.size("p").alias("n_tokens"), F.unhex(F.array_join(F.col("p.x"), "")).alias("bytes"))
    empty = ids.where(F.coalesce(F.size("ids"), F.lit(0)) <= 0).select("doc_id", F.lit(0).alias("n_tokens"), F.unhex(F.lit("")).alias("bytes"))
    return text.union(empty)


def round_trip(docs: DataFrame, ids: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, n_tokens, same): whether the decoded bytes are the text again (null counts as empty)."""
    back = decode_ids(ids, pieces(spark))
    return docs.select("doc_id", "text").join(back, "doc_id").select(
        "doc_id", "n_tokens", (F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col("bytes")).alias("same")
    )
