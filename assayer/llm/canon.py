"""Problem 8: one form for texts that look the same, and the documents that coincide in it."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import Scratch

# Letters of other scripts that look like a Latin letter, each above the letter it looks like.
LOOKALIKE = "ᎠᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏟᏢᏦᏞᏴՕՍոսօհցⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿρΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳАВЕЅІЈКМНОРСТУХҮҺԌԚԜӀаеорсухѕіјһԁԛԝӏүɡɑѐёїӑӓӗӧЀЁЇӐӒӖӦ"
LATIN__ = "DTAJEWMHGZSCPKLBOUnuohgIVXLCDMivxlcdmpABEZHIKMNOPTYXovcjABESIJKMHOPCTYXYhGQWIaeopcyxsijhdqwlygaèëïăäĕöÈËÏĂÄĔÖ"
# Kinds of hyphen.
HYPHENS = "‐‑﹣－"
# Invisible characters, as ranges of a regular expression.
INVISIBLE = (
    r"\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}\x{80}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}"
    r"\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}"
    r"\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
#: A zero-width joiner between two of these makes one visible sign of them, so it stays.
EMOJI = r"\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}"
JOIN = "\U0010fffe"


@cache
def mapping() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, replacements): single characters for translate(), and joined letters with what they stand for.

    Built from the Unicode data by rule: width forms and presentation forms by their compatibility
    decomposition, all space separators to a blank, and the tables above.
    """
    single: dict[str, str] = {}
    joined: dict[str, str] = {}
    for cp in [*range(0x2000, 0x3001), *range(0xFB00, 0xFB50), *range(0xFE30, 0xFE70), *range(0xFF01, 0xFFEF), 0xA0, 0x1680]:
        c = chr(cp)
        kind = unicodedata.decomposition(c).split(" ")[0]
        if unicodedata.category(c) == "Zs":
            single[c] = " "
        elif kind in ("<wide>", "<narrow>", "<small>"):
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1:
                single[c] = to
        elif kind == "<compat>" and 0xFB00 <= cp < 0xFB18:
            joined[c] = unicodedata.normalize("NFKC", c)
    for c in HYPHENS:
        single[c] = "-"
    for a, b in zip(LOOKALIKE, LATIN__, strict=True):
        if a != b:
            single.setdefault(a, b)
    return "".join(single), "".join(single.values()), tuple(joined.items())


def canonical_sql(col: str) -> str:
    """The canonical form of a text column as a DuckDB expression."""
    src, to, joined = mapping()
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"regexp_replace({col}, '([{EMOJI}][\\x{{FE0E}}\\x{{FE0F}}]?)\\x{{200D}}', '\\1{JOIN}', 'g')"
    x = f"regexp_replace({x}, '{JOIN}([^{EMOJI}]|$)', '\\1', 'g')"
    x = f"CASE WHEN contains({col}, '\u200d') THEN {x} ELSE {col} END"
    x = f"regexp_replace({x}, '[{INVISIBLE}]', '', 'g')"
    x = f"translate(nfc_normalize({x}), {lit(src)}, {lit(to)})"
    for a, b in joined:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    x = f"replace(nfc_normalize({x}), '{JOIN}', '\u200d')"
    # a text of printable ASCII is its own form
    return f"CASE WHEN strlen({col}) = length({col}) AND NOT regexp_matches({col}, '[\\x00-\\x08\\x0E-\\x1F\\x7F]') THEN {col} ELSE {x} END"


def duckdb_map(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """df's rows through a DuckDB query over the view `batch`, Arrow batch by batch, inside Spark's partitions.

    The query must work row by row: it sees one batch at a time. One thread and one connection for a task.
    """

    def run(batches):
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(config={"threads": 1})
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches()
                con.unregister("batch")
        con.close()

    return df.mapInArrow(run, schema)


def canonical_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, canonical): null stays null, empty stays empty; whole texts."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return duckdb_map(rows, f"SELECT doc_id, text, {canonical_sql('text')} AS canonical FROM batch", "doc_id bigint, text string, canonical string")


def marks(docs: DataFrame, scratch: Scratch, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, raw, form): 128-bit digests of each text and of its canonical form. Null texts and texts without a visible
    character have no row."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    out = duckdb_map(
        rows,
        f"SELECT doc_id, unhex(md5(text)) AS raw, unhex(md5(c)) AS form FROM (SELECT doc_id, text, {canonical_sql('text')} AS c FROM batch) "
        r"WHERE regexp_matches(c, '[^\s\x{85}\x{A0}\x{2028}\x{2029}\x{2800}]')",
        "doc_id bigint, raw binary, form binary",
    )
    return scratch.write(out, "marks")


def look_alike_classes(docs: DataFrame, scratch: Scratch, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_docs, n_texts): one row for each document whose text coincides with a different one in its
    canonical form; class_id is the least doc_id of the class. As many rows as documents, however large a class."""
    found = marks(docs, scratch, doc, text)
    texts = found.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    classes = texts.groupBy("form").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_texts")).where("n_texts > 1")
    return found.join(classes, "form").select("doc_id", "class_id", "n_docs", "n_texts")


def look_alikes(docs: DataFrame, scratch: Scratch, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: documents with different texts of one canonical form.

    Null texts and texts without a visible character are no case. Only 128-bit digests of the text and of its
    canonical form leave the tasks. Documents with the same text are one class; classes are paired by
    canonical form, and only then joined back to their documents, so a mass of exact copies is never compared
    with itself. An empty table gives an empty result.
    """
    found = marks(docs, scratch, doc, text)
    classes = found.select("form", "raw").distinct()
    many = classes.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    classes = scratch.write(classes.join(many, "form"), "classes")
    pairs = classes.select("form", F.col("raw").alias("raw_a")).join(classes.select("form", F.col("raw").alias("raw_b")), "form").where("raw_a < raw_b")
    out = (
        pairs.join(found.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("a")), "raw_a")
        .join(found.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("b")), "raw_b")
    )
    return out.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
