"""The pN_ queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import canon, cutoff, digest, leak, neardup, overlap, splits, tokenids
from assayer.session import Scratch, load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of each group of two or more tied records: the groups that the split search moved as a whole."""
    return splits.assign_splits(load(spark, d, "image_scores")).where("group_size > 1").select("score_id", "group_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(load(spark, d, "image_scores")).select("score_id", "group_id", "split")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    records = load(spark, d, "image_scores")
    return splits.split_report(records, splits.assign_splits(records))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(load(spark, d, "pool_index"), Scratch(spark, "p2"))
    return pairs.select(F.least("eval_id", "train_id").alias("pool_id_a"), F.greatest("eval_id", "train_id").alias("pool_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    pool = load(spark, d, "pool_index")
    return overlap.overlap_report(pool, overlap.cross_split_pairs(pool, Scratch(spark, "p2")))


def p2_names(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation and training rows whose names differ in at most two letters."""
    return overlap.near_names(load(spark, d, "pool_index"), Scratch(spark, "p2"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_scores(load(spark, d, "image_scores"))[0].select("score_id")


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_scores(load(spark, d, "image_scores"))[1]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each group of two or more alike rows."""
    return neardup.picture_groups(load(spark, d, "pool_index"), Scratch(spark, "p4")).where("group_size > 1").select("pool_id", "group_id")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digest.all_percentiles(load(spark, d, "image_scores"), load(spark, d, "pool_index"), Scratch(spark, "p5"))


def p5_day_summaries(spark: SparkSession, d: str) -> DataFrame:
    return digest.unmasked(digest.all_day_summaries(load(spark, d, "image_scores"), load(spark, d, "pool_index"), Scratch(spark, "p5")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenids.token_ids(load(spark, d, "documents"), Scratch(spark, "p6"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return tokenids.round_trip(docs, tokenids.token_ids(docs, Scratch(spark, "p6")), spark)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaking(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "eval_items")
    return leak.leaked_items(items, leak.leaking(load(spark, d, "documents"), items))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return leak.kept_documents(docs, leak.leaking(docs, load(spark, d, "eval_items"))).select("doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.look_alikes(load(spark, d, "documents"), Scratch(spark, "p8"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return canon.look_alike_classes(load(spark, d, "documents"), Scratch(spark, "p8"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The canonical form of every document."""
    return canon.canonical_texts(load(spark, d, "documents")).select("doc_id", "canonical")


P3_COUNTED = r"""
counted AS (
  SELECT score_id, detector_id, dataset, regexp_replace(lower(trim(source)), '[-_\s]+', '_', 'g') AS source, image_score AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY detector_id, path ORDER BY scored_at DESC, score_id DESC) AS rn FROM image_scores)
  WHERE rn = 1 AND trim(source) <> '' AND image_score IS NOT NULL AND NOT isnan(image_score) AND abs(image_score) < 'infinity'::DOUBLE
),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY detector_id, dataset, source) AS n,
    count(*) OVER (PARTITION BY detector_id, dataset, source ORDER BY score DESC) AS at_or_above
  FROM counted
)
"""


POOL = r"""
p0 AS (SELECT pool_id, source, lower(trim(split)) AS split, lower(regexp_extract(coalesce(phash, ''), '^\s*(?:0[xX])?([0-9a-fA-F]{16})\s*$', 1)) AS hex,
  list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_extract(coalesce(location, ''), '([^/\\]*)$', 1), '\.[^.]*$', ''), '[A-Za-z]+'), lambda x: lower(x)))) AS words FROM pool_index),
p AS (SELECT pool_id, source, split, CASE WHEN hex NOT IN ('', '0000000000000000', 'ffffffffffffffff') THEN ('0x' || hex)::UBIGINT END AS fp, CASE WHEN len(words) >= 4 THEN words END AS words FROM p0)
"""
P2 = POOL + """,
ev AS (SELECT * FROM p WHERE split IN ('validation', 'test')), tr AS (SELECT * FROM p WHERE split = 'train'),
hit AS (SELECT ev.pool_id AS e, tr.pool_id AS t FROM ev JOIN tr ON bit_count(xor(ev.fp, tr.fp)) <= 6 UNION SELECT ev.pool_id, tr.pool_id FROM ev JOIN tr ON ev.words = tr.words)
"""
P4 = POOL + """,
wd AS (SELECT pool_id, len(words) AS n, unnest(words) AS w FROM p),
by_name AS (SELECT x.pool_id AS a, y.pool_id AS b FROM wd x JOIN wd y ON x.w = y.w AND x.pool_id <> y.pool_id GROUP BY x.pool_id, y.pool_id, x.n, y.n HAVING count(*) >= 0.6::DOUBLE * (x.n + y.n - count(*)) - 1e-9::DOUBLE),
by_print AS (SELECT x.pool_id AS a, y.pool_id AS b FROM p x JOIN p y ON bit_count(xor(x.fp, y.fp)) <= 6 AND x.pool_id <> y.pool_id),
e AS (SELECT * FROM by_name UNION SELECT * FROM by_print),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""


def _key(col: str, name: str) -> str:
    """The file key and the contributor of a path, as columns k_<name> and c_<name>."""
    p = rf"regexp_replace(regexp_replace('/' || lower(replace(replace({col}, '\', '/'), '%20', ' ')), '/(?:\.?/)+', '/', 'g'), '^.*?/px/', '/')"
    return rf"""SELECT score_id, CASE WHEN c IS NULL THEN p ELSE regexp_extract(p, '^(.*/)[^/]+/[^/]+$', 1) || c || '/' || split_part(p, '/', -1) END AS k_{name}, c AS c_{name}
      FROM (SELECT score_id, p, CASE WHEN len(q) = 3 THEN array_to_string(list_sort(q), ' ') END AS c
        FROM (SELECT score_id, p, string_split(trim(regexp_replace(regexp_extract(p, '^/[^/]+/[^/]+.*/([^/]+)/[^/]+$', 1), '[^\p{{L}}\p{{M}}]+', ' ', 'g')), ' ') AS q FROM (SELECT score_id, {p} AS p FROM image_scores)))"""


P1 = f"""
a AS ({_key('path', 'own')}), b AS ({_key('orig_path', 'orig')}),
ties AS (SELECT score_id, coalesce('f' || k_own, 'r' || score_id) AS own, 'c' || c_own AS credit, 'f' || k_orig AS orig FROM a JOIN b USING (score_id)),
e0 AS (SELECT DISTINCT own AS x, credit AS y FROM ties WHERE credit IS NOT NULL UNION SELECT DISTINCT own, orig FROM ties WHERE orig <> own),
e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
part AS (SELECT own, least(own, coalesce(m, own)) AS part FROM (SELECT DISTINCT own FROM ties) LEFT JOIN (SELECT x AS own, min(y) AS m FROM r GROUP BY 1) USING (own)),
g AS (SELECT score_id, min(score_id) OVER (PARTITION BY part) AS group_id, count(*) OVER (PARTITION BY part) AS n FROM ties JOIN part USING (own))
"""
WORDS = leak.WORDS_SQL.format(canon.canonical_sql("text"))
P7 = f"""
d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
P8 = rf"""
c AS (SELECT doc_id, text, {canon.canonical_sql('text')} AS form FROM documents WHERE text IS NOT NULL AND text <> ''),
v AS (SELECT * FROM c WHERE regexp_matches(form, '[^\s\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{2800}}]'))
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_splits, p1_report, p2_found, p2_report, p2_names, p3_found, p3_cutoffs, p4_found,
        p5_percentiles, p5_day_summaries, p6_ids, p6_round_trip, p7_found, p7_items, p7_kept, p8_found, p8_classes, p8_texts,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH RECURSIVE {P1} SELECT score_id, group_id FROM g WHERE n > 1",
        "p2_found": f"WITH {P2} SELECT least(e, t) AS pool_id_a, greatest(e, t) AS pool_id_b FROM hit",
        "p2_report": rf"WITH {P2} SELECT ev.split, nullif(regexp_replace(lower(trim(source)), '[-_\s]+', '_', 'g'), '') AS source, count(*) AS n_rows, count(h.e) AS n_overlapping FROM ev LEFT JOIN (SELECT DISTINCT e FROM hit) h ON h.e = ev.pool_id GROUP BY 1, 2",
        "p2_names": f"""WITH {P2}, n AS (SELECT pool_id, split, array_to_string(words, ' ') AS t FROM p WHERE words IS NOT NULL), m AS (SELECT DISTINCT e.t AS a, t.t AS b FROM n e JOIN n t ON abs(len(e.t) - len(t.t)) <= 2 AND e.split IN ('validation', 'test') AND t.split = 'train'),
            k AS (SELECT a, b, levenshtein(a, b)::INT AS distance FROM m) SELECT e.pool_id AS eval_id, t.pool_id AS train_id, distance FROM k JOIN n e ON e.t = a AND e.split IN ('validation', 'test') JOIN n t ON t.t = b AND t.split = 'train' WHERE distance <= 2""",
        "p4_found": f"WITH RECURSIVE {P4} SELECT a AS pool_id, least(a, min(b)) AS group_id FROM r GROUP BY a",
        "p7_found": f"WITH {P7} SELECT * FROM hit",
        "p7_items": f"WITH {P7} SELECT item_id, suite, count(hit.doc_id) AS n_docs FROM eval_items LEFT JOIN hit USING (item_id) GROUP BY 1, 2",
        "p7_kept": f"WITH {P7} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
        "p8_found": f"WITH {P8} SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM v x JOIN v y ON x.form = y.form AND x.text <> y.text AND x.doc_id < y.doc_id",
        "p8_classes": f"WITH {P8} SELECT doc_id, class_id, n_docs, n_texts FROM v JOIN (SELECT form, min(doc_id) AS class_id, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM v GROUP BY 1) USING (form) WHERE n_texts > 1",
        "p8_texts": f"SELECT doc_id, {canon.canonical_sql('text')} AS canonical FROM documents",
        "p3_found": f"WITH {P3_COUNTED} SELECT score_id FROM ranked WHERE at_or_above * 10 <= n",
        "p3_cutoffs": f"""WITH {P3_COUNTED} SELECT detector_id, dataset, source, min(CASE WHEN at_or_above * 10 <= n THEN score END) AS cutoff,
            any_value(n) AS n_counted, count(CASE WHEN at_or_above * 10 <= n THEN 1 END) AS n_kept
            FROM ranked GROUP BY ALL""",
    }
