"""Each operator against brute force, and on empty, null, tied, repeated, long and hot inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from assayer.llm import canon, cutoff, digest, hamming, leak, names, neardup, overlap, queries, splits, tokenids
from assayer.llm.components import connected_components
from assayer.session import Scratch

SF = "/root/testdata/sf0.001"
SCORES = "score_id long, detector_id string, path string, dataset string, source string, label int, image_score double, orig_path string, scored_at timestamp, group_id string, node string, n int"
POOL = "pool_id long, source string, label int, location string, phash string, split string, fp string, words int, name string"
DOCS = "doc_id long, text string, canonical string, ids string, w int, raw string, n int"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def score(i, path, orig=None, det="d", src="s", lab=0, x=0.5, at=0):
    import datetime as dt

    return (i, det, path, "ds", src, lab, x, orig, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), "x", "y", 1)


def groups_of(pairs, nodes):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_sql_twins(spark):
    con = connect(SF)
    for n, sql in queries.oracle_sql().items():
        same(spark, con, SF, queries.queries()[n], sql)


def test_components_against_union_find(spark, scratch):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(df, scratch).collect()}
    used = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == groups_of([p for p in pairs], used)
    assert connected_components(df.limit(0), scratch).count() == 0


# 1 -------------------------------------------------------------------------------------------------------------


def test_p1_ties(spark, scratch):
    rows = [
        score(1, "/vol1/px/ds/src/ann_bo_cee/a.jpg"), score(2, r"D:\px\DS\src\Cee, Ann Bo\b.png"),  # one contributor
        score(3, "px/ds/src/x%20y/a.jpg"), score(4, "/m/px/.//ds/src/X Y/A.JPG"),  # one file
        score(5, "/m/px/ds/src/anon/c.jpg", orig="/m/px/ds/src/x y/a.jpg"),  # a copy of it
        score(6, "/m/px/ds/src/d.jpg", orig="/gone/px/ds/src/dee_eff_gee/z.jpg"), score(7, "/m/px/ds/src/e.jpg", orig="/px/ds/src/gee.dee.eff/Z.jpg"),  # a missing original
        score(8, "/m/px/ds/src/dee_eff_gee/other.jpg"),  # the missing original's contributor, but another file
        score(9, "/m/px/ds/src/n_a/f.jpg"), score(10, "/m/px/ds/old_pool_real/f.jpg"), score(11, "/m/px/ds/old_pool_real/g.jpg"),  # nobody
        score(12, None), score(13, None), score(14, "/m/px/ds/src/h.jpg", orig="/m/px/ds/src/h.jpg"),
    ]
    df = spark.createDataFrame(rows, SCORES)
    got = {r["score_id"]: (r["group_id"], r["group_size"]) for r in splits.tie_groups(df, scratch).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 3), 4: (3, 3), 5: (3, 3), 6: (6, 2), 7: (6, 2), **{i: (i, 1) for i in range(8, 15)}}
    assert splits.tie_groups(df.limit(0), scratch).count() == 0


def test_p1_hot_contributor_and_chain(spark, scratch):
    rows = [score(i, f"/px/ds/src/hot_hot_name/{i}.jpg") for i in range(200)]
    rows += [score(1000 + i, f"/px/ds/src/c{i}.jpg", orig=f"/px/ds/src/c{i + 1}.jpg") for i in range(60)]
    got = {r["score_id"]: r["group_id"] for r in splits.tie_groups(spark.createDataFrame(rows, SCORES), scratch).collect()}
    assert {got[i] for i in range(200)} == {0} and {got[1000 + i] for i in range(60)} == {1000}


def test_p1_splits_keep_groups_and_shares(spark):
    df = spark.read.parquet(f"{SF}/image_scores.parquet")
    got = splits.assign_splits(df).toPandas()
    assert got.score_id.is_unique and len(got) == df.count()
    assert (got.groupby("group_id").split.nunique() == 1).all()
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    again = splits.assign_splits(df).toPandas()
    assert got.sort_values("score_id").split.tolist() == again.sort_values("score_id").split.tolist()
    assert splits.assign_splits(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(df, {"train": 0.0})


# 2 and 4 -------------------------------------------------------------------------------------------------------


def prints(n, seed=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = set(base)
    for b in base:
        for _ in range(3):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 9)):
                x ^= 1 << bit
            out.add(x)
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


@pytest.mark.parametrize("agree,chunk", [(1, 16384), (2, 16384), (3, 16384), (1, 20), (2, 5)])
def test_near_pairs_are_all_pairs(spark, scratch, monkeypatch, agree, chunk):
    monkeypatch.setattr(hamming, "CHUNK", chunk)
    values = prints(400)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = [tuple(sorted(r)) for r in hamming.near_pairs(df, 6, scratch, agree=agree).collect()]
    assert len(got) == len(set(got)) and set(got) == hamming.near_pairs_brute(values, 6)


def test_vantage_point_tree_is_exact():
    rng = np.random.default_rng(5)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64), np.uint64(77) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    got = {(min(a, b), max(a, b)) for i, j in hamming.vp_pairs(x, 6) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if int(x[a] ^ x[b]).bit_count() <= 6}
    assert got == want


def test_forest_keeps_what_is_connected():
    i, j = np.array([0, 1, 5, 6, 5]), np.array([1, 2, 6, 7, 7])
    a, b = hamming.forest(i, j)
    assert groups_of(zip(a.tolist(), b.tolist(), strict=True), range(8)) == groups_of(zip(i.tolist(), j.tolist(), strict=True), range(8))


def test_fingerprints(spark):
    rows = ["00000000000000ff", " 0X00000000000000FF ", "0" * 16, "F" * 16, "", None, "  ", "error", "12345", "zz000000000000ff", "ffffffffffffff00"]
    df = spark.createDataFrame([(r,) for r in rows], "h string")
    assert [r[0] for r in df.select(hamming.fingerprint(F.col("h"))).collect()] == [255, 255, *[None] * 8, -256]


def test_name_words(spark):
    rows = [r"a\b/Foo-bar_foo%20BAZ.x.jpg", "no/ext", None, "", "dir.d/one two", "x/.hidden"]
    df = spark.createDataFrame([(r,) for r in rows], "l string")
    assert [r[0] for r in df.select(names.name_words(F.col("l"))).collect()] == [["bar", "baz", "foo", "x"], ["ext"], [], [], ["one", "two"], []]


def test_similar_names_against_brute_force(spark, scratch):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    sets = {frozenset(rng.sample(vocabulary, rng.randrange(4, 24))) for _ in range(80)}
    for s in list(sets):
        for _ in range(3):
            t = set(s)
            for w in rng.sample(vocabulary, rng.randrange(1, 5)):
                t ^= {w}
            if len(t) >= 4:
                sets.add(frozenset(t))
    sets |= {frozenset(["common", "other", "third", f"x{chr(97 + i)}"]) for i in range(20)}
    rows = [(i, sorted(s)) for i, s in enumerate(sorted(sets, key=sorted))]
    got = [tuple(r) for r in names.similar_links(spark.createDataFrame(rows, "id long, words array<string>"), 0.6, scratch).collect()]
    want = [(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y)) - 1e-9]
    assert {(min(p), max(p)) for p in got} <= set(want)
    assert groups_of(got, range(len(rows))) == groups_of(want, range(len(rows)))


def pool_rows():
    base = "0123456789abcdef"
    return [
        (1, "a", 0, "x/one two three four.jpg", base, "train", "", 1, ""), (2, "a", 0, "y/FOUR_three-two.one_7.png", None, "test", "", 1, ""),
        (3, "b", 1, "z/IMG_1.jpg", "0X0123456789ABCDEE", "validation", "", 1, ""), (4, "b", 1, "z/IMG_2.jpg", base, "train", "", 1, ""),
        (5, "c", 0, "q/one two three.jpg", "0" * 16, "test", "", 1, ""), (6, "c", 0, "q/one two three.gif", "0" * 16, "train", "", 1, ""),
        (7, None, None, "q/one two three four five.jpg", "error", None, "", 1, ""), (8, "c", 0, "IMG", "fedcba9876543210", "test", "", 1, ""),
        (9, "c", 0, "IMG", "", "train", "", 1, ""), (10, "c", 0, "IMG", "fedcba987654ffff", "train", "", 1, ""),
    ]


def test_p2_cases(spark, scratch):
    df = spark.createDataFrame(pool_rows(), POOL)
    pairs = overlap.cross_split_pairs(df, scratch)
    assert sorted(tuple(r) for r in pairs.collect()) == [(2, 1), (3, 1), (3, 4)]
    rep = {(r["split"], r["source"]): (r["n_rows"], r["n_overlapping"]) for r in overlap.overlap_report(df, pairs).collect()}
    assert rep == {("test", "a"): (1, 1), ("validation", "b"): (1, 1), ("test", "c"): (2, 0)}
    assert overlap.cross_split_pairs(df.limit(0), scratch).count() == 0


def test_p4_cases(spark, scratch):
    df = spark.createDataFrame(pool_rows(), POOL)
    got = {r["pool_id"]: (r["group_id"], r["group_size"]) for r in neardup.picture_groups(df, scratch).collect()}
    assert got == {**{i: (1, 5) for i in (1, 2, 3, 4, 7)}, **{i: (i, 1) for i in (5, 6, 8, 9, 10)}}
    assert neardup.picture_groups(df.limit(0), scratch).count() == 0


def test_p4_hot_group_of_copies(spark, scratch):
    rows = [(i, "a", 0, "x/one two three four.jpg", "0123456789abcdef", "train", "", 1, "") for i in range(500)]
    got = neardup.picture_groups(spark.createDataFrame(rows, POOL), scratch).collect()
    assert {(r["group_id"], r["group_size"]) for r in got} == {(0, 500)}


# 3 -------------------------------------------------------------------------------------------------------------


def kept_by_hand(rows, share=0.1):
    last = {}
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        last[r[1], r[2]] = r
    groups = defaultdict(list)
    for r in last.values():
        s = re.sub(r"[-_\s]+", "_", (r[4] or "").strip().lower())
        if s and r[6] is not None and np.isfinite(r[6]):
            groups[r[1], s].append((r[6], r[0]))
    out = set()
    for g in groups.values():
        ok = [v for v, _ in g if sum(x >= v for x, _ in g) <= int(len(g) * share + 1e-9)]
        out |= {i for v, i in g if ok and v >= min(ok)}
    return out


def test_p3_against_counting(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 0.25, 0.5, 1.0, -5.0, 1e300, -1e300, 1e-300, 5e-324, float("nan"), float("inf"), float("-inf"), None]
    rows = [
        score(i, f"p{rng.randrange(260)}", det=rng.choice("ab"), src=rng.choice(["Harbor-Phone ", "harbor_phone", "x", None, " "]), x=rng.choice(values) if i % 3 else rng.gauss(0, 1), at=rng.randrange(5))
        for i in range(600)
    ]
    kept, cuts = cutoff.cut_scores(spark.createDataFrame(rows, SCORES))
    got = [r["score_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_hand(rows)
    assert sum(r["n_kept"] for r in cuts.collect()) == len(got)
    kept, cuts = cutoff.cut_scores(spark.createDataFrame([score(i, f"p{i}", x=1.0) for i in range(30)], SCORES))
    assert kept.count() == 0 and [(r["cutoff"], r["n_counted"], r["n_kept"]) for r in cuts.collect()] == [(None, 30, 0)]
    kept, cuts = cutoff.cut_scores(spark.createDataFrame([], SCORES))
    assert kept.count() == 0 and cuts.count() == 0


# 5 -------------------------------------------------------------------------------------------------------------


def test_digests_merge_and_stay_small():
    rng = np.random.default_rng(0)
    x = rng.lognormal(0, 3, 200_000)
    zero = np.zeros(50_000, dtype=np.int64)
    parts = [digest.cluster(zero, p, np.ones(len(p), dtype=np.int64)) for p in np.split(x, 4)]
    g, m, w = digest.cluster(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    assert len(m) <= digest.DELTA / 2 + 2 and w.sum() == len(x) and (np.diff(m) >= 0).all()
    mid = np.cumsum(w) - w / 2
    for p in digest.PERCENTILES:
        est = np.interp(p * len(x), np.concatenate(([0], mid, [len(x)])), np.concatenate(([x.min()], m, [x.max()])))
        assert abs((x < est).mean() - p) < digest.BOUND


def test_p5_certified(spark, scratch):
    rng = random.Random(6)
    rows = [("s", "d", rng.choice("ab"), rng.randrange(3), rng.choice([0.0, 1.0, rng.gauss(0, 1), 1e308, -1e308])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "series string, detector_id string, source string, d int, value double").selectExpr("*", "date_add(date'2024-01-01', d) as day").repartition(7)
    days = digest.day_summaries(df, digest.KEYS, scratch)
    assert days.count() == 6
    out = digest.certified_percentiles(df, digest.KEYS, days, scratch).toPandas()
    assert len(out) == 2 * len(digest.PERCENTILES) and out.within_bound.all()
    vals = sorted(r[4] for r in rows if r[2] == "a")
    r = out[(out.source == "a") & (out.p == 0.5)].iloc[0]
    lt, le = sum(v < r.estimate for v in vals), sum(v <= r.estimate for v in vals)
    assert abs(max(0, lt - len(vals) / 2, len(vals) / 2 - le) / len(vals) - r.rank_error) < 1e-12


def test_p5_nulls_and_nothing(spark, scratch):
    scores = spark.createDataFrame([(None, None, float("nan"), None, None), ("d", None, 1.0, None, None)], "detector_id string, source string, image_score double, bytes_per_pixel double, scored_at timestamp")
    pool = spark.createDataFrame([], "source string, bytes_per_pixel double, seen_at timestamp")
    out = digest.all_percentiles(scores, pool, scratch).toPandas()
    assert set(out.estimate) == {1.0} and out.source.isna().all() and set(out.series) == {"image_scores.image_score"}
    assert digest.all_percentiles(scores.limit(0), pool, scratch).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------

ODD = [
    None, "", " ", "\n\n a  b\t\tc \r\n", "Don't we'll I'M it's", "naïve café — “quotes”", "日本語のテキスト 123４５６", "a\u00a0b\u3000c\u2009d\u0085e\x1cf\x0bg",
    "👍🏽👩\u200d👧 ok", "<|endoftext|> x", "x" * 5000, "a b " * 5000, "\u0378\U0001fae8 new", "\u200b", "e\u0301 \ufb01 \x00 z", "१२३ ½ ²", "..." * 20 + "!?", "   lead", "trail   ",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "c", "i", 1, "r", 2) for i, t in enumerate(texts)], DOCS)


def test_p6_equals_the_tokenizer(spark, scratch):
    t = tokenids._encoder(tokenids.tokenizer_path())
    df = docs(spark, ODD + ["same text"] * 5)
    got = {r["doc_id"]: list(r["ids"]) for r in tokenids.token_ids(df, scratch).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD + ["same text"] * 5)}
    back = tokenids.round_trip(df, tokenids.token_ids(df, scratch), spark).collect()
    assert len(back) == len(got) and all(r["same"] for r in back)
    assert tokenids.token_ids(df.limit(0), scratch).count() == 0


# 7 -------------------------------------------------------------------------------------------------------------


def test_p7_cases(spark):
    item = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, item, "s"), (2, "too short", "s"), (3, None, "s"), (4, " ".join(f"word{i}" for i in range(20, 40)), "t")], "item_id long, text string, suite string")
    ten, nine = " ".join(f"word{i}" for i in range(3, 13)), " ".join(f"word{i}" for i in range(3, 12))
    texts = [f"before {ten} after", f"before {nine} after", ten.upper().replace(" ", " -- \n"), ten.replace("o", "о").replace("w", "ｗ").replace("r", "r\u200b"), None, "", f"{nine} x word12", item + " x " + " ".join(f"word{i}" for i in range(30, 40)), "filler " * 30000 + ten, " ".join(f"word{i}" for i in range(20, 30))]
    df = docs(spark, texts)
    got = sorted(tuple(r) for r in leak.leaking(df, items).collect())
    assert got == [(0, 1), (2, 1), (3, 1), (7, 1), (7, 4), (8, 1), (9, 1), (9, 4)]
    hits = leak.leaking(df, items)
    assert sorted(r[0] for r in leak.kept_documents(df, hits).select("doc_id").collect()) == [1, 4, 5, 6]
    assert {r["item_id"]: r["n_docs"] for r in leak.leaked_items(items, hits).collect()} == {1: 6, 2: 0, 3: 0, 4: 2}
    assert leak.leaking(df.limit(0), items).count() == 0 and leak.leaking(df, items.limit(0)).count() == 0


def test_p7_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leak, "PASS_CHARS", 100)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12)), "s") for i in range(6)], "item_id long, text string, suite string")
    df = docs(spark, [" ".join(f"w{i}x{j}" for j in range(1, 11)) for i in range(6)])
    assert sorted(tuple(r) for r in leak.leaking(df, items).collect()) == [(i, i) for i in range(6)]


# 8 -------------------------------------------------------------------------------------------------------------


def test_p8_same_and_different_looks(spark, scratch):
    base = "Fine café-bar: office 12, OK scope"
    alike = ["Ｆｉｎｅ cafe\u0301-bar: office 12, OK scope", "Fine\u00a0café\u2010bar: o\ufb03ce 12,\u2009OK scope", "F\u200bine c\u00adafé-bar: office 12, OK\ufeff scope", "Finе café-bar: оffice 12, ОK scоре"]
    other = ["fine café-bar: office 12, OK scope", "Fine cafe-bar: office 12, OK scope", "Fine café—bar: office 12, OK scope", "Fine café-bar: office 12, OK  scope", "Fine café-bar: office 13, OK scope", "Fine café-bar; office 12, OK scope", "Fine\ncafé-bar: office 12, OK scope"]
    texts = [base, *alike, *other, base, None, "", "", "\u200b", "\u00a0", "👩\u200d👧", "👩👧", "👩👧\u200d", "ёлка", "е\u0308лка", "ëлка"]
    df = docs(spark, texts)
    got = sorted(tuple(r) for r in canon.look_alikes(df, scratch).collect())
    group, n = [0, 1, 2, 3, 4, 12], len(texts)
    want = {(a, b) for a in group for b in group if a < b and texts[a] != texts[b]} | {(n - 5, n - 4), (n - 3, n - 2), (n - 3, n - 1), (n - 2, n - 1)}
    assert got == sorted(want)
    form = [r[1] for r in canon.canonical_texts(df).orderBy("doc_id").select("doc_id", "canonical").collect()]
    assert form[:5] == [base] * 5 and form[13] is None and form[14] == ""
    assert canon.look_alikes(df.limit(0), scratch).count() == 0


def test_p8_mass_of_copies(spark, scratch):
    df = docs(spark, ["the same note"] * 300 + ["the\u00a0same note"] * 2)
    assert canon.look_alikes(df, scratch).count() == 600


def test_canonical_form_is_stable(spark):
    df = docs(spark, ODD)
    once = canon.canonical_texts(df).select("doc_id", F.col("canonical").alias("text"))
    twice = canon.canonical_texts(once)
    assert twice.where(~F.col("text").eqNullSafe(F.col("canonical"))).count() == 0
    assert Counter(r["text"] is None for r in once.collect())[True] == 1
