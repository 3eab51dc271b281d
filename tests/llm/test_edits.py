import random

import numpy as np
import pytest

from assayer.llm import edits, hamming, names
from assayer.session import Scratch


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def strings(rng, n):
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 24))) for _ in range(n)]
    out = set(base) | {"", "a", "\u00e9\u4e2d", "x" * 3000}
    for s in base:
        t = list(s)
        for _ in range(rng.randrange(1, 5)):
            at, what = rng.randrange(len(t) + 1), rng.choice("ids")
            if what == "i":
                t.insert(at, rng.choice("abcde"))
            elif at < len(t):
                t[at : at + 1] = [] if what == "d" else [rng.choice("abcd")]
        out.add("".join(t))
    return sorted(out)


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_banded_distance(k):
    rng = random.Random(k)
    pairs = [(a, b) for a in strings(rng, 12)[:25] for b in strings(rng, 12)[:25] if len(a) < 100 and len(b) < 100]
    (p, lp), (q, lq) = edits._codes([a for a, _ in pairs]), edits._codes([b for _, b in pairs])
    assert edits.banded_distance(p, lp, q, lq, k).tolist() == [min(distance(a, b), k + 1) for a, b in pairs]


@pytest.mark.parametrize("k", [0, 2, 3])
def test_edit_join_finds_all_pairs(spark, k):
    rng = random.Random(9 + k)
    left, right = strings(rng, 25), strings(rng, 25)
    right += [s[1:] + "q" for s in left[:20]]
    df = lambda x: spark.createDataFrame([(s,) for s in [*x, *x[:3]]] + [(None,)], "text string")
    got = {tuple(r) for r in edits.edit_join(df(left), df(right), k, Scratch(spark, "t")).collect()}
    near = lambda a, b: abs(len(a) - len(b)) <= k and (a == b or (len(a) < 100 and distance(a, b) <= k))
    want = {(a, b, 0 if a == b else distance(a, b)) for a in left for b in set(right) if near(a, b)}
    assert got == want
    assert edits.edit_join(df([]).limit(0), df(right), k, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("agree,limit", [(1, 16_384), (1, 3), (2, 16_384), (3, 16_384)])
def test_left_against_right_only(spark, agree, limit):
    rng = random.Random(agree)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values |= {x, *(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(3))}
    rows = [(v - (1 << 64) if v >> 63 else v, rng.random() < 0.4, rng.random() < 0.7) for v in sorted(values)]
    df = spark.createDataFrame(rows, "fp long, left boolean, right boolean")
    got = [tuple(r) for r in hamming.near_pairs(df, 6, Scratch(spark, "t"), sides=True, agree=agree, limit=limit).collect()]
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(a, b) for a, la, _ in rows for b, _, rb in rows if la and rb and a != b and bits(a, b) <= 6}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_shards_of_names_are_cut_up(spark):
    """Many sets that share their words with all others but for one or two."""
    common = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    sets = [sorted([*common, f"w{i // 26}{chr(97 + i % 26)}"]) for i in range(60)]
    sets += [sorted([*common[:3], f"x{i}a", f"x{i}b", f"x{i}c", f"x{i}d"]) for i in range(60)] + [sorted(common), sorted(common[:4])]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>")
    got = {tuple(sorted(r)) for r in names.similar_links(df, 0.6, Scratch(spark, "t"), limit=8).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b)) - 1e-9}
    label = lambda pairs: _components(pairs, len(sets))
    assert got <= want and label(got) == label(want) and len(got) < len(want) / 4


def _components(pairs, n):
    at = np.arange(n)
    for _ in range(n):
        for a, b in pairs:
            at[a] = at[b] = min(at[a], at[b])
    return at.tolist()
