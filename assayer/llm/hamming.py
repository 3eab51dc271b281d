"""Pairs of 64-bit fingerprints within a few bits: pigeonhole shards, then an exact search in each shard."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shards import FIRST, WHOLE, sorted_groups
from assayer.session import Scratch

BITS = 64
#: Rows of a shard that one task searches; larger shards are cut up by further segments.
CHUNK = 16_384
#: Below this a vantage-point node is a leaf, compared outright; and shards that are compared without a tree, all at once.
LEAF, SMALL = 256, 48


def fingerprint(col: Column) -> Column:
    """The 64 bits of a valid fingerprint as a BIGINT, else null.

    Valid are 16 hex digits in either case, with or without 0x, outer blanks aside, neither all zeros nor all ones.
    """
    h = F.lower(F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*(?:0[xX])?([0-9a-fA-F]{16})\s*$", 1))
    half = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("bigint")
    bits = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    return F.when((h != "") & (h != "0" * 16) & (h != "f" * 16), bits)


def segments(agree: int, errors: int) -> list[list[int]]:
    """The bit numbers of each of errors + agree segments. Bits are dealt out in turn, so that a run of
    bits that many fingerprints share doesn't fill a whole segment."""
    n = errors + agree
    return [list(range(i, BITS, n)) for i in range(n)]


def choose_agree(n: int, errors: int) -> int:
    """How many segments must agree, by cost: rows written for each fingerprint against pairs compared.

    Two fingerprints within `errors` bits agree in at least `agree` of errors + agree segments, for any
    `agree`; more segments mean more shards for each row but far fewer rows in each.
    """
    def cost(m: int) -> float:
        keys, bits = comb(errors + m, m), m * BITS / (errors + m)
        return n * keys * 2e-6 + n * n / 2 * keys * 2.0**-bits * 1e-8

    return min(range(1, 6), key=cost)


def _masks(agree: int, errors: int) -> list[int]:
    return [sum(1 << b for b in seg) for seg in segments(agree, errors)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shard_keys(fp: str, agree: int, errors: int) -> Column:
    """The shards of a fingerprint: one for each choice of `agree` segments, named by the choice and its bits."""
    masks = _masks(agree, errors)
    return F.array(*[
        F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(_signed(sum(masks[j] for j in c))).cast("bigint")))
        for i, c in enumerate(combinations(range(agree + errors), agree))
    ])


def _near(x: np.ndarray, y: np.ndarray, errors: int):
    """Index pairs (i, j) with x[i], y[j] within `errors` bits, block by block."""
    for s in range(0, len(x), 64):
        a = x[s : s + 64, None]
        for t in range(0, len(y), 1024):
            b = y[None, t : t + 1024]
            f = np.flatnonzero(np.bitwise_count(a ^ b) <= errors)
            if len(f):
                i, j = np.divmod(f, b.shape[1])
                yield i + s, j + t


def _near_self(x: np.ndarray, errors: int):
    """Index pairs i < j with x[i], x[j] within `errors` bits."""
    for s in range(0, len(x), 64):
        for i, j in _near(x[s : s + 64], x[s:], errors):
            ok = i < j
            yield i[ok] + s, j[ok] + s


def vp_pairs(fps: np.ndarray, errors: int):
    """All index pairs of one shard within `errors` bits, each once, by a vantage-point tree; yields arrays (i, j).

    A node's fingerprints are split at the median distance to a vantage point. By the triangle inequality a
    near pair across the split has both ends within `errors` of it, so only the two boundary rings are compared
    with each other; the halves are searched in turn.
    """
    stack = [np.arange(len(fps))]
    while stack:
        at = stack.pop()
        x = fps[at]
        d, m = _split(x, x, len(at))
        if m is None:
            for i, j in _near_self(x, errors):
                yield at[i], at[j]
            continue
        inner = d <= m
        ring_in, ring_out = np.flatnonzero(inner & (d > m - errors)), np.flatnonzero(~inner & (d <= m + errors))
        for i, j in _near(x[ring_in], x[ring_out], errors):
            yield at[ring_in[i]], at[ring_out[j]]
        stack += [at[inner], at[~inner]]


def vp_cross(left: np.ndarray, right: np.ndarray, errors: int):
    """Index pairs (i, j) with left[i], right[j] within `errors` bits, by one tree over the left side that the right
    side is sent down: never a comparison within a side."""
    stack = [(np.arange(len(left)), np.arange(len(right)))]
    while stack:
        at, to = stack.pop()
        if not len(at) or not len(to):
            continue
        x, y = left[at], right[to]
        d, m = _split(x, x, max(len(at), len(to)))
        if m is None:
            for i, j in _near(x, y, errors):
                yield at[i], to[j]
            continue
        e = np.bitwise_count(y ^ x[0]).astype(np.int16)
        for p, q in (((d <= m) & (d > m - errors), (e > m) & (e <= m + errors)), ((d > m) & (d <= m + errors), (e <= m) & (e > m - errors))):
            p, q = np.flatnonzero(p), np.flatnonzero(q)
            for i, j in _near(x[p], y[q], errors):
                yield at[p[i]], to[q[j]]
        stack += [(at[d <= m], to[e <= m]), (at[d > m], to[e > m])]


def _split(x: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray | None, int | None]:
    """Distances to the vantage point and where to split them; no split for a leaf or where all are at one distance."""
    if n <= LEAF:
        return None, None
    d = np.bitwise_count(of ^ x[0]).astype(np.int16)
    m = int(np.median(d))
    if (d <= m).all():
        m -= 1
    return (d, m) if (d <= m).any() else (None, None)


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected part of the pairs: as many links as nodes, whatever the number of pairs."""
    nodes, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    p, q = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[p], label[q])
        nxt = label.copy()
        np.minimum.at(nxt, label[p], low)
        np.minimum.at(nxt, label[q], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    far = label != np.arange(len(nodes))
    return nodes[label[far]], nodes[far]


def _mix(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all 64 of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Layout:
    """Which bits the shards on a path hold fixed.

    A path names the choice of segments made at each level: the first level's in the low ten bits, those of deeper
    levels above it. A deeper level cuts the bits that the path leaves free into errors + 1 segments, of which one
    must agree, by the same pigeonhole argument.
    """

    def __init__(self, agree: int, errors: int):
        self.agree, self.errors, self.step = agree, errors, (errors + 1).bit_length()
        self.choices = list(combinations(range(agree + errors), agree))
        self.known: dict[int, list[tuple[np.ndarray, int, int]]] = {}

    def levels(self, path: int) -> list[tuple[np.ndarray, int, int]]:
        """(masks of the segments, how many agree, number of the choice) of each level of a path."""
        if path not in self.known:
            out = [(np.array(_masks(self.agree, self.errors), dtype=np.uint64), self.agree, (path & 1023) - 1)]
            rest = path >> 10
            fixed = sum(int(out[0][0][i]) for i in self.choices[out[0][2]])
            while rest:
                masks = self.deeper(fixed)
                out.append((masks, 1, (rest & ((1 << self.step) - 1)) - 1))
                fixed |= int(masks[out[-1][2]])
                rest >>= self.step
            self.known[path] = out
        return self.known[path]

    def deeper(self, fixed: int) -> np.ndarray:
        free, n = [b for b in range(BITS) if not fixed >> b & 1], self.errors + 1
        return np.array([sum(1 << b for b in free[i::n]) for i in range(n)], dtype=np.uint64)

    def fixed(self, path: int) -> int:
        out = 0
        for level, (masks, _, choice) in enumerate(self.levels(path)):
            out |= sum(int(masks[i]) for i in (self.choices[choice] if level == 0 else (choice,)))
        return out

    def children(self, path: int) -> list[tuple[int, np.uint64]]:
        """(path, bits held fixed) of the shards that rows of a path go on to."""
        at = 10
        while path >> at:
            at += self.step
        if at + self.step > 62:
            raise RuntimeError("fingerprint shards did not get smaller")
        fixed = self.fixed(path)
        return [(path | (i + 1) << at, np.uint64(fixed | int(m))) for i, m in enumerate(self.deeper(fixed))]

    def first(self, x: np.ndarray, y: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Whether x and y agree in no earlier choice than the path's, at every level: so a pair counts in one shard."""
        out = np.ones(len(x), dtype=bool)
        for p in np.unique(path).tolist():
            at = np.flatnonzero(path == p)
            z = x[at] ^ y[at]
            for level, (masks, agree, choice) in enumerate(self.levels(p)):
                same = (z[:, None] & masks[None, :]) == 0
                head = np.cumsum(same, axis=1)
                want = np.zeros(len(masks), dtype=bool)
                want[list(self.choices[choice]) if level == 0 else [choice]] = True
                out[at] &= ((same & (head <= agree)) == want).all(axis=1)
        return out


def near_pairs(
    fps: DataFrame, errors: int, scratch: Scratch, sides: bool = False, links: bool = False, agree: int | None = None, limit: int | None = None
) -> DataFrame:
    """(fa, fb) of distinct fingerprints within `errors` bits of each other, each pair once.

    fps has one row for each distinct fingerprint: fp BIGINT and, with sides=True, left and right BOOLEAN; then
    only left fingerprints are compared with right ones, and left is in fa. A pair is found in every shard that both
    ends share and reported only in the first of them. With links=True a task that finds very many pairs gives
    a star for each connected part of them instead, which keeps what is connected.

    Partitions are sorted by shard and searched one shard at a time. A shard above `limit` rows is not searched but
    cut up (`limit` is CHUNK unless given): the bits it doesn't hold fixed are segments again (Layout), and its rows go on to smaller shards in the
    next round. Fingerprints are distinct, so a shard with few free bits is small, and the rounds end.
    """
    n = fps.count()
    agree, limit = agree or choose_agree(n, errors), limit or CHUNK
    layout = Layout(agree, errors)
    side = ((F.col("left").cast("int") + 2 * F.col("right").cast("int")) if sides else F.lit(3)).cast("bigint")
    rows = fps.select(F.col("fp").alias("fa"), side.alias("side"), F.posexplode(shard_keys("fp", agree, errors)).alias("choice", "key"))
    rows = rows.select("key", (F.col("choice") + 1).cast("bigint").alias("path"), "fa", "side")

    def search(batches):
        import pyarrow as pa

        def batch(fa, fb, key=None, path=None, side=None):
            none = pa.nulls(len(fa), pa.int64())
            cols = [none if c is None else pa.array(c.astype(np.int64, copy=False)) for c in (fa.view(np.int64), fb, key, path, side)]
            return pa.RecordBatch.from_arrays(cols, names=["fa", "fb", "key", "path", "side"])

        needed = True
        for kind, t in sorted_groups(batches, "key", limit):
            fp, path, sd = t["fa"].view(np.uint64), t["path"], t["side"]
            if kind != WHOLE:
                if kind == FIRST:  # left rows come first: a shard without any has no pairs
                    needed = not sides or bool((sd & 1).any())
                if needed:
                    for p in np.unique(path).tolist():
                        at = path == p
                        for child, mask in layout.children(p):
                            with np.errstate(over="ignore"):
                                key = _mix((fp[at] & mask) ^ _mix(np.full(at.sum(), child, dtype=np.uint64)))
                            yield batch(fp[at], None, key.view(np.int64), np.full(at.sum(), child), sd[at])
                continue
            held, n_held = [], 0
            for i, j in _shard_pairs(t["key"], fp, sd, errors, sides):
                ok = np.bitwise_count(fp[i] ^ fp[j]) <= errors
                ok &= fp[i] != fp[j]
                i, j = i[ok], j[ok]
                ok = layout.first(fp[i], fp[j], path[i])
                held.append((i[ok], j[ok]))
                n_held += int(ok.sum())
                if n_held > 1_000_000:
                    i, j = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    if links:
                        held = [forest(i, j)]
                        n_held = len(held[0][0])
                    else:
                        yield batch(fp[i], fp[j].view(np.int64))
                        held, n_held = [], 0
            if n_held:
                yield batch(fp[np.concatenate([h[0] for h in held])], fp[np.concatenate([h[1] for h in held])].view(np.int64))

    out = None
    while True:
        order = ["key", F.col("side") == 2] if sides else ["key"]
        got = rows.repartition("key").sortWithinPartitions(*order).mapInArrow(search, "fa bigint, fb bigint, key bigint, path bigint, side bigint")
        got = scratch.write(got, "near")
        found = got.where("key is null").select("fa", "fb")
        out = found if out is None else out.union(found)
        rows = got.where("key is not null").select("key", "path", "fa", "side")
        if not rows.limit(1).count():
            return out


def _shard_pairs(key: np.ndarray, fp: np.ndarray, side: np.ndarray, errors: int, sides: bool):
    """Candidate index pairs within each shard of a block: small shards compared outright, all at once, others by tree."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.concatenate((start, [len(key)])))
    if not sides:
        small = np.repeat(length, length) <= SMALL
        for step in range(1, min(SMALL, int(length.max(initial=0)))):
            i = np.flatnonzero((key[:-step] == key[step:]) & small[:-step])
            yield i, i + step
        for s, n in zip(start[length > SMALL].tolist(), length[length > SMALL].tolist(), strict=True):
            for i, j in vp_pairs(fp[s : s + n], errors):
                yield i + s, j + s
        return
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    shard = np.repeat(np.arange(len(start)), length)
    nl, nr = np.bincount(shard[left], minlength=len(start)), np.bincount(shard[right], minlength=len(start))
    sl, sr = np.concatenate(([0], np.cumsum(nl))), np.concatenate(([0], np.cumsum(nr)))
    pairs = nl * nr
    small = np.flatnonzero((pairs > 0) & (pairs <= SMALL * SMALL))
    for s in range(0, len(small), 4096):
        g = small[s : s + 4096]
        each = pairs[g]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        i, j = np.divmod(at, np.repeat(nr[g], each))
        yield left[np.repeat(sl[g], each) + i], right[np.repeat(sr[g], each) + j]
    for g in np.flatnonzero(pairs > SMALL * SMALL).tolist():
        a, b = left[sl[g] : sl[g + 1]], right[sr[g] : sr[g + 1]]
        for i, j in vp_cross(fp[a], fp[b], errors):
            yield a[i], b[j]


def near_pairs_brute(values: list[int], errors: int) -> set[tuple[int, int]]:
    """All pairs by comparison of everything with everything, for tests."""
    x = np.array([v & (2**64 - 1) for v in values], dtype=np.uint64)
    return {tuple(sorted((values[a], values[b]))) for i, j in _near(x, x, errors) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}
