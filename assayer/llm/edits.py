"""Edit-distance segment join: pairs of strings of two sides within k insertions, deletions or substitutions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import Scratch


def segment_starts(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 even segments of a string; the last ones are longer by one where it doesn't divide."""
    n = k + 1
    short, more = divmod(length, n)
    sizes = [short] * (n - more) + [short + 1] * more
    ends = np.cumsum([0, *sizes]).tolist()
    return list(zip(ends[:-1], sizes, strict=True))


def allowed_starts(own: int, other: int, i: int, start: int, size: int, k: int) -> range:
    """Where the i-th segment of a string of length `other` can start in a string of length `own` within k edits.

    At most i edits lie before segment i and at most k - i after it, if segment i is the first that matches or, seen
    from the end, the last; so the place is off by at most i from the left and by at most k - i from the right.
    """
    shift = own - other
    low = max(0, start - i, start + shift - (k - i))
    high = min(own - size, start + i, start + shift + (k - i))
    return range(low, high + 1)


def banded_distance(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, k: int) -> np.ndarray:
    """Edit distance of each row's strings, k + 1 where it is larger: a dynamic programme on the 2k + 1 diagonals, all rows at once.

    a, b: character codes, padded on the right; la, lb: lengths.
    """
    rows, width, far = len(a), 2 * k + 1, k + 1
    # cell d of a row of the band stands for column j = i + d - k
    band = np.minimum(np.abs(np.arange(width) - k)[None, :] + np.where(np.arange(width) < k, far, 0)[None, :], far).repeat(rows, axis=0).astype(np.int16)
    result = np.where(la == 0, np.minimum(lb, far), far).astype(np.int16)
    pad = np.full((rows, k + 1), -1, dtype=b.dtype)
    shifted = np.concatenate((pad[:, :k], b, np.full((rows, a.shape[1] + width), -1, dtype=b.dtype)), axis=1)
    for i in range(1, a.shape[1] + 1):
        j = i + np.arange(width) - k
        cost = (a[:, i - 1 : i] != shifted[:, i - 1 : i - 1 + width]).astype(np.int16)
        nxt = np.minimum(band + cost, far)
        nxt[:, :-1] = np.minimum(nxt[:, :-1], band[:, 1:] + 1)
        nxt[:, j < 0] = far
        if k >= i:
            nxt[:, k - i] = i
        for d in range(1, width):
            if j[d] >= 1:
                nxt[:, d] = np.minimum(nxt[:, d], nxt[:, d - 1] + 1)
        band = np.minimum(nxt, far)
        done = np.flatnonzero(la == i)
        at = lb[done] - i + k
        ok = (at >= 0) & (at < width)
        result[done[ok]] = band[done[ok], at[ok]]
    return result


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), int(n.max(initial=0))), -2, dtype=np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
    return out, n


def edit_join(left: DataFrame, right: DataFrame, k: int, scratch: Scratch, text: str = "text") -> DataFrame:
    """(a, b, distance): each pair of a left and a right string within k edits, once; equal strings have distance 0.

    Left strings are cut into k + 1 segments, of which k edits leave one whole; right strings give the substrings that
    stand at an allowed place for some left length. Pairs that meet are verified by banded dynamic programming, in Arrow
    batches. Each different string counts once, nulls match nothing, and a hot segment is split by adaptive execution.
    Lengths that no left string has give no substrings. A lone segment that half of all strings share still makes every
    pair of them a candidate, so k should leave segments of some length.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    ls = scratch.write(left.select(F.col(text).alias("a")).where("a is not null").distinct(), "left")
    rs = scratch.write(right.select(F.col(text).alias("b")).where("b is not null").distinct(), "right")
    lengths = sorted(r[0] for r in ls.select(F.length("a")).distinct().collect())  # at most as many as the longest string has characters
    by_length = {n: segment_starts(n, k) for n in lengths}

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            own, key, i_, n_ = [], [], [], []
            for t in b.column(0).to_pylist():
                for i, (s, m) in enumerate(by_length[len(t)]):
                    own.append(t), key.append(t[s : s + m]), i_.append(i), n_.append(len(t))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(key, pa.string()), pa.array(i_, pa.int32()), pa.array(n_, pa.int32())], names=["a", "seg", "i", "n"])

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            own, key, i_, n_ = [], [], [], []
            for t in b.column(0).to_pylist():
                for n in range(max(0, len(t) - k), len(t) + k + 1):
                    for i, (s, m) in enumerate(by_length.get(n, ())):
                        for at in allowed_starts(len(t), n, i, s, m, k):
                            own.append(t), key.append(t[at : at + m]), i_.append(i), n_.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(key, pa.string()), pa.array(i_, pa.int32()), pa.array(n_, pa.int32())], names=["b", "seg", "i", "n"])

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            xs, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s in range(0, len(xs), 4096):
                (p, lp), (q, lq) = _codes(xs[s : s + 4096]), _codes(ys[s : s + 4096])
                d = banded_distance(p, lp, q, lq, k)
                ok = np.flatnonzero(d <= k)
                yield pa.RecordBatch.from_arrays([pa.array([xs[s + i] for i in ok], pa.string()), pa.array([ys[s + i] for i in ok], pa.string()), pa.array(d[ok].astype(np.int32))], names=["a", "b", "distance"])

    digest = F.xxhash64("n", "i", "seg").alias("key")
    keys = ls.mapInArrow(cut, "a string, seg string, i int, n int").select("a", digest)
    asked = rs.mapInArrow(probe, "b string, seg string, i int, n int").select("b", digest)
    met = keys.join(asked, "key").select("a", "b").distinct()
    return met.mapInArrow(verify, "a string, b string, distance int")
