"""SHA-256 of many short messages: by the interpreter's digest, or where all share a long start, in numpy, a lane for each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

try:
    from _sha2 import sha256  # the interpreter's own: less than half of OpenSSL's cost on a short message
except ImportError:
    from hashlib import sha256

#: Numbers hashed at once, and lanes.
PIECE, LANES = 65_536, 16_384
#: Shifts whose nesting gives the two sums of a round and the two of the schedule: rotations to the right as shifts to both sides.
SUM_0, SUM_1 = ((9, 11, 2), (11, 9, 10)), ((14, 5, 6), (5, 14, 7))
LOW_0, LOW_1 = ((11, 4, 3), (11, 14)), ((2, 7, 10), (2, 13))
SHIFT = [np.array(i, dtype=np.uint32) for i in range(32)]


@lru_cache(maxsize=8)
def _digits(first: int, last: int) -> list[bytes]:
    return [b"%d" % i for i in range(first, last)]


def numbered_heads(prefix: bytes, n: int) -> np.ndarray:
    """n uint32: the first 32 bits of the digests of prefix followed by 0, 1, ... n-1 in digits."""
    out = np.empty(n, dtype=np.uint32)
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        out[at:to] = np.frombuffer(b"".join([sha256(prefix + i).digest()[:4] for i in _digits(at, to)]), dtype=">u4")
    return out


def _roots(power: int, count: int) -> np.ndarray:
    """The first 32 fractional bits of the square or cube roots of the first primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, p))][:count]
    out = []
    for p in primes:
        whole = 0
        for bit in range(36, -1, -1):
            if (whole | 1 << bit) ** power <= p << 32 * power:
                whole |= 1 << bit
        out.append(whole % 2**32)
    return np.array(out, dtype=np.uint32)


START, ROUND = _roots(2, 8), _roots(3, 64)


def _mixed(v: np.ndarray, shifts: tuple, out: np.ndarray, spare: np.ndarray) -> None:
    """out = the XOR of v's shifts: ((v >> a ^ v) >> b ^ v) >> c, and the same to the left."""
    for way, by, at in ((np.right_shift, shifts[0], out), (np.left_shift, shifts[1], spare)):
        way(v, SHIFT[by[0]], out=at)
        for s in by[1:]:
            np.bitwise_xor(at, v, out=at)
            way(at, SHIFT[s], out=at)
    np.bitwise_xor(out, spare, out=out)


def schedule(words: np.ndarray) -> np.ndarray:
    """(64, lanes) round words, constants added, of the (16, lanes) words of a block."""
    w = np.empty((64, words.shape[1]), dtype=np.uint32)
    w[:16] = words
    x, y = np.empty_like(w[0]), np.empty_like(w[0])
    for t in range(16, 64):
        np.add(w[t - 16], w[t - 7], out=w[t])
        for back, shifts in ((15, LOW_0), (2, LOW_1)):
            _mixed(w[t - back], shifts, x, y)
            np.add(w[t], x, out=w[t])
    w += ROUND[:, None]
    return w


def compress(state: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(8, lanes): the state, (8,) or (8, lanes), after a block of these round words."""
    state = np.broadcast_to(state[:, None] if state.ndim == 1 else state, (8, w.shape[1]))
    a, b, c, d, e, f, g, h = (v.copy() for v in state)
    x, y, ab = np.empty_like(a), np.empty_like(a), np.empty_like(a)
    bc = b ^ c
    for t in range(64):
        np.add(h, w[t], out=h)
        _mixed(e, SUM_1, x, y)
        np.add(h, x, out=h)
        np.bitwise_xor(f, g, out=x)  # of e's bits: f's where set, else g's
        np.bitwise_and(x, e, out=x)
        np.bitwise_xor(x, g, out=x)
        np.add(h, x, out=h)
        np.add(d, h, out=d)
        _mixed(a, SUM_0, x, y)
        np.add(h, x, out=h)
        np.bitwise_xor(a, b, out=ab)  # the majority of a, b and c
        np.bitwise_and(bc, ab, out=bc)
        np.bitwise_xor(bc, b, out=bc)
        np.add(h, bc, out=h)
        ab, bc = bc, ab
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _words(octets: np.ndarray) -> np.ndarray:
    """(words, lanes) of (bytes, lanes)."""
    b = octets.reshape(-1, 4, octets.shape[1]).astype(np.uint32)
    return b[:, 0] << 24 | b[:, 1] << 16 | b[:, 2] << 8 | b[:, 3]


@lru_cache(maxsize=8)
def _counters(first: int, last: int, copies: int) -> np.ndarray:
    """(64, copies * numbers) round words of the block that holds what follows 64 bytes: a colon and the digits of first..last-1."""
    octets = np.zeros((64, last - first), dtype=np.uint8)
    for lane, i in enumerate(range(first, last)):
        text = b":%d\x80" % i
        octets[: len(text), lane] = np.frombuffer(text, dtype=np.uint8)
        octets[-8:, lane] = np.frombuffer(((63 + len(text)) * 8).to_bytes(8, "big"), dtype=np.uint8)
    return np.tile(schedule(_words(octets)), (1, copies))


def counted_bytes(keys: list[bytes], size: int) -> Iterator[bytes]:
    """For each key of 64 bytes `size` bytes: the digests of the key, a colon and a counter from 0, one after the other."""
    if not keys:
        return
    n = -(-size // 32)
    together = max(1, LANES // n)
    states = compress(START, schedule(_words(np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 64).T)))
    for at in range(0, len(keys), together):
        own = states[:, at : at + together]
        parts = []
        for first in range(0, n, LANES):
            m = min(n - first, LANES)
            got = compress(np.repeat(own, m, axis=1), _counters(first, first + m, together)[:, : m * own.shape[1]])
            parts.append(got.reshape(8, -1, m).transpose(1, 2, 0))
        for picture in np.concatenate(parts, axis=1).astype(">u4"):
            yield picture.tobytes()[:size]
