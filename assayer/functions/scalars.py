"""Scalar columns: bands, geometry, names, verdict words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band_of(x: Column, edges: list[float]) -> Column:
    """Index of the band [edge, next edge); the last band also takes what lies below the first edge, null stays null."""
    k = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1
    return F.when(x.isNotNull(), F.when(k < 0, len(edges) - 1).otherwise(k))


def longest(w: str = "w", h: str = "h") -> Column:
    return F.greatest(w, h)


def aspect(w: str = "w", h: str = "h") -> Column:
    return F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))


def capped_size(w: str, h: str, cap: int = 2048) -> tuple[Column, Column, Column]:
    """(was_capped, width, height) with the longer side at most `cap`, sizes rounded half to even, at least 1."""
    over = F.greatest(w, h) > cap
    scale = F.lit(float(cap)) / F.greatest(w, h)
    side = lambda c: F.when(over, F.greatest(F.lit(1), F.bround(F.col(c) * scale).cast("int"))).otherwise(F.col(c))
    return over, side(w), side(h)


def degraded_size(w: str, h: str, share: float = 0.75, cap: int = 2048) -> tuple[Column, Column]:
    """Width and height after shrinking to a share, rounded half to even, and then to the cap."""
    small = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * F.lit(share)).cast("int"))
    sw, sh = small(w), small(h)
    scale = F.lit(float(cap)) / F.greatest(sw, sh)
    fit = lambda c: F.when(F.greatest(sw, sh) > cap, F.greatest(F.lit(1), F.bround(c * scale).cast("int"))).otherwise(c)
    return fit(sw), fit(sh)


def bytes_per_pixel(size: Column, w: str, h: str) -> Column:
    return size / F.greatest(F.col(w).cast("double") * F.col(h), F.lit(1.0))


def percent_box(x: Column, y: Column, bw: Column, bh: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, width and height of a box in percent of the picture."""
    return x * 100.0 / w, y * 100.0 / h, bw * 100.0 / w, bh * 100.0 / h


def overlap_area(x: Column, y: Column, w: Column, h: Column, mx: Column, my: Column, mw: Column, mh: Column) -> Column:
    """Pixels that two rectangles share."""
    side = lambda a, n, b, m: F.greatest(F.lit(0), F.least(a + n, b + m) - F.greatest(a, b))
    return side(x, w, mx, mw).cast("double") * side(y, h, my, mh)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def class_guess(path: Column) -> Column:
    """'ai' or 'real' by the deepest folder whose name says so, else null."""
    folders = F.slice(F.split(F.lower(path), r"[/\\]"), F.lit(1), F.greatest(F.size(F.split(path, r"[/\\]")) - 1, F.lit(0)))
    words = F.filter(F.transform(folders, lambda f: F.when(f.contains("real"), "real").when(f.contains("ai"), "ai")), lambda x: x.isNotNull())
    return F.try_element_at(words, F.lit(-1))


def safe_name(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 16)


def hash_seed(name: Column) -> Column:
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")


def decide(score: Column, threshold: Column) -> Column:
    """'ai' at or above the threshold, else 'insufficient'; null where the arm has no score. Never 'real'."""
    return F.when(score.isNull() | threshold.isNull(), None).when(score >= threshold, "ai").otherwise("insufficient")


def combine(bands: Column) -> tuple[Column, Column]:
    """(label, triggered): OR over an ordered array of (name, band); arms without a band don't count."""
    hit = F.filter(bands, lambda b: b["band"].eqNullSafe(F.lit("ai")))
    return F.when(F.size(hit) > 0, "ai").otherwise("insufficient"), F.transform(hit, lambda b: b["name"])


def caveats(w: str, h: str, bpp: str) -> Column:
    return F.array_compact(F.array(F.when(F.greatest(w, h) > 2048, "capped"), F.when(F.col(bpp) <= 0.30, "strong_compression")))


def route(w: str, h: str) -> Column:
    """Which method judges a picture of this size."""
    side = F.greatest(w, h)
    return F.when(side.isNull(), None).when(side >= 700, "tiles").when(side < 128, "small").otherwise("cnn")


def display(p: Column) -> tuple[Column, Column]:
    """(word, percent): 'uncertain' within 0.1 of even odds; percent kept within [0.1, 99.9]."""
    word = F.when(F.abs(p - 0.5) < 0.1, "uncertain").when(p >= 0.5, "ai").otherwise("real")
    return word, F.least(F.lit(99.9), F.greatest(F.lit(0.1), p * 100))
