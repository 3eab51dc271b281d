"""Columns over arrays of tile scores, tile geometry and small vectors; all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import finite

RULES = ("top3", "top10pct", "p90", "mean", "fixed16_top3")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; inside a lambda it would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finite_only(a: Column) -> Column:
    return F.filter(a, finite)


def mean_of(a: Column) -> Column:
    """Mean of an array, null for an empty or null one."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def top_mean(a: Column, k: Column | int) -> Column:
    return mean_of(F.slice(F.sort_array(a, asc=False), F.lit(1), F.lit(k) if isinstance(k, int) else k))


def linear_percentile(a: Column, p: float) -> Column:
    s, at = F.sort_array(a), F.lit(p) * (F.size(a) - 1)
    lo, hi = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def thin(a: Column, k: int) -> Column:
    """k entries at evenly spaced places, both ends kept, places rounded half to even; shorter arrays stay."""
    step = (F.size(a) - 1) / F.lit(float(k - 1))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * step).cast("int")))
    return F.when(F.size(a) > k, F.transform(places, lambda i: F.get(a, i))).otherwise(a)


def aggregate_rule(a: Column, rule: str) -> Column:
    """One score of an array of tile scores; values that aren't finite don't count, an empty rest gives null."""
    if rule not in (*RULES, "top_half", "max", "median"):
        raise ValueError(f"unknown rule {rule}")
    return let(F.sort_array(finite_only(a)) if rule not in ("fixed16_top3", "mean") else finite_only(a), lambda x: _rule(x, rule))


def _rule(a: Column, rule: str) -> Column:
    """The rule on an array of finite values, sorted unless the rule looks at places."""
    if rule == "top3":
        return top_mean(a, 3)
    if rule == "top10pct":
        return top_mean(a, F.greatest(F.lit(1), F.ceil(F.lit(0.1) * F.size(a))).cast("int"))
    if rule == "fixed16_top3":
        return top_mean(thin(a, 16), 3)
    if rule == "top_half":
        return mean_of(F.slice(a, F.floor(F.size(a) / 2).cast("int") + 1, F.greatest(F.size(a), F.lit(1))))
    if rule == "max":
        return F.array_max(a)
    if rule == "mean":
        return mean_of(a)
    return linear_percentile(a, 0.9 if rule == "p90" else 0.5)


def weighted_mean(a: Column, weights: Column, least: float = 1e-3) -> Column:
    """Mean weighted by max(weight, least)."""
    w = F.transform(weights, lambda t: F.greatest(t, F.lit(least)))
    return F.aggregate(F.zip_with(a, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.aggregate(w, F.lit(0.0), lambda s, x: s + x)


def textured(tiles: Column, floor: float = 0.04, least: int = 3) -> Column:
    """Tiles (structs with x, y, texture) at or above the texture floor; if fewer than `least`, the most textured
    ones instead, in their order."""
    kept = F.filter(tiles, lambda t: t["texture"] >= floor)
    order = F.transform(tiles, lambda t, i: F.struct((-t["texture"]).alias("k"), i.alias("i"), t.alias("t")))
    best = F.transform(F.array_sort(F.transform(F.slice(F.array_sort(order), 1, least), lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t")))), lambda s: s["t"])
    return F.when(F.size(kept) < least, best).otherwise(kept)


def origins(length: Column, tile: int = 128) -> Column:
    """Tile origins along one axis: 0 for a short one, else ceil(length/tile) evenly spaced, distinct places."""
    n = F.ceil(length / F.lit(float(tile))).cast("int")
    step = (length - tile) / F.greatest(n - 1, F.lit(1)).cast("double")
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.bround(i * step).cast("int")))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(spread)


def z_scores(a: Column, eps: float = 1e-6) -> Column:
    """Each value less the mean, over the population standard deviation plus eps."""
    centred = let(a, lambda x: let(mean_of(x), lambda m: F.transform(x, lambda v: v - m)))
    return let(centred, lambda c: let(F.sqrt(mean_of(F.transform(c, lambda v: v * v))), lambda sd: F.transform(c, lambda v: v / (sd + eps))))


def dot(a: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(a, w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def grid_hash(grid: Column) -> Column:
    """16 hex digits of a difference hash: an array of 8 rows of 9 grey values, bit set where the right one is larger."""
    bits = F.flatten(F.transform(grid, lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.get(r, i + 1) > F.get(r, i), "1").otherwise("0"))))
    return F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0"))
