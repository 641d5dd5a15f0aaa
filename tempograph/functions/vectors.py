"""Column expressions over array<double> vectors, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it (also within lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    """Sum of a vector."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l1_normalise(v: Column, least: float = 1e-12) -> Column:
    """The vector over its sum; unchanged where the sum is too small."""
    return let(v, lambda w: let(total(w), lambda s: F.when(s <= least, w).otherwise(F.transform(w, lambda x: x / s))))


def l2_norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalise(v: Column) -> Column:
    return let(v, lambda w: let(l2_norm(w), lambda n: F.when(n == 0, w).otherwise(F.transform(w, lambda x: x / n))))


def cosine(a: Column, b: Column, empty: float = 0.0) -> Column:
    """M4: cosine similarity; ``empty`` where a norm is zero."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: let(l2_norm(p["a"]) * l2_norm(p["b"]), lambda n: F.when(n == 0, F.lit(empty)).otherwise(dot(p["a"], p["b"]) / n)))


def vector_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by) -> Column:
    return F.transform(v, lambda x: x * by)


def argmax_first(v: Column) -> Column:
    """Index (from 0) of the largest value; the lowest index wins a tie."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def fold(v: Column, classes: int = 12, first: int = 0) -> Column:
    """A10: sums of the vector's values by (index + first) mod classes."""

    def classes_of(w: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(w) - 1)
        one = lambda c: F.aggregate(F.filter(spots, lambda i: F.pmod(i + first, F.lit(classes)) == c), F.lit(0.0), lambda acc, i: acc + F.get(w, i))
        return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), one)

    return let(v, classes_of)


def interpolate(v: Column, at: Column) -> Column:
    """R2: linear interpolation into a vector at a fractional index; null outside."""
    low = F.floor(at).cast("int")
    a, b = F.get(v, low), F.get(v, low + 1)
    return F.when((at < 0) | (low >= F.size(v)), None).when(at == low, a).otherwise(a + (at - low) * (b - a))


def flux(now: Column, before: Column) -> Column:
    """Half-wave rectified difference, summed over bands."""
    return total(F.zip_with(now, before, lambda x, y: F.greatest(F.lit(0.0), x - y)))


def clamp01(x: Column) -> Column:
    """Into [0, 1]; NaN and null become 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def is_flat(v: Column, least: float = 1e-9) -> Column:
    """P5: no value above the least."""
    return ~F.exists(v, lambda x: x > least)


def is_silent(v: Column, least: float = 1e-4) -> Column:
    """The peak is under the least."""
    return F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0)) < least


def java_round(x: Column) -> Column:
    """H6: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def snap(x: Column, step) -> Column:
    """To the nearest multiple of the step, halves up."""
    return F.floor(x / step + F.lit(0.5)) * step


def snap_even(x: Column, step, most=None) -> Column:
    """To the nearest multiple of the step, halves to even; clamped to [0, most]."""
    y = F.rint(x / step) * step
    return y if most is None else F.greatest(F.lit(0.0), F.least(F.lit(most), y))
