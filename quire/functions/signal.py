"""One-dimensional signal operators on array columns, and small-grid ones."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return let(values, lambda v: total(v) / F.size(v))


def variance(values: Column) -> Column:
    """Population variance."""
    return let(values, lambda v: let(total(v) / F.size(v), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))


def differences(values: Column) -> Column:
    """Each value less the one before; one shorter than the input."""
    return let(values, lambda v: F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda b, a: b - a))


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights of radius int(4 sigma + 0.5)."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smoothed(values: Column, sigma: float = 2.0) -> Column:
    """Gaussian filter; beyond its ends the signal is mirrored, its first and last value repeated."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    kernel = F.array(*[F.struct(F.lit(k - radius).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)])

    def of(v: Column) -> Column:
        n = F.size(v)
        inside = lambda j: F.when(F.pmod(j, 2 * n) < n, F.pmod(j, 2 * n)).otherwise(2 * n - 1 - F.pmod(j, 2 * n))
        return F.transform(v, lambda _, i: F.aggregate(kernel, F.lit(0.0), lambda a, k: a + k["w"] * F.get(v, inside(i + k["d"]).cast("int"))))

    return let(values, of)


def autocorrelation(values: Column, lags: int) -> Column:
    """Of lags 0 to ``lags`` - 1, normalised by lag 0, of the centred signal."""

    def of(c: Column) -> Column:
        n = F.size(c)
        at = F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: F.when(k >= n, 0.0).otherwise(total(F.zip_with(F.slice(c, 1, F.greatest(n - k, F.lit(0))), F.slice(c, k + 1, F.greatest(n - k, F.lit(0))), lambda a, b: a * b))))
        return let(at, lambda a: F.transform(a, lambda x: x / (a[0] + 1e-10)))

    return let(values, lambda v: let(mean(v), lambda m: let(F.transform(v, lambda x: x - m), of)))


def local_maxima(values: Column) -> Column:
    """Indexes, from 0, of values greater than both neighbours."""
    return let(values, lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i > 0) & (i < F.size(v) - 1) & (F.get(v, i) > F.get(v, i - 1)) & (F.get(v, i) > F.get(v, i + 1))))


def argmin(values: Column) -> Column:
    """Index, from 0, of the first smallest value."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def valleys(values: Column) -> Column:
    """Index of the first smallest value from each local maximum up to the next."""
    return let(values, lambda v: let(local_maxima(v), lambda p: F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, k: a + argmin(F.slice(v, a + 1, F.get(p, k + 1) - a)))))


def otsu(levels: Column) -> Column:
    """Threshold of 0..255 levels with the greatest variance between classes; of equal ones the lowest."""

    def of(v: Column) -> Column:
        n = F.size(v)

        def between(t: Column) -> Column:
            low = F.filter(v, lambda x: x <= t)
            return let(F.struct(F.size(low).alias("n"), F.aggregate(low, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("all")), lambda q: F.when((q["n"] == 0) | (q["n"] == n), 0.0).otherwise(F.pow(q["s"].cast("double") * n - q["all"] * q["n"], F.lit(2.0)) / (q["n"].cast("double") * (n - q["n"]))))

        scored = F.transform(F.array_sort(F.array_distinct(v)), lambda t: F.struct(between(t).alias("b"), (-t).alias("t")))
        return -F.array_max(scored)["t"]

    return let(values_long(levels), of)


def values_long(levels: Column) -> Column:
    return F.transform(levels, lambda x: x.cast("long"))


def seam_cost(grid: Column, height: int, width: int) -> Column:
    """Cost of the cheapest path from the left to the right column of a row-major grid, moving at most one row a step."""

    def column(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.get(grid, r * width + c))

    def step(costs: Column, c: Column) -> Column:
        return F.zip_with(F.transform(costs, lambda x, r: F.least(x, F.coalesce(F.get(costs, r - 1), x), F.coalesce(F.get(costs, r + 1), x))), column(c), lambda a, b: a + b)

    return F.array_min(F.aggregate(F.sequence(F.lit(1), F.lit(width - 1)), column(F.lit(0)), step))


def clipped(values: Column, low: float = 0.0, high: float = 255.0) -> Column:
    return F.transform(values, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def brightness(values: Column, gain: float, bias: float) -> Column:
    return clipped(F.transform(values, lambda x: x * gain + bias))
