"""Number functions: vectors, intervals, fusion terms. Sums over vectors are left folds, so their bits do not vary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rms(values: Column) -> Column:
    """Root of the mean square; an empty array is an error."""
    guarded = F.when(F.size(values) > 0, values).otherwise(F.raise_error(F.lit("rms of no values")).cast("array<double>"))
    return F.sqrt(fold_sum(F.transform(guarded, lambda v: v * v)) / F.size(values))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return fold_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column) -> Column:
    """The vector over its norm; null for no numbers, a zero norm, or values that are not finite."""
    n = norm(a)
    fine = (F.size(a) > 0) & (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(fine, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector the best dot product with a document vector, summed in order."""
    return fold_sum(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))))


def mean_absolute_difference(a: Column, b: Column) -> Column:
    return fold_sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(a)


def rrf(rank: Column, k: float = 60.0, weight: float = 1.0) -> Column:
    """weight / (k + rank), and 0 where there is no rank."""
    return F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + rank), F.lit(0.0))


def point_distance(x: Column, start: Column, end: Column) -> Column:
    """Distance of a point from a closed interval."""
    return F.greatest(start - x, x - end, F.lit(0))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of closed whole-number intervals; 0 if disjoint, an error if one is upside down."""
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    value = both / ((a1 - a0 + 1) + (b1 - b0 + 1) - both)
    return F.when((a0 <= a1) & (b0 <= b1), value).otherwise(F.raise_error(F.lit("inverted interval")).cast("double"))


def uniform_indices(n: Column, count: int) -> Column:
    """count indices spread over 0..n-1 with halves rounded to even, distinct and in order; all if there are no more than count."""
    if count < 1:
        raise ValueError("count must be at least 1")
    every = F.sequence(F.lit(0), n - 1)
    if count == 1:
        return F.array(F.lit(0))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (n - 1) / F.lit(float(count - 1))).cast("int"))
    return F.when(n <= count, every).otherwise(F.array_distinct(spread))


def interior_fractions(k: int) -> list[float]:
    if k not in (1, 2, 3):
        raise ValueError("k must be 1, 2 or 3")
    return [r / (k + 1) for r in range(1, k + 1)]


def top_peaks(scored: Column, top_k: int, min_separation: int) -> Column:
    """Greedy non-maximum suppression over array<struct<score double, frame int>>.

    In order of falling score, then rising frame, a frame is taken if it is
    ``min_separation`` or more from all that were taken; it ends at ``top_k``.
    Scores that are not finite are dropped; no frames for top_k of 0 or less.
    """
    fine = F.filter(scored, lambda s: s["score"].isNotNull() & ~F.isnan(s["score"]) & (F.abs(s["score"]) < float("inf")))
    ordered = F.array_sort(F.transform(fine, lambda s: F.struct((-s["score"]).alias("neg"), s["frame"].cast("int").alias("frame"))))
    empty = F.array().cast("array<struct<neg:double,frame:int>>")

    def step(taken: Column, s: Column) -> Column:
        free = F.forall(taken, lambda t: F.abs(t["frame"] - s["frame"]) >= min_separation)
        return F.when((F.size(taken) < top_k) & free, F.concat(taken, F.array(s))).otherwise(taken)

    return F.transform(F.aggregate(ordered, empty, step), lambda t: F.struct((-t["neg"]).alias("score"), t["frame"].alias("frame")))
