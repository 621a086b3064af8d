"""Statistics as aggregate expressions, null where a value cannot be given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value, or null for null, NaN and infinities."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def rounded(value: Column, digits: int = 6) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def nine_numbers(value: Column, prefix: str = "") -> list[Column]:
    """count, mean, median, stdev (sample), q1, q3, iqr, min and max of the non-null values."""
    q = lambda p: F.percentile(value, F.lit(p))
    return [
        F.count(value).alias(f"{prefix}count"), F.avg(value).alias(f"{prefix}mean"), F.median(value).alias(f"{prefix}median"), F.stddev_samp(value).alias(f"{prefix}stdev"),
        q(0.25).alias(f"{prefix}q1"), q(0.75).alias(f"{prefix}q3"), (q(0.75) - q(0.25)).alias(f"{prefix}iqr"), F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"),
    ]


def overlap_ratio(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Intersection over union of two intervals; null if a bound is null or the union is empty."""
    shared = F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b))
    whole = F.greatest(high_a, high_b) - F.least(low_a, low_b)
    known = low_a.isNotNull() & high_a.isNotNull() & low_b.isNotNull() & high_b.isNotNull()
    return F.when(known, ratio(shared, whole))


def cohens_d(n_a: Column, mean_a: Column, var_a: Column, n_b: Column, mean_b: Column, var_b: Column) -> Column:
    """(mean_b - mean_a) over the pooled deviation; null with fewer than two values on a side."""
    pooled = ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
    return F.when((n_a >= 2) & (n_b >= 2) & (pooled > 0), (mean_b - mean_a) / F.sqrt(pooled))


def variation(value: Column) -> Column:
    """Coefficient of variation of a group; null below two values or at mean zero."""
    return ratio(F.stddev_samp(value), F.avg(value))


def safe_log(value: Column) -> Column:
    return F.when(finite(value) > 0, F.ln(value))


def confusion(label: Column, predicted: Column) -> list[Column]:
    """tn, fp, fn and tp over the rows that have a prediction."""
    both = lambda y, p: F.count_if((label == y) & (predicted == p))
    return [both(0, 0).alias("tn"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(1, 1).alias("tp")]


def scores_of(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """accuracy, precision, recall and f1, 0 where a denominator is 0; fpr and fnr, null there."""
    zero = F.lit(0.0)
    return {
        "accuracy": F.coalesce(ratio(tn + tp, tn + fp + fn + tp), zero), "precision": F.coalesce(ratio(tp, tp + fp), zero), "recall": F.coalesce(ratio(tp, tp + fn), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp),
    }
