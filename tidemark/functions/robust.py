"""Robust statistics as array expressions (no UDF).

A baseline is an array column. Frames that feed it are bounded by a rule's window,
so the arrays stay small whatever the table size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import K_IQR, K_MAD


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Plain column reuse would be copied into every expression the optimizer moves (a pushed-down
    filter, say); a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def sorted_finite(values: Column) -> Column:
    """Ascending array without nulls and non-finite values."""
    def drop_odd(v: Column) -> Column:  # nulls sort first, NaN last, infinities at the ends
        ends = F.array(F.get(v, 0), F.get(v, F.size(v) - 1))
        odd = F.exists(ends, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
        finite = F.filter(v, lambda e: ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
        return F.when(odd & (F.size(v) > 0), finite).otherwise(v)

    return let(F.sort_array(values), drop_odd)


def array_quantile(sorted_values: Column, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array; null when it is empty."""
    rank = (F.size(sorted_values) - 1) * F.lit(float(p))
    low = F.floor(rank).cast("int")
    high = F.ceil(rank).cast("int")
    a = F.get(sorted_values, low)
    b = F.get(sorted_values, high)
    return F.when(F.size(sorted_values) > 0, a + (b - a) * (rank - low))


def robust_z(x: Column, baseline: Column, min_n: int) -> Column:
    """struct<z, method, baseline_median, scale, n_baseline, reason> of x against an array that does not contain x.

    The scale is the MAD; where that is zero the inter-quartile range stands in, and where
    both are zero, history is short or x is missing the score is withheld with a reason.
    """
    missing = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    def spread(b: Column) -> Column:
        return F.struct(b.alias("b"), array_quantile(b, 0.5).alias("med"),
                        (array_quantile(b, 0.75) - array_quantile(b, 0.25)).alias("iqr"))

    def scales(s: Column) -> Column:
        deviations = F.sort_array(F.transform(s["b"], lambda v: F.abs(v - s["med"])))
        return F.struct(F.size(s["b"]).alias("n"), s["med"].alias("med"), s["iqr"].alias("iqr"),
                        array_quantile(deviations, 0.5).alias("mad"))

    def score(s: Column) -> Column:
        short = s["n"] < min_n
        flat = (s["mad"] <= 0) & (s["iqr"] <= 0)
        held = missing | short | flat
        return F.struct(
            F.when(held, None).when(s["mad"] > 0, F.lit(K_MAD) * (x - s["med"]) / s["mad"])
            .otherwise(F.lit(K_IQR) * (x - s["med"]) / s["iqr"]).alias("z"),
            F.when(held, "suppressed").when(s["mad"] > 0, "MAD").otherwise("IQR-fallback").alias("method"),
            F.when(missing, None).otherwise(s["med"]).alias("baseline_median"),
            F.when(held, None).when(s["mad"] > 0, s["mad"]).otherwise(s["iqr"]).alias("scale"),
            s["n"].alias("n_baseline"),
            F.when(missing, "current value missing")
            .when(short, F.concat(F.lit("insufficient history ("), s["n"].cast("string"), F.lit(f" < {min_n})")))
            .when(flat, "insufficient variability (MAD and IQR are zero)").otherwise("").alias("reason"))

    return let(sorted_finite(baseline), lambda b: let(spread(b), lambda s: let(scales(s), score)))


def with_robust_z(df: DataFrame, x: str, baseline: str, min_n: int) -> DataFrame:
    """Add z, method, baseline_median, scale, n_baseline and reason for ``x`` against an array column.

    The score goes through a one-element ``inline``: neither filters nor projections on its parts can be
    moved below a generator, so it is computed once per row.
    """
    return df.select("*", F.inline(F.array(robust_z(F.col(x), F.col(baseline), min_n))))


def quantile_position(x: Column, baseline: Column) -> Column:
    """Share of the baseline at or below x; null for an empty baseline."""
    kept = F.filter(baseline, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(kept) > 0, F.size(F.filter(kept, lambda v: v <= x)) / F.size(kept))
