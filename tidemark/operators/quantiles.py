"""Exact quantiles of groups of any size in bounded memory: the bin that holds a rank is found, then the bin within it.

``percentile`` keeps every distinct value of a group in one place. Here a group is only ever counted: first by sign and power
of two, then by a thousand even steps inside the bin a rank falls into, until that bin is small or holds one value. Each
round counts with partial aggregation, and only rows of the bins still sought go on to the next.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

STEPS = 1024                    # bins of one round, within a bin of the last
LEAF = 4096                     # values that may be sorted together


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: sign and power of two, zero between the signs."""
    power = F.greatest(F.floor(F.log2(F.abs(v))) + 1100, F.lit(1)).cast("int")
    return F.when(v == 0, 0).when(v > 0, power).otherwise(-power)


def _step(v: Column, lo: Column, hi: Column) -> Column:
    """Even steps of [lo, hi]; halves keep the width finite, and rounding keeps the order."""
    return F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * STEPS), F.lit(STEPS - 1)).cast("int")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], leaf: int = LEAF) -> DataFrame:
    """keys, n, and one column per named quantile, interpolated linearly as ``percentile`` does.

    Null and NaN values count for nothing, a group of only those is absent; null keys are a group. Infinite values are values.
    No task holds more than ``leaf`` values of a group, and no shuffle carries more than its partial counts.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.struct(*keys).alias("k"), v.alias("v"), F.lit("").alias("node"))
    rows = rows.withColumn("b", F.when(F.abs("v") == float("inf"), F.signum("v").cast("int") * 9999).otherwise(_magnitude(F.col("v"))))
    wanted = totals = None
    found = []
    while True:
        bins = cut_lineage(rows.groupBy("k", "node", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        if wanted is None:
            totals = bins.groupBy("k").agg(F.sum("n").alias("n"))
            places = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles.values()]
            ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
            wanted = totals.select("k", F.lit("").alias("node"), F.explode(ranks).alias("rank")).withColumn("r", F.col("rank"))
        before = F.sum("n").over(Window.partitionBy("k", "node").orderBy("b")) - F.col("n")     # as many rows as a round has bins
        hit = wanted.join(bins.withColumn("before", before), ["k", "node"]).where("r >= before AND r < before + n")
        hit = cut_lineage(hit.select("k", "rank", (F.col("r") - F.col("before")).alias("r"), "node", "b", F.concat_ws("/", "node", F.col("b").cast("string")).alias("next"), "n", "lo", "hi"))
        found.append(hit.where("lo = hi").select("k", "rank", F.col("lo").alias("value")))
        open_ = hit.where("lo < hi")
        nodes = open_.select("k", "node", "b", "next", "n", "lo", "hi").distinct()
        rows = cut_lineage(rows.select("k", "node", "b", "v").join(nodes, ["k", "node", "b"]).select("k", F.col("next").alias("node"), "v", "n", "lo", "hi"))
        small = rows.where(F.col("n") <= leaf).groupBy("k", "node").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        found.append(open_.where(F.col("n") <= leaf).select("k", F.col("next").alias("node"), "rank", "r").join(small, ["k", "node"])
                     .select("k", "rank", F.element_at("vs", (F.col("r") + 1).cast("int")).alias("value")))
        wanted = open_.where(F.col("n") > leaf).select("k", F.col("next").alias("node"), "rank", "r")
        if wanted.isEmpty():
            break
        rows = rows.where(F.col("n") > leaf).select("k", "node", "v", _step(F.col("v"), F.col("lo"), F.col("hi")).alias("b"))
    known = reduce(DataFrame.unionByName, found).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))
    out = totals.join(known, "k")

    def between(q: float) -> Column:
        place = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("m", low), F.element_at("m", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)
    return out.select("k.*", "n", *[between(q).alias(name) for name, q in quantiles.items()])
