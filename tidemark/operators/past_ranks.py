"""Order statistics over everything before a moment, without carrying the past along.

"The r-th smallest value of all earlier rows" is a descent by the value's place in its key's order. A level splits the places
of a node sixteen ways; one running sum per way, over rows and questions sorted together in time, says how many earlier rows
lie in each, so every question learns its way and what is left of its rank. A row is met once per level, where a growing
array would hold it once per later question.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BITS = 4


def past_ranks(facts: DataFrame, asks: DataFrame, keys: Sequence[str], at: str, value: str, ranks: str) -> DataFrame:
    """keys, ``at`` and ``found``: for each row of ``asks`` a map from rank (0 is the smallest) to the value of that rank among
    the facts of its key with a smaller ``at``.

    ``ranks`` is an array of longs. Ranks that are null, negative or not below the number of earlier facts are left out of the map;
    a row without any answer is absent. Rows of ``asks`` with the same keys and ``at`` are answered as one. Facts without a value
    or time count for nothing, NaN is the largest value, equal values take places of their own, null keys are a key, and an empty
    side gives no rows. One task sorts one key's facts, so they should be reduced to a bounded axis first, such as a row per day.
    """
    key = F.struct(*keys).alias("k")
    order = Window.partitionBy("k").orderBy("v", "at")
    f = facts.select(key, F.col(at).alias("at"), F.col(value).cast("double").alias("v")).where("at IS NOT NULL AND v IS NOT NULL")
    f = cut_lineage(f.withColumn("place", F.row_number().over(order).cast("long") - 1))
    most = f.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    levels = max(1, -(-int(most).bit_length() // BITS))
    q = asks.select(key, F.col(at).alias("at"), F.explode(ranks).alias("rank")).where("rank >= 0 AND at IS NOT NULL").distinct()
    q = q.withColumns({"node": F.lit(0).cast("long"), "left": F.col("rank")})
    ways = 1 << BITS
    for level in reversed(range(levels)):
        way = F.shiftright("place", BITS * level)
        rows = f.select("k", "at", F.lit(None).cast("long").alias("rank"), F.shiftright(way, BITS).alias("node"), F.lit(None).cast("long").alias("left"),
                        way.bitwiseAND(ways - 1).alias("way"))
        mixed = rows.unionByName(q.withColumn("way", F.lit(None).cast("long")))
        # At one time questions come before rows, so they count what is strictly earlier.
        w = Window.partitionBy("k", "node").orderBy("at", F.col("way").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        upto = [F.coalesce(F.sum((F.col("way") <= j).cast("long")).over(w), F.lit(0)).alias(f"c{j}") for j in range(ways)]
        seen = mixed.select("*", *upto).where("rank IS NOT NULL AND left < c%d" % (ways - 1))
        below = F.filter(F.array(*[f"c{j}" for j in range(ways - 1)]), lambda c: c <= F.col("left"))
        q = seen.select("k", "at", "rank", (F.col("node") * ways + F.size(below)).alias("node"),
                        (F.col("left") - F.coalesce(F.array_max(below), F.lit(0))).alias("left"))
    hit = q.join(f.select("k", F.col("place").alias("node"), "v"), ["k", "node"])
    found = hit.groupBy("k", "at").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("found"))
    return found.select("k.*", F.col("at").alias(at), "found")
