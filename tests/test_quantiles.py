"""Exact quantiles by counting: equal to percentile, odd values, and one very large group in small pieces."""
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import quantiles
from tidemark.operators.quantiles import group_quantiles

QS = {"least": 0.0, "low": 0.1, "mid": 0.5, "high": 0.95, "most": 1.0}


def test_equals_percentile(spark):
    r = random.Random(2)
    rows = [("a", r.gauss(0, 1)) for _ in range(700)] + [("b", float(r.randint(-3, 3))) for _ in range(400)] + [("c", r.choice([1e-300, 5e-324, -1e300, 1e300, 0.0, -0.0]) * r.random()) for _ in range(90)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 5.0), ("gone", None), ("gone", float("nan")), ("a", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = d.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(F.count("*").alias("n"), *[F.percentile("v", q).alias(c) for c, q in QS.items()])
    for leaf in (1, 4, 50, 4096):
        got = group_quantiles(d, ["g"], "v", QS, leaf)
        assert got.columns == ["g", "n", *QS]
        assert {r.g: tuple(r)[1:] for r in got.collect()} == {r.g: tuple(r)[1:] for r in want.collect()}
    assert group_quantiles(d.where("false"), ["g"], "v", QS).collect() == []


def test_infinite_values_and_two_keys(spark):
    rows = [(1, 1, float("inf")), (1, 1, float("-inf")), (1, 1, 0.5), (1, None, 1.0), (2, 1, 4.0), (2, 1, 6.0)]
    got = {(r.a, r.b): r.mid for r in group_quantiles(spark.createDataFrame(rows, "a int, b int, v double"), ["a", "b"], "v", {"mid": 0.5}, 1).collect()}
    assert got == {(1, 1): 0.5, (1, None): 1.0, (2, 1): 5.0}


def test_one_group_of_millions_is_never_gathered(spark, monkeypatch):
    """Two million different doubles of one group: no task after the first sees more than the bins still sought."""
    n, sizes = 2_000_000, []
    d = spark.range(n, numPartitions=8).select(F.lit("g").alias("g"), (F.sqrt(F.col("id").cast("double")) * F.pi() - 1000).alias("v"))
    plain = quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: sizes.append((df.columns, (out := plain(df)).count(), out.rdd.glom().map(len).max())) or out)
    got = group_quantiles(d, ["g"], "v", {"low": 0.25, "mid": 0.5}).first()
    v = np.sort(np.sqrt(np.arange(n, dtype=float)) * np.pi - 1000)
    assert np.allclose([got.low, got.mid], np.quantile(v, [0.25, 0.5]), rtol=1e-12) and got.n == n
    kept = [count for columns, count, _ in sizes if "v" in columns]
    counted = [count for columns, count, _ in sizes if "v" not in columns]
    assert kept[-1] <= 4 * 4096 and all(b < a / 20 for a, b in zip(kept, kept[1:])) and max(counted) <= 5000
