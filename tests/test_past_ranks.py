import random

import numpy as np

from tidemark.operators.past_ranks import past_ranks
from tidemark.plans.thermal import _quantile_with, _ranks_near
from pyspark.sql import functions as F


def test_ranks_of_all_earlier_rows(spark):
    rng = random.Random(4)
    facts = [(rng.choice(["a", "a", "a", None]), rng.randrange(300), rng.choice([1.0, 2.0, rng.random() * 9, None])) for _ in range(1500)]
    asks = [(k, t, [0, 1, 7, 40, 10 ** 6, -1, None]) for k in ("a", None, "none") for t in range(0, 320, 9)]
    got = {(r.s, r.t): r.found for r in past_ranks(spark.createDataFrame(facts, "s string, t int, v double"),
                                                   spark.createDataFrame(asks, "s string, t int, r array<long>"), ["s"], "t", "v", "r").collect()}
    want = {}
    for k, t, ranks in asks:
        past = sorted(v for s, at, v in facts if s == k and at < t and v is not None)
        answer = {r: past[r] for r in ranks if r is not None and 0 <= r < len(past)}
        if answer:
            want[k, t] = answer
    assert got == want


def test_empty_sides(spark):
    facts, asks = spark.createDataFrame([], "s string, t int, v double"), spark.createDataFrame([], "s string, t int, r array<long>")
    assert past_ranks(facts, asks, ["s"], "t", "v", "r").collect() == []
    one = spark.createDataFrame([("a", 1, 2.0)], "s string, t int, v double")
    assert past_ranks(one, spark.createDataFrame([("a", 1, [0])], "s string, t int, r array<long>"), ["s"], "t", "v", "r").collect() == []


def test_a_quantile_with_one_value_more(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        past = sorted(rng.choice([1.0, 5.0, rng.random() * 10]) for _ in range(rng.randrange(0, 30)))
        rows.append((i, past, rng.choice([None, 1.0, rng.random() * 12])))
    d = spark.createDataFrame(rows, "i int, past array<double>, extra double").withColumn("n", F.size("past"))
    for q in (0.0, 0.5, 0.95, 1.0):
        near = F.filter(_ranks_near(F.col("n"), q), lambda r: (r >= 0) & (r < F.col("n")))
        m = F.map_from_arrays(F.array_distinct(near), F.transform(F.array_distinct(near), lambda r: F.get("past", r.cast("int"))))
        got = {r.i: r.q for r in d.withColumn("m", m).select("i", _quantile_with("m", F.col("n"), F.col("extra"), q).alias("q")).collect()}
        for i, past, extra in rows:
            values = past + ([extra] if extra is not None else [])
            assert got[i] is None if not values else abs(got[i] - np.quantile(values, q)) < 1e-9
