import random
from math import asin, cos, radians, sin, sqrt

from pyspark.sql import functions as F

from tidemark.operators.spatial import near_any, thin_by_distance


def km(a, b):
    x = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * asin(min(1.0, sqrt(x)))


def test_crowded_places_enter_the_rounds_once(spark, monkeypatch):
    from tidemark.operators import spatial
    sizes, cut = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda d: sizes.append(d.count()) or cut(d))
    r = random.Random(2)
    rows = [(f"d{i:04d}", "p", 50 + r.randrange(12) / 1500, 25 + r.randrange(12) / 1500, float(r.randrange(6)), r.random() < 0.9) for i in range(900)]
    want, free = [], {x[0] for x in rows if not x[5]}
    for x in sorted((x for x in rows if x[5]), key=lambda x: (x[4], x[0]), reverse=True):
        if all(km(x[2:4], y[2:4]) >= 0.1 for y in want):
            want.append(x)
    d = spark.createDataFrame(rows, "id string, p string, lon double, lat double, v double, b boolean")
    got = {x.id for x in thin_by_distance(d, ["p"], "id", F.col("v"), 0.1, F.col("b")).collect()}
    assert got == free | {x[0] for x in want}
    assert sizes[0] <= 144                                      # places, not candidates


def test_near_any_asks_once_per_place(spark):
    p = spark.createDataFrame([(i, 50.0 + i % 3, 25.0) for i in range(60)], "id int, lon double, lat double")
    s = spark.createDataFrame([(50.001, 25.0)] * 50, "site_lon double, site_lat double")
    out = near_any(p, "id", s, 1.0, "near", cell_deg=0.05)
    assert {x.id for x in out.where("near").collect()} == {i for i in range(60) if i % 3 == 0} and out.count() == 60
