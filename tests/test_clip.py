"""Convex clipping inside the JVM against a plain clip in numpy, and no Python in the plan."""
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators.spatial import overlap_fraction

RING = "array<struct<lon:double,lat:double>>"


def plain(scene, area):
    """Share of the convex area inside the scene, by cutting the scene with each half-plane."""
    def size(p):
        x, y = np.array([q[0] for q in p]), np.array([q[1] for q in p])
        return (x @ np.roll(y, -1) - np.roll(x, -1) @ y) / 2 if len(p) else 0.0
    scene = scene[:-1] if scene[0] == scene[-1] else scene
    area = area[:-1] if area[0] == area[-1] else area
    if size(area) < 0:
        area = area[::-1]
    out = scene
    for a, b in zip(area, area[1:] + area[:1]):
        turn = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        kept = []
        for i, p in enumerate(out):
            q, s, t = out[(i + 1) % len(out)], turn[i], turn[(i + 1) % len(out)]
            kept += [p] if s >= 0 else []
            kept += [(p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1]))] if s * t < 0 else []
        out = kept
    return float(abs(size(out)) / abs(size(area))) if size(area) else None


def convex(r, n):
    angles = sorted(r.uniform(0, 6.28) for _ in range(n))
    x, y, w, h = r.uniform(-3, 3), r.uniform(-3, 3), r.uniform(1, 4), r.uniform(1, 4)
    return [(float(x + w * np.cos(t)), float(y + h * np.sin(t))) for t in angles]


def test_random_rings(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        scene, area = convex(r, r.randint(3, 9)), convex(r, r.randint(3, 7))
        scene = scene + scene[:1] if i % 2 else scene
        area = area[::-1] if i % 3 else area + area[:1]
        rows.append((i, scene, area, plain(scene, area)))
    d = spark.createDataFrame(rows, f"i int, scene {RING}, area {RING}, want double").select("i", "want", overlap_fraction("scene", F.col("area")).alias("got"))
    assert "Python" not in d._jdf.queryExecution().toString() and "Pandas" not in d._jdf.queryExecution().toString()
    got = d.collect()
    assert all(abs(x.got - x.want) < 1e-9 for x in got)
    assert sum(x.got == 0 for x in got) > 10 and sum(0 < x.got < 1 for x in got) > 100


def test_odd_rings(spark):
    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [(1, None, box), (2, box, None), (3, box[:2], box), (4, box, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (5, [], box), (6, box, box), (7, [(9.0, 9.0), (9.0, 8.0), (8.0, 8.0)], box),
            (8, [(0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0)], box)]                 # a scene that is not convex
    got = {x.i: x.f for x in spark.createDataFrame(rows, f"i int, s {RING}, a {RING}").select("i", overlap_fraction("s", "a").alias("f")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [None] * 5 and (got[6], got[7]) == (1.0, 0.0)
    assert abs(got[8] - plain(*rows[7][1:])) < 1e-12
