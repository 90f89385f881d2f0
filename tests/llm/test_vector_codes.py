"""Vector codes: every part against every entry, in plain numpy."""
import hashlib
import math

import numpy as np
from oracle import compare, connect

import __spark_entry__ as e
from tidemark.llm import vector_codes as vc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>, far string, q int, s string"


def brute(rows, entries=256, rounds=4):
    kept = [(i, lab, [max(-vc.MOST, min(vc.MOST, math.floor(1024 * float(np.float32(x))))) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    if not kept:
        return []
    d = len(kept[0][2])
    width = max(1, -(-d // 4))
    x = np.zeros((len(kept), 4 * width), np.int64)
    x[:, :d] = np.array([r[2] for r in kept], np.int64).reshape(len(kept), d)
    x = x.reshape(len(kept), 4, width)
    book = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        dist = np.stack([((x[:, k, None] - book[k][None]) ** 2).sum(-1) for k in range(4)], 1)
        return dist.argmin(-1), dist.min(-1)
    for _ in range(rounds):
        which, _ = assign()
        for k in range(4):
            for j in range(book.shape[1]):
                if (which[:, k] == j).any():
                    got = x[which[:, k] == j, k]
                    book[k, j] = got.sum(0) // len(got)
    which, dist = assign()
    by = {}
    for r, err in zip(kept, dist.sum(1).tolist()):
        by[r[1]] = by.get(r[1], 0) + err
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in w), err, by[r[1]], digest) for r, w, err in zip(kept, which.tolist(), dist.sum(1).tolist())]


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in vc.vector_codes(df, **how).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, **how), key=str)
    return got


def test_ties_copies_and_odd_rows(spark):
    """A coarse grid makes many equal distances; a third of the rows are copies of one vector."""
    rng = np.random.default_rng(1)
    rows = [(i, [None, 1, 2][i % 3], (rng.integers(-3, 4, 8) / 1024).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(200)]
    rows += [(2, 1, None), (3, 1, [0.1] * 7 + [None]), (4, 1, [float("nan")] * 8), (5, 1, [float("inf")] + [0.0] * 7), (6, 2, [1.0, 2.0]), (7, 1, []), (None, 1, [0.5] * 8), (9, None, [3e38] * 8),
             (9, 1, [-0.0001] * 8), (9, 1, [-0.0001] * 8)]
    check(spark, rows)
    check(spark, rows, entries=16, rounds=2)


def test_lengths_and_small_tables(spark):
    check(spark, [(3, 1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), (1, 1, [0.3, 0.2, 0.1, 0.0, -0.1, -0.2]), (2, None, [0.0] * 6)])
    check(spark, [(1, 1, [0.25])])
    assert check(spark, [(1, 1, [])]) and not check(spark, [(1, 1, None)]) and not check(spark, [])


def test_bounds_skip_most_evaluations():
    """Clustered parts: fewer than a third of the distances are evaluated, and none that matters is skipped."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (64, 16))
    parts = (centres[rng.integers(0, 64, 3000)] + rng.integers(-20, 20, (3000, 16))).astype(np.int64)
    book = parts[:256]
    pivots = vc.choose_pivots(book)
    which, best, tried = vc.nearest(parts, vc.to_pivots(parts, pivots), book, vc.to_pivots(book, pivots))
    d = ((parts[:, None] - book[None]) ** 2).sum(-1)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all() and tried < d.size / 3


def test_sql(spark):
    result, _ = compare(spark, connect(FOLDER), FOLDER, "op12", e.queries()["op12_vector_codes"], e.oracle_sql()["op12_vector_codes"])
    assert result.startswith("OK"), result
