"""Address parts with thousands of zeros, at-sign chains in linear time, and batches cut by bytes."""
import time

import pyarrow as pa

from tidemark.llm import common, personal


def test_long_zeros_in_address_parts():
    zeros = "1.2.3." + "0" * 5000 + "9"
    assert personal.base_spans(zeros) == [("ip", 0, len(zeros))]
    assert personal.base_spans("1.2.3." + "0" * 5000 + "999") == []
    assert personal.base_spans("0000.0.0.0") == [("ip", 0, 10)]


def test_chains_of_at_signs_are_linear():
    def took(n):
        t = time.perf_counter()
        personal.base_spans("a@" * n)
        return time.perf_counter() - t
    took(1000)
    assert took(400_000) < 5        # 100 KB of this took minutes when every sign was walked back to the last blank


def test_small_batches_lose_nothing():
    rows = [None, "", "a" * 50, "é" * 40, "", "b"] * 30
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(rows))), "t": rows}).slice(3)
    for limit in (1, 60, 10_000):
        parts = list(common.small_batches(iter([batch, batch.slice(0, 0)]), 1, limit))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        assert all(p.num_rows == 1 or sum(len(t.encode()) for t in p.column(1).to_pylist() if t) <= limit for p in parts)
