"""Benchmark passages in texts: a plain version on word lists, parts of long texts, several blocks, removal."""
import hashlib
import random
import re

import numpy as np
import pytest
from data import ASCII_LOWER, SCHEMA, counted, odd_rows
from oracle import compare, connect

import __spark_entry__ as e
from tidemark.llm import decontaminate as dc

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(ASCII_LOWER))]


def brute(text, items):
    found, hit, names = split(text), set(), set()
    w = [x[0] for x in found]
    for item_id, t in items:
        q = [x[0] for x in split(t)]
        for k in range(max(1, len(q) - 9) if q else 0):
            part = q[k:k + 10]
            for i in range(len(w) - len(part) + 1):
                if w[i:i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    names.add(item_id)
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i - 1:
            spans[-1] = (spans[-1][0], i, spans[-1][2], found[i][2])
        else:
            spans.append((i, i, found[i][1], found[i][2]))
    return len(w), len(hit), spans, sorted(str(x) for x in names if x is not None)


def tables():
    r = random.Random(3)
    v = ["".join(r.choice("abCdé日") for _ in range(r.randint(1, 4))) for _ in range(60)]
    line = lambda k: " ".join(r.choice(v) for _ in range(k))
    long = line(30)
    items = [(1, long), (2, long.upper()), (10, line(10)), (11, line(12)), (3, "Only three words"), (4, ""), (5, None), (None, line(11)), (6, "  ..  "),
             (7, long[: len(long) // 2]), (7, line(14)), (8, "aa " * 25), (9, "ab")]
    docs = [(r[0], r[1]) for r in odd_rows(40)[:40]]
    for i in range(60):
        k = r.choice([x for x in items if x[1]])[1]
        w = k.split()
        a = r.randint(0, max(0, len(w) - 3))
        docs.append((100 + i, f"{line(r.randint(0, 15))}, {'--'.join(w[a:a + r.randint(3, 30)])}! {line(r.randint(0, 15))}"))
    docs += [(300, "aa " * 400), (301, f"{line(3000)} {long} {line(3000)}"), (302, "only THREE\twords"), (302, "only THREE\twords"), (302, "x"), (None, long), (303, None), (304, "é" * 3000 + long)]
    return docs, items


@pytest.fixture(scope="module")
def made(spark):
    docs, items = tables()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def digest(r):
    return (r.doc_id, r.n_words, r.n_hit, str([tuple(s) for s in r.spans]), str(r["items"]))


def test_against_brute_force(made):
    docs, items = tables()
    want = counted((i, n, h, str(s), str(x)) for i, (n, h, s, x) in ((i, brute(t, items)) for i, t in docs))
    assert sum(k[2] > 0 for k in want) > 30
    assert counted(map(digest, dc.contamination(*made).collect())) == want
    assert counted(map(digest, dc.contamination(*made, most=7).collect())) == want      # many blocks
    assert counted(map(digest, dc.contamination(*made, chars=200).collect())) == want


def test_long_texts_in_parts(monkeypatch):
    """Pieces of 64 bytes: windows over several parts, words longer than a part."""
    docs, items = tables()
    texts = [t or "" for _, t in docs] + ["", "q" * 500, " " * 300]
    pairs = [(" ".join(x[0] for x in split(t)[k:k + 10]), str(i)) for i, t in items if i is not None for k in range(max(1, len(split(t)) - 9) if split(t) else 0)]
    known = dc.HashSet([p[0] for p in pairs], [p[1] for p in pairs])
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    whole = dc.scan_texts(np.frombuffer(b"".join(raw), np.uint8), offsets, known)
    monkeypatch.setattr(dc, "SLICE", 64)
    parts = dc.scan_texts(np.frombuffer(b"".join(raw), np.uint8), offsets, known)
    assert [(t.n, t.joined(), t.items) for t in whole] == [(t.n, t.joined(), t.items) for t in parts]


def test_removal(spark, made):
    docs, items = tables()
    plain = [(i, t, brute(t, items)[2]) for i, t in docs]

    def without(t, spans):
        for _, _, a, b in reversed(spans):
            t = t[:a] + t[b:]
        return t
    assert counted(dc.decontaminated(*made).collect()) == counted((i, t if t is None else without(t, s)) for i, t, s in plain)
    assert counted(dc.decontaminated(*made, remove="documents").collect()) == counted((i, t) for i, t, s in plain if not s)
    with pytest.raises(ValueError):
        dc.decontaminated(*made, remove="some")
    odd = spark.createDataFrame(odd_rows(20), SCHEMA)
    assert dc.decontaminated(odd, made[1]).columns == odd.columns


def test_empty_tables(spark, made):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(spark.createDataFrame([], SCHEMA), made[1]).collect() == []
    assert counted(map(digest, dc.contamination(made[0], none).collect())) == counted((i, len(split(t)), 0, "[]", "[]") for i, t in tables()[0])


def test_sql(spark):
    result, _ = compare(spark, connect(FOLDER), FOLDER, "op13", e.queries()["op13_decontaminate"], e.oracle_sql()["op13_decontaminate"])
    assert result.startswith("OK"), result
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in e.queries()["op13_decontaminate"](spark, FOLDER).collect()}
