"""Fill-in-the-middle: a plain version on strings, round trips, odd rows."""
import hashlib

import pytest
from data import SCHEMA, counted, odd_rows
from oracle import compare, connect

import __spark_entry__ as e
from tidemark.llm import fill_middle as fm

FOLDER = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()      # noqa: E731


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def rows():
    odd = [(r[0], r[1]) for r in odd_rows(80)]
    more = ["<", "a<P", "<P>", "x<S>y", "P>x<", "é" * 5, "😀<M", "日本語" * 40_000, "z" * 200_001, "<" * 50, ">S>", "\0a\0"]
    return odd + [(20_000 + i, t) for i, t in enumerate(more)] + [(None, None), (None, "abc"), (7, "other text of 7"), (7, "other text of 7")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)


def test_outputs_and_round_trip(docs):
    made = fm.fill_in_middle(docs)
    want = counted(plain(*r) for r in rows())
    assert counted(made.collect()) == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert counted(fm.original_texts(made).collect()) == counted((i, t or "") for i, t in rows())


def test_digests(docs):
    got = fm.arranged(docs, fm.digests, f"{fm._DECIDED}, output_sha256 string, restored_sha256 string").collect()
    assert counted(got) == counted((*plain(i, t)[:5], sha(plain(i, t)[5]), sha(t or "")) for i, t in rows())


def test_seams_hold_no_sentinels():
    """Every cut of texts made of sentinel letters comes back."""
    for t in ("<P", "<S<M<P", "P>S>M>", "<<P>"[:3], "S><", "M>é<"):
        raw = t.encode()
        for a in range(len(t) + 1):
            for b in range(a, len(t) + 1):
                x, y = len(t[:a].encode()), len(t[:b].encode())
                for form, order in fm.ORDERS.items():
                    out = b"".join(fm.streamed(fm.arrange(fm.split(fm.Piece(fm.TEXT, 0, len(raw)), x, y), order), raw, fm.MARKS))
                    assert b"".join(fm.streamed(fm.restored(out, form), out)) == raw


def test_edges(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    assert fm.fill_in_middle(spark.createDataFrame(odd_rows(20), SCHEMA)).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_sql(spark):
    result, _ = compare(spark, connect(FOLDER), FOLDER, "op11", e.queries()["op11_fill_in_middle"], e.oracle_sql()["op11_fill_in_middle"])
    assert result.startswith("OK"), result
