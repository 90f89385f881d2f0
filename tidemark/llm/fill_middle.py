"""Fill-in-the-middle training texts, made as piece tables.

A document is never rewritten while it is arranged: it is a list of descriptors (buffer, start, end) over two buffers that do
not change, the text's UTF-8 bytes as they lie in the Arrow column and the sentinels' bytes. Cutting splits a descriptor,
an arrangement is a permutation of the parts, its inverse gives the text back, and hashes read descriptor by descriptor.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

# Sentinels, and the order in which each form lists prefix (0), middle (1) and suffix (2) behind their sentinels.
SENTINELS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}

MARKS = b"".join(SENTINELS)
TEXT, MARK = 0, 1               # buffers
BLOCK = 1 << 16                 # bytes looked at together when code points are counted
OUT_BYTES = 8_000_000           # output texts held before a batch is sent on


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


def byte_at(raw: np.ndarray, unit: int) -> int:
    """Where code point ``unit`` of UTF-8 bytes starts (their length, if there are only so many)."""
    for a in range(0, len(raw), BLOCK):
        lead = (raw[a:a + BLOCK] & 0xC0) != 0x80
        here = int(np.count_nonzero(lead))
        if unit < here:
            return a + int(np.flatnonzero(lead)[unit])
        unit -= here
    return len(raw)


def split(piece: Piece, *cuts: int) -> list[Piece]:
    """The piece cut before each of the rising offsets, as one more part than cuts; parts may be empty."""
    at = [piece.start, *(piece.start + c for c in cuts), piece.end]
    return [Piece(piece.buffer, a, b) for a, b in zip(at, at[1:])]


def arrange(parts: list[Piece], order: tuple[int, ...]) -> list[Piece]:
    """The parts in ``order``, each behind its sentinel."""
    out = []
    for k in order:
        a = sum(map(len, SENTINELS[:k]))
        out += [Piece(MARK, a, a + len(SENTINELS[k])), parts[k]]
    return out


def inverse(order: tuple[int, ...]) -> list[int]:
    return sorted(range(len(order)), key=order.__getitem__)


def streamed(pieces: list[Piece], *buffers) -> Iterator[memoryview]:
    """The bytes of the pieces, one view after the other; nothing is copied."""
    views = [memoryview(b) for b in buffers]
    return (views[p.buffer][p.start:p.end] for p in pieces)


def sha256(views) -> str:
    h = hashlib.sha256()
    for v in views:
        h.update(v)
    return h.hexdigest()


def restored(output: bytes, form: str) -> list[Piece]:
    """Pieces over ``output`` that read as the text it was made of: the sentinels are found again, the parts behind them put back.

    A text that holds a sentinel is never arranged, and no sentinel can arise across a seam, so the first of each is the right one.
    """
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    order, at, parts = ORDERS[form], 0, []
    for k, following in zip(order, [*order[1:], None]):
        start = at + len(SENTINELS[k])
        at = len(output) if following is None else output.index(SENTINELS[following], start)
        parts.append(Piece(TEXT, start, at))
    return [parts[i] for i in inverse(order)]


class Arranged(NamedTuple):
    """One document: its pieces over (text, sentinels), and what was decided."""
    n: int
    form: str
    prefix: int | None
    middle: int | None
    pieces: list[Piece]
    text: memoryview

    def views(self) -> Iterator[memoryview]:
        return streamed(self.pieces, self.text, MARKS)

    def output(self) -> bytes:
        return b"".join(self.views())


def decide(doc_id, text: memoryview, n: int, marked: bool, plain_from: int, spm_below: int, seed: str) -> Arranged:
    """Cut points and form follow from sha256 of ``seed:doc_id`` alone; a null doc_id counts as an empty word there."""
    whole = Piece(TEXT, 0, len(text))
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not n or marked or h3 % 100 >= plain_from:
        return Arranged(n, "plain", None, None, [whole], text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == len(text):
        x, y = a, b
    else:
        raw = np.frombuffer(text, np.uint8)
        x = byte_at(raw, a)
        y = x + byte_at(raw[x:], b - a)
    form = "spm" if h4 % 100 < spm_below else "psm"
    return Arranged(n, form, a, b - a, arrange(split(whole, x, y), ORDERS[form]), text)


def _documents(batch: pa.RecordBatch, **choice) -> Iterator[tuple[int | None, Arranged]]:
    column = batch.column(1).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"").cast("B")
    marked = pc.match_substring(column, SENTINELS[0].decode())
    for s in SENTINELS[1:]:
        marked = pc.or_(marked, pc.match_substring(column, s.decode()))
    sizes = pc.utf8_length(column)
    for i, doc_id in enumerate(batch.column(0).to_pylist()):
        yield doc_id, decide(doc_id, data[offsets[i]:offsets[i + 1]], sizes[i].as_py(), marked[i].as_py(), **choice)


def arranged(docs: DataFrame, finish: Callable[[Arranged], dict], schema: str, plain_from: int = 90, spm_below: int = 20, seed: str = "1") -> DataFrame:
    """doc_id and what ``finish`` makes of each row's arrangement, in one narrow stage over (doc_id, text).

    Form is plain for texts that are empty, hold a sentinel or draw a number of ``plain_from`` or more of 100, else spm below
    ``spm_below`` of 100, else psm. Null texts count as empty, equal rows give equal rows, other columns are not read, and an
    empty table gives no rows. A very long text is cut where it lies; only its output is built beside it.
    """
    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, one in _documents(batch, plain_from=plain_from, spm_below=spm_below, seed=seed):
                rows.append({"doc_id": doc_id, "n": one.n, "form": one.form, "prefix_chars": one.prefix, "middle_chars": one.middle, **finish(one)})
                held += len(one.text)
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=target)
    return docs.select("doc_id", "text").mapInArrow(run, kind)


_DECIDED = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def fill_in_middle(docs: DataFrame, **choice) -> DataFrame:
    """Training texts: doc_id, n, form, prefix_chars, middle_chars, output; see ``arranged`` for choices and edges."""
    return arranged(docs, lambda one: {"output": one.output().decode("utf-8", "replace")}, f"{_DECIDED}, output string", **choice)


def original_texts(made: DataFrame) -> DataFrame:
    """doc_id and text of rows (doc_id, form, output) that ``fill_in_middle`` made. Null outputs give empty texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (r[2] or "").encode()
                rows.append({"doc_id": r[0], "text": b"".join(streamed(restored(raw, r[1]), raw)).decode()})
                held += len(raw)
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    kind = StructType.fromDDL("doc_id long, text string")
    target = to_arrow_schema(kind)
    return made.select("doc_id", "form", "output").mapInArrow(run, kind)


def digests(one: Arranged) -> dict:
    """Hashes of the output's pieces, and of the pieces found in the output again in the text's order."""
    output = one.output()
    return {"output_sha256": sha256(one.views()), "restored_sha256": sha256(streamed(restored(output, one.form), output))}


def op11_fill_in_middle(spark, sf_dir):
    return arranged(table(spark, sf_dir, "documents"), digests, f"{_DECIDED}, output_sha256 string, restored_sha256 string")


FILL_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e FROM d),
formed AS (
  SELECT *, least(a, b) AS p, abs(a - b) AS m,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, m) AS middle, substr(t, p + m + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
