"""Training texts that repeat benchmark passages: a hash set of the items' word windows against every window of every text.

Tasks read the texts' bytes in pieces of about a megabyte, hash words and windows with array operations, look the hashes up in
the broadcast set, and verify each hit by its words. What is broadcast is one block of windows of a stated size; a benchmark
beyond one block is scanned block by block, and the blocks' hits are united.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

WINDOW = 10
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WINDOWS = 1_000_000       # (window, item) pairs in one broadcast
BLOCK_CHARS = 64_000_000        # and the characters of their windows, one window at least
SLICE = 1 << 20                 # bytes of text whose words are hashed together
SPANS = "array<struct<w0: long, w1: long, c0: long, c1: long>>"
FOUND = f"struct<n_words: long, spans: {SPANS}, items: array<string>>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False
_RNG = np.random.default_rng(13)
_BYTE = np.where(_IN_WORD, _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64), 0).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)           # odd multipliers of the two hashes, modulo 2^64
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _STEP, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words in ``raw`` (uint8); a word never crosses an offset in ``breaks``."""
    inside = _IN_WORD[_LOWER[raw]]
    fresh = np.empty(len(raw) + 1, bool)
    fresh[0] = fresh[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=fresh[1:-1])
    fresh[breaks] = True
    edges = np.flatnonzero(fresh)
    starts, ends = edges[:-1], edges[1:]
    keep = inside[starts]
    if not keep.any():
        return starts[:0], ends[:0], np.zeros(0, np.uint64)
    power = _powers(int((ends - starts).max()))
    at = np.arange(len(raw)) - np.repeat(starts, ends - starts)
    h = np.add.reduceat(_BYTE[_LOWER[raw]] * power[at], starts)[keep]
    h ^= h >> np.uint64(29)
    return starts[keep], ends[keep], h * _STEP


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` words that start at each word but the last n - 1."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out = out * _NEXT + h[j:j + size]
    return out ^ (out >> np.uint64(32))


def normal(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, lower-cased, with one blank between."""
    return b" ".join(_LOWER[raw[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))


class HashSet:
    """Windows of one block: by length a bit table, sorted hashes, and the windows' words with their items."""

    def __init__(self, windows: list[str], items: list[str | None]):
        self.items = defaultdict(list)
        for w, i in zip(windows, items):
            found = self.items[w.encode()]
            if i is not None:
                found.append(i)
        by_length = defaultdict(list)
        for w in self.items:
            raw = np.frombuffer(w, np.uint8)
            h = words(raw, np.zeros(0, np.int64))[2]
            by_length[len(h)].append(int(window_hashes(h, len(h))[0]))
        self.bits = max(16, int(16 * len(self.items)).bit_length())
        self.keys = {}
        for n, found in by_length.items():
            keys = np.unique(np.array(found, np.uint64))
            seen = np.zeros(1 << self.bits, bool)
            seen[keys >> np.uint64(64 - self.bits)] = True
            self.keys[n] = (seen, keys)

    def candidates(self, h: np.ndarray, n: int) -> np.ndarray:
        seen, keys = self.keys[n]
        some = window_hashes(h, n)
        at = np.flatnonzero(seen[some >> np.uint64(64 - self.bits)])
        if len(at):
            place = np.minimum(np.searchsorted(keys, some[at]), len(keys) - 1)
            at = at[keys[place] == some[at]]
        return at


class _Text:
    """What one text has shown so far: its words, runs of hit words as [first word, last word, first byte, end byte], items."""

    def __init__(self):
        self.n, self.runs, self.items = 0, [], set()

    def hit(self, w0: int, w1: int, a: int, b: int) -> None:
        self.runs.append([w0, w1, a, b])

    def joined(self) -> list[list[int]]:
        out = []
        for r in sorted(self.runs):
            if out and r[0] <= out[-1][1] + 1:
                if r[1] > out[-1][1]:
                    out[-1][1], out[-1][3] = r[1], r[3]
            else:
                out.append(list(r))
        return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first byte, end byte): many short texts, or a part of a long one that ends between words."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        a, end = int(offsets[i]), int(offsets[j])
        while end - a > SLICE:          # then j == i + 1
            b = a + SLICE
            while b < end and _IN_WORD[_LOWER[data[b - 1]]]:
                stretch = ~_IN_WORD[_LOWER[data[b:min(end, b + SLICE)]]]
                b = b + int(stretch.argmax()) + 1 if stretch.any() else min(end, b + SLICE)
            yield i, j, a, b
            a = b
        yield i, j, a, end
        i = j


def scan_texts(data: np.ndarray, offsets: np.ndarray, known: HashSet) -> list[_Text]:
    """Hits of every text; the last words of a part are carried into the next, so windows across parts are seen."""
    out = [_Text() for _ in range(len(offsets) - 1)]
    longest = max(known.keys, default=1)
    carry, last = None, -1
    for i, j, a, b in _pieces(data, offsets):
        inner = offsets[i + 1:j] - a
        s, e, h = words(data[a:b], inner[inner < b - a])
        s, e = s + a, e + a
        owner = np.searchsorted(offsets[i + 1:j], s, "right") + i
        count = np.bincount(owner - i, minlength=j - i)
        before = np.cumsum(count) - count
        base = np.array([out[t].n for t in range(i, j)])
        number = np.arange(len(s)) - before[owner - i] + base[owner - i]
        if i == last and carry is not None:
            s, e, h, owner, number = (np.concatenate(x) for x in zip(carry, (s, e, h, owner, number)))
        for n in known.keys:
            at = known.candidates(h, n)
            for k in at[owner[at] == owner[at + n - 1]].tolist():
                items = known.items.get(normal(data, s[k:k + n], e[k:k + n]))
                if items is not None:
                    text = out[owner[k]]
                    text.hit(int(number[k]), int(number[k + n - 1]), int(s[k]), int(e[k + n - 1]))
                    text.items.update(items)
        for t, c in zip(range(i, j), count.tolist()):
            out[t].n += c
        if len(out[i].runs) > 4096:
            out[i].runs = out[i].joined()
        carry, last = tuple(x[-(longest - 1):] if longest > 1 else x[:0] for x in (s, e, h, owner, number)), j - 1
    return out


def windows_of(items: DataFrame) -> DataFrame:
    """Distinct (window, item_id): each run of ten words, or all words of an item that has fewer."""
    text = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = items.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(text, F.lit(WORD_SQL), F.lit(0)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("window")).distinct()


def blocks(windows: DataFrame, most: int = BLOCK_WINDOWS, chars: int = BLOCK_CHARS) -> Iterator[HashSet]:
    """The windows in blocks of about ``most`` pairs at most, dealt by hash; only one block at a time is on the driver."""
    windows = windows.persist()
    rows, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    n = max(1, -(-rows // most), -(-size // chars))
    for k in range(n):
        got = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(n)) == k).toPandas()
        yield HashSet(got["window"].tolist(), [None if pd.isna(i) else i for i in got["item_id"]])
    windows.unpersist()


def _scan(docs: DataFrame, known: HashSet, name: str = "__found") -> DataFrame:
    """The rows of ``docs`` with a struct of what was found in ``text``; one narrow stage."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = StructType([*docs.schema, *StructType.fromDDL(f"{name} {FOUND}")])
    target = to_arrow_schema(schema)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            found = []
            for text, start in zip(scan_texts(data, offsets, sent.value), offsets.tolist()):
                spans, at, units = [], start, 0
                for w0, w1, a, b in text.joined():
                    c0 = units + _units(data[at:a])
                    units, at = c0 + _units(data[a:b]), b
                    spans.append({"w0": w0, "w1": w1, "c0": c0, "c1": units})
                found.append({"n_words": text.n, "spans": spans, "items": sorted(text.items)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, target.field(name).type)], schema=target)
    return docs.mapInArrow(run, schema)


def _units(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _united(spans):
    """Runs of one text from several blocks as disjoint runs."""
    return F.aggregate(F.sort_array(spans), F.expr(f"cast(array() as {SPANS})"), lambda done, s: F.when(
        (F.size(done) > 0) & (s["w0"] <= F.element_at(done, -1)["w1"] + 1),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["w0"].alias("w0"), F.greatest(F.element_at(done, -1)["w1"], s["w1"]).alias("w1"),
            F.element_at(done, -1)["c0"].alias("c0"), F.greatest(F.element_at(done, -1)["c1"], s["c1"]).alias("c1")))),
    ).otherwise(F.concat(done, F.array(s))))


def found_in(docs: DataFrame, items: DataFrame, most: int = BLOCK_WINDOWS, chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` with ``__found``: n_words, spans of hit words (w0 to w1, and code points c0 to c1, end exclusive),
    and the items with a window in the text, as sorted strings.

    Null texts have no words. Items without words have no window; an item with a null id marks words but has no name to report;
    rows of one item_id are one item. Rows of ``docs`` with equal doc_id stay apart. Other columns pass through unread.
    """
    each = blocks(windows_of(items), most, chars)
    first = _scan(docs, next(each))
    rest = None
    for known in each:              # a text's hits follow from the text alone, so its digest names it
        hits = _scan(docs.select("text"), known).where("size(__found.spans) > 0").select(F.sha2("text", 256).alias("h"), "__found")
        rest = hits if rest is None else rest.unionByName(hits)
    if rest is None:
        return first
    more = rest.dropDuplicates(["h", "__found"]).groupBy("h").agg(F.flatten(F.collect_list("__found.spans")).alias("__s"), F.flatten(F.collect_list("__found.items")).alias("__i"))
    none = F.expr("array()")
    both = first.join(more.withColumnRenamed("h", "__h"), F.sha2("text", 256) == F.col("__h"), "left")
    united = F.struct(F.col("__found.n_words").alias("n_words"),
                      _united(F.concat("__found.spans", F.coalesce("__s", none.cast(SPANS)))).alias("spans"),
                      F.array_sort(F.array_union("__found.items", F.coalesce("__i", none.cast("array<string>")))).alias("items"))
    return both.select(*docs.columns, united.alias("__found"))


def _hit_words():
    return F.aggregate("__found.spans", F.lit(0).cast("long"), lambda n, s: n + s["w1"] - s["w0"] + 1)


def contamination(docs: DataFrame, items: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items for every row; see ``found_in``."""
    return found_in(docs.select("doc_id", "text"), items, **sizes).select("doc_id", "__found.n_words", _hit_words().alias("n_hit"), "__found.spans", "__found.items")


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", **sizes) -> DataFrame:
    """``docs`` without what benchmarks hold: ``spans`` cuts each run of hit words out of its text, from the first hit word's
    start to the last one's end; ``documents`` drops every row with a hit. Texts without a hit, nulls included, stay as they are."""
    found = found_in(docs, items, **sizes)
    if remove == "documents":
        return found.where("size(__found.spans) = 0").select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove must be 'spans' or 'documents'")
    kept = F.aggregate("__found.spans", F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")), lambda r, s: F.struct(
        F.concat(r["t"], F.col("text").substr((r["at"] + 1).cast("int"), (s["c0"] - r["at"]).cast("int"))).alias("t"), s["c1"].alias("at")),
        lambda r: F.concat(r["t"], F.col("text").substr((r["at"] + 1).cast("int"), F.length("text"))))
    cut = F.when(F.size("__found.spans") > 0, kept).otherwise(F.col("text"))
    return found.select(*[cut.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op13_decontaminate(spark, sf_dir):
    marked = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def scan_sql() -> str:
    """The same from the rule alone, with windows as texts."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

    def listed(name: str, key: str, source: str) -> str:
        return f"""
{name} AS MATERIALIZED (
  SELECT r, {key}, pos, n, word, {", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(1, WINDOW))}
  FROM (SELECT r, {key}, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos
        FROM (SELECT row_number() OVER () AS r, {key}, regexp_extract_all({lower}, {pattern}) AS w FROM {source}))
  WINDOW o AS (PARTITION BY r ORDER BY pos))"""
    text = lambda n: "concat_ws(' ', word" + "".join(f", w{j}" for j in range(1, n)) + ")"      # noqa: E731
    seen = " UNION ALL ".join(f"SELECT r, pos, {n} AS l, {text(n)} AS t FROM d WHERE pos + {n - 1} <= n AND {n} IN (SELECT l FROM windows)" for n in range(1, WINDOW + 1))
    item = " UNION ALL ".join(f"SELECT item_id, {n} AS l, {text(n)} AS t FROM i WHERE {f'n = {n} AND pos = 1' if n < WINDOW else f'pos + {n - 1} <= n'}" for n in range(1, WINDOW + 1))
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),{listed("d", "doc_id", "numbered").replace("SELECT row_number() OVER () AS r, doc_id", "SELECT r, doc_id")},{listed("i", "item_id", "benchmark")},
windows AS MATERIALIZED (SELECT DISTINCT * FROM ({item})),
hits AS MATERIALIZED (SELECT DISTINCT s.r, s.pos, s.l, w.item_id FROM ({seen}) s JOIN windows w ON w.l = s.l AND w.t = s.t),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + l)) AS p FROM (SELECT DISTINCT r, pos, l FROM hits)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words FROM d GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM numbered LEFT JOIN sizes USING (r) LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""
