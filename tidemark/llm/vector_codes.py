"""Vectors compressed to one codebook entry per part; nearest entries are found exactly with LAESA pivots.

Distances from every part to a few fixed pivots are computed once and stored with the part. In each round only the codebook's
entries are measured against the pivots; |d(part, pivot) - d(entry, pivot)| bounds d(part, entry) from below, so entries are
tried in the order of their bound and the rest of the list is skipped as soon as a bound exceeds the best distance found.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 12
SCALE = 1024.0
MOST = 1 << 24                  # components saturate here, so that squared distances stay exact in 64 bits
SLACK = 1e-6                    # roots of exact integers, and their differences, are off by far less
ROWS = 1024                     # vectors whose bounds are held together
STEP = 8                        # entries tried before bounds are looked at again


def whole_components(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has only finite components, with ``q``: floor(1024 * x) of each."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    floor = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return df.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("q", floor)


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of ``parts`` and the rows of ``entries`` beside them."""
    d = parts - entries
    return np.einsum("...i,...i->...", d, d)


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(parts, p) for p in pivots], axis=-1).astype(np.float64))


def choose_pivots(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: each next pivot is the entry farthest from those chosen."""
    chosen, gap = [0], squared(entries, entries[0])
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest(parts: np.ndarray, known: np.ndarray, entries: np.ndarray, entry_known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each part, ties to the lower index, and how many distances were evaluated.

    ``known`` and ``entry_known`` are distances to the pivots. A part's search ends when the next bound, less the slack,
    exceeds its best distance; entries with an equal distance are never skipped, so ties are exact.
    """
    bound = np.zeros((len(parts), len(entries)))
    for p in range(known.shape[1]):
        np.maximum(bound, np.abs(known[:, p, None] - entry_known[None, :, p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) - SLACK
    best = np.full(len(parts), np.iinfo(np.int64).max)
    which = np.zeros(len(parts), np.int64)
    alive, tried = np.arange(len(parts)), 0
    for k in range(0, len(entries), STEP):
        if k:
            first = bound[alive, k]
            alive = alive[(first <= 0) | (first * first <= best[alive])]
        if not len(alive):
            break
        some = order[alive, k:k + STEP]
        d = squared(parts[alive, None, :], entries[some])
        tried += d.size
        least = d.min(axis=1)
        index = np.where(d == least[:, None], some, len(entries)).min(axis=1)
        better = (least < best[alive]) | ((least == best[alive]) & (index < which[alive]))
        best[alive[better]], which[alive[better]] = least[better], index[better]
    return which, best, tried


class Codebook:
    """Entries and pivots of every part position: (PARTS, entries, width) and (PARTS, pivots, width), a few thousand numbers."""

    def __init__(self, entries: np.ndarray, pivots: list[np.ndarray]):
        self.entries, self.pivots = entries, pivots
        self.known = [to_pivots(e, p) for e, p in zip(entries, pivots)]

    def assign(self, parts: np.ndarray, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found = [nearest(parts[:, k], known[k], self.entries[k], self.known[k])[:2] for k in range(PARTS)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def cut_parts(column: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, width) int64 of a list column whose lists all have one length; the last part is filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    return np.pad(flat, ((0, 0), (0, PARTS * width - flat.shape[1]))).reshape(len(column), PARTS, width)


def _measured(q: DataFrame, pivots: list[np.ndarray], width: int) -> DataFrame:
    """Adds ``far``: each part's distances to its pivots, as the bytes of doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = cut_parts(batch.column("q"), width)
            far = np.concatenate([to_pivots(parts[:, k], pivots[k]) for k in range(PARTS)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in far], pa.binary())], [*batch.schema.names, "far"])
    return q.mapInArrow(run, StructType([*q.schema]).add("far", "binary"))


def _batches(batches: Iterator[pa.RecordBatch], width: int, pivots: list[np.ndarray]):
    cuts = np.cumsum([len(p) for p in pivots])[:-1]
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            b = whole.slice(a, ROWS)
            far = np.frombuffer(b"".join(b.column("far").to_pylist()), np.float64).reshape(b.num_rows, -1)
            yield b, cut_parts(b.column("q"), width), np.split(far, cuts, axis=1)


def _sums(q: DataFrame, book: Codebook, width: int) -> DataFrame:
    """(slot, n, s0, s1, ...): how many parts chose each entry, and their componentwise sums. A task adds up its own first."""
    n_entries = book.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PARTS * n_entries, np.int64)
        s = np.zeros((PARTS * n_entries, width), np.int64)
        for _, parts, known in _batches(batches, width, book.pivots):
            slots = book.assign(parts, known)[0] + np.arange(PARTS) * n_entries
            n += np.bincount(slots.ravel(), minlength=len(n))
            np.add.at(s, slots.ravel(), parts.reshape(-1, width))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "s"])

    partial = q.select("q", "far").mapInArrow(run, "slot long, n long, s array<long>")
    return partial.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)])


def _codes(q: DataFrame, book: Codebook, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, parts, known in _batches(batches, width, book.pivots):
            which, d = book.assign(parts, known)
            code = ["".join(f"{x:02x}" for x in row) for row in which.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code), pa.array(d.sum(axis=1))], ["vec_id", "label", "code", "error"])
    schema = StructType([*q.select("vec_id", "label").schema]).add("code", "string").add("error", "long")
    return q.select("vec_id", "label", "q", "far").mapInArrow(run, schema)


def train(q: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebook, int] | None:
    """(stored parts with pivot distances, final codebook, width) of rows (vec_id, label, q); None if there are none.

    The first codebook is read from the ``entries`` smallest vec_ids (null ids last, rows of one id by their components); the
    pivots are entries of it. What returns to the driver in a round is one sum per entry: ``entries`` times the vector's length.
    """
    first = q.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not first:
        return None
    length = len(first[0].q)
    width = max(1, -(-length // PARTS))
    start = [r.q for r in first if len(r.q) == length]
    if len(start) < len(first):     # other lengths are left out below, so the codebook starts without them, too
        q = q.where(F.size("q") == length)
        start = [r.q for r in q.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    grid = np.pad(np.array(start, np.int64).reshape(len(start), length), ((0, 0), (0, PARTS * width - length)))
    book = grid.reshape(len(start), PARTS, width).transpose(1, 0, 2)
    pivots = [choose_pivots(b) for b in book]
    q = stored(_measured(q.where(F.size("q") == length), pivots, width), "vector_parts")
    book = Codebook(book, pivots)
    for _ in range(rounds):
        new = book.entries.copy()
        for r in _sums(q, book, width).collect():
            new[divmod(r.slot, new.shape[1])] = np.array(r[2:], np.int64) // r.n
        book = Codebook(new, pivots)
    return q, book, width


def vector_codes(vectors: DataFrame, vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without a null or non-finite component.

    The vector of the smallest kept vec_id sets the length; vectors of another length are left out. A length that is no
    multiple of four is filled with zeros at the end. Components saturate at 2^24. Rows that share a vec_id each get a row;
    null labels are one label; with fewer kept rows than entries the codebook is as short; without any, no rows come out.
    """
    spark = vectors.sparkSession
    q = whole_components(vectors.select("vec_id", "label", F.col(vector).alias("embedding"))).select("vec_id", "label", "q")
    made = train(q, entries, rounds)
    if made is None:
        empty = StructType([*q.select("vec_id").schema]).add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string")
        return spark.createDataFrame([], empty)
    q, book, width = made
    coded = stored(_codes(q, book, width), "vector_codes")
    per_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "label_")
    return (coded.join(per_label, F.expr("label <=> label_"))
            .select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256")))


def op12_vector_codes(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))


def codes_sql(rounds: int = ROUNDS) -> str:
    """The same from the rule alone: every part against every entry. Doubles hold these integers exactly."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT p.rn, p.part, arg_min(b.entry, {{d}} * 1000 + b.entry) AS entry, min({{d}}) AS error
  FROM parts p JOIN book{r} b ON b.part = p.part GROUP BY p.rn, p.part)""".replace("{d}", "CAST(list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT)"))
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT n.part, n.entry, i.i, floor(sum(list_extract(p.v, i.i)) / count(*)) AS x
  FROM near{r} n JOIN parts p ON p.rn = n.rn AND p.part = n.part, (SELECT unnest(range(1, (SELECT width + 1 FROM dims))) AS i) i GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM book{r} b
  LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM sums{r} GROUP BY ALL) s USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q, row_number() OVER (ORDER BY vec_id) - 1 AS rn
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
dims AS (SELECT len(q) // 4 AS width FROM kept WHERE rn = 0),
parts AS MATERIALIZED (
  SELECT rn, p.part, list_slice(q, p.part * width + 1, (p.part + 1) * width) AS v FROM kept, dims, (SELECT unnest(range(4)) AS part) p),
book0 AS (SELECT part, rn AS entry, v FROM parts WHERE rn < 256),{",".join(steps)},
coded AS (
  SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM near{rounds} GROUP BY rn),
books AS (
  SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) AS h
  FROM (SELECT part, entry, array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN v], ',') AS x FROM book{rounds}))
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, books.h AS codebooks_sha256
FROM kept k JOIN coded c USING (rn), books
"""
