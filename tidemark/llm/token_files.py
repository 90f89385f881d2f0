"""Token-id files: ids of all documents back to back, their boundaries Elias-Fano coded, with select for any offset."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, table, text_slices, whole_text
from .pretokens import memory_of

SEGMENT_IDS = 1 << 20           # a row of the file holds about so many ids; a longer document stands alone
SEGMENT = "part long, seq long, n_docs long, n_ids long, width int, doc_ids array<bigint>, low_bits int, low binary, high binary, directory binary, ids binary"
_BLOCK = 512                    # bits of the upper stream under one directory entry


class EliasFano:
    """Ascending values v[0] <= ... <= v[n-1] <= last in about 2 + log2(last / n) bits each.

    The low bits lie side by side; the high parts are unary in one bit stream, with a 32-bit count of ones before every
    512 bits. select(i) looks up its block and counts inside it; no table of 64-bit offsets exists on disk or in memory.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.directory = np.frombuffer(directory, "<u4")

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (last // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        blocks = (n + (last >> bits)) // _BLOCK + 1
        stream = np.zeros(blocks * _BLOCK, np.uint8)
        stream[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        ones = stream.reshape(blocks, _BLOCK).sum(1, dtype=np.int64)
        return EliasFano(n, bits, low.tobytes(), np.packbits(stream, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes())

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``, each found on its own."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.directory, i, "right") - 1
        inside = np.unpackbits(self.high.reshape(-1, _BLOCK // 8)[block], axis=1, bitorder="little")
        rank = (i - self.directory[block].astype(np.int64) + 1)[:, None]
        at = block * _BLOCK + np.argmax(np.cumsum(inside, 1, dtype=np.int32) >= rank, 1)
        out = (at - i) << self.low_bits
        for k in range(self.low_bits):
            p = i * self.low_bits + k
            out |= ((self.low[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def all(self, step: int = 4096) -> np.ndarray:
        return np.concatenate([self.select(np.arange(a, min(a + step, self.n))) for a in range(0, self.n, step)] or [np.empty(0, np.int64)])


def _encoder(spec: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        memory = memory_of(spec)
        docs, sizes, ids, held = [], [], [], 0
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                            ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("directory", pa.binary()), ("ids", pa.binary())])

        def flush():
            nonlocal docs, sizes, ids, held, seq
            n = np.concatenate(sizes)
            ef, all_ids = EliasFano.encode(np.cumsum(n)), np.concatenate(ids)
            row = [part, seq, len(n), len(all_ids), all_ids.itemsize, docs, ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), ef.directory.tobytes(), all_ids.tobytes()]
            docs, sizes, ids, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                flat, n = memory.encode(texts[a:b])
                if end_id is not None:
                    flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                docs += keys[a:b]
                sizes.append(n)
                ids.append(flat)
                held += len(flat)
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, spec: str, end_id: int | None = 2) -> None:
    """Encode every whole text and write the files below ``path``, documents in ascending doc_id order (null first).

    Texts are dealt out by ranges of doc_id and sorted within them, so task order and row order give the global order; rows
    with one doc_id follow each other by text. Null and empty texts have the end id alone. An empty table writes no rows.
    ``ids`` are little-endian, 2 bytes wide where the vocabulary allows. Any columns beside doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encoder(spec, end_id), SEGMENT).write.parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ends = EliasFano(r["n_docs"], r["low_bits"], r["low"], r["high"], r["directory"]).all()
            starts = np.concatenate(([0], ends[:-1]))
            ids = np.frombuffer(r["ids"], f"<u{r['width']}")
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(ends), pa.int64()), pa.array([r["seq"]] * len(ends), pa.int64()), pa.array(r["doc_ids"], pa.int64()),
                                              pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only segment headers meet in one place, for the sum of what lies before each; ids never move.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    docs = files.mapInArrow(_reader, "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver (about 1.5 MB) and sent along with the tasks."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op3_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_spec())
    return read_tokens(spark, path)
