"""Reading, cutting lineage and batching, shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, scratch_path

SPACE = r"[^\x20\x09-\x0D]+"      # a word, as the contracts define it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, and one computation for several readers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frame(**columns) -> pd.DataFrame:
    """A pandas frame of plain objects, whatever pandas would infer; Arrow casts them to the declared schema."""
    return pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in columns.items()})


def cut(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


def byte_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, characters) of the texts; one narrow scan."""
    r = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    return int(r[0]), int(r[1] or 0)


def text_slices(texts: list[str], limit: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def small_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in column ``text``, so that few texts are Python objects at a time.

    Workers are reused by later stages; what this one allocated goes back to the system at its end.
    """
    for batch in batches:
        column = batch.column(text)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else ()
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    give_back()


def give_back() -> None:
    """Freed memory of this worker, from Arrow's pool and from the C heap, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)
