"""BPE over a distinct-word table: split in Spark, encode each distinct word once, join ids back by position, decode by id."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_size, frame as rows_of, give_back, small_batches, table, text_slices, whole_text
from .hashing import U64
from .pretokens import pieces_of, split
from .token_files import tokenizer_spec

CHUNK_CHARS = 6_000_000        # documents whose words share one local numbering
BUCKET_CHARS = 8_000_000        # text per bucket of the distinct-word table
_ROWS = "bucket long, chunk string, kind int, body binary"


def _pack(*arrays: np.ndarray) -> bytes:
    import pickle
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def _unpack(body: bytes):
    import pickle
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of like weight side by side: the upper ones are nearly all alike and compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _splitter(buckets: int, spec: str, numbered: bool):
    """Per chunk of documents one row with the words' local numbers by position, or one row per bucket with its words."""
    shift = U64(64) - U64(max(1, (buckets - 1).bit_length()))

    def chunk(docs, parts):
        hashes = np.concatenate([p[0] for p in parts])
        u, inverse = np.unique(hashes, return_inverse=True)
        words = np.empty(len(u), object)
        for h, w in ((p[0], p[1]) for p in parts):
            words[np.searchsorted(u, h)] = w
        numbers = np.concatenate([np.searchsorted(u, p[0])[p[2]] for p in parts]).astype(np.uint32)
        del inverse
        # Frequent words get small numbers, which pack into little more than a byte each; words met once keep hash order.
        often = np.bincount(numbers, minlength=len(u))
        common = np.flatnonzero(often > 1)
        common = common[np.argsort(-often[common], kind="stable")]
        rank = np.empty(len(u), np.uint32)
        rank[common] = np.arange(len(common))
        rank[often <= 1] = np.arange(len(common), len(u))
        numbers = rank[numbers]
        sizes = np.concatenate([p[3] for p in parts])
        bucket = (u >> shift).astype(np.int64)
        name = hashlib.blake2b(repr((len(docs), len(numbers), int(u.sum(dtype=U64)), docs)).encode(), digest_size=12).hexdigest()
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        if numbered:
            return [(-1, name, 0, _pack(np.array(docs, object), sizes, _planes(numbers), bucket[edges], common.astype(np.uint32)))]
        rows = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(u)]):
            text = "".join(words[a:b])
            rows.append((int(bucket[a]), name, 1, _pack(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32 if text and max(text) > "￿" else np.uint16),
                                                      np.fromiter(map(len, words[a:b]), np.uint32, b - a))))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = tuple(pieces_of(spec).specials)
        docs, parts, chars = [], [], 0

        def out(rows):
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, (pa.int64(), pa.string(), pa.int32(), pa.binary()))], names=["bucket", "chunk", "kind", "body"])

        for batch in small_batches(batches, 1):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                h, bounds, joined, s, e = split(texts[a:b], specials)
                u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                words = np.empty(len(u), object)
                words[:] = [joined[x:y] for x, y in zip(s[first].tolist(), e[first].tolist())]
                parts.append((u, words, inverse.astype(np.uint32), np.diff(bounds)))
                docs += keys[a:b]
                chars += len(joined)
                if chars >= CHUNK_CHARS:
                    yield from out(chunk(docs, parts))
                    docs, parts, chars = [], [], 0
        if docs:
            yield from out(chunk(docs, parts))
    return run


def _words(body: bytes) -> list[str]:
    cp, sizes = _unpack(body)
    text = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _encode_bucket(spec: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words = frame
        lists = [_words(b) for b in words["body"]]
        distinct = list(dict.fromkeys(w for x in lists for w in x))
        flat, counts = pieces_of(spec).encode(distinct)
        starts = np.cumsum(counts) - counts
        number = {w: i for i, w in enumerate(distinct)}
        bodies = []
        for x in lists:
            at = np.fromiter((number[w] for w in x), np.int64, len(x))
            n = counts[at]
            ends = np.cumsum(n)
            pick = np.repeat(starts[at] - (ends - n), n) + np.arange(int(n.sum()))
            bodies.append(_pack(flat[pick], n.astype(np.uint16 if n.max(initial=0) < 65536 else np.uint32)))
        return rows_of(chunk=words["chunk"].tolist(), kind=[1] * len(bodies), bucket=words["bucket"].tolist(), body=bodies)
    return run


def _join_chunk(spec: str, finish):
    """Ids of a chunk's words meet the numbers of its documents; ``finish`` makes rows of them, document by document."""
    def one(head: bytes, by: dict) -> list:
        docs, sizes, planes, buckets, common = _unpack(head)
        numbers = np.ascontiguousarray(planes.T).view("<u4").ravel()
        flats, counts = [np.empty(0, pieces_of(spec).width)], [np.empty(0, np.int64)]
        for b in buckets.tolist():
            flat, n = _unpack(by[b])
            flats.append(flat)
            counts.append(n.astype(np.int64))
        flat, n = np.concatenate(flats), np.concatenate(counts)
        starts = np.cumsum(n) - n
        once = np.ones(len(n), bool)
        once[common] = False
        order = np.concatenate((common.astype(np.int64), np.flatnonzero(once)))
        starts, n = starts[order], n[order]
        ends = np.cumsum(sizes)
        out, step, a = [], 200_000, 0
        while a < len(docs):                                    # a run of documents with about ``step`` words
            base = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + step, "right")))
            w = numbers[base:ends[b - 1]]
            c = n[w]
            stop = np.cumsum(c)
            ids = flat[np.repeat(starts[w] - (stop - c), c) + np.arange(int(c.sum()))]
            cut = np.concatenate(([0], stop))[np.concatenate(([0], ends[a:b] - base))]
            out += [finish(docs[i], ids[x:y]) for i, x, y in zip(range(a, b), cut[:-1].tolist(), cut[1:].tolist())]
            a = b
        return out

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        heads = frame[frame["kind"] == 0]["body"]
        words = frame[frame["kind"] == 1]
        if not len(heads):
            raise ValueError("the documents were read in another order the second time; store them before encoding")
        by = dict(zip(words["bucket"].tolist(), words["body"]))
        out = pd.DataFrame([r for h in heads for r in one(h, by)], dtype=object)      # equal chunks, if any, share their words
        give_back()
        return out
    return run


def encode(docs: DataFrame, spec: str, finish, schema: str) -> DataFrame:
    """Rows of ``finish(doc_id, ids)`` for every row of ``docs``; null texts count as empty, rows with one doc_id stay apart.

    1. Each task splits its documents and numbers their distinct words. 2. The words travel to buckets by hash; a bucket
    holds its share of the corpus's distinct-word table and encodes each of its words once. 3. The ids travel back to the
    chunk and meet the documents by position. Texts are not shuffled, only words, numbers and ids, in compressed blocks; a
    hot word is one entry per chunk however often it occurs.

    Documents are split twice, once for their words and once for their numbers, which is cheaper than moving the numbers
    twice. ``docs`` must therefore read the same again, as files do; the chunk's name holds a digest, and a difference fails.
    """
    rows, chars = byte_size(docs)
    buckets = max(8, -(-chars // BUCKET_CHARS))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    words = src.mapInArrow(_splitter(buckets, spec, False), _ROWS)
    numbers = src.mapInArrow(_splitter(buckets, spec, True), _ROWS).select("chunk", "kind", "bucket", "body")
    ids = words.groupBy("bucket").applyInPandas(_encode_bucket(spec), "chunk string, kind int, bucket long, body binary")
    return ids.unionByName(numbers).groupBy("chunk").applyInPandas(_join_chunk(spec, finish), schema)


def decode(tokens: DataFrame, pieces: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text_bytes) of rows of ids by a join with the id-to-piece table (id, piece binary), in the ids' order.

    The table is as large as the vocabulary, so Spark broadcasts it by its size. Rows are exploded with their position and
    brought together by key again; for whole corpora ``decoder`` does the same look-up inside the task that holds the ids.
    """
    one = tokens.select(F.col(key), F.posexplode_outer(ids).alias("pos", "id"))
    one = one.join(pieces, "id", "left")
    parts = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("p"))
    return parts.select(key, F.unhex(F.concat_ws("", F.transform("p", lambda x: x["h"]))).alias("text_bytes"))


def decoder(spec: str):
    """ids -> text by look-ups in the id-to-piece table; bytes that are no UTF-8 become the replacement sign."""
    from . import pretokens
    key = ("table", hash(spec))
    if key not in pretokens._STATE:
        pretokens._STATE[key] = pieces_of(spec).table()
    pieces = pretokens._STATE[key]
    return lambda ids: b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def digests(spec: str):
    def finish(doc_id, ids):
        ids = ids.tolist()
        text = decoder(spec)(ids)
        return {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}
    return finish


def op9_bpe_round_trip(spark, sf_dir):
    spec = tokenizer_spec()
    return encode(table(spark, sf_dir, "documents"), spec, digests(spec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
