"""Duplicate passages by prefix-free parsing: rolling-hash triggers cut texts into phrases, equal phrases are one entry of a
dictionary, and only the dictionary's suffixes are sorted."""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_size, stored, table, whole_text
from .hashing import _BYTES, U64, _powers, mix

LENGTH = 50                     # bytes of a string that counts as repeated
TRIGGER = 26                    # bytes under the rolling hash; every LENGTH bytes hold LENGTH - TRIGGER + 1 = 25 of them
SPAN = LENGTH - TRIGGER + 1
CHUNK = 2_000_000               # phrases held by a task before it sends them on
BUCKET_CHARS = 8_000_000        # text per bucket, of documents as of phrases
HOT = 4096                      # contexts of one trigger in one sort; beyond, its strings are dealt out by content
_PIECE = 1 << 20


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of data[p:p + TRIGGER] for every p."""
    out = np.empty(max(0, len(data) - TRIGGER + 1), U64)
    up, down = _powers(_PIECE + TRIGGER + 1)
    for a in range(0, len(out), _PIECE):
        b = min(a + _PIECE, len(out))
        part = data[a:b + TRIGGER - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTES[part] * up[:len(part)], out=sums[1:])
        out[a:b] = mix((sums[TRIGGER:] - sums[:-TRIGGER]) * down[:b - a])
    return out


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i:i + n] for every i, by doubling."""
    k = 1
    while 2 * k <= n:
        x = op(x[:-k], x[k:])
        k *= 2
    return op(x[:len(x) - (n - k)], x[n - k:]) if n > k else x


def phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger hash, phrase hash, first string, last string) of a text's bytes, in text order.

    A string is LENGTH bytes from its start. Its trigger is the leftmost smallest rolling hash inside it, so equal strings
    have equal triggers at equal places. The strings of one trigger start side by side, first to last; the phrase runs from
    the first one's start to the last one's end, and its hash tells its bytes and where in it the trigger lies.
    """
    if len(data) < LENGTH:
        e = np.empty(0, np.int64)
        return e.view(U64), e.view(U64), e, e
    h = _rolling(data)
    least = _sliding(h, SPAN, np.minimum)                       # one for each string
    padded = np.concatenate((np.zeros(SPAN - 1, U64), least, np.zeros(SPAN - 1, U64)))
    triggers = np.flatnonzero(_sliding(padded, SPAN, np.maximum) == h)
    starts = np.arange(len(least))
    at = np.searchsorted(triggers, starts)
    open_ = np.flatnonzero(h[triggers[at]] != least)
    while len(open_):
        at[open_] += 1
        open_ = open_[h[triggers[at[open_]]] != least[open_]]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    owner = triggers[at[cut]]
    first, last = cut, np.append(cut[1:], len(least)) - 1
    up, down = _powers(_PIECE + LENGTH + SPAN + 1)
    body = np.empty(len(first), U64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + _PIECE, "left")))
        lo, hi = int(first[a]), int(last[b - 1]) + LENGTH
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTES[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        body[a:b] = (sums[last[a:b] + LENGTH - lo] - sums[first[a:b] - lo]) * down[first[a:b] - lo]
        a = b
    body = mix(body ^ ((owner - first).astype(U64) << U64(58)) ^ ((last - first).astype(U64) * U64(0xD6E8FEB86659FD93)))
    return h[owner], body, first, last


def _token(key: np.ndarray, body: np.ndarray) -> np.ndarray:
    """48 bits that name a phrase inside a document."""
    return mix(key ^ (body * U64(0x9E3779B97F4A7C15))) >> U64(16)


def _dump(*x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def _load(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _place(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64)) % U64(buckets)).astype(np.int64)


_SCHEMA = pa.schema([("bucket", pa.int64()), ("body", pa.binary())])


def _row(bucket: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([body], pa.binary())], schema=_SCHEMA)


def _groups(key: np.ndarray):
    edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1)).tolist() if len(key) else []
    return zip(edges, [*edges[1:], len(key)])


def _parse(buckets: int):
    """Dictionary entries of a task's documents: per (trigger, phrase) the smallest document. Others know their fate already,
    but they are told with the rest, so the answer does not depend on how documents were dealt."""
    def send(parts):
        key, body, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
        bucket = (key % U64(buckets)).astype(np.int64)
        order = np.lexsort((doc, key, bucket))
        key, body, doc, bucket = key[order], body[order], doc[order], bucket[order]
        for a, b in _groups(bucket):
            low = int(doc[a:b].min())
            planes = (doc[a:b] - low).astype("<u8").view(np.uint8).reshape(-1, 8).T
            used = max(1, int(np.flatnonzero(planes.any(1)).max(initial=0)) + 1)
            raw = [x[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:7].tobytes() for x in (key, body)]
            yield _row(int(bucket[a]), pickle.dumps((b - a, low, used, np.ascontiguousarray(planes[:used]).tobytes(), *raw), 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc is None:
                    continue
                key, body, _, _ = phrases(np.frombuffer(text.as_buffer(), np.uint8))
                if not len(key):
                    continue
                parts.append((key, body, np.full(len(key), doc, np.int64)))
                held += len(key)
                if held >= CHUNK:
                    yield from send(parts)
                    parts, held = [], 0
        if parts:
            yield from send(parts)
    return run


def _short(x: np.ndarray) -> np.ndarray:
    """The 40 bits of a hash that travel."""
    return (x >> U64(16)) & U64((1 << 40) - 1)


def _match(buckets: int):
    """Which phrases an earlier document has whole (1), and which meet another phrase at their trigger (2; 3 where hot)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, bodies, docs = [], [], []
        for raw in frame["body"]:
            n, low, used, planes, k, b = pickle.loads(raw)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :used] = np.frombuffer(planes, np.uint8).reshape(used, n).T
            docs.append(wide.view("<u8").ravel().view(np.int64) + low)
            for raw5, out in ((k, keys), (b, bodies)):
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(raw5, np.uint8).reshape(n, 5)
                out.append(wide.view("<u8").ravel())
        key, body, doc = map(np.concatenate, (keys, bodies, docs))
        order = np.lexsort((doc, body, key))
        key, body, doc = key[order], body[order], doc[order]
        new_key = np.diff(key, prepend=~key[:1]) != 0
        new_body = new_key | (np.diff(body, prepend=~body[:1]) != 0)
        of_key, of_body = np.cumsum(new_key) - 1, np.cumsum(new_body) - 1
        first = doc[new_body]                                    # smallest document of every phrase
        variants = np.bincount(of_key[new_body])
        low, high = np.minimum.reduceat(doc, np.flatnonzero(new_key)), np.maximum.reduceat(doc, np.flatnonzero(new_key))
        shared = (low < high)[of_key]
        whole = doc > first[of_body]
        lead = ~whole & shared & (variants > 1)[of_key]
        status = np.where(whole, 1, np.where(lead, np.where((variants > HOT)[of_key], 3, 2), 0)).astype(np.uint8)
        pick = np.flatnonzero(status)
        token, d, s = _token(key[pick], body[pick]), doc[pick], status[pick]
        place = _place(d, buckets)
        order = np.lexsort((token, d, place))
        token, d, s, place = token[order], d[order], s[order], place[order]
        fresh = (np.diff(token, prepend=~token[:1]) != 0) | (np.diff(d, prepend=d[:1] - 1) != 0)
        token, d, s, place = token[fresh], d[fresh], s[fresh], place[fresh]
        out = [(int(place[a]), _dump(d[a:b], token[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), s[a:b])) for a, b in _groups(place)]
        return pd.DataFrame(out, columns=["bucket", "body"])
    return run


def _texts(buckets: int):
    """Documents in compressed blocks by bucket of doc_id."""
    def send(docs, texts):
        place = _place(np.array([0 if d is None else d for d in docs], np.int64), buckets)
        order = np.argsort(place, kind="stable")
        for a, b in _groups(place[order]):
            pick = order[a:b].tolist()
            yield _row(int(place[pick[0]]), _dump([docs[i] for i in pick], [texts[i] for i in pick]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                texts.append(text.as_buffer().to_pybytes())
                held += len(texts[-1])
                if held >= 24_000_000:
                    yield from send(docs, texts)
                    docs, texts, held = [], [], 0
        if docs:
            yield from send(docs, texts)
    return run


def _told(frame: pd.DataFrame) -> dict:
    """{doc: (tokens ascending, values)} of the answers to a bucket's documents."""
    docs, tokens, values = [], [], []
    for raw in frame["body"]:
        d, t, v = _load(raw)
        wide = np.zeros((len(d), 8), np.uint8)
        wide[:, :6] = np.frombuffer(t, np.uint8).reshape(-1, 6)
        docs.append(d)
        tokens.append(wide.view("<u8").ravel())
        values.append(v.astype(np.uint32))
    if not docs:
        return {}
    d, t, v = map(np.concatenate, (docs, tokens, values))
    order = np.lexsort((t, d))
    d, t, v = d[order], t[order], v[order]
    return {int(d[a]): (t[a:b], v[a:b]) for a, b in _groups(d)}


def _values(told, token: np.ndarray) -> np.ndarray:
    out = np.zeros(len(token), np.uint32)
    if told is not None and len(token):
        t, v = told
        at = np.minimum(np.searchsorted(t, token), len(t) - 1)
        hit = t[at] == token
        out[hit] = v[at[hit]]
    return out


def _contexts(buckets: int):
    """Dictionary entries to be compared string by string, with their bytes, dealt out by trigger (hot ones by string)."""
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        told, rows = _told(answers), {}
        for raw in docs["body"]:
            for doc, text in zip(*_load(raw)):
                if doc is None or doc not in told:
                    continue
                data = np.frombuffer(text, np.uint8)
                key, body, first, last = phrases(data)
                token = _token(_short(key), _short(body))
                status = _values(told[doc], token)
                pick = np.flatnonzero(status >= 2)
                pick = pick[np.unique(token[pick], return_index=True)[1]]
                for i in pick.tolist():
                    a, b = int(first[i]), int(last[i])
                    if status[i] == 2:
                        rows.setdefault(int(key[i] % U64(buckets)), []).append((doc, int(token[i]), 0, text[a:b + LENGTH]))
                    else:
                        for o in range(b - a + 1):
                            s = text[a + o:a + o + LENGTH]
                            rows.setdefault(int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little") % buckets, []).append((doc, int(token[i]), o, s))
        return pd.DataFrame([(k, _dump(v)) for k, v in rows.items()], columns=["bucket", "body"])
    return run


def _order(buckets: int):
    """Sorts the suffixes of the dictionary entries of a bucket by LENGTH bytes; in every run of equals the smallest document
    is the first owner, and the strings of all others are repeats. Answers with a bit for each string of a phrase."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        entries = [e for raw in frame["body"] for e in _load(raw)[0]]
        data = np.frombuffer(b"".join(e[3] for e in entries) + bytes(6), np.uint8)
        size = np.array([len(e[3]) for e in entries])
        count = size - LENGTH + 1
        begin = np.cumsum(size) - size
        entry = np.repeat(np.arange(len(entries)), count)
        offset = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[entry] + offset
        words = np.zeros(len(data) - 7 if len(data) > 7 else 0, U64)
        for k in range(8):
            words = (words << U64(8)) | data[k:k + len(words)]
        columns = [words[at + k] for k in range(0, LENGTH - 7, 8)] + [words[at + LENGTH - 8]]      # big-endian: the order of bytes
        doc = np.array([e[0] for e in entries], np.int64)[entry]
        order = np.lexsort((doc, *columns[::-1]))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= np.diff(c[order]) != 0
        owner = doc[order][new][np.cumsum(new) - 1]
        hit = order[doc[order] > owner]
        token = np.array([e[1] for e in entries], U64)[entry[hit]]
        bit = (1 << (offset[hit] + np.array([e[2] for e in entries])[entry[hit]])).astype(np.uint32)
        d = doc[hit]
        place = _place(d, buckets)
        order = np.lexsort((token, d, place))
        token, d, bit, place = token[order], d[order], bit[order], place[order]
        out = [(int(place[a]), _dump(d[a:b], token[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), bit[a:b] << np.uint32(2))) for a, b in _groups(place)]
        return pd.DataFrame(out, columns=["bucket", "body"])
    return run


def _remove(finish):
    """Each document with the mask of its repeated bytes."""
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        told, out = {}, []
        for doc, (t, v) in _told(answers).items():
            new = np.flatnonzero(np.diff(t, prepend=~t[:1]))
            told[doc] = (t[new], np.bitwise_or.reduceat(v, new))
        for raw in docs["body"]:
            for doc, text in zip(*_load(raw)):
                data = np.frombuffer(text, np.uint8)
                gone = np.zeros(len(data), bool)
                if doc is not None and doc in told:
                    key, body, first, last = phrases(data)
                    value = _values(told[doc], _token(_short(key), _short(body)))
                    n = last - first + 1
                    k = np.repeat(np.arange(len(first)), n)
                    o = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    hit = ((value[k] & 3) == 1) | (((value[k] >> np.uint32(2)) >> o.astype(np.uint32)) & 1).astype(bool)
                    start = (first[k] + o)[hit]
                    depth = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + LENGTH, minlength=len(data) + 1)
                    gone = np.cumsum(depth)[:len(data)] > 0
                out.append(finish(doc, data, gone))
        return pd.DataFrame(out, dtype=object)
    return run


def dedupe_passages(docs: DataFrame, finish, schema: str) -> DataFrame:
    """Rows of ``finish(doc_id, bytes, mask)`` for every row of ``docs``; the mask marks each byte inside a LENGTH-byte string
    that also starts in a document with a smaller doc_id. Texts count as UTF-8 bytes, null as empty.

    1. Parse. Triggers cut every text into phrases; (trigger, phrase, document) travels to the trigger's bucket in about 12
    bytes. A phrase that an earlier document has whole is repeated whole: long copies end here, however many there are.
    2. Dictionary. Where different phrases meet at a trigger (the ends of shared passages), the first document of each
    phrase sends its bytes, and the suffixes of these entries are sorted to find equal strings and their first document.
    3. The parse and the sorted dictionary together tell every document its repeated strings.

    Rows with a null doc_id neither lose bytes nor take any; rows with one doc_id do not count as earlier than each other;
    texts shorter than LENGTH lose nothing; an empty table gives no rows. Triggers and phrases are told apart by 40 bits
    and more of their hashes (a clash only makes a comparison more), phrases within a trigger by 40 bits, strings by bytes.
    """
    spark = docs.sparkSession
    _, chars = byte_size(docs)
    buckets = max(16, -(-chars // BUCKET_CHARS))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    rows = "bucket long, body binary"
    answers = stored(src.mapInArrow(_parse(buckets), rows).groupBy("bucket").applyInPandas(_match(buckets), rows), "parse")
    texts = src.mapInArrow(_texts(buckets), rows)
    entries = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(_contexts(buckets), rows)
    strings = stored(entries.groupBy("bucket").applyInPandas(_order(buckets), rows), "strings")
    told = answers.unionByName(strings)
    return texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(_remove(finish), schema)


def digest(doc, data: np.ndarray, gone: np.ndarray) -> dict:
    return {"doc_id": doc, "n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()),
            "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest()}


def op10_passage_dedup(spark, sf_dir):
    return dedupe_passages(table(spark, sf_dir, "documents"), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
