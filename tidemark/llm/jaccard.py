"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, pruned by bounds that sizes give."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_size, frame as rows_of, small_batches, stored, table, text_slices, whole_text
from .graph import components, forest
from .hashing import U64, mix, word_hashes

WORDS = 5
PERCENT = 75                    # link when 100 * common >= PERCENT * union
CHUNK = 3_000_000               # incidence entries held by a task before it sends them on
BUCKET_CHARS = 8_000_000        # text per range of n-gram hashes
BLOCK = 256                     # documents per block of the product
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Distinct hashes of each text's n-grams; fewer words make one n-gram, none make an empty set."""
    h, bounds, _ = word_hashes(texts)
    m = max(0, len(h) - words + 1)
    grams = np.zeros(m, U64)
    for k in range(words):
        grams += h[k:k + m] * _ODD[k % len(_ODD)] + U64(k)
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            v = np.array([b - a], U64)
            for k in range(a, b):
                v = mix((v * _ODD[6]) ^ h[k:k + 1])
            out.append(v)
        else:
            out.append(np.empty(0, U64))
    return out


def _incidence(bits: int, words: int):
    """Per chunk of documents: a row of its documents' sizes and set fingerprints, and its entries by range of the hash."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.string()), ("kind", pa.int32()), ("body", pa.binary()), ("more", pa.binary())])

    def row(bucket, chunk, kind, body, more):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((bucket, chunk, kind, body, more), schema)], schema=schema)

    def send(place, ids, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        marks = np.zeros((len(sets), 2), U64)
        for i, s in enumerate(sets):
            marks[i] = s.sum(dtype=U64), mix(s ^ _ODD[1]).sum(dtype=U64)
        seen: dict = {}
        first = [d is not None and n > 0 and seen.setdefault((n, *m), i) == i for i, (n, m, d) in enumerate(zip(sizes.tolist(), marks.tolist(), ids))]
        who = np.repeat(np.arange(len(sets), dtype=np.uint32), np.where(first, sizes, 0))
        keys = np.concatenate([s for s, f in zip(sets, first) if f] or [np.empty(0, U64)])
        order = np.argsort(keys)
        keys, who = keys[order], who[order].astype(np.uint16 if len(sets) < 65536 else np.uint32)
        name = hashlib.blake2b(repr((place, ids[:3], len(ids))).encode() + marks.tobytes(), digest_size=12).hexdigest()
        head = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes), "a": pa.array(marks[:, 0]), "b": pa.array(marks[:, 1])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as w:
            w.write_batch(head)
        yield row(-1 - int(name[:12], 16), name, 0, sink.getvalue().to_pybytes(), b"")
        bucket = (keys >> U64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]            # the bucket tells the upper 8 bits
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            yield row(int(bucket[a]), name, who.itemsize, low[a:b].tobytes(), who[a:b].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, k, ids, sets, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in small_batches(batches, 1):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                new = shingle_sets(texts[a:b], words)
                ids += keys[a:b]
                sets += new
                held += sum(map(len, new))
                if held >= CHUNK:
                    yield from send((part, k), ids, sets)
                    ids, sets, held, k = [], [], 0, k + 1
        if ids:
            yield from send((part, k), ids, sets)
    return run


def _shared(bits: int):
    """Keeps the entries of n-grams that more than one document of the bucket has, with a rank by how many have it."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["kind"].iloc[0] == 0:
            return frame[["chunk", "kind", "body", "more"]]
        counts = [len(b) // 7 for b in frame["body"]]
        keys = np.zeros((sum(counts), 8), np.uint8)
        keys[:, :7] = np.frombuffer(b"".join(frame["body"]), np.uint8).reshape(-1, 7)
        keys = keys.view("<u8").ravel()
        if bits < 8:
            raise ValueError("buckets must tell the upper 8 bits")
        keys = (keys & U64((1 << 56) - 1)) | (U64(int(frame["bucket"].iloc[0]) >> (bits - 8)) << U64(56))
        _, inverse, df = np.unique(keys, return_inverse=True, return_counts=True)
        df = df[inverse]
        out, a = [], 0
        for chunk, kind, more, n in zip(frame["chunk"], frame["kind"], frame["more"], counts):
            hit = np.flatnonzero(df[a:a + n] > 1)
            who = np.frombuffer(more, np.uint16 if kind == 2 else np.uint32)[hit].astype(np.uint32)
            rank = np.minimum(np.log2(df[a:a + n][hit]) * 8, 255).astype(np.uint8)
            if len(hit):
                out.append((chunk, 1, keys[a:a + n][hit].tobytes(), who.tobytes() + rank.tobytes()))
            a += n
        return rows_of(**dict(zip(("chunk", "kind", "body", "more"), zip(*out)))) if out else frame.head(0)[["chunk", "kind", "body", "more"]]
    return run


def need(n, percent: int = PERCENT):
    """Fewest common n-grams that a set of n has with any set it links to: common >= t * union >= t * n."""
    return (percent * n + 99) // 100


def _assemble(percent: int):
    """Documents of a chunk with their shared n-grams, rarest first; a document with fewer than it needs has none at all."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = pa.ipc.open_stream(frame[frame["kind"] == 0]["body"].iloc[0]).read_all()
        n = head["n"].to_numpy()
        rest = frame[frame["kind"] == 1]
        keys = np.frombuffer(b"".join(rest["body"]), "<u8")
        who = np.concatenate([np.frombuffer(m, np.uint32, len(b) // 8) for b, m in zip(rest["body"], rest["more"])] or [np.empty(0, np.uint32)])
        rank = np.concatenate([np.frombuffer(m, np.uint8, offset=len(b) // 2) for b, m in zip(rest["body"], rest["more"])] or [np.empty(0, np.uint8)])
        found = np.bincount(who, minlength=len(n))
        alive = (found >= need(n, percent)) & (n > 0)
        pick = np.flatnonzero(alive[who]) if len(who) else np.empty(0, np.int64)
        keys, who, rank = keys[pick], who[pick], rank[pick]
        order = np.lexsort((keys, rank, who))
        keys, ends = keys[order].view(np.int64), np.cumsum(np.bincount(who, minlength=len(n)))
        lists = [keys[e - c:e] if ok else None for e, c, ok in zip(ends.tolist(), np.where(alive, found, 0).tolist(), alive.tolist())]
        mark = [f"{a:016x}{b:016x}" if k else None for a, b, k in zip(head["a"].to_pylist(), head["b"].to_pylist(), n.tolist())]
        return rows_of(doc_id=head["doc_id"].to_pylist(), n=n.tolist(), mark=mark, keys=lists)
    return run


def _product(percent: int):
    """Overlap counts of two blocks (or one with itself), then the pairs that reach the bound, as counts and a forest."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = frame["lo"].iloc[0] == frame["hi"].iloc[0]
        lists = [np.asarray(k, np.int64) for k in frame["keys"]]
        n, size = frame["n"].to_numpy(), frame["size"].to_numpy()
        left = np.flatnonzero(frame["block"].to_numpy() == frame["lo"].iloc[0])
        right = left if same else np.flatnonzero(frame["block"].to_numpy() == frame["hi"].iloc[0])
        nl, nr = len(left), len(right)
        place = np.zeros(len(n), np.int64)
        place[left] = np.arange(nl)
        if not same:
            place[right] = np.arange(nr)
        who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        _, col = np.unique(np.concatenate(lists), return_inverse=True)
        is_left = np.zeros(len(n), bool)
        is_left[left] = True
        lm = is_left[who]
        rm = lm if same else ~lm
        cl, cr = np.bincount(col[lm], minlength=col.max() + 1), np.bincount(col[rm], minlength=col.max() + 1)
        pairs = cl.astype(np.int64) * cr
        heavy = pairs > 256
        over = np.zeros((nl, nr), np.float32)
        heavy_cols = np.flatnonzero(heavy)
        for a in range(0, len(heavy_cols), 4096):
            number = np.full(len(cl), -1, np.int64)
            number[heavy_cols[a:a + 4096]] = np.arange(len(heavy_cols[a:a + 4096]))
            c = number[col]
            x, y = np.zeros((nl, c.max() + 1), np.float32), np.zeros((nr, c.max() + 1), np.float32)
            s = lm & (c >= 0)
            x[place[who[s]], c[s]] = 1
            s = rm & (c >= 0)
            y[place[who[s]], c[s]] = 1
            over += x @ y.T
        light = (pairs > 0) & ~heavy
        s, t = np.flatnonzero(lm & light[col]), np.flatnonzero(rm & light[col])
        s, t = s[np.argsort(col[s], kind="stable")], t[np.argsort(col[t], kind="stable")]
        begin = np.cumsum(np.where(light, cr, 0)) - np.where(light, cr, 0)
        for a in range(0, len(s), 1 << 16):                    # every light entry meets the other block's entries of its column
            part = s[a:a + (1 << 16)]
            k = cr[col[part]]
            ends = np.cumsum(k)
            other = t[np.repeat(begin[col[part]] - (ends - k), k) + np.arange(int(k.sum()))]
            flat = place[np.repeat(who[part], k)] * nr + place[who[other]]
            over += np.bincount(flat, minlength=nl * nr).reshape(nl, nr)
        over = over.astype(np.int64)
        a, b = n[left][:, None], n[right][None, :]
        link = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (100 * over >= percent * (a + b - over))
        if same:
            np.fill_diagonal(link, False)
        links = np.zeros(len(n), np.int64)
        links[left] += link @ size[right]
        if not same:
            links[right] += link.T @ size[left]
        x, y = np.nonzero(link)
        x, y = left[x], right[y]
        tree = forest(x, y)
        node, mark = frame["node"].to_numpy(), frame["mark"].to_numpy()
        got = np.flatnonzero(links)
        none = [None] * len(got)
        return rows_of(mark=[*mark[got].tolist(), *[None] * len(tree)], links=[*links[got].tolist(), *[0] * len(tree)],
                       a=[*none, *node[x[tree]].tolist()], b=[*none, *node[y[tree]].tolist()])
    return run


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (rows linked directly).

    1. Incidence entries (n-gram, document) go to ranges of the n-gram's hash, 9 bytes each in blocks; only n-grams that
    several documents have return. A document with fewer of those than it needs for any link is out: most are.
    2. Equal sets become one class. A class is compared by the rarest of its shared n-grams, so many that two classes that
    link have one of them in common; classes that meet so are dealt to blocks of about BLOCK, likely partners together.
    3. Each pair of blocks with common rare n-grams is one sparse product: overlaps are accumulated, pairs below the bounds
    are dropped inside the task, and per document a count plus a spanning forest of the links leave it. A hot n-gram is
    spread over as many block pairs as it needs; no pair of it is ever a row.

    Empty and null texts have no n-grams and link with nothing. Rows with a null doc_id link with nothing and have a null
    component. Rows with one doc_id are one node. An empty table gives no rows. Sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    _, chars = byte_size(docs)
    bits = max(8, (max(1, chars // BUCKET_CHARS) - 1).bit_length())
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    cells = src.mapInArrow(_incidence(bits, words), "bucket long, chunk string, kind int, body binary, more binary")
    shared = cells.groupBy("bucket").applyInPandas(_shared(bits), "chunk string, kind int, body binary, more binary")
    rows = stored(shared.groupBy("chunk").applyInPandas(_assemble(percent), "doc_id long, n long, mark string, keys array<long>"), "shingles")
    named = rows.where("mark IS NOT NULL AND doc_id IS NOT NULL")
    sizes = named.groupBy("mark").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size"))
    alive = named.where("keys IS NOT NULL").groupBy("mark").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).join(sizes, "mark")
    prefix = F.slice("keys", F.lit(1), (F.size("keys") - F.expr(f"({percent} * n + 99) div 100") + 1).cast("int"))
    home = F.array_min(F.transform(F.expr("rare"), lambda k: F.xxhash64(k)))
    alive = alive.withColumn("rare", prefix).withColumn("home", home)
    per_home = alive.groupBy("home").agg(F.count(F.lit(1)).alias("at_home"))
    alive = stored(alive.join(per_home, "home"), "classes")
    blocks = max(1, alive.count() // BLOCK)
    block = F.when(F.col("at_home") <= BLOCK, F.pmod(F.xxhash64("home", F.lit(1)), F.lit(blocks))).otherwise(
        F.xxhash64("home", F.pmod(F.xxhash64("mark"), F.ceil(F.col("at_home") / BLOCK))))
    # Eight bytes stand for a class while it meets others: classes whose numbers clash are only compared once more.
    alive = alive.withColumn("block", block).withColumn("number", F.xxhash64("mark")).drop("home", "at_home")
    rare = alive.select("block", "number", F.explode("rare").alias("key"))
    by_key = rare.groupBy("key", "block").agg(F.count(F.lit(1)).alias("here"))
    common = by_key.groupBy("key").agg(F.sum("here").alias("all")).where("all > 1")
    by_key = by_key.join(common, "key").select("key", F.col("block").alias("other"), "here")
    meet = rare.join(by_key, "key").where("other != block OR here > 1")
    meet = meet.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "number").distinct()
    groups = meet.join(alive.select("number", "mark", "node", "n", "size", "block", "keys"), "number").where("block = lo OR block = hi")
    found = stored(groups.groupBy("lo", "hi").applyInPandas(_product(percent), "mark string, links long, a long, b long"), "links")
    comp = components(found.where("a IS NOT NULL").select("a", "b"))
    links = found.where("mark IS NOT NULL").groupBy("mark").agg(F.sum("links").alias("links"))
    per_class = (sizes.join(links, "mark", "left").join(comp, sizes["node"] == comp["node"], "left")
                 .select(F.col("mark"), sizes["node"].alias("least_id"), "size", "links", "component"))
    full = named.join(per_class, "mark").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "least_id").alias("component_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = rows.where("mark IS NULL OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(alone)


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
