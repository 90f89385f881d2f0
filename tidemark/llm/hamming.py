"""Exact top-k search over binary codes by multi-index hashing: segment radii grow until the kth distance is proven."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SEGMENT = 16                    # bits of a code that one index covers
BLOCK_ROWS = 65_536             # codes per block of one index
SHARE_ROWS = 8_192              # queries that meet a block at once
K = 10


def binary_codes(vectors: DataFrame) -> DataFrame:
    """(id, code): one bit per component, set where it is positive, as a string of SEGMENT-bit numbers. Null vectors and
    null components count as no code and as an unset bit."""
    bits = F.transform("embedding", lambda x: F.coalesce((x > 0).cast("long"), F.lit(0)))
    word = lambda s: F.aggregate(F.slice("bits", s * SEGMENT + 1, SEGMENT), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    segments = F.transform(F.sequence(F.lit(0), F.ceil(F.size("bits") / SEGMENT).cast("int") - 1), word)
    return (vectors.select(F.col("vec_id").cast("long").alias("id"), bits.alias("bits")).where("bits IS NOT NULL AND id IS NOT NULL AND size(bits) > 0")
            .select("id", segments.alias("code"), F.size("bits").alias("width")))


_ONES = np.array([bin(i).count("1") for i in range(1 << SEGMENT)], np.uint8)


def _probe(k: int, radius: int):
    """New candidates of one block of one index at segment distance ``radius``: non-empty buckets first, then whole codes.

    A code is reported by the first segment that is this near only; codes beyond the query's bound are not reported, nor
    those that ``k`` ids at smaller distances or ``k`` codes by (distance, node) come before in the block.
    """
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "node": [], "distance": []}
        if len(asked) and len(held):
            seg = int(asked["seg"].iloc[0])
            codes, queries = np.array(held["code"].tolist(), np.int64), np.array(asked["code"].tolist(), np.int64)
            node, size, bound = held["node"].to_numpy(), held["size"].to_numpy(), asked["bound"].to_numpy()
            values, of = np.unique(codes[:, seg], return_inverse=True)
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of))
            for i, q in enumerate(queries):
                near = np.flatnonzero(_ONES[values ^ q[seg]] == radius)
                if not len(near):
                    continue
                at = np.concatenate([order[(ends[b - 1] if b else 0):ends[b]] for b in near.tolist()])
                apart = _ONES[codes[at] ^ q]
                fresh = (apart[:, :seg] > radius).all(1) & (apart[:, seg + 1:] >= radius).all(1)
                d = apart.sum(1, dtype=np.int64)
                fresh &= d <= bound[i]
                at, d = at[fresh], d[fresh]
                if len(at) > k:
                    best = np.lexsort((node[at], d))[:k]
                    kth = int(np.searchsorted(np.cumsum(size[at][best]), k))
                    best = best[d[best] <= d[best[min(kth, len(best) - 1)]]]     # a tied node's smallest id may be needed
                    at, d = at[best], d[best]
                out["query"] += [int(asked["node"].iloc[i])] * len(at)
                out["node"] += node[at].tolist()
                out["distance"] += d.tolist()
        return pd.DataFrame(out).astype("int64")
    return run


def hamming_search(database: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row of ``queries`` its ``k`` nearest rows of ``database`` other than
    itself, by Hamming distance, then id. Both have (id, code, width) as ``binary_codes`` makes them; codes of different
    width never meet. Fewer rows come where the database has fewer.

    Equal codes are one node with its k + 1 smallest ids, all that any answer can use. With m segments, a code at distance
    d has a segment within d // m, so once all segments were searched to radius r, every code up to m * (r + 1) - 1 is
    known. A query leaves when its (k + 1)th verified distance lies within that; the others go on with r + 1. Each block
    of an index answers with its best k + 1 within the query's bound so far; nothing else leaves the task.
    """
    spark = database.sparkSession
    order = Window.partitionBy("width", "code").orderBy("id")
    top = database.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    nodes = stored(top.groupBy("width", "code").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"))
                   .select("node", "width", "code", "ids", F.size("ids").alias("size")), "codes")
    asked = stored(queries.groupBy("width", "code").agg(F.min("id").alias("node")).select("node", "width", "code"), "asked")
    widths = {r["width"]: r["n"] for r in nodes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}    # one row per code length
    answers = []
    for width, n in sorted(widths.items()):
        m, blocks = -(-width // SEGMENT), -(-n // BLOCK_ROWS)
        segs = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        index = nodes.where(F.col("width") == width).select("node", "code", "size", segs.alias("seg"))
        index = index.withColumn("block", F.pmod(F.xxhash64(F.col("code")[F.col("seg")]), F.lit(blocks)))
        open_ = asked.where(F.col("width") == width).select("node", "code", F.lit(width).alias("bound"))
        best, waiting = None, max(1, open_.count())
        for radius in range(SEGMENT + 1):
            shares = -(-waiting // SHARE_ROWS)                  # neither all queries nor a whole index meet in one task
            probes = open_.select("node", "code", "bound", segs.alias("seg"), F.pmod(F.xxhash64("node"), F.lit(shares)).alias("share"))
            probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            sides = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            found = probes.groupBy("seg", "block", "share").cogroup(sides.groupBy("seg", "block", "share")).applyInPandas(_probe(k + 1, radius), "query long, node long, distance long")
            found = found.join(nodes.select("node", F.col("size").alias("count")), "node")
            pool = found if best is None else found.unionByName(best)
            by = Window.partitionBy("query").orderBy("distance", "node")
            pool = pool.withColumn("place", F.row_number().over(by)).withColumn("ids", F.sum("count").over(by.rowsBetween(Window.unboundedPreceding, 0)))
            # Ids at smaller distances count against a node, those of tied nodes do not: their ids may be larger than its own.
            closer = F.coalesce(F.max("ids").over(Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
            pool = stored(pool.withColumn("closer", closer).where((F.col("place") <= k + 1) & (F.col("closer") < k + 1)), "nearest")
            best = pool.select("query", "node", "distance", "count")
            state = pool.groupBy("query").agg(F.sum("count").alias("have"), F.max("distance").alias("kth"))
            state = open_.join(state, open_["node"] == state["query"], "left")
            proven = m * (radius + 1) - 1
            done = (F.coalesce("have", F.lit(0)) >= k + 1) & (F.col("kth") <= proven)
            left = stored(state.where(~done).select(open_["node"], "code", F.when(F.col("have") >= k + 1, F.col("kth")).otherwise(F.lit(width)).alias("bound")), "open")
            open_ = left
            waiting = left.count()
            if proven >= width or waiting == 0:
                break
        answers.append(best)
    if not answers:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance long")
    best = reduce(DataFrame.unionByName, answers).join(nodes.select("node", "ids"), "node").select(F.col("query").alias("q_node"), "distance", F.explode("ids").alias("neighbour_id"))
    mine = queries.join(asked.withColumnRenamed("node", "q_node"), ["width", "code"]).select(F.col("id").alias("query_id"), "q_node")
    pairs = mine.join(best, "q_node").where("query_id != neighbour_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


def op2_hamming_top_k(spark, sf_dir):
    codes = stored(binary_codes(table(spark, sf_dir, "embeddings")), "binary")
    return hamming_search(codes, codes.where("id % 20 = 0"))


SEARCH_SQL = f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
 d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbour_id,
  CAST(len(list_filter(list_zip(q.b, n.b), lambda z: z[1] != z[2])) AS BIGINT) AS distance
  FROM c q JOIN c n ON q.vec_id % 20 = 0 AND q.vec_id != n.vec_id AND len(q.b) = len(n.b)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
 SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= {K}"""
