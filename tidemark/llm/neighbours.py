"""Embedding near-duplicates by NN-descent: neighbours of neighbours refine a graph whose edges at the threshold are links."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame as rows_of
from .common import stored, table
from .graph import components, forest

COSINE = 0.93
FLOOR = 0.6                     # edges below it cannot join links: two vectors within COSINE of a third are within 0.73
LIST = 16                       # neighbours kept per vector before its list is enlarged
LEAF = 96                       # vectors compared with each other for the first lists
TREES = 10
ROUNDS = 6
BLOCK = 512
SHARE = 2048                    # balls of blocks that meet at once
PROBES = 50                     # vectors of the audit, compared with all of their label
RECALL = 0.9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): labels and vectors that can link; others have a null, zero or non-finite component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where("label IS NOT NULL AND vec_id IS NOT NULL")
            .where(finite).where(F.exists("v", lambda x: x != 0)))


def _unit(rows) -> np.ndarray:
    x = np.array(list(map(np.asarray, rows)), np.float64)
    x = x / np.abs(x).max(1, keepdims=True)                     # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(sim: np.ndarray, left: np.ndarray, right: np.ndarray, size: int):
    """(left, right, cosine) of each row's best ``size`` entries at FLOOR or above, itself left out."""
    k = min(size + 1, sim.shape[1])
    top = np.argpartition(-sim, k - 1, 1)[:, :k] if k < sim.shape[1] else np.tile(np.arange(sim.shape[1]), (len(sim), 1))
    a, b = np.repeat(left, top.shape[1]), right[top.ravel()]
    s = np.take_along_axis(sim, top, 1).ravel()
    keep = (a != b) & (s >= FLOOR)
    return a[keep], b[keep], s[keep]


def _leaf(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, out = frame["vec_id"].to_numpy(), []
        x = _unit(frame["v"])
        for a in range(0, len(x), BLOCK):                       # an uneven leaf is still compared in blocks
            out.append(_best(x[a:a + BLOCK] @ x.T, ids[a:a + BLOCK], ids, size))
        a, b, s = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"a": a, "b": b, "s": s})
    return run


def _trees(data: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """Leaves of random hyperplane trees, as deep as a label's share needs; a leaf that copies overfill is split by chance."""
    def codes(batches):
        for dim, f in ((d, f) for whole in batches for d, f in whole.groupby(whole["v"].map(len))):
            planes = np.random.default_rng((seed, dim)).normal(size=(TREES, 24, dim))
            x = _unit(f["v"])
            depth = f["depth"].to_numpy()
            for t in range(TREES):
                bits = (x @ planes[t].T > 0).astype(np.int64)
                bits[np.arange(24)[None, :] >= depth[:, None]] = 0
                yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "tree": t, "leaf": bits @ (1 << np.arange(24)), "v": f["v"]})

    depth = F.least(F.lit(24), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int")
    rows = data.join(counts.select("label", depth.alias("depth")), "label").select("vec_id", "label", "v", "depth")
    rows = rows.mapInPandas(codes, f"vec_id long, label {dict(data.dtypes)['label']}, tree int, leaf long, v array<double>")
    per_leaf = rows.groupBy("label", "tree", "leaf").agg(F.count(F.lit(1)).alias("in_leaf"))
    return rows.join(per_leaf, ["label", "tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "tree"), F.ceil(F.col("in_leaf") / (4 * LEAF))))


def _lists(edges: DataFrame, size: int) -> DataFrame:
    """The best ``size`` different neighbours of every vector; partial maxima first, so a hub's candidates never meet whole."""
    from pyspark.sql import Window
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).groupBy("a", "b").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return both.withColumn("r", rank).where(F.col("r") <= size).select("a", "b", "s")


def _refine(size: int):
    """Compares the neighbours of one vector with each other."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["b"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "s": np.empty(0)})
        x = _unit(frame["v"])
        a, b, s = _best(x @ x.T, ids, ids, size)
        return pd.DataFrame({"a": a, "b": b, "s": s})
    return run


def _count(cosine: float):
    """Links between two blocks (or inside one): how many vectors and how many rows each vector links with there, and a forest of them."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        block, ids, x = frame["block"].to_numpy(), frame["vec_id"].to_numpy(), _unit(frame["v"])
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        found = x[left] @ x[right].T >= cosine
        if lo == hi:
            np.fill_diagonal(found, False)
        copies, links, weight = frame["copies"].to_numpy(), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        links[left] += found.sum(1)
        weight[left] += found @ copies[right]
        if lo != hi:
            links[right] += found.sum(0)
            weight[right] += copies[left] @ found
        p, q = np.nonzero(found)
        p, q = ids[left[p]], ids[right[q]]
        tree = forest(p, q)
        got, none = np.flatnonzero(links), [None] * int((links > 0).sum())
        return rows_of(vec_id=[*ids[got].tolist(), *[None] * len(tree)], links=[*links[got].tolist(), *[0] * len(tree)],
                       weight=[*weight[got].tolist(), *[0] * len(tree)], a=[*none, *p[tree].tolist()], b=[*none, *q[tree].tolist()])
    return run


def _ball(frame: pd.DataFrame) -> pd.DataFrame:
    """Centre of a block's vectors and the widest angle from it to one of them."""
    x = _unit(frame["v"])
    centre = x.sum(0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-6 else x[0]             # opposite vectors have no mean direction
    return rows_of(label=[frame["label"].iloc[0]], block=[frame["block"].iloc[0]], centre=[centre.tolist()], radius=[float(np.arccos(np.clip(x @ centre, -1, 1)).max())])


def _meet(cosine: float):
    """Pairs of blocks of two shares whose balls are near enough to hold a link; angles obey the triangle inequality."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        share = frame["share"].to_numpy()
        left = np.flatnonzero(share == frame["lo"].iloc[0])
        right = np.flatnonzero(share == frame["hi"].iloc[0])
        block, radius, c = frame["block"].to_numpy(), frame["radius"].to_numpy(), np.array(frame["centre"].tolist())
        reach = radius[left][:, None] + radius[right][None, :] + np.arccos(cosine) + 1e-6
        p, q = np.nonzero(np.arccos(np.clip(c[left] @ c[right].T, -1, 1)) <= reach)
        p, q = block[left[p]], block[right[q]]
        if frame["lo"].iloc[0] == frame["hi"].iloc[0]:
            p, q = p[p <= q], q[p <= q]
        return pd.DataFrame({"label": frame["label"].iloc[0], "lo": np.minimum(p, q), "hi": np.maximum(p, q)})
    return run


def _whole(member: DataFrame, data: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, links, weight, a, b): all links between the vectors of ``member`` (vec_id, block), by pairs of blocks of a label that may hold one."""
    held = stored(member.join(data, "vec_id").select("vec_id", "label", "block", "copies", "v"), "blocks")
    balls = held.groupBy("label", "block").applyInPandas(_ball, "label long, block long, centre array<double>, radius double")
    balls = stored(balls, "balls")
    shares = balls.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
    balls = balls.join(shares, "label").withColumn("share", F.pmod(F.xxhash64("block", F.lit(6)), F.col("shares")))
    balls = balls.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("shares") - 1).cast("int"))))
    balls = balls.select("label", "block", "centre", "radius", "share", F.least("share", "other").alias("lo"), F.greatest("share", "other").alias("hi"))
    pair = balls.groupBy("label", "lo", "hi").applyInPandas(_meet(cosine), "label long, lo long, hi long")
    pair = pair.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    return stored(held.join(pair, ["label", "block"]).groupBy("label", "lo", "hi").applyInPandas(_count(cosine), "vec_id long, links long, weight long, a long, b long"), "dense")


def _counted(found: DataFrame) -> DataFrame:
    return found.where("vec_id IS NOT NULL").select("vec_id", "links", "weight")


def _degrees(counted: DataFrame) -> DataFrame:
    return counted.groupBy("vec_id").agg(F.sum("links").alias("links"), F.sum("weight").alias("n_links"))


def nn_descent(data: DataFrame, size: int = LIST, rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """(a, b, s): lists of up to ``size`` neighbours at FLOOR or above. Rounds end when no list changes."""
    counts = data.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    leaves = _trees(data, counts, seed).groupBy("label", "tree", "leaf", "part")
    graph = stored(_lists(leaves.applyInPandas(_leaf(size), "a long, b long, s double"), size), "neighbours")
    before = None
    for _ in range(rounds):
        known = data.select(F.col("vec_id").alias("b"), "v")
        better = graph.join(known, "b").select("a", "b", "v").groupBy("a").applyInPandas(_refine(size), "a long, b long, s double")
        graph = stored(_lists(graph.unionByName(better), size), "neighbours")
        now = tuple(graph.agg(F.count(F.lit(1)), F.sum(F.round(F.col("s") * 1e6).cast("long"))).first())
        if now == before:
            break
        before = now
    return graph


def audit(data: DataFrame, links: DataFrame, cosine: float = COSINE, probes: int = PROBES) -> float:
    """Share of the true links of a bounded set of vectors (smallest hash of vec_id) that are known, by comparing each with
    all vectors of its label inside the tasks that hold them."""
    asked = data.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(probes).collect()
    if not asked:
        return 1.0
    probe = {}
    for r in asked:                                             # a label here has vectors of one length
        probe.setdefault(r["label"], []).append((r["vec_id"], r["v"]))

    def compare(batches):
        for label, f in ((k, f) for whole in batches for k, f in whole.groupby("label")):
            if label in probe:
                ids = np.array([i for i, _ in probe[label]])
                s = _unit([v for _, v in probe[label]]) @ _unit(f["v"]).T >= cosine
                yield pd.DataFrame({"vec_id": ids, "n": (s & (ids[:, None] != f["vec_id"].to_numpy()[None, :])).sum(1)})

    true = data.mapInPandas(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    r = true.join(links, "vec_id", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("n_links", F.lit(0))))).first()
    return 1.0 if not r[0] else float(r[1] or 0) / float(r[0])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, size: int = LIST, recall: float = RECALL) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).

    1. Equal vectors of a label become one node. 2. Random hyperplane leaves give the first lists, NN-descent refines them.
    3. A list whose every neighbour links is saturated: it may hide links. The groups that such nodes form with their
    neighbours are compared whole, in pairs of blocks, which is where lists of any length end; blocks of different groups
    meet too, unless their centres are further apart than their radii and the bound allow. 4. The links of a bounded
    set of vectors are audited against all vectors; below ``recall`` the descent starts again with longer lists and other
    leaves, and after the last lists all vectors of each label are compared. Only cosines in double precision at
    ``cosine`` or above count.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing;
    vectors of different length never link. A null vec_id gives n_links 0, component null and kept null. Rows that share a
    vec_id should not occur; each counts as a row of its own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    named = stored(rows.withColumn("mark", F.xxhash64("label", "v")).withColumn("width", F.size("v")), "vectors")
    nodes = stored(named.groupBy("mark", "label", "width", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
                   .select("vec_id", F.xxhash64("label", "width").alias("group"), "label", "mark", "copies", "v"), "nodes")
    data = nodes.select("vec_id", F.col("group").alias("label"), "copies", "v")
    for attempt in range(4):
        k = size << attempt
        graph = nn_descent(data, k, seed=5 + attempt)
        near = graph.where(F.col("s") >= cosine)
        degree = near.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
        full = degree.where(F.col("d") >= k).select("a")
        comp = components(near.select("a", "b"))
        dense = comp.join(full.withColumnRenamed("a", "node"), "node").select("component").distinct()
        inside = comp.join(dense, "component")
        # Groups with a saturated list are compared whole, also with each other; for all others the lists hold every link found.
        sized = inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        block = F.xxhash64("component", F.pmod(F.xxhash64("node", F.lit(4)), F.col("blocks")))
        found = _whole(inside.join(sized, "component").select(F.col("node").alias("vec_id"), block.alias("block")), data, cosine)
        sparse = near.join(inside.select(F.col("node").alias("a")), "a", "left_anti")
        # Copies count as links of every neighbour; the audit counts different vectors on both sides.
        sparse = sparse.join(nodes.select(F.col("vec_id").alias("b"), "copies"), "b").select(F.col("a").alias("vec_id"), F.lit(1).cast("long").alias("links"), F.col("copies").alias("weight"))
        links = stored(_degrees(sparse.unionByName(_counted(found))), "degrees")
        if audit(data, links.select("vec_id", F.col("links").alias("n_links")), cosine) >= recall:
            break
    else:                                                       # no list was long enough: every label is compared whole
        sized = data.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        found = _whole(data.join(sized, "label").select("vec_id", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.col("blocks")).alias("block")), data, cosine)
        links = stored(_degrees(_counted(found)), "degrees")
    edges = near.select("a", "b").unionByName(found.where("a IS NOT NULL").select("a", "b"))
    comp = components(edges) if attempt or found.where("a IS NOT NULL").limit(1).count() else comp
    node = (nodes.select("mark", "label", F.col("vec_id").alias("least_id"), "copies", F.col("v").alias("v_")).join(links.select(F.col("vec_id").alias("x"), "n_links"), F.col("least_id") == F.col("x"), "left")
            .join(comp, F.col("least_id") == F.col("node"), "left")
            .select(F.col("mark").alias("m"), F.col("label").alias("l"), "v_", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "least_id").alias("component_id")))
    linked = named.join(node, (F.col("mark") == F.col("m")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("v_"))).select("vec_id", "n_links", "component_id")
    out = vectors.select(F.col("vec_id").cast("long").alias("id_")).join(linked.dropDuplicates(["vec_id"]), F.col("id_") == F.col("vec_id"), "left")
    component = F.coalesce("component_id", "id_")
    return out.select(F.col("id_").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id_")).alias("kept"))


def op5_embedding_neighbours(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
