"""Toxicity learns from every labelled row, in the tasks; the result does not hang on how the rows are dealt."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity

TOXIC, CLEAN, EARLY = 2200, 3300, 1500


@pytest.fixture(scope="module")
def tables(spark):
    """Toxic texts have one of two words: the first EARLY by hash of doc_id the one, all later ones the other."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(400)]
    ranked = [x.i for x in spark.range(TOXIC).select(F.col("id").alias("i")).orderBy(F.xxhash64("i", F.lit(3)), "i").collect()]
    word = {i: "zorku" if k < EARLY else "wimpel" for k, i in enumerate(ranked)}
    rows, lang = [], ("en", "de", None)
    for i in range(TOXIC + CLEAN):
        w = [r.choice(vocabulary) for _ in range(r.randint(4, 12))]
        if i in word:
            w[r.randrange(len(w))] = word[i]
        rows.append((i, " ".join(w), lang[i % 3]))
    rows += [(i + 100_000, t, x) for i, t, x in rows[TOXIC:TOXIC + 300]]             # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    return docs, docs.select("doc_id", (F.col("doc_id") % 100_000 < TOXIC).cast("int").alias("toxic")).cache()


def test_learns_from_every_row(tables):
    docs, labels = tables
    model = toxicity.train_model(docs, labels)
    probe = [f"{a} {w} {b}" for w in ("zorku", "wimpel") for a, b in (("abc", "fgh"), ("dead", "cafe"), ("beg", "had"))]
    assert (model.score(probe) >= toxicity.CUT).all()
    assert set(model.thresholds) == {"en", "de"}


def test_shards_see_all_texts(tables):
    docs, labels = tables
    found = toxicity.labelled_texts(docs.union(docs.limit(50)), labels)      # 50 rows twice
    learned = toxicity.store_shards(docs.union(docs.limit(50)), toxicity.once(found, True), 5).cache()
    want = {(r.text, r.toxic) for r in docs.join(labels, "doc_id").collect()}
    assert {(r.text, r.toxic) for r in learned.collect()} == want and learned.select("shard").distinct().count() == 5
    copies = {(r.text, r.lang, r.toxic): r.copies for r in learned.where("check").collect()}
    assert 0.1 * len(want) < len(copies) < 0.3 * len(want)
    asked = docs.union(docs.limit(50)).join(labels, "doc_id").groupBy("text", "lang", "toxic").count().collect()
    assert all(copies.pop((r.text, r.lang, r.toxic), r["count"]) == r["count"] for r in asked) and not copies
    train = learned.where("NOT check").select("shard", "text", "toxic")
    rows, model = train.collect(), toxicity.TextCNN()
    assert len(rows) == len({(r.text, r.toxic) for r in rows})
    ids, bounds = model.encode([r.text for r in rows])
    assert (toxicity.count_slots(train, model) == model.texts_with(ids, bounds, [r.toxic for r in rows])).all()


def test_reruns_agree(tables, monkeypatch):
    docs, labels = tables
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 60_000)
    one, two = toxicity.train_model(docs, labels), toxicity.train_model(docs.repartition(7, "text"), labels.repartition(3))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p) and one.scale == two.scale and one.thresholds == two.thresholds
    texts = [r.text for r in docs.limit(400).collect()]
    truth = np.array(["zorku" in t or "wimpel" in t for t in texts])
    assert ((one.score(texts) >= toxicity.CUT) == truth).mean() > 0.98
