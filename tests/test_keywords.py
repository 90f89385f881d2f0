import re

from pyspark.sql import functions as F

from tidemark.functions import text as T

WORDS = ["the", "les", "oil", "price", "ation", "u.s.", "north sea", "für", "öl"]


def test_plain_keywords_need_no_pattern_and_find_the_same(spark):
    texts = ["The oil_price", "oil-price,the", "north  sea oil", "In the U.S. the", "x́the thé", "caféles les", "the‿x", "İles", "für Öl", "prices", "enprice", None, "", "(the)\tles"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern = {k: "(?U)" + T._keyword_pattern(k) for k in WORDS}
    want = d.select("i", *[F.coalesce(T.normal_text(F.col("t")).rlike(p), F.lit(False)).alias(f"k{n}") for n, p in enumerate(pattern.values())]).collect()
    got = {r.i: r.h for r in d.select("i", T.keyword_hits(F.col("t"), WORDS).alias("h")).collect()}
    assert got == {r.i: [k for n, k in enumerate(WORDS) if r[f"k{n}"]] for r in want}
    plan = d.select(T.topic_hits(F.col("t"), {"a": {"keywords": ["the", "price"], "require_any": ["les"]}}))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("RLIKE", plan, re.I)                    # one pass over the text, whatever the number of keywords


def test_claim_words_need_no_pattern(spark):
    words = {"up": ["rise", "a+b"], "down": ["fall"], "disruption": ["halt of"]}
    d = spark.createDataFrame([(0, "RISE"), (1, "a+b  falls"), (2, "aab"), (3, "halt\n of"), (4, None)], "i int, t string")
    out = d.select("i", T.claims(F.col("t"), words).alias("c"))
    assert {r.i: r.c for r in out.collect()} == {0: ["up"], 1: ["mixed"], 2: [], 3: ["disruption"], 4: []}
    assert not re.search("RLIKE", out._jdf.queryExecution().optimizedPlan().toString(), re.I)
