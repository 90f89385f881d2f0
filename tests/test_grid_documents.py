from pyspark.sql import functions as F

from tidemark.registry.streams import grid_documents


def test_a_users_document_does_not_depend_on_the_order_of_rows(spark):
    e = spark.range(4000).select(F.pmod("id", F.lit(3)).alias("user_id"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("string")).alias("event_type"),
                                 F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)) * 86_400).alias("ts"))
    seen = {}
    for parts, order in ((1, "id"), (7, "-id"), (30, "hash(id)")):
        for r in grid_documents(e.repartition(parts).orderBy(F.expr(order))).collect():
            seen.setdefault(r.user_id, set()).add(r.doc)
    assert {u: len(d) for u, d in seen.items()} == {0: 1, 1: 1, 2: 1}
