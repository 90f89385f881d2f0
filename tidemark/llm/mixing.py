"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, table, whole_text

MAX_EPOCHS = 3
BUCKET_DOCS = 4096              # documents of one source whose order is decided in one task


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight in (0, 1]: words of about five characters count most, so junk is drawn later."""
    return F.lit(1.0) / (1.0 + F.abs(F.length(text) / F.greatest(size, F.lit(1)) - 6.0))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights repeat in code-point order, null last; caps of ``most`` times a
    source's size are filled first and what they leave is shared again by weight.

    Sources sorted by cap / weight are capped one after the other as long as the level reached by sharing the rest lies
    above their cap; that is where repeated resharing ends. One row per source, so these windows are small.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    s = sources.select("*", w.alias("w"), cap.alias("cap"))
    before = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = s.select("*", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("rest"),
                 (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_rest"))
    s = s.select("*", (F.col("rest") / F.col("w_rest")).alias("level"))
    free = F.col("cap") / F.col("w") >= F.col("level")
    level = F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), "level"))).over(all_rows)["level"]
    return s.select("source", "source_size", F.least(F.coalesce(level * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def mix_plan(docs: DataFrame, weight: Column | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    Whole epochs come first; the rest of a source's budget goes to the documents with the smallest exponential keys
    -ln(u) / weight, summed in key order up to the document that brings the sum nearest to the budget. ``u`` hashes doc_id
    and ``seed``, so reruns agree. Rows with one doc_id share a key and are taken together. Null or blank texts have size
    0 and are taken 0 times; a source of size 0 has target 0; an empty table gives no rows.

    A source is split into slices of the key's range before anything is sorted, so no task sees a whole source.
    """
    text = whole_text()
    size = F.regexp_count(text, F.lit(SPACE)).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), text.alias("t"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 1) / F.lit(float(2 ** 53 + 1))
    w = weight if weight is not None else quality_weight(F.col("t"), F.col("size"))
    sized = cut(base.select("doc_id", "source", "size", (-F.log(u) / w).alias("key")))
    counts = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    sources = source_targets(counts.select("source", "source_size"))
    counts = counts.select("source", "n")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(0).cast("long")
    plan = cut(sources.join(counts.withColumnRenamed("source", "source_"), F.expr("source <=> source_"))
               .select("source", "source_size", "target", epochs.alias("epochs"),
                       F.ceil(F.col("n") / BUCKET_DOCS).alias("slices"))
               .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    # exp(-key) = u ** (1 / w): its complement rises with the key and stays within (0, 1).
    s = (sized.join(plan.withColumnRenamed("source", "source_"), F.expr("source <=> source_")).drop("source_")
         .withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("slices")), F.col("slices") - 1)))
    tie = ["source", "slice", "key", "doc_id"]
    per_slice = s.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    order = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(F.col("source").alias("source_"), F.col("slice").alias("slice_"), F.coalesce(F.sum("in_slice").over(order), F.lit(0)).alias("before"))
    s = s.join(per_slice, F.expr("source <=> source_ AND slice = slice_"))
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id")           # peers, rows of one doc_id, count at once
    peers = Window.partitionBy(*tie)
    upto = F.col("before") + F.sum("size").over(within)
    s = s.select("doc_id", "source", "size", "source_size", "target", "epochs", "budget", upto.alias("upto"), F.sum("size").over(peers).alias("group"))
    extra = ((F.col("budget") > 0) & (F.col("upto") - F.col("group") / 2.0 <= F.col("budget"))).cast("long")
    copies = F.when(F.col("size") > 0, F.least(F.col("epochs") + extra, F.lit(MAX_EPOCHS))).otherwise(0)
    return s.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 7) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it. Documents without words are in no mix."""
    plan = mix_plan(docs, weight, seed).groupBy("doc_id").agg(F.max("copies").cast("int").alias("__copies")).withColumnRenamed("doc_id", "__doc_id")
    kept = docs.join(plan, F.expr("doc_id <=> __doc_id")).where(F.regexp_count(whole_text(), F.lit(SPACE)) > 0)
    return kept.withColumn("__copy", F.explode(F.expr("array_repeat(0, __copies)"))).select(*docs.columns)


def op6_source_mix(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
