"""Text-to-series matching. Topics and keywords are configuration; texts are data."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_hits, topic_hits


def match_topics(docs: DataFrame, id_col: str, text: Column, topics: dict, aliases: Sequence[str] = (),
                 alias_topic: str | None = None) -> DataFrame:
    """One row per (document, topic) with the keywords found. No shuffle: the topics are literals."""
    return (docs.select(id_col, F.explode(topic_hits(text, topics, list(aliases), alias_topic)).alias("_t"))
            .select(id_col, F.col("_t.topic").alias("topic"), F.col("_t.hits").alias("hits")))


def mentioned(docs: DataFrame, id_col: str, text: Column, aliases: dict[str, list[str]]) -> DataFrame:
    """One row per (document, named entity) by its aliases."""
    found = F.array_compact(F.array(*[
        F.when(F.size(keyword_hits(text, names)) > 0, F.lit(key)) for key, names in aliases.items()]))
    return docs.select(id_col, F.explode(found).alias("entity"))


def topic_series(spark, topics: dict) -> DataFrame:
    """(topic, series_id, position): a configuration-sized table."""
    rows = [(t, s, i) for t, cfg in topics.items() for i, s in enumerate(cfg.get("series", []))]
    return spark.createDataFrame(rows, "topic string, series_id string, position int")


def linked_series(matches: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Distinct (document, series) of the matched topics with the first position that names the series."""
    order = {"order": F.struct("topic", "position")}
    return matches.join(links, "topic").groupBy(id_col, "series_id").agg(F.min(order["order"]).alias("link_order"))


def headlines_for_series(docs: DataFrame, id_col: str, text: Column, at: str, cluster: str, targets: DataFrame,
                         keywords: dict[str, list[str]], limit: int = 15) -> DataFrame:
    """For each target (series_id, topic, start_at, end_at) the best headlines of its topic in the period.

    Order: most keywords, then latest; one per cluster; at most ``limit`` per target. The keyword test
    runs before the join, so only matching texts are shuffled, and days name the range.
    """
    per_topic = F.transform(topic_hits(text, {t: {"keywords": ks} for t, ks in keywords.items()}), lambda x: F.struct(
        x["topic"].alias("topic"), F.size(x["hits"]).alias("n_hits")))
    hits = docs.select(id_col, at, cluster, F.inline(per_topic)).withColumn("_day", F.to_date(at))
    days = targets.withColumn("_day", F.explode(F.sequence(F.to_date("start_at"), F.to_date("end_at"))))
    j = hits.join(days, ["topic", "_day"]).where((F.col(at) >= F.col("start_at")) & (F.col(at) <= F.col("end_at")))
    target = ["series_id", "start_at"]
    best = F.struct("n_hits", at, F.col(id_col).alias("_id"))
    per_cluster = j.groupBy(*target, cluster).agg(F.max(best).alias("_b"))
    # Two levels: first within a slice of the clusters, so no task ranks all headlines of a hot target.
    order = [F.col("_b.n_hits").desc(), F.col(f"_b.{at}").desc(), F.col("_b._id").desc()]
    slice_ = F.pmod(F.hash(cluster), F.lit(64))
    inner = Window.partitionBy(*target, "_slice").orderBy(*order)
    few = per_cluster.withColumn("_slice", slice_).withColumn("_rn", F.row_number().over(inner)).where(
        F.col("_rn") <= limit)
    outer = Window.partitionBy(*target).orderBy(*order)
    return (few.withColumn("position", F.row_number().over(outer)).where(F.col("position") <= limit)
            .select(*target, F.col("_b._id").alias(id_col), cluster, F.col("_b.n_hits").alias("n_hits"),
                    F.col(f"_b.{at}").alias(at), "position"))
