"""The corpus pipeline: toxicity, n-gram Jaccard join, personal data, source mix, BPE. Each stage reads what the last one wrote."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, mixing, personal, toxicity
from tidemark.llm.common import stored, table
from tidemark.llm.token_files import tokenizer_spec

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labels of rows in ``docs``, none of them held out."""
    model = toxicity.train_model(docs.where(~toxicity.held_out()), table(spark, sf_dir, "labels"), learn=~toxicity.held_out())
    scored = toxicity.toxicity(docs, model)
    return scored.where("NOT rejected").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose doc_id names the group. A doc_id belongs to the smallest group of
    its rows; where it stays, each of its different texts stays once. Rows with a null doc_id all stay."""
    found = jaccard.jaccard_components(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    losers = found.where("component_id != doc_id").select("doc_id")
    kept = docs.join(losers, "doc_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("source", "lang"))
    one = kept.where("doc_id IS NOT NULL").withColumn("__first", first).where("__first = 1").drop("__first")
    return one.unionByName(kept.where("doc_id IS NULL")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows. Null texts stay null."""
    def finish(row, text, base, spans):
        if row["text"] is not None:
            row["text"] = personal.redacted(text, spans)
            if "n_chars" in row:
                row["n_chars"] = len(row["text"])
        return row
    return personal.find_personal(docs, finish, docs.schema)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take, and those without words, go."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every row, as ``bpe.digests`` names them."""
    spec = tokenizer_spec()
    return bpe.encode(docs, spec, bpe.digests(spec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("personal_data", redact), ("source_mix", mix_sources), ("bpe", encode)]

ORACLE_SQL = None               # no stage but the mix can be said in SQL; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
