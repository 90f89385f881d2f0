"""JSON-stat 2.0 datasets: a flat value list over the product of ordered dimension categories."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_end, month_start
from ..operators.guards import assert_each

SCHEMA = ("id array<string>, size array<int>, updated string, label string, error string, "
          "dimension map<string,struct<category:struct<index:string,label:map<string,string>>>>, value string, status string")


def _ordered(category: Column) -> Column:
    """Category codes in the order of their positions; the index may be a list, an object, or left out for a single code."""
    index = category["index"]
    placed = F.transform(F.array_sort(F.transform(F.map_entries(F.from_json(index, "map<string,int>")), lambda e: F.struct(
        e["value"].alias("p"), e["key"].alias("c")))), lambda x: x["c"])
    return F.when(index.startswith("["), F.from_json(index, "array<string>")).when(index.startswith("{"), placed).otherwise(F.map_keys(category["label"]))


def _entries(json: Column, kind: str) -> Column:
    """(position, value) pairs of a list or an object."""
    listed = F.transform(F.from_json(json, f"array<{kind}>"), lambda v, i: F.struct(i.cast("long").alias("_flat"), v.alias("v")))
    named = F.transform(F.map_entries(F.from_json(json, f"map<string,{kind}>")), lambda e: F.struct(e["key"].try_cast("long").alias("_flat"), e["value"].alias("v")))
    return F.when(json.startswith("["), listed).when(json.startswith("{"), named)


def decode_jsonstat(docs: DataFrame, text: str, dimensions: Sequence[str]) -> DataFrame:
    """One row per combination of categories, with value and status; an absent position is a null value.

    Dimensions are named in the document's own order. Values and statuses may be lists or objects; a document that reports
    an error stops the query that reads its rows, whichever columns that takes. A document's cells are its flat positions; each carries the code of every dimension by division,
    and values join by (document, position), so work is linear in cells plus values and no cell holds the document.
    """
    keep = [c for c in docs.columns if c != text]
    d = docs.withColumns({"_j": F.from_json(text, SCHEMA), "_doc": F.sha2(F.col(text), 256)})
    d = assert_each(d, F.col("_j.error").isNull(), F.concat(F.lit("the source reports an error: "), F.col("_j.error")))
    updated = F.try_to_timestamp("_j.updated")

    def cells_of(part: str, kind: str, name: str) -> DataFrame:    # a document that comes twice says the same: its cells fold, not its text
        return d.select("_doc", F.inline(_entries(F.col(f"_j.{part}"), kind))).groupBy("_doc", "_flat").agg(F.first("v").alias(name))
    values, states = cells_of("value", "double", "value"), cells_of("status", "string", "status")
    codes = {dim: _ordered(F.col("_j.dimension")[dim]["category"]) for dim in dimensions}
    cells = d.select(*keep, "_doc", updated.alias("published_at"), *[c.alias(f"_c_{dim}") for dim, c in codes.items()])
    total = F.lit(1).cast("long")
    for dim in dimensions:
        total = total * F.size(f"_c_{dim}")
    cells = cells.withColumn("_flat", F.explode(F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1))))
    step, picked = F.lit(1).cast("long"), []
    for dim in reversed(dimensions):
        n = F.size(f"_c_{dim}")
        at = F.pmod(F.floor(F.col("_flat") / step), n.cast("long"))
        picked.append(F.element_at(f"_c_{dim}", (at + 1).cast("int")).alias(dim))
        step = step * n
    rows = cells.select(*keep, "_doc", "_flat", "published_at", *reversed(picked))
    rows = rows.join(values, ["_doc", "_flat"], "left").join(states, ["_doc", "_flat"], "left")
    return rows.select(*keep, *dimensions, "value", "status", "published_at")


def monthly_series(rows: DataFrame, by: str, dataset: str, geo: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Observations of one series per category of ``by``.

    A category that never reported anything but zero is left out, unless it was asked for by name.
    """
    live = rows.groupBy(by).agg(F.sum(F.abs("value")).alias("_s")).where(F.coalesce("_s", F.lit(0.0)) != 0).select(by)
    d = rows.where(F.col(by).isin(list(wanted))) if wanted else rows.join(live, by, "left_semi")
    sid = F.lower(F.concat_ws(".", F.lit("eurostat"), F.lit(dataset), F.lit(geo), F.col(by)))
    return d.select(sid.alias("series_id"), month_start(F.col("time")).alias("obs_start"), month_end(F.col("time")).alias("obs_end"),
                    "value", F.when(F.col("value").isNull(), "missing").otherwise("ok").alias("status"),
                    F.col("published_at").alias("source_published_at"), F.to_json(F.struct(F.col("status").alias("flag"))).alias("attrs"))


def missing_codes(rows: DataFrame, by: str, wanted: Sequence[str]) -> DataFrame:
    asked = rows.sparkSession.createDataFrame([(w,) for w in wanted], f"{by} string")
    return asked.join(rows.select(by).distinct(), by, "left_anti")
