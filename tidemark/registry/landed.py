"""Provider files landed from the given tables and read back with the readers of ``sources``."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..session import scratch_path
from ..sources import feeds as S
from .base import query


def _pages(df, spark, name):
    """One JSON document per row, each in a file of its own; ``page`` names the folder."""
    path = scratch_path(spark, name)
    df.write.partitionBy("page").json(path)
    return path


@query("landed_statistics", """SELECT lower('jodi.P' || substr(o_orderpriority, 1, 1) || '.CRUDEOIL.FLOW' || o_orderstatus || '.KBD') AS series_id, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS obs_start,
 CAST(CAST(last_day(MIN(o_orderdate)) AS DATE) AS VARCHAR) AS obs_end, CASE WHEN month(MIN(o_orderdate)) = 6 THEN NULL ELSE CAST(COUNT(*) AS DOUBLE) END AS value, CASE WHEN month(MIN(o_orderdate)) = 6 THEN 'missing' ELSE 'ok' END AS status
 FROM orders WHERE substr(o_orderpriority, 1, 1) < '5' AND o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1993-01-01' GROUP BY 1, 2""")
def landed_statistics(spark, folder):
    o = B.table(spark, folder, "orders")
    rows = o.groupBy(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("REF_AREA"), F.date_format("o_orderdate", "yyyy-MM").alias("TIME_PERIOD"),
                     F.lit("CRUDEOIL").alias("ENERGY_PRODUCT"), F.concat(F.lit("FLOW"), "o_orderstatus").alias("FLOW_BREAKDOWN"), F.lit("KBD").alias("UNIT_MEASURE")).agg(F.count("*").cast("string").alias("n"))
    path = scratch_path(spark, "statistics")
    rows.withColumn("OBS_VALUE", F.when(F.col("TIME_PERIOD").endswith("-06"), "-").otherwise(F.col("n"))).drop("n").write.option("header", True).csv(path)
    raw = S.read_csv_text(spark, path, S.NATIONAL, "national statistics CSV")
    d = S.national_statistics(raw, ["P1", "P2", "P3", "P4"], ["CRUDEOIL"], ["FLOWF", "FLOWO"], ["KBD"], "1993-01")
    return d.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), F.col("obs_end").cast("string").alias("obs_end"), "value", "status")


@query("landed_features", """SELECT 'portwatch.' || lower(l_linestatus) || '.' || f.field AS series_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS obs_start,
 CASE WHEN f.field = 'n_lines' THEN CAST(COUNT(*) AS DOUBLE) WHEN COUNT(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN CAST(COUNT(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) END AS value
 FROM lineitem, (VALUES ('n_lines'), ('n_returned')) f(field) GROUP BY l_linestatus, CAST(l_shipdate AS DATE), f.field""")
def landed_features(spark, folder):
    li = B.table(spark, folder, "lineitem")
    day = F.to_date("l_shipdate")
    daily = li.groupBy(F.col("l_linestatus").alias("portid"), day.alias("d")).agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    attributes = F.struct("portid", F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"), F.unix_date("d").alias("ObjectId"),
                          "n_lines", F.when(F.col("r") > 0, F.col("r")).alias("n_returned"))
    # A day's provisional row comes first in its page; the later one counts.
    both = F.explode(F.array(F.struct(F.lit(0).alias("o"), attributes.withField("n_lines", F.lit(-1).cast("long")).alias("attributes")), F.struct(F.lit(1).alias("o"), attributes.alias("attributes"))))
    pages = daily.select("portid", "d", both.alias("f")).groupBy(F.concat_ws("-", "portid", F.year("d")).alias("page")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("f.o", "d", "f.attributes"))), lambda x: F.struct(x["attributes"].alias("attributes"))).alias("features"))
    ids = li.select(F.col("l_linestatus").alias("portid"), F.lower("l_linestatus").alias("slug")).distinct()
    d = S.daily_features(spark, _pages(pages, spark, "features"), ids, ["n_lines", "n_returned"])
    return d.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "value")


@query("landed_thermal", """SELECT event_id, 'S' || (user_id % 3) AS satellite, strftime(ts, '%Y-%m-%d %H:%M') AS acquired, ROUND(value, 6) AS frp, CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight FROM events""")
def landed_thermal(spark, folder):
    e = B.table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "thermal")
    e.select((F.col("event_id") / 100.0).alias("latitude"), F.lit(50.0).alias("longitude"), F.date_format("t", "yyyy-MM-dd").alias("acq_date"), F.date_format("t", "HHmm").alias("acq_time"), F.lit("n").alias("confidence"),
             F.col("value").alias("frp"), F.when(F.hour("t").between(6, 17), "D").otherwise("N").alias("daynight"), F.lit(0.4).alias("scan"), F.lit(0.4).alias("track"),
             F.concat(F.lit("S"), F.pmod("user_id", F.lit(3)).cast("string")).alias("satellite")).write.option("header", True).csv(path)
    d = S.thermal_detections(spark, path, "VIIRS")
    return d.select(F.round(F.col("lat") * 100).cast("bigint").alias("event_id"), "satellite", F.date_format("acq_datetime", "yyyy-MM-dd HH:mm").alias("acquired"), F.round("frp", 6).alias("frp"), "daynight")


@query("landed_trade", "SELECT 'trade.orders' AS series_id, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS obs_start, CAST(COUNT(*) AS DOUBLE) AS value FROM orders GROUP BY 2")
def landed_trade(spark, folder):
    path = scratch_path(spark, "trade")
    B.table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("TIME_PERIOD")).agg(F.count("*").alias("OBS_VALUE")).write.option("header", True).csv(path)
    d = S.monthly_trade(spark, path, "trade.orders")
    return d.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "value")


@query("landed_pages", """SELECT 'orders.' || o_orderpriority AS series_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS obs_start, CASE WHEN isodow(o_orderdate) = 7 THEN NULL ELSE CAST(COUNT(*) AS DOUBLE) END AS value,
 CASE WHEN isodow(o_orderdate) = 7 THEN 'missing' ELSE 'ok' END AS status FROM orders GROUP BY o_orderpriority, o_orderdate""")
def landed_pages(spark, folder):
    o = B.table(spark, folder, "orders")
    daily = o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").cast("string").alias("n"))
    row = F.struct(F.col("d").cast("string").alias("period"), "series", F.when(F.weekday("d") == 6, "--").otherwise(F.col("n")).alias("value"), F.lit("MBBL").alias("units"))
    total = daily.groupBy("series").agg(F.count("*").cast("string").alias("total"))
    pages = daily.join(total, "series").groupBy(F.concat_ws("-", F.substring("series", 1, 1), F.year("d")).alias("page")).agg(
        F.struct(F.max("total").alias("total"), F.sort_array(F.collect_list(row)).alias("data")).alias("response"))
    asked = o.select(F.col("o_orderpriority").alias("facet")).distinct().select(
        "facet", F.concat(F.lit("orders."), "facet").alias("series_id"), F.lit("thousand barrels").alias("unit"), F.lit("stock").alias("measure"), F.lit(False).alias("weekly"))
    d = S.paged_series(spark, _pages(pages, spark, "pages"), asked)
    return d.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "value", "status")
