"""Query registry and the shared SQL fragments of the oracle side."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin on the same tables."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


DAILY_PRICE = """SELECT 'orders.' || o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_start,
  CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS value
  FROM orders GROUP BY 1, 2"""
DAILY_COUNT = """SELECT 'orders.' || o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_start,
  CAST(COUNT(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2"""
WEEKLY_PRICE = """SELECT 'lineitem.' || l_returnflag AS series_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS obs_start,
  CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / SUM(CAST(l_quantity AS BIGINT)) AS value
  FROM lineitem GROUP BY 1, 2"""
DAILY_CRUDE = """SELECT CAST(o_orderdate AS DATE) AS obs_start,
  CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS value FROM orders GROUP BY 1"""
FIXING = """SELECT CAST(l_shipdate AS DATE) AS fx_date,
  1 + CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS fx
  FROM lineitem WHERE isodow(l_shipdate) IN (1, 4) GROUP BY 1"""
BATCHES = """SELECT 'order.' || l_orderkey AS series_id, l_linenumber AS batch, MAX(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2"""


def price_points_sql(source: str, window: int, min_history: int, max_gap: int, min_pct: float, z: float = 3.5) -> str:
    """Evaluated price points of a rule as CTEs ending in ``points``."""
    return f"""WITH s AS ({source}),
 p AS (SELECT *, LAG(value) OVER w AS pv, LAG(obs_start) OVER w AS pd FROM s WHERE value > 0
   WINDOW w AS (PARTITION BY series_id ORDER BY obs_start)),
 r AS (SELECT *, CASE WHEN date_diff('day', pd, obs_start) <= {max_gap} THEN ln(value / pv) END AS ret FROM p),
 b AS (SELECT *, COUNT(ret) OVER f AS n, MEDIAN(ret) OVER f AS med, MAD(ret) OVER f AS mad,
   QUANTILE_CONT(ret, 0.75) OVER f - QUANTILE_CONT(ret, 0.25) OVER f AS iqr FROM r
   WINDOW f AS (PARTITION BY series_id ORDER BY obs_start ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)),
 q AS (SELECT *, (exp(ret) - 1) * 100 AS pct, CASE WHEN n < {min_history} THEN NULL WHEN mad > 0 THEN 0.67449 * (ret - med) / mad
   WHEN iqr > 0 THEN 1.349 * (ret - med) / iqr END AS z,
   CASE WHEN n < {min_history} THEN 'suppressed' WHEN mad > 0 THEN 'MAD' WHEN iqr > 0 THEN 'IQR-fallback' ELSE 'suppressed' END AS method
   FROM b WHERE ret IS NOT NULL),
 points AS (SELECT *, COALESCE(abs(z) >= {z} AND abs(pct) >= {min_pct}, FALSE) AS fired,
   LEAST(abs(COALESCE(z, 0)) / {z}, 3) + LEAST(abs(pct) / {min_pct}, 3) AS severity FROM q)"""
