"""Dirty inputs derived from the clean tables, by the same expressions in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: Orders whose status is missing in each seventh, whose customer is unknown in each eleventh.
DIRTY_ORDERS_SQL = """
  SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
         o_orderpriority, CAST(o_orderdate AS DATE) AS o_date
  FROM orders"""


def dirty_orders(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.when(key % 11 == 0, F.col("o_custkey") + 10000000).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 13 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"),
        "o_orderpriority", F.to_date("o_orderdate").alias("o_date"))


#: Versions of each customer: one from 1990, for even keys a second from 1998 in another segment.
SEGMENTS_SQL = """
  SELECT c_custkey, c_mktsegment AS segment, DATE '1990-01-01' AS valid_from, CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-01' END AS valid_to FROM customer
  UNION ALL SELECT c_custkey, 'MOVED-' || c_mktsegment, DATE '1998-01-01', NULL FROM customer WHERE c_custkey % 2 = 0"""


def segments(t: Tables) -> DataFrame:
    day = lambda s: F.lit(s).cast("date")
    even = F.col("c_custkey") % 2 == 0
    first = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), day("1990-01-01").alias("valid_from"), F.when(even, day("1998-01-01")).alias("valid_to"))
    return first.unionByName(t.customer.where(even).select("c_custkey", F.concat(F.lit("MOVED-"), "c_mktsegment").alias("segment"), day("1998-01-01").alias("valid_from"), F.lit(None).cast("date").alias("valid_to")))


#: Prices of each brand from four days on.
PRICES_SQL = """
  SELECT p_brand, d.price_from, d.price_to, CAST(avg_price * d.factor AS DECIMAL(18,4)) AS price
  FROM (SELECT p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) / count(*) AS DECIMAL(18,2)) AS avg_price FROM part GROUP BY p_brand) b
  CROSS JOIN (VALUES (DATE '1995-01-01', DATE '1997-01-01', CAST(1.00 AS DECIMAL(4,2))), (DATE '1997-01-01', DATE '1999-01-01', CAST(1.10 AS DECIMAL(4,2))), (DATE '1999-01-01', NULL, CAST(1.25 AS DECIMAL(4,2)))) AS d(price_from, price_to, factor)"""

#: Two feeds of orders: what was known first, and later changes of each fifth order, some of them older than the first.
UPDATES_SQL = """
  SELECT o_orderkey, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS updated FROM orders
  UNION ALL
  SELECT o_orderkey, 'X', CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderdate AS DATE) - 3 ELSE CAST(o_orderdate AS DATE) + 3 END FROM orders WHERE o_orderkey % 5 = 0"""


def first_feed(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("updated"))


def second_feed(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("status"), F.when(F.col("o_orderkey") % 10 == 0, F.date_sub(d, 3)).otherwise(F.date_add(d, 3)).alias("updated"))
