"""Marketplace views (items, payments, orders, customers, places, reviews, links) over the Parquet tables.

Each view is a lazy DataFrame; ``PRELUDE`` states the same views for the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import table

MONEY = "decimal(18,2)"


def lines(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """The order lines, of the orders in ``keys`` (order_id) where given."""
    line = table(spark, sf_dir, "lineitem")
    return line if keys is None else line.join(keys.select(F.col("order_id").alias("l_orderkey")), "l_orderkey", "left_semi")


def items(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """One row per order line with category (null where unknown), seller state and money."""
    line = lines(spark, sf_dir, keys)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    seller = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = F.col("l_extendedprice").cast("decimal(12,2)")
    return (
        line.join(part, line.l_partkey == part.p_partkey, "left")
        .join(seller, line.l_suppkey == seller.s_suppkey, "left")
        .join(nation, F.col("s_nationkey") == nation.n_nationkey, "left")
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("item_no"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.when(F.col("p_partkey") % 11 != 0, F.lower("p_type")).alias("product_category"),
            F.col("n_name").alias("seller_state"),
            F.col("l_extendedprice").cast(MONEY).alias("price"),
            (base * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY).alias("freight"),
        )
    )


def payments(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    base = F.col("l_extendedprice").cast("decimal(12,2)")
    return lines(spark, sf_dir, keys).select(
        F.col("l_orderkey").alias("order_id"),
        F.lower("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("installments"),
        (base * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY).alias("payment_value"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer")
    return c.join(nation, c.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"), F.col("c_mktsegment").alias("customer_city"), F.col("c_nationkey").alias("zip")
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geolocation observations."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .join(r, n.n_regionkey == r.r_regionkey, "left")
        .select(F.col("c_nationkey").alias("zip"), F.col("c_mktsegment").alias("city"), F.col("r_name").alias("state"), F.col("c_acctbal").cast(MONEY).alias("balance"))
    )


def orders(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """Orders with purchase, estimated and delivered timestamps; delivered only once shipped and not open."""
    shipped = lines(spark, sf_dir, keys).groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.lower("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("purchase_ts")
    )
    o = o if keys is None else o.join(keys, "order_id", "left_semi")
    return o.join(shipped, "order_id", "left").select(
        "order_id", "customer_id", "order_status", F.col("purchase_ts").cast("timestamp").alias("purchase_ts"),
        (F.col("purchase_ts") + F.expr("interval 60 days")).cast("timestamp").alias("estimated_ts"),
        F.when(F.col("order_status") != "o", F.col("shipped")).cast("timestamp").alias("delivered_ts"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    m = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    score = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when(F.col("doc_id") % 3 == 0, 4).when(F.col("quality") == 1, 5)
    return d.join(m, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"), score.alias("review_score"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("title"),
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("message"), F.col("lang"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, order_id): every review has one order, each seventh two."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"))
    return d.select("review_id", _order_ids(F.col("review_id")))


def _order_ids(review_id: Column) -> Column:
    """A review's orders, a row each: made from its one row, so the documents are scanned once."""
    return F.explode(F.when(review_id % 7 == 0, F.array(review_id, review_id + 1)).otherwise(F.array(review_id))).alias("order_id")


def scored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, review_score, order_id): each order of a review beside its score, without its text."""
    return reviews(spark, sf_dir).select("review_id", "review_score", _order_ids(F.col("review_id")))


def order_lines(spark: SparkSession, sf_dir: str, where: Column | None = None, between: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Orders (those where a condition on o_orderdate holds, or with ids ``between`` two) with their lines' category, money and
    shipping date: conditions reach the scans, and lines are shuffled once for what items, deliveries and keys would each need."""
    inside = lambda c: F.lit(True) if between is None else F.col(c).between(*(F.lit(x).cast("long") for x in between))
    o = table(spark, sf_dir, "orders").where(inside("o_orderkey"))
    o = (o if where is None else o.where(where)).select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.lower("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("purchase_ts"))
    base = F.col("l_extendedprice").cast("decimal(12,2)")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 11 != 0, F.lower("p_type")).alias("product_category"))
    line = table(spark, sf_dir, "lineitem").where(inside("l_orderkey")).select(
        F.col("l_orderkey").alias("order_id"), "l_partkey", F.col("l_extendedprice").cast(MONEY).alias("price"), (base * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY).alias("freight"), F.col("l_shipdate").alias("shipped"), F.lit(True).alias("is_line")
    )
    return o.join(line, "order_id", "left").join(part, "l_partkey", "left")


PRELUDE = """
WITH d_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS item_no, l_partkey AS product_id, l_suppkey AS seller_id,
    CASE WHEN p_partkey % 11 <> 0 THEN lower(p_type) END AS product_category, n_name AS seller_state,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS freight
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
    LEFT JOIN nation ON n_nationkey = s_nationkey),
d_payments AS (
  SELECT l_orderkey AS order_id, lower(l_returnflag) AS payment_type, l_linenumber AS installments,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS payment_value
  FROM lineitem),
d_customers AS (
  SELECT c_custkey AS customer_id, n_name AS customer_state, c_mktsegment AS customer_city, c_nationkey AS zip
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
d_places AS (
  SELECT c_nationkey AS zip, c_mktsegment AS city, r_name AS state, CAST(c_acctbal AS DECIMAL(18,2)) AS balance
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
d_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, lower(o_orderstatus) AS order_status, o_orderdate AS purchase_ts,
    o_orderdate + INTERVAL 60 DAY AS estimated_ts, CASE WHEN lower(o_orderstatus) <> 'o' THEN shipped END AS delivered_ts
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
d_reviews AS (
  SELECT d.doc_id AS review_id,
    CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 WHEN d.doc_id % 3 = 0 THEN 4 WHEN quality = 1 THEN 5 END AS review_score,
    CASE WHEN d.doc_id % 4 = 0 THEN source END AS title, CASE WHEN d.doc_id % 5 <> 0 THEN text END AS message, lang
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
d_links AS (
  SELECT doc_id AS review_id, doc_id AS order_id FROM documents
  UNION ALL SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 7 = 0)
"""
