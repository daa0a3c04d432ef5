"""The engine's logical tables as views over the driver's tables.

Each function takes (spark, sf_dir) and returns a long DataFrame; sums run
over decimals, so they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _total(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, ts, value``: daily order totals by priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        _total("o_totalprice").alias("value"))


def ship_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, ts, value``: daily shipped value by return flag, a calendar of its own."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        _total("l_extendedprice").alias("value"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, ts, open, high, low, close, adj_close, volume``: daily bars of ten tickers."""
    x = table(spark, sf_dir, "lineitem")
    # line numbers repeat within an order here; the price settles ties
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1e6 + F.col("l_extendedprice")
    return x.groupBy(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("ticker"),
        F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"),
    ).agg(
        F.min_by("l_extendedprice", order).alias("open"), F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", order).alias("close"), _total("l_quantity").alias("volume"),
    ).withColumn("adj_close", F.col("close") * 0.98)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, field, period_end, value``: quarterly figures of nations' suppliers."""
    x = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier")
    q = (F.date_trunc("quarter", "l_shipdate") + F.expr("interval 3 months")).cast("timestamp_ntz")
    wide = x.join(s, x.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("entity"), q.alias("period_end")).agg(
        _total("l_extendedprice").alias("revenue"),
        F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)")).cast("double").alias("cost_of_revenue"),
        F.sum((F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)")).cast("double").alias("tax"),
        _total("l_quantity").alias("units"),
    )
    return wide.unpivot(["entity", "period_end"], ["revenue", "cost_of_revenue", "tax", "units"], "field", "value")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items: documents with a time of their own, every seven minutes. The
    title is the first line, the snippet the whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("snippet"), "lang",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, doc_id * 7)").alias("published_at"),
        F.concat(F.lit("S"), (F.col("doc_id") % 10).cast("string")).alias("ticker"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# The same views for the SQL checks.
OBS = """obs AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1, 2)"""
SHIP = """ship AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"""
BARS = """bars AS (SELECT 'S' || (l_suppkey % 10) AS ticker, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
  arg_min(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 1e6::DOUBLE + l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  arg_max(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 1e6::DOUBLE + l_extendedprice) AS close, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume,
  arg_max(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 1e6::DOUBLE + l_extendedprice) * 0.98 AS adj_close FROM lineitem GROUP BY 1, 2)"""
FACTS = """wide_facts AS (SELECT s_nationkey AS entity, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::TIMESTAMP AS period_end,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue,
  sum((l_extendedprice * l_discount)::DECIMAL(18,4))::DOUBLE AS cost_of_revenue,
  sum((l_extendedprice * l_tax)::DECIMAL(18,4))::DOUBLE AS tax, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS units
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
facts AS (SELECT entity, period_end, 'revenue' AS field, revenue AS value FROM wide_facts UNION ALL
  SELECT entity, period_end, 'cost_of_revenue', cost_of_revenue FROM wide_facts UNION ALL
  SELECT entity, period_end, 'tax', tax FROM wide_facts UNION ALL SELECT entity, period_end, 'units', units FROM wide_facts)"""
ITEMS = """items AS (SELECT doc_id AS item_id, source AS source_id, split_part(text, chr(10), 1) AS title, text AS snippet, lang,
  TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7)::BIGINT) AS published_at, 'S' || (doc_id % 10) AS ticker FROM documents)"""
