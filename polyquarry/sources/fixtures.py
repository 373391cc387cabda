"""Nodes, edges, revisions and points derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyquarry.sources.tables import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, path, name, node_type, properties: regions, their nations, their customers as /REGION/NATION/CUSTOMER."""
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.concat(F.lit("/"), "r_name").alias("path"), F.col("r_name").alias("name"), F.lit("Region").alias("node_type"), F.lit("{}").alias("properties"))
    n_ = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # regions and nations are fixed, small tables
    n = n_.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name"), "n_name", F.lit("geo:Nation"), F.concat(F.lit('{"region":'), F.col("n_regionkey").cast("string"), F.lit("}")))
    c_ = customer.join(F.broadcast(n_), F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    props = F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('","cents":'), cents, F.lit(',"at":{"nation":'), F.col("c_nationkey").cast("string"), F.lit("}}"))
    c = c_.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_name"), "c_name", F.lit("Customer"), props)
    return r.union(n).union(c)


NODES_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, '/' || r_name AS path, r_name AS name, 'Region' AS node_type, '{}' AS properties FROM region
  UNION ALL
  SELECT 'n' || n_nationkey, '/' || r_name || '/' || n_name, n_name, 'geo:Nation', '{"region":' || n_regionkey || '}'
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'c' || c_custkey, '/' || r_name || '/' || n_name || '/' || c_name, c_name, 'Customer',
         '{"segment":"' || c_mktsegment || '","cents":' || CAST(round(c_acctbal * 100) AS BIGINT) || ',"at":{"nation":' || c_nationkey || '}}'
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Edges from customers to the suppliers of their orders: BUYS, weight the number of lines; customers are IN their nation."""
    orders, line, customer = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    lines = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    buys = lines.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("BUYS").alias("relation_type"), "weight")
    home = customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit("IN"), F.lit(1.0))
    return buys.union(home)


TRADE_SQL = """
edges AS (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, 'BUYS' AS relation_type, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
  UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN', 1.0 FROM customer)"""


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    """``nodes`` and the suppliers."""
    supplier = table(spark, d, "supplier")
    cents = F.round(F.col("s_acctbal") * 100).cast("long").cast("string")
    s = supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("/suppliers/"), "s_name"), "s_name", F.lit("Supplier"), F.concat(F.lit('{"cents":'), cents, F.lit("}")))
    return nodes(spark, d).union(s)


TRADE_NODES_SQL = NODES_SQL + """,
all_nodes AS (SELECT * FROM nodes UNION ALL
  SELECT 's' || s_suppkey, '/suppliers/' || s_name, s_name, 'Supplier', '{"cents":' || CAST(round(s_acctbal * 100) AS BIGINT) || '}' FROM supplier)"""


def follows(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, weight: users of successive events of one type, in order of event_id; weight in whole cents of the first event's value."""
    events = table(spark, d, "events")
    w = Window.partitionBy("event_type").orderBy("event_id")
    step = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), (F.round(F.abs("value") * 100) + 1).alias("weight"))
    return step.where("dst IS NOT NULL AND src <> dst")


FOLLOWS_SQL = """
follows AS (SELECT * FROM (
  SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS dst, round(abs(value) * 100) + 1 AS weight
  FROM events) WHERE dst IS NOT NULL AND src <> dst)"""


def revision_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as writes: id the user, revision the event, deleted on errors."""
    events = table(spark, d, "events")
    return events.select(F.col("event_id").alias("revision"), F.col("user_id").alias("id"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("state"), F.lit("main").alias("branch"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, lon, lat of customers, spread by modular arithmetic."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), ((key * 7919) % 36000 / 100.0 - 180.0).alias("lon"), ((key * 104729) % 17000 / 100.0 - 85.0).alias("lat"))


POINTS_SQL = "points AS (SELECT c_custkey AS id, (c_custkey * 7919) % 36000 / 100.0 - 180.0 AS lon, (c_custkey * 104729) % 17000 / 100.0 - 85.0 AS lat FROM customer)"
