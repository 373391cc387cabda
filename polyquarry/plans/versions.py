"""Revision, branch, data-change and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyquarry.operators import dml, versioning
from polyquarry.plans.registry import registry
from polyquarry.sources import fixtures
from polyquarry.sources.tables import table
from polyquarry.streaming import subscriptions

QUERIES, ORACLES, query = registry()

_LOG = "log AS (SELECT event_id AS revision, user_id AS id, event_type = 'error' AS deleted, event_type AS state FROM events)"
_STATE = "SELECT id, revision, state FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS k FROM log{}) WHERE k = 1 AND NOT deleted"


@query("version_head", f"WITH {_LOG} {_STATE.format('')}")
def version_head(spark, d):
    return versioning.as_of(fixtures.revision_log(spark, d)).select("id", "revision", "state")


@query("version_as_of", f"WITH {_LOG} {_STATE.format(' WHERE revision <= 4000')}")
def version_as_of(spark, d):
    return versioning.as_of(fixtures.revision_log(spark, d), 4000).select("id", "revision", "state")


@query(
    "version_branch",
    f"""WITH {_LOG}, seen AS (SELECT * FROM log WHERE revision <= 3000 OR (revision > 3000 AND state = 'click'))
        SELECT id, revision, state FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS k FROM seen) WHERE k = 1 AND NOT deleted""",
)
def version_branch(spark, d):
    """A branch forked at revision 3000 that only knows the clicks since."""
    log = fixtures.revision_log(spark, d)
    own = log.where("revision > 3000 AND state = 'click'").withColumn("branch", F.lit("draft"))
    branches = spark.createDataFrame([("main", None, None), ("draft", "main", 3000)], versioning.BRANCHES)
    return versioning.branch_state(log.unionByName(own), branches, "draft").select("id", "revision", "state")


@query(
    "version_merge",
    f"""WITH {_LOG}, s AS (SELECT *, CASE WHEN state IN ('view', 'click') THEN 'o' WHEN state = 'purchase' THEN 't' END AS side FROM log),
        b AS (SELECT id, max(revision) AS r FROM log WHERE revision <= 2000 GROUP BY 1), o AS (SELECT id, max(revision) AS r FROM s WHERE revision <= 2000 OR side = 'o' GROUP BY 1), t AS (SELECT id, max(revision) AS r FROM s WHERE revision <= 2000 OR side = 't' GROUP BY 1)
        SELECT id, CASE WHEN o.r IS NOT DISTINCT FROM t.r THEN CASE WHEN o.r IS NOT DISTINCT FROM b.r THEN 'same' ELSE 'both' END WHEN t.r IS NOT DISTINCT FROM b.r THEN 'ours' WHEN o.r IS NOT DISTINCT FROM b.r THEN 'theirs' ELSE 'conflict' END AS status,
               CASE WHEN o.r IS NOT DISTINCT FROM b.r AND o.r IS DISTINCT FROM t.r THEN t.r WHEN t.r IS NOT DISTINCT FROM b.r OR o.r IS NOT DISTINCT FROM t.r THEN o.r ELSE t.r END AS r
        FROM b FULL JOIN o USING (id) FULL JOIN t USING (id)""",
)
def version_merge(spark, d):
    """Three states of the last revision per user; conflicts keep theirs."""
    log = fixtures.revision_log(spark, d)
    last = lambda c: log.where(c).groupBy("id").agg(F.max("revision").alias("r"))
    merged = versioning.three_way_merge(last("revision <= 2000"), last("revision <= 2000 OR state IN ('view', 'click')"), last("revision <= 2000 OR state = 'purchase'"), ["r"], "theirs")
    return merged.select("id", "status", "r")


@query("version_locale", "SELECT n_nationkey AS id, locale, CASE WHEN locale = 'de' AND n_nationkey < 10 THEN 'DE_' || n_name ELSE n_name END AS name FROM nation, (VALUES ('en'), ('de')) l(locale)")
def version_locale(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    german = n.where("id < 10").select("id", F.lit("de").alias("locale"), F.concat(F.lit("DE_"), "name").alias("name"))
    return versioning.localise(n, german, ["en", "de"], ["name"])


@query("dml_update", f"WITH {fixtures.NODES_SQL} SELECT id, CASE WHEN node_type = 'Region' THEN lower(name) ELSE name END AS name FROM nodes WHERE NOT starts_with(path, '/AFRICA/')")
def dml_update(spark, d):
    n = fixtures.nodes(spark, d)
    n = dml.update(n, F.col("node_type") == "Region", {"name": F.lower("name")})
    return dml.delete(n, F.col("path").startswith("/AFRICA/")).select("id", "name")


@query("dml_upsert", f"WITH {fixtures.NODES_SQL} SELECT id, CASE WHEN id = 'r1' THEN 'new name' ELSE name END AS name FROM nodes UNION ALL SELECT 'r99', 'added'")
def dml_upsert(spark, d):
    rows = spark.createDataFrame([("r1", "new name"), ("r99", "added")], "id string, name string")
    return dml.upsert(fixtures.nodes(spark, d), rows).select("id", "name")


@query("dml_move", f"WITH {fixtures.NODES_SQL} SELECT id, CASE WHEN path = '/ASIA' OR starts_with(path, '/ASIA/') THEN '/EUROPE' || path ELSE path END AS path FROM nodes")
def dml_move(spark, d):
    return dml.move(fixtures.nodes(spark, d), "/ASIA", "/EUROPE").select("id", "path")


@query("dml_copy", f"WITH {fixtures.NODES_SQL} SELECT path FROM nodes UNION ALL SELECT '/EUROPE' || path FROM nodes WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')")
def dml_copy(spark, d):
    return dml.copy(fixtures.nodes(spark, d), "/ASIA", "/EUROPE").select("path")


@query("dml_relate", f"WITH {fixtures.TRADE_SQL} SELECT src, dst, relation_type FROM edges WHERE NOT (relation_type = 'IN' AND dst = 'n1') UNION ALL SELECT 'c1', 'c2', 'KNOWS'")
def dml_relate(spark, d):
    edges = fixtures.trade(spark, d)
    edges = dml.relate(edges, spark.createDataFrame([("c1", "c2", "KNOWS", 1.0)], "src string, dst string, relation_type string, weight double"))
    return dml.unrelate(edges, edges.where("relation_type = 'IN' AND dst = 'n1'").select("src", "dst", "relation_type")).select("src", "dst", "relation_type")


@query("dml_validate", f"WITH {fixtures.NODES_SQL} SELECT id FROM nodes WHERE node_type = 'Customer' AND properties ->> '$.segment' NOT IN ('BUILDING', 'MACHINERY')")
def dml_validate(spark, d):
    kind = dml.NodeType("Customer", {"segment": dml.Property("String", required=True, allowed=["BUILDING", "MACHINERY"]), "cents": dml.Property("Number", required=True)})
    return dml.violations(fixtures.nodes(spark, d), kind).where(F.size("problems") > 0).select("id")


@query("event_subscription", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND user_id < 50")
def event_subscription(spark, d):
    """A subscription's filter on a table; the same object filters a stream."""
    e = table(spark, d, "events").withColumn("workspace", F.when(F.col("user_id") < 50, "small").otherwise("large")).withColumn("path", F.concat(F.lit("/u/"), "user_id"))
    return subscriptions.Subscription(workspaces=["small"], event_types=["click", "purchase"], paths=["/u/*"]).apply(e).select("event_id")


@query("event_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = subscriptions.windowed_counts(e, "at", "6 hours", keys=["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("event_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 2 HOUR GROUP BY 1")
def event_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return subscriptions.sessions(e, "at", "2 hours", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("sessions"))
