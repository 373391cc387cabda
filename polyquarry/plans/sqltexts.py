"""Queries through the SQL front end and the graph languages: one for each operator or clause of theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyquarry.operators import graph_algos as algos
from polyquarry.operators import relational
from polyquarry.plans import match, sqlfront
from polyquarry.plans.registry import registry
from polyquarry.session import checkpoint
from polyquarry.sources import fixtures
from polyquarry.sources.tables import table

QUERIES, ORACLES, query = registry()

_N = f"WITH {fixtures.NODES_SQL}"
_G = f"WITH {fixtures.TRADE_NODES_SQL}, {fixtures.TRADE_SQL}"
_VECTOR = [((i * 37) % 19 - 9) / 30 for i in range(64)]
_ARRAY = "ARRAY[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in _VECTOR) + "]"
_LIST = "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in _VECTOR) + "]"
_EMB = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _engine(spark, d) -> sqlfront.Engine:
    engine = sqlfront.Engine(spark)
    engine.register("nodes", fixtures.nodes(spark, d))
    engine.register("embeddings", table(spark, d, "embeddings"))
    engine.register("documents", table(spark, d, "documents"))
    engine.register_vectors("embeddings", "vec_id", "embedding")
    engine.register_text("documents", "doc_id", "text")
    engine.register_graph(match.Graph(fixtures.trade_nodes(spark, d), fixtures.trade(spark, d)))
    return engine


def _sql(name: str, text: str, oracle: str) -> None:
    """A query that is one statement."""
    query(name, oracle)(lambda spark, d: _engine(spark, d).sql(text))


# --- JSON

_sql(
    "sql_json_contains_number",
    """SELECT id FROM nodes WHERE properties @> '{"at":{"nation":7}}'""",
    f"{_N} SELECT id FROM nodes WHERE properties ->> '$.at.nation' = '7'",
)
_sql(
    "sql_json_remove_merge",
    """SELECT id, properties - 'cents' - 'at' AS a, properties #- '{at,nation}' ->> 'at' AS b, properties -> 'at' || '{"z":1}'::jsonb AS c FROM nodes WHERE node_type = 'Customer'""",
    f"""{_N} SELECT id, '{{"segment":"' || (properties ->> '$.segment') || '"}}' AS a, '{{}}' AS b, '{{"nation":' || (properties ->> '$.at.nation') || ',"z":1}}' AS c FROM nodes WHERE node_type = 'Customer'""",
)
_sql(
    "sql_json_set",
    """SELECT id, JSONB_SET(properties -> 'at', '{nation}', '"x"') AS a, JSONB_SET(properties -> 'at', '{new}', '2') AS b FROM nodes WHERE properties ? 'at'""",
    f"""{_N} SELECT id, '{{"nation":"x"}}' AS a, '{{"nation":' || (properties ->> '$.at.nation') || ',"new":2}}' AS b FROM nodes WHERE node_type = 'Customer'""",
)
_sql(
    "sql_json_functions",
    """SELECT id, JSON_GET_INT(properties, 'cents') AS i, JSON_GET_DOUBLE(properties, 'at.nation') AS f, JSON_GET(properties, 'at') AS g, JSON_VALUE(properties, '$.cents' RETURNING BIGINT) AS v,
    JSON_QUERY(properties, '$.at') AS q, JSON_QUERY(properties, '$.segment' WITH WRAPPER) AS w FROM nodes WHERE JSON_EXISTS(properties, '$.at.nation')""",
    f"""{_N} SELECT id, CAST(properties ->> '$.cents' AS BIGINT) AS i, CAST(properties ->> '$.at.nation' AS DOUBLE) AS f, CAST(properties -> '$.at' AS VARCHAR) AS g, CAST(properties ->> '$.cents' AS BIGINT) AS v,
    CAST(properties -> '$.at' AS VARCHAR) AS q, '["' || (properties ->> '$.segment') || '"]' AS w FROM nodes WHERE node_type = 'Customer'""",
)
_sql(
    "sql_json_path_tests",
    """SELECT id FROM nodes WHERE properties @@ '$.cents > 500000 && $.at.nation < 12' AND properties @? '$.segment' AND NOT (properties ?| ARRAY['region', 'zz']) AND properties ?& ARRAY['at', 'cents']""",
    f"{_N} SELECT id FROM nodes WHERE CAST(properties ->> '$.cents' AS DOUBLE) > 500000 AND CAST(properties ->> '$.at.nation' AS INTEGER) < 12",
)
_sql(
    "sql_json_property_equals",
    "SELECT id, path FROM nodes WHERE properties ->> 'segment' = 'MACHINERY'",
    f"{_N} SELECT id, path FROM nodes WHERE properties ->> '$.segment' = 'MACHINERY'",
)
_sql("sql_path_equals", "SELECT id, name FROM nodes WHERE path = '/ASIA'", f"{_N} SELECT id, name FROM nodes WHERE path = '/ASIA'")
_sql("sql_literals", "SELECT 'properties->>''k''' AS a, 'it''s -- no comment' AS b", "SELECT 'properties->>''k''' AS a, 'it''s -- no comment' AS b")


@query("sql_references", f"{_N} SELECT id FROM nodes WHERE id LIKE 'c%7'")
def sql_references(spark, d):
    """References at any depth, inside objects with further objects."""
    engine = sqlfront.Engine(spark)
    made = F.concat(F.lit('{"a":[{"x":{"y":1},"workspace":"w","path":"/p'), F.substring("id", -1, 1), F.lit('"}]}'))
    engine.register("nodes", fixtures.nodes(spark, d).where("startswith(id, 'c')").withColumn("properties", made))
    return engine.sql("SELECT id FROM nodes WHERE REFERENCES('w:/p7')")


# --- vectors and text

for _name, _op, _of in (("l2", "<->", f"list_distance(e, {_LIST})"), ("cosine", "<=>", f"1 - list_inner_product(e, {_LIST})"), ("inner", "<#>", f"-list_inner_product(e, {_LIST})")):
    _sql(
        f"sql_vector_{_name}",
        f"SELECT vec_id, round(embedding {_op} {_ARRAY}, 9) AS distance FROM embeddings ORDER BY embedding {_op} {_ARRAY}, vec_id LIMIT 10",
        f"SELECT vec_id, round({_of}, 9) AS distance FROM {_EMB} ORDER BY {_of}, vec_id LIMIT 10",
    )
_sql(
    "sql_vector_functions",
    f"SELECT vec_id, round(VECTOR_L2_DISTANCE(embedding, {_ARRAY}), 9) AS a, round(VECTOR_COSINE_DISTANCE(embedding, {_ARRAY}), 9) AS b, round(VECTOR_INNER_PRODUCT(embedding, {_ARRAY}), 9) AS c FROM embeddings",
    f"SELECT vec_id, round(list_distance(e, {_LIST}), 9) AS a, round(1 - list_inner_product(e, {_LIST}), 9) AS b, round(-list_inner_product(e, {_LIST}), 9) AS c FROM {_EMB}",
)
_sql(
    "sql_knn",
    f"SELECT k.node_id AS vec_id, round(k.distance, 9) AS distance FROM KNN({_LIST.replace('CAST(', '').replace(' AS DOUBLE)', '')}, 10, 'label < 5') AS k",
    f"SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_LIST}), 9) AS distance FROM embeddings WHERE label < 5 ORDER BY 2, 1 LIMIT 10",
)
_sql(
    "sql_text_match",
    "SELECT doc_id FROM documents WHERE to_tsvector('english', text) @@ to_tsquery('english', 'license & (general | mit) & !apache')",
    f"SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE list_contains(w, 'license') AND (list_contains(w, 'general') OR list_contains(w, 'mit')) AND NOT list_contains(w, 'apache')",
)
_sql(
    "sql_fulltext_match",
    "SELECT doc_id FROM documents WHERE FULLTEXT_MATCH('licen:* & public', 'english')",
    f"SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0 AND list_contains(w, 'public')",
)
_sql(
    "sql_ts_rank",
    "SELECT doc_id, round(ts_rank(to_tsvector('english', text), to_tsquery('english', 'license | public')), 9) AS r FROM documents",
    f"SELECT doc_id, round((1 - 1.0 / (1 + len(list_filter(w, lambda x: x = 'license'))) + 1 - 1.0 / (1 + len(list_filter(w, lambda x: x = 'public')))) / 2, 9) AS r FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
)
_sql("sql_neighbors_in", "SELECT id FROM NEIGHBORS('n3', 'IN', 'IN')", f"{_G} SELECT src AS id FROM edges JOIN all_nodes ON id = src WHERE dst = 'n3' AND relation_type = 'IN'")
_sql(
    "sql_cypher",
    "SELECT c.home, count(*) AS n FROM CYPHER('MATCH (a:Customer)-[:IN]->(b) RETURN a.id AS id, b.name AS home') AS c GROUP BY c.home",
    f"{_G} SELECT b.name AS home, count(*) AS n FROM edges JOIN all_nodes b ON b.id = dst WHERE relation_type = 'IN' GROUP BY 1",
)


# --- changes of logs


@query("sql_log_changes", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN 'it''s' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 10 <> 4 UNION ALL SELECT -1, 'new'")
def sql_log_changes(spark, d):
    """INSERT, UPDATE and DELETE on a branch of a log; a rolled back change leaves nothing."""
    log = table(spark, d, "customer").select(F.lit(1).cast("long").alias("revision"), F.col("c_custkey").alias("id"), F.lit(False).alias("deleted"), F.col("c_mktsegment").alias("v"), F.lit("main").alias("branch"))
    engine = sqlfront.Engine(spark, udfs=False)
    engine.register_log("docs", log, spark.createDataFrame([("main", None, None)], "name string, parent string, fork_revision long"))
    engine.batch("CREATE BRANCH 'b'; USE BRANCH 'b'; INSERT INTO docs (id, v) VALUES (-1, 'new'); UPDATE docs SET v = 'it''s' WHERE id % 10 = 3; DELETE FROM docs WHERE id % 10 = 4; BEGIN; DELETE FROM docs WHERE id > 0; ROLLBACK; USE BRANCH 'main'")
    return engine.sql("SELECT id, v FROM docs WHERE __branch = 'b'")


@query("sql_log_join", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 = 3")
def sql_log_join(spark, d):
    """Two branches of one log in one statement."""
    log = table(spark, d, "customer").select(F.lit(1).cast("long").alias("revision"), F.col("c_custkey").alias("id"), F.lit(False).alias("deleted"), F.col("c_mktsegment").alias("v"), F.lit("main").alias("branch"))
    engine = sqlfront.Engine(spark, udfs=False)
    engine.register_log("docs", log, spark.createDataFrame([("main", None, None)], "name string, parent string, fork_revision long"))
    engine.batch("CREATE BRANCH 'b'; USE BRANCH 'b'; UPDATE docs SET v = 'x' WHERE id % 10 = 3")
    return engine.sql("SELECT n.id FROM docs o JOIN docs n ON o.id = n.id WHERE o.__branch = 'main' AND n.__branch = 'b' AND o.v <> n.v")


@query("sql_move_tree", f"{_N} SELECT id, replace(path, '/ASIA/', '/EUROPE/') AS path, regexp_replace(replace(path, '/ASIA/', '/EUROPE/'), '/[^/]*$', '') AS parent_path FROM nodes WHERE starts_with(path, '/ASIA/NATION_2/') OR path = '/ASIA/NATION_2'")
def sql_move_tree(spark, d):
    """MOVE keeps what the table derives from paths up to date."""
    engine = sqlfront.Engine(spark, udfs=False)
    nodes = fixtures.nodes(spark, d)
    engine.register("nodes", nodes.withColumn("parent_path", F.regexp_replace("path", "/[^/]*$", "")))
    moved = nodes.where("path = '/ASIA/NATION_2'").select("id").collect()
    if moved:
        engine.sql("MOVE nodes SET path='/ASIA/NATION_2' TO path='/EUROPE'")
    return engine.sql("SELECT id, path, parent_path FROM nodes WHERE path = '/EUROPE/NATION_2' OR DESCENDANT_OF('/EUROPE/NATION_2')")


# --- graph languages


def _graph(spark, d) -> match.Graph:
    return match.Graph(fixtures.trade_nodes(spark, d), fixtures.trade(spark, d))


def _match(name: str, text: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, d: match.graph_table(_graph(spark, d), text))


def _cypher(name: str, text: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, d: match.cypher(_graph(spark, d), text))


_BUYS = "JOIN all_nodes a ON a.id = src JOIN all_nodes b ON b.id = dst WHERE relation_type = 'BUYS'"
_match(
    "pgq_typed_where",
    "MATCH (a:Customer)-[r:BUYS]->(b:Supplier) WHERE a.cents < b.cents AND a.cents > 100000 AND r.weight >= 2 COLUMNS (a.id AS a, b.id AS b)",
    f"{_G} SELECT a.id AS a, b.id AS b FROM edges {_BUYS} AND CAST(a.properties ->> '$.cents' AS BIGINT) < CAST(b.properties ->> '$.cents' AS BIGINT) AND CAST(a.properties ->> '$.cents' AS BIGINT) > 100000 AND weight >= 2",
)
_match(
    "pgq_where_lists",
    "MATCH (a:Customer)-[r:BUYS]->(b) WHERE a.segment IN ['BUILDING', 'MACHINERY'] AND b.cents BETWEEN 0 AND 400000 AND a.name LIKE '%1%' AND a.segment <> 'x' COLUMNS (a.id AS a, b.id AS b)",
    f"{_G} SELECT a.id AS a, b.id AS b FROM edges {_BUYS} AND a.properties ->> '$.segment' IN ('BUILDING', 'MACHINERY') AND CAST(b.properties ->> '$.cents' AS BIGINT) BETWEEN 0 AND 400000 AND a.name LIKE '%1%'",
)
_match("pgq_star", "MATCH (a:Customer)-[r:IN]->(b) COLUMNS (*)", f"{_G} SELECT src AS a, 'IN' AS r, dst AS b FROM edges WHERE relation_type = 'IN'")
_cypher(
    "cypher_two_matches",
    "MATCH (a:Customer)-[:IN]->(n) WHERE n.id = 'n3' MATCH (a)-[r:BUYS]->(s) WHERE r.weight >= 2 RETURN a.id AS a, s.id AS s",
    f"{_G} SELECT e.src AS a, b.dst AS s FROM edges e JOIN edges b ON e.src = b.src WHERE e.relation_type = 'IN' AND e.dst = 'n3' AND b.relation_type = 'BUYS' AND b.weight >= 2",
)
_cypher(
    "cypher_optional",
    "MATCH (a:Customer)-[:IN]->(n) WHERE n.id = 'n3' OPTIONAL MATCH (a)-[r:BUYS]->(s) WHERE r.weight >= 2 RETURN a.id AS a, s.id AS s",
    f"{_G} SELECT e.src AS a, b.dst AS s FROM edges e LEFT JOIN edges b ON e.src = b.src AND b.relation_type = 'BUYS' AND b.weight >= 2 WHERE e.relation_type = 'IN' AND e.dst = 'n3'",
)
_cypher(
    "cypher_with",
    "MATCH (a:Customer)-[r:BUYS]->(s) WITH s, count(*) AS n, sum(r.weight) AS w WHERE n > 2 RETURN s.name AS name, n, w",
    f"{_G} SELECT b.name, count(*) AS n, sum(weight) AS w FROM edges {_BUYS} GROUP BY 1 HAVING count(*) > 2",
)
_cypher(
    "cypher_operators",
    "MATCH (a:Customer)-[:IN]->(n) WHERE (a.cents > 500000 XOR a.segment =~ 'B.*') AND NOT a.name ENDS WITH '3' AND a.cents ^ 2 > 4 AND n.name CONTAINS 'TION' RETURN a.id AS id, a.cents + 1 AS more",
    f"""{_G} SELECT a.id, CAST(a.properties ->> '$.cents' AS DOUBLE) + 1 AS more FROM edges JOIN all_nodes a ON a.id = src WHERE relation_type = 'IN' AND (CAST(a.properties ->> '$.cents' AS BIGINT) > 500000) <> starts_with(a.properties ->> '$.segment', 'B')
    AND NOT ends_with(a.name, '3') AND pow(CAST(a.properties ->> '$.cents' AS DOUBLE), 2) > 4""",
)
_cypher(
    "cypher_distinct_edges",
    "MATCH (a)-[:IN]-(n)-[:IN]-(b) WHERE n.id = 'n3' RETURN a.id AS a, b.id AS b",
    f"{_G} SELECT x.src AS a, y.src AS b FROM edges x JOIN edges y ON x.dst = y.dst AND x.src <> y.src WHERE x.relation_type = 'IN' AND y.relation_type = 'IN' AND x.dst = 'n3'",
)
_match(
    "pgq_wcc",
    "MATCH (a)-[:IN]->(n:Nation) COLUMNS (a.id AS id, wcc(a) AS part, in_degree(n) AS customers, component_count() AS parts)",
    f"""{_G.replace('WITH', 'WITH RECURSIVE', 1)}, reach(id, other) AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    far AS (SELECT min(least(src, dst)) AS low FROM edges), ins AS (SELECT dst, count(*) AS k FROM edges GROUP BY 1)
    SELECT src AS id, low AS part, k AS customers, 1::BIGINT AS parts FROM edges JOIN ins USING (dst), far WHERE relation_type = 'IN'""",
)


@query("pgq_pagerank")
def pgq_pagerank(spark, d):
    """PageRank of the pattern's nodes over the whole graph; tested against the algorithm itself."""
    return match.graph_table(_graph(spark, d), "MATCH (a:Customer)-[:IN]->(n:Nation) COLUMNS (n.id AS id, count(*) AS customers, max(pagerank(n, 0.85, 8)) AS rank)")


# --- paths and centralities of the graph of followers

_F = f"WITH RECURSIVE {fixtures.FOLLOWS_SQL}"
_ENDS = "ends AS (SELECT min(src) AS a, max(dst) AS b FROM follows)"


@query(
    "graph_betweenness_values",
    f"""{_F}, links AS (SELECT src, dst, count(*)::DOUBLE AS m FROM follows GROUP BY 1, 2), ids AS (SELECT src AS id FROM follows UNION SELECT dst FROM follows),
    walk(s, v, d, p) AS (SELECT id, id, 0, 1.0::DOUBLE FROM ids UNION SELECT s, dst, d + 1, sum(p * m) FROM walk JOIN links ON src = v WHERE d < 5 GROUP BY s, dst, d),
    best AS (SELECT s, v, min(d) AS d, arg_min(p, d) AS p FROM walk GROUP BY 1, 2),
    mid AS (SELECT x.v AS id, x.p * y.p / z.p AS part FROM best x JOIN best y ON x.v = y.s JOIN best z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND y.s <> y.v AND x.s <> y.v)
    SELECT ids.id, round(coalesce(sum(part), 0) / (((SELECT count(*) FROM ids) - 1) * ((SELECT count(*) FROM ids) - 2)), 9) AS betweenness FROM ids LEFT JOIN mid USING (id) GROUP BY 1""",
)
def graph_betweenness_values(spark, d):
    return algos.betweenness(checkpoint(fixtures.follows(spark, d))).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(
    "graph_shortest_all",
    f"""{_F}, {_ENDS}, links AS (SELECT DISTINCT src, dst FROM follows), walk(v, hops, path) AS (SELECT a, 0, [a] FROM ends UNION ALL SELECT dst, hops + 1, list_append(path, dst) FROM walk JOIN links ON src = v, ends WHERE hops < 4 AND v <> b AND NOT list_contains(path, dst)),
    hit AS (SELECT path, hops FROM walk, ends WHERE v = b) SELECT path, hops FROM hit WHERE hops = (SELECT min(hops) FROM hit)""",
)
def graph_shortest_all(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    ends = edges.agg(F.min("src"), F.max("dst")).first()
    return algos.shortest_paths(edges, ends[0], ends[1])


_WALK = "links AS (SELECT src, dst, min(weight) AS w FROM follows GROUP BY 1, 2), walk(id, distance, hops) AS (SELECT a, 0.0::DOUBLE, 0 FROM ends UNION SELECT dst, min(distance + w), hops + 1 FROM walk JOIN links ON src = id WHERE hops < 14 GROUP BY dst, hops)"


@query("graph_a_star_cost", f"{_F}, {_ENDS}, {_WALK} SELECT a AS first, b AS last, min(distance) AS cost FROM walk, ends WHERE id = b GROUP BY 1, 2")
def graph_a_star_cost(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    ends = edges.agg(F.min("src"), F.max("dst")).first()
    return algos.a_star(edges, ends[0], ends[1]).select(F.col("path")[0].alias("first"), F.element_at("path", -1).alias("last"), "cost")


@query("graph_k_shortest_first", f"{_F}, {_ENDS}, {_WALK} SELECT min(distance) AS cost, 3::BIGINT AS paths FROM walk, ends WHERE id = b")
def graph_k_shortest_first(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    ends = edges.agg(F.min("src"), F.max("dst")).first()
    return algos.k_shortest_paths(edges, ends[0], ends[1], 3).agg(F.min("cost").alias("cost"), F.count("*").alias("paths"))


# --- policies, paths, durations, functions of users


_sql("sql_dollar_paths", "SELECT id, $.properties.at.nation AS nation FROM nodes WHERE $.properties.segment = 'BUILDING'", f"{_N} SELECT id, properties ->> '$.at.nation' AS nation FROM nodes WHERE properties ->> '$.segment' = 'BUILDING'")


@query("sql_policy", f"{_N} SELECT id FROM nodes WHERE node_type <> 'Customer'")
def sql_policy(spark, d):
    """A row filter and the hidden root."""
    engine = sqlfront.Engine(spark, udfs=False)
    nodes = fixtures.nodes(spark, d)
    root = nodes.limit(1).select(F.lit("root").alias("id"), F.lit("/").alias("path"), F.lit("").alias("name"), F.lit("Root").alias("node_type"), F.lit("{}").alias("properties"))
    engine.register("nodes", nodes.union(root))
    engine.register_policy("nodes", "node_type <> 'Customer'")
    return engine.sql("SELECT id FROM nodes")


@query("sql_durations", "SELECT event_id, ts + INTERVAL 30 DAY AS a, ts - INTERVAL 90 MINUTE AS b, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01')) AS BIGINT) AS c FROM events")
def sql_durations(spark, d):
    """A month is 30 days; the difference of two times."""
    engine = sqlfront.Engine(spark, udfs=False)
    engine.register("events", table(spark, d, "events"))
    return engine.sql("SELECT event_id, ts + INTERVAL '1 month' AS a, ts - INTERVAL '1 hour 30 minutes' AS b, CAST(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000 - unix_micros(TIMESTAMP '2024-01-01 00:00:00') / 1000000 AS BIGINT) AS c FROM events")


@query("sql_invoke", "SELECT c_custkey AS id, c_custkey * 2 + 1 AS v FROM customer")
def sql_invoke(spark, d):
    engine = sqlfront.Engine(spark, udfs=False)
    engine.register("customer", table(spark, d, "customer"))
    engine.register_function("twice_and_one", lambda x: 2 * x + 1, "long")
    return engine.sql("SELECT c_custkey AS id, INVOKE('twice_and_one', c_custkey) AS v FROM customer")


@query("sql_user_aggregate", "SELECT c_nationkey AS nation, max(c_custkey) - min(c_custkey) AS spread FROM customer GROUP BY 1")
def sql_user_aggregate(spark, d):
    engine = sqlfront.Engine(spark, udfs=False)
    engine.register("customer", table(spark, d, "customer"))
    engine.register_aggregate("spread_of", lambda x: int(x.max() - x.min()), "long")
    return engine.sql("SELECT c_nationkey AS nation, spread_of(c_custkey) AS spread FROM customer GROUP BY 1")


class _Digits:
    def eval(self, n: int):
        for i, c in enumerate(str(n)):
            yield i, int(c)


@query("sql_user_table_function", "SELECT c_custkey AS id, CAST(i AS INTEGER) AS place, CAST(substr(CAST(c_custkey AS VARCHAR), i + 1, 1) AS INTEGER) AS digit FROM customer, range(0, 20) r(i) WHERE i < length(CAST(c_custkey AS VARCHAR))")
def sql_user_table_function(spark, d):
    engine = sqlfront.Engine(spark, udfs=False)
    engine.register("customer", table(spark, d, "customer"))
    engine.register_table_function("digits_of", _Digits, "place int, digit int")
    return engine.sql("SELECT c.c_custkey AS id, t.place, t.digit FROM customer c, LATERAL digits_of(c.c_custkey) t")


def _plain(name: str, text: str, oracle: str, *tables: str) -> None:
    """Aggregates that Spark's SQL has itself."""

    def run(spark, d):
        engine = sqlfront.Engine(spark, udfs=False)
        for t in tables:
            engine.register(t, table(spark, d, t))
        return engine.sql(text)

    query(name, oracle)(run)


_plain(
    "agg_statistics",
    "SELECT c_nationkey AS nation, round(stddev(c_acctbal), 6) AS sd, round(variance(c_acctbal), 4) AS var, round(percentile(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS med, round(corr(c_acctbal, c_custkey), 9) AS r FROM customer GROUP BY 1",
    "SELECT c_nationkey AS nation, round(stddev(c_acctbal), 6) AS sd, round(variance(c_acctbal), 4) AS var, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS med, round(corr(c_acctbal, c_custkey), 9) AS r FROM customer GROUP BY 1",
    "customer",
)
_plain(
    "agg_grouping_sets",
    "SELECT c_mktsegment AS segment, c_nationkey AS nation, grouping(c_mktsegment) AS g, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "SELECT c_mktsegment AS segment, c_nationkey AS nation, CAST(grouping(c_mktsegment) AS TINYINT) AS g, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "customer",
)
_plain("agg_by_all", "SELECT c_mktsegment AS segment, c_nationkey % 3 AS part, count(*) AS n FROM customer GROUP BY ALL", "SELECT c_mktsegment AS segment, c_nationkey % 3 AS part, count(*) AS n FROM customer GROUP BY ALL", "customer")
_plain(
    "window_named",
    "SELECT c_custkey AS id, rank() OVER w AS r, lag(c_custkey) OVER w AS before FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "SELECT c_custkey AS id, CAST(rank() OVER w AS INTEGER) AS r, lag(c_custkey) OVER w AS before FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "customer",
)


@query("agg_approximate", "SELECT true AS close_count, true AS close_median FROM range(1)")
def agg_approximate(spark, d):
    """approx_count_distinct and approx_percentile within their stated error of the exact values."""
    line = table(spark, d, "lineitem")
    # each aggregate on its own: beside a DISTINCT, sketches would be kept for each of its keys
    about = line.agg(F.approx_count_distinct("l_partkey", 0.02).alias("n"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("m"))
    exact = line.select("l_partkey").where("l_partkey IS NOT NULL").distinct().agg(F.count("*").alias("exact"))
    got = about.crossJoin(exact).crossJoin(relational.exact_median(line, "l_extendedprice"))  # one row each
    return got.select((F.abs(F.col("n") / F.col("exact") - 1) < 0.08).alias("close_count"), (F.abs(F.col("m") / F.col("median") - 1) < 0.02).alias("close_median"))
