"""Graph queries: patterns, neighbours, algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyquarry.operators import graph_algos as algos
from polyquarry.plans import match
from polyquarry.plans.registry import registry
from polyquarry.session import checkpoint
from polyquarry.sources import fixtures

QUERIES, ORACLES, query = registry()

_G = f"WITH {fixtures.TRADE_NODES_SQL}, {fixtures.TRADE_SQL}"


def _graph(spark, d) -> match.Graph:
    return match.Graph(fixtures.trade_nodes(spark, d), fixtures.trade(spark, d))


@query("pgq_hop", f"{_G} SELECT a.name AS buyer, b.name AS seller, CAST(weight AS BIGINT) AS lines FROM edges JOIN all_nodes a ON a.id = src JOIN all_nodes b ON b.id = dst WHERE relation_type = 'BUYS' AND weight >= 3 AND a.properties ->> '$.segment' = 'BUILDING'")
def pgq_hop(spark, d):
    text = "GRAPH_TABLE(NODES_GRAPH MATCH (a:Customer)-[r:BUYS WHERE r.weight >= 3]->(b:Supplier) WHERE a.segment = 'BUILDING' COLUMNS (a.name AS buyer, b.name AS seller, CAST(r.weight AS BIGINT) AS lines))"
    return match.graph_table(_graph(spark, d), text)


@query("pgq_node", f"{_G} SELECT id FROM all_nodes WHERE lower(node_type) LIKE '%nation' AND id IN (SELECT dst FROM edges UNION SELECT src FROM edges)")
def pgq_node(spark, d):
    return match.graph_table(_graph(spark, d), "MATCH (n:Nation) COLUMNS (n.id AS id)")


@query("pgq_chain", f"{_G} SELECT n.name AS nation, s.name AS seller, count(*) AS buyers FROM edges e JOIN edges b ON e.src = b.src JOIN all_nodes n ON n.id = e.dst JOIN all_nodes s ON s.id = b.dst WHERE e.relation_type = 'IN' AND b.relation_type = 'BUYS' AND b.weight >= 2 GROUP BY 1, 2")
def pgq_chain(spark, d):
    """Two hops, one against the arrow, grouped by the plain columns."""
    return match.graph_table(_graph(spark, d), "MATCH (n:Nation)<-[i:IN]-(c:Customer)-[b:BUYS WHERE b.weight >= 2]->(s:Supplier) COLUMNS (n.name AS nation, s.name AS seller, COUNT(*) AS buyers)")


@query("pgq_comma", f"{_G} SELECT c.id AS buyer, n.id AS home, s.id AS seller FROM edges e JOIN edges b ON e.src = b.src JOIN all_nodes n ON n.id = e.dst JOIN all_nodes s ON s.id = b.dst JOIN all_nodes c ON c.id = e.src WHERE e.relation_type = 'IN' AND b.relation_type = 'BUYS' AND b.weight >= 4")
def pgq_comma(spark, d):
    """Patterns that share a variable join on it."""
    return match.graph_table(_graph(spark, d), "MATCH (c:Customer)-[:IN]->(n), (c)-[b:BUYS]->(s) WHERE b.weight >= 4 COLUMNS (c.id AS buyer, n.id AS home, s.id AS seller)")


@query(
    "pgq_variable_length",
    f"""{_G}, heavy AS (SELECT src, dst FROM edges WHERE relation_type = 'BUYS' AND weight >= 4), pairs2 AS (SELECT src, dst FROM heavy UNION ALL SELECT dst, src FROM heavy),
    p AS (SELECT src AS a, dst AS b, 1 AS hops FROM pairs2 UNION ALL SELECT x.src, y.dst, 2 FROM pairs2 x JOIN pairs2 y ON x.dst = y.src WHERE x.src <> y.dst)
    SELECT a, b, hops, count(*) AS n FROM p GROUP BY ALL""",
)
def pgq_variable_length(spark, d):
    g = _graph(spark, d)
    heavy = match.Graph(g.nodes, g.edges.where("relation_type = 'BUYS' AND weight >= 4"))
    return match.graph_table(heavy, "MATCH (a)-[p:BUYS*1..2]-(b) COLUMNS (a.id AS a, b.id AS b, CARDINALITY(p) AS hops, COUNT(*) AS n)")


@query("cypher_return", f"{_G} SELECT b.name AS seller, count(*) AS buyers, CAST(sum(weight) AS BIGINT) AS lines FROM edges JOIN all_nodes a ON a.id = src JOIN all_nodes b ON b.id = dst WHERE relation_type = 'BUYS' AND starts_with(a.path, '/ASIA') GROUP BY 1 ORDER BY lines DESC, seller LIMIT 10")
def cypher_return(spark, d):
    text = "MATCH (a:Customer)-[r:BUYS]->(b) WHERE a.path STARTS WITH $prefix RETURN b.name AS seller, count(*) AS buyers, CAST(sum(r.weight) AS BIGINT) AS lines ORDER BY lines DESC, seller LIMIT 10"
    return match.cypher(_graph(spark, d), text, {"prefix": "/ASIA"})


@query("neighbors_out", f"{_G} SELECT id, relation_type FROM edges JOIN all_nodes ON id = dst WHERE src = 'c1'")
def neighbors_out(spark, d):
    return match.neighbors(_graph(spark, d), "c1", "OUT").select("id", "relation_type")


@query("neighbors_both", f"{_G} SELECT id FROM (SELECT dst AS id FROM edges WHERE src = 's1' UNION ALL SELECT src FROM edges WHERE dst = 's1') JOIN all_nodes USING (id)")
def neighbors_both(spark, d):
    return match.neighbors(_graph(spark, d), "s1", "BOTH").select("id")


_F = f"WITH RECURSIVE {fixtures.FOLLOWS_SQL}"
_PAIRS = "pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM follows)"
_IDS = "ids AS (SELECT src AS id FROM follows UNION SELECT dst FROM follows)"


@query("graph_degree", f"{_F} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM follows UNION ALL SELECT dst, 0, 1 FROM follows) GROUP BY 1")
def graph_degree(spark, d):
    return algos.degrees(fixtures.follows(spark, d))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"{_F}, {_IDS}, outs AS (SELECT src, count(*) AS o FROM follows GROUP BY 1), n AS (SELECT count(*) AS n FROM ids), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM ids, n)"]
    for i in range(rounds):
        parts.append(
            f"""g{i} AS (SELECT dst AS id, sum(r / o) AS g FROM follows JOIN outs USING (src) JOIN r{i} ON r{i}.id = src GROUP BY 1),
            d{i} AS (SELECT coalesce(sum(r), 0) AS d FROM r{i} WHERE id NOT IN (SELECT src FROM outs)),
            r{i + 1} AS (SELECT ids.id, 0.15 / n + 0.85 * d / n + 0.85 * coalesce(g, 0) AS r FROM ids LEFT JOIN g{i} USING (id), n, d{i})"""
        )
    return ", ".join(parts) + f" SELECT id, round(r / (SELECT sum(r) FROM r{rounds}), 9) AS rank FROM r{rounds}"


@query("graph_pagerank", _pagerank_sql(8))
def graph_pagerank(spark, d):
    return algos.pagerank(fixtures.follows(spark, d), rounds=8, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query("graph_wcc", f"{_F}, reach(id, other) AS (SELECT src, dst FROM follows UNION SELECT dst, src FROM follows UNION SELECT r.id, x.b FROM reach r JOIN (SELECT src AS a, dst AS b FROM follows UNION SELECT dst, src FROM follows) x ON r.other = x.a) SELECT id, min(least(id, other)) AS component FROM reach GROUP BY 1")
def graph_wcc(spark, d):
    return algos.components(fixtures.follows(spark, d))


@query("graph_component_count", f"{_F}, reach(id, other) AS (SELECT src, dst FROM follows UNION SELECT dst, src FROM follows UNION SELECT r.id, x.b FROM reach r JOIN (SELECT src AS a, dst AS b FROM follows UNION SELECT dst, src FROM follows) x ON r.other = x.a) SELECT count(DISTINCT c) AS components FROM (SELECT id, min(least(id, other)) AS c FROM reach GROUP BY 1)")
def graph_component_count(spark, d):
    return algos.component_count(fixtures.follows(spark, d))


_TRI = f"{_F}, {_PAIRS}, {_IDS}, t AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM pairs p JOIN pairs q ON p.b = q.a JOIN pairs r ON r.a = p.a AND r.b = q.b), tri AS (SELECT id, count(t) AS n FROM ids LEFT JOIN (SELECT x AS t FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) ON t = id GROUP BY 1)"


@query("graph_triangles", f"{_TRI} SELECT id, n AS triangles FROM tri")
def graph_triangles(spark, d):
    return algos.triangles(checkpoint(fixtures.follows(spark, d)))


@query("graph_lcc", f"{_TRI}, deg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1) SELECT id, CASE WHEN d > 1 THEN round(2.0 * n / (d * (d - 1)), 9) ELSE 0.0 END AS lcc FROM tri JOIN deg USING (id)")
def graph_lcc(spark, d):
    return algos.clustering(checkpoint(fixtures.follows(spark, d))).select("id", F.round("lcc", 9).alias("lcc"))


def _cdlp_sql(rounds: int) -> str:
    parts = [f"{_F}, {_IDS}, near AS (SELECT src, dst FROM follows UNION ALL SELECT dst, src FROM follows), l0 AS (SELECT id, id AS label FROM ids)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS (SELECT id, label FROM (SELECT src AS id, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM near JOIN l{i} ON l{i}.id = dst GROUP BY src, label) WHERE k = 1)")
    return ", ".join(parts) + f" SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS community FROM l{rounds}"


@query("graph_cdlp", _cdlp_sql(4))
def graph_cdlp(spark, d):
    return algos.cdlp(fixtures.follows(spark, d), rounds=4)


@query("graph_bfs", f"{_F}, links AS (SELECT DISTINCT src, dst FROM follows), walk(id, distance) AS (SELECT min(src), 0 FROM follows UNION SELECT dst, distance + 1 FROM walk JOIN links ON src = id WHERE distance < 8) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY 1")
def graph_bfs(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    return algos.bfs(edges, edges.agg(F.min("src").alias("id"))).select("id", "distance")


@query("graph_sssp", f"{_F}, links AS (SELECT src, dst, min(weight) AS w FROM follows GROUP BY 1, 2), walk(id, distance, hops) AS (SELECT min(src), 0.0::DOUBLE, 0 FROM follows UNION SELECT dst, min(distance + w), hops + 1 FROM walk JOIN links ON src = id WHERE hops < 14 GROUP BY dst, hops) SELECT id, min(distance) AS distance FROM walk GROUP BY 1")
def graph_sssp(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    return algos.sssp(edges, edges.agg(F.min("src")).first()[0])


@query("graph_closeness", f"{_F}, {_IDS}, links AS (SELECT DISTINCT src, dst FROM follows), walk(s, id, distance) AS (SELECT id, id, 0 FROM ids UNION SELECT s, dst, distance + 1 FROM walk JOIN links ON src = id WHERE distance < 5), dist AS (SELECT s, id, min(distance) AS d FROM walk GROUP BY 1, 2 HAVING min(distance) > 0) SELECT s AS id, round(count(*) / ((SELECT count(*) FROM ids) - 1) * count(*) / sum(d), 9) AS closeness FROM dist GROUP BY 1")
def graph_closeness(spark, d):
    return algos.closeness(checkpoint(fixtures.follows(spark, d))).select("id", F.round("closeness", 9).alias("closeness"))


@query("graph_betweenness")
def graph_betweenness(spark, d):
    return algos.betweenness(checkpoint(fixtures.follows(spark, d)))


@query("graph_label_propagation")
def graph_label_propagation(spark, d):
    return algos.label_propagation(checkpoint(fixtures.follows(spark, d)))


@query("graph_louvain")
def graph_louvain(spark, d):
    return algos.louvain(checkpoint(fixtures.follows(spark, d)))


@query("graph_shortest_paths")
def graph_shortest_paths(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    ends = edges.agg(F.min("src"), F.max("dst")).first()
    return algos.shortest_paths(edges, ends[0], ends[1])


@query("graph_k_shortest")
def graph_k_shortest(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    ends = edges.agg(F.min("src"), F.max("dst")).first()
    return algos.k_shortest_paths(edges, ends[0], ends[1], 3)


@query("graph_a_star")
def graph_a_star(spark, d):
    edges = checkpoint(fixtures.follows(spark, d))  # read by several jobs
    ends = edges.agg(F.min("src"), F.max("dst")).first()
    return algos.a_star(edges, ends[0], ends[1])
