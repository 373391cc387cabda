"""Work is spread and bounded: what larger tables brought to light, on small ones."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from polyquarry.functions import geo
from polyquarry.functions import geometry as g
from polyquarry.operators import graph_algos as algos
from polyquarry.operators import relational
from polyquarry.plans import geometries, match, sqltexts
from polyquarry.session import checkpoint

SQUARE = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}'


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """3,000 customers in one file."""
    d = str(tmp_path_factory.mktemp("customers"))
    spark.range(3000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{d}/customer.parquet")
    return d


def test_boxes_are_dealt_over_all_cores(spark, customers):
    """One file with one row group is still work for every core."""
    got = geometries._boxes(spark, customers).select("id").groupBy(F.spark_partition_id()).count().collect()
    assert len(got) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in got) < 2 * 3000 / len(got)


def test_equal_geometries_are_computed_once(spark, monkeypatch):
    monkeypatch.setitem(geo.FUNCTIONS, "st_numpoints", (lambda a: random.getrandbits(30), "int"))
    rows = spark.range(400).coalesce(1).select(F.when(F.col("id") % 2 == 0, F.lit(SQUARE)).alias("a"))
    found = [r.n for r in rows.select(geo.st("st_numpoints", "a").alias("n")).collect()]
    assert found.count(None) == 200 and len(set(found)) == 2


def test_zeros_of_both_signs_stay_apart(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (0.0,)], "x double").coalesce(1)
    made = [json.loads(r.g)["coordinates"][0][0][0] for r in rows.select(geo.st("st_makeenvelope", "x", F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("g")).collect()]
    assert list(map(str, made)) == ["0.0", "-0.0", "0.0"]


def test_overlays_of_random_boxes():
    r, planar = random.Random(3), lambda shape: sum(g.ring_area(ring) for rings in g.polygons(shape) for ring in rings)
    for _ in range(60):
        (a, b, c, d), (p, q, s, t) = ([r.randrange(9), r.randrange(9), r.randrange(1, 5), r.randrange(1, 5)] for _ in range(2))
        one, two = (g.make("Polygon", [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]) for x, y, w, h in ((a, b, c, d), (p, q, s, t)))
        both = max(0, min(a + c, p + s) - max(a, p)) * max(0, min(b + d, q + t) - max(b, q))
        want = {"intersection": both, "union": c * d + s * t - both, "difference": c * d - both, "symdifference": c * d + s * t - 2 * both}
        assert {k: planar(g.overlay(one, two, k)) for k in want} == pytest.approx(want)


def test_all_pairs_in_blocks_agree_with_joins(spark):
    """Searches of the whole graph from blocks of nodes, against layers of joins; parallels, loops, islands, over 64 sources."""
    r = random.Random(9)
    rows = [(f"v{r.randrange(90)}", f"v{r.randrange(90)}") for _ in range(260)] + [("v3", "v4")] * 3 + [("x", "x"), ("y", "z")]
    links, alone = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([("alone",)], "id string")
    for name in ("closeness", "betweenness"):
        one, two = ({x.id: x[name] for x in getattr(algos, name)(links, alone, held=held).collect()} for held in (0, 1 << 20))
        assert one == pytest.approx(two) and max(one.values()) > 0 and len(one) > 70


def test_all_pairs_shuffle_no_pairs(spark):
    """No rows of (source, node) travel: what the searches give is one row a node and block."""
    n = 150
    ring = spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"))
    assert {round(x.closeness * n, 9) for x in algos.closeness(ring).collect()} == {2.0}
    assert {round(x.betweenness, 9) for x in algos.betweenness(ring).collect()} == {0.5}


def test_numbers_of_paths_beyond_doubles(spark):
    """400 layers with ten parallels each: 1e400 paths."""
    chain = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("m")
    got = {x.id: x.betweenness for x in algos.betweenness(chain).collect()}
    assert got == pytest.approx({i: i * (400 - i) / (400 * 399) for i in range(401)})


def test_triangles_by_colours(spark):
    """Against brute force, over several colours, names and a hub; no wedge is shuffled."""
    r = random.Random(4)
    near = {(f"v{a}", f"v{b}") for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(500))} | {("hub", f"v{i}") for i in range(60)}
    pairs = {(min(x), max(x)) for x in near if x[0] != x[1]}
    names = sorted({x for p in pairs for x in p})
    want = {a: sum((b, c) in pairs for i, b in enumerate(names) for c in names[i + 1 :] if tuple(sorted((a, b))) in pairs and tuple(sorted((a, c))) in pairs) for a in names}
    links = spark.createDataFrame(sorted(near), "src string, dst string")
    for most in (1 << 20, 20):
        found = algos._triangles(checkpoint(algos.undirected(links)), algos.vertices_of(links), most)
        assert {x.id: x.triangles for x in found.collect()} == want
    plan = algos.triangles(links)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin [u" not in plan
    assert algos.triangles(links.limit(0)).count() == 0


def test_exact_median(spark):
    r = random.Random(2)
    for n in (0, 1, 2, 7, 1000, 1001):
        values = [round(r.uniform(0, 50), r.choice([0, 1])) for _ in range(n)] + [None]
        got = relational.exact_median(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
        assert [x.median for x in got] == [statistics.median(values[:-1]) if n else None]


def test_sketches_are_not_kept_for_each_key(spark, tmp_path):
    """The plan has no aggregate that holds percentiles beside the distinct keys, and no median in one task."""
    spark.range(500).select((F.col("id") % 40).alias("l_partkey"), F.col("id").cast("double").alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sqltexts.agg_approximate(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and not any("l_partkey" in line and "percentile_approx" in line and "Aggregate [l_partkey" in line for line in plan.splitlines())
    assert [tuple(x) for x in got.collect()] == [(True, True)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rounds_leave_links_where_they_are(spark):
    """A round's join on written links shuffles the front only, not the links."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = spark.range(500).select((F.col("id") % 50).alias("src"), (F.col("id") * 7 % 51).alias("dst"), F.lit(2.0).alias("weight"))
        kept, front = algos._lightest(links, "weight"), spark.range(9)
        assert exchanges(front.join(kept, front["id"] == kept["src"])) == 1
        assert exchanges(front.withColumnRenamed("id", "dst").join(algos._kept_by(links, "dst"), "dst")) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_hubs_fan_out_in_places(spark, monkeypatch):
    """A hub of 40 edges, dealt over places of 7: every pair once, on both sides of a hub, with parallel edges and filters."""
    monkeypatch.setattr(match, "HUB", 7)
    ids = [f"c{i}" for i in range(43)] + ["h", "g"]
    nodes = spark.createDataFrame([(x, x[0], f"/{x}", "{}") for x in ids], "id string, node_type string, path string, properties string")
    links = spark.createDataFrame([(f"c{i}", "h" if i < 40 else "g", "IN", 1.0) for i in range(43)], "src string, dst string, relation_type string, weight double")
    run = lambda t: sorted(tuple(r) for r in match.cypher(match.Graph(nodes, links), t).collect())
    pairs = lambda low, high: [(f"c{i}", f"c{j}") for i in range(low, high) for j in range(low, high) if i != j]
    assert run("MATCH (a)-[:IN]-(n)-[:IN]-(b) WHERE n.id = 'h' RETURN a.id AS a, b.id AS b") == sorted(pairs(0, 40))
    assert run("MATCH (a:c)-[:IN]-(n)-[:IN]-(b) RETURN a.id AS a, b.id AS b") == sorted(pairs(0, 40) + pairs(40, 43))
    # GRAPH_TABLE lets an edge repeat
    both = match.graph_table(match.Graph(nodes, links), "MATCH (a)-[:IN]->(n)<-[:IN]-(b) COLUMNS (n.id AS n, count(*) AS k)")
    assert sorted(tuple(r) for r in both.collect()) == [("g", 9), ("h", 1600)]


def test_components_run_once_for_all_functions(spark, monkeypatch):
    runs, real = [], algos.components
    monkeypatch.setattr(match.graph_algos, "components", lambda *a: runs.append(1) or real(*a))
    nodes = spark.createDataFrame([(x, "N", f"/{x}", "{}") for x in "abcd"], "id string, node_type string, path string, properties string")
    links = spark.createDataFrame([("a", "b", "T", 1.0), ("c", "d", "T", 1.0)], "src string, dst string, relation_type string, weight double")
    got = match.graph_table(match.Graph(nodes, links), "MATCH (x)-[:T]->(y) COLUMNS (x.id AS id, wcc(y) AS part, component_count() AS parts)")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a", 2), ("c", "c", 2)] and len(runs) == 1
