"""Path, JSON, full-text, vector, hybrid and geospatial queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyquarry.functions import geo, jsonops, paths, scalars, vectors
from polyquarry.operators import search
from polyquarry.plans import dsl, rel, sqlfront
from polyquarry.plans.registry import registry
from polyquarry.sources import fixtures
from polyquarry.sources.tables import spread, table

QUERIES, ORACLES, query = registry()

# --- paths

_DEPTH = "len(list_filter(string_split(path, '/'), lambda x: x <> ''))"


@query(
    "path_functions",
    f"""WITH {fixtures.NODES_SQL} SELECT id, {_DEPTH} AS depth,
        CASE WHEN {_DEPTH} = 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
        CASE WHEN {_DEPTH} < 2 THEN '' ELSE '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] END AS second FROM nodes""",
)
def path_functions(spark, d):
    n = fixtures.nodes(spark, d)
    return n.select("id", paths.depth("path").cast("long").alias("depth"), paths.parent("path").alias("parent"), paths.ancestor("path", 2).alias("second"))


@query(
    "path_edge_cases",
    """SELECT * FROM (VALUES ('/', 0, '', ''), ('/a', 1, '/', '/a'), ('/a/', 1, '/', '/a'), ('/a/b', 2, '/a', '/a'), ('/ab/x', 2, '/ab', '/ab'), ('', 0, '', '')) v(path, depth, parent, top)""",
)
def path_edge_cases(spark, d):
    v = spark.createDataFrame([(p,) for p in ("/", "/a", "/a/", "/a/b", "/ab/x", "")], "path string")
    return v.select("path", paths.depth("path").alias("depth"), paths.parent("path").alias("parent"), paths.ancestor("path", 1).alias("top"))


@query("scan_prefix", f"WITH {fixtures.NODES_SQL} SELECT id, path FROM nodes WHERE starts_with(path, '/ASIA/')")
def scan_prefix(spark, d):
    n = fixtures.nodes(spark, d)
    return n.where(paths.path_starts_with("path", "/ASIA/")).select("id", "path")


@query("path_children", f"WITH {fixtures.NODES_SQL} SELECT id, name FROM nodes WHERE starts_with(path, '/ASIA/') AND {_DEPTH} = 2")
def path_children(spark, d):
    return fixtures.nodes(spark, d).where(paths.child_of("path", "/ASIA")).select("id", "name")


@query("path_descendants", f"WITH {fixtures.NODES_SQL} SELECT id FROM nodes WHERE starts_with(path, '/EUROPE/') AND {_DEPTH} <= 3")
def path_descendants(spark, d):
    return fixtures.nodes(spark, d).where(paths.descendant_of("path", "/EUROPE", 2)).select("id")


@query("path_order", f"WITH {fixtures.NODES_SQL} SELECT path FROM nodes ORDER BY path LIMIT 40")
def path_order(spark, d):
    return fixtures.nodes(spark, d).select("path").orderBy("path").limit(40)


@query("path_rollup", f"WITH {fixtures.NODES_SQL} SELECT '/' || string_split(path, '/')[2] AS region, count(*) AS n FROM nodes WHERE {_DEPTH} = 3 GROUP BY 1")
def path_rollup(spark, d):
    n = fixtures.nodes(spark, d).where(paths.depth("path") == 3)
    return n.groupBy(paths.ancestor("path", 1).alias("region")).agg(F.count("*").alias("n"))


# --- JSON


@query("json_extract", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, (props -> '$.k')::VARCHAR AS raw, (props ->> '$.missing') IS NULL AS none FROM events")
def json_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", jsonops.get_text("props", "k").cast("long").alias("k"), jsonops.get("props", "k").alias("raw"), jsonops.get_text("props", "missing").isNull().alias("none"))


@query("json_group", "SELECT CAST(props ->> '$.k' AS BIGINT) % 10 AS bucket, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def json_group(spark, d):
    e = table(spark, d, "events").select((jsonops.get_typed("props", "bigint", "k") % 10).alias("bucket"), "value")
    return e.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(
    "json_nested",
    f"""WITH {fixtures.NODES_SQL} SELECT id, CAST(properties ->> '$.at.nation' AS BIGINT) AS nation, properties ->> '$.segment' AS segment, CAST(properties ->> '$.cents' AS BIGINT) / 100.0 AS balance
        FROM nodes WHERE node_type = 'Customer'""",
)
def json_nested(spark, d):
    n = fixtures.nodes(spark, d).where("node_type = 'Customer'")
    return n.select("id", jsonops.get_typed("properties", "bigint", "at", "nation").alias("nation"), jsonops.get_text("properties", "segment").alias("segment"), (jsonops.get_typed("properties", "bigint", "cents") / F.lit(100.0)).alias("balance"))


@query(
    "json_keys",
    f"""WITH {fixtures.NODES_SQL} SELECT id, list_contains(json_keys(properties), 'segment') AS has_segment, list_has_any(json_keys(properties), ['region', 'cents']) AS has_some, list_has_all(json_keys(properties), ['cents', 'at']) AS has_all FROM nodes""",
)
def json_keys(spark, d):
    n = fixtures.nodes(spark, d)
    return n.select("id", jsonops.has_key("properties", "segment").alias("has_segment"), jsonops.has_any_key("properties", ["region", "cents"]).alias("has_some"), jsonops.has_all_keys("properties", ["cents", "at"]).alias("has_all"))


@query("json_contains", f"""WITH {fixtures.NODES_SQL} SELECT id FROM nodes WHERE json_contains(properties, '{{"segment":"BUILDING"}}') OR json_contains(properties, '{{"at":{{"nation":3}}}}')""")
def json_contains(spark, d):
    n = fixtures.nodes(spark, d)
    return n.where(jsonops.contains("properties", '{"segment":"BUILDING"}') | jsonops.contains("properties", '{"at":{"nation":3}}')).select("id")


@query("json_exists", f"WITH {fixtures.NODES_SQL} SELECT id, json_exists(properties, '$.at.nation') AS ex, json_value(properties, '$.cents') AS val, CAST(json_query AS VARCHAR) AS obj FROM (SELECT *, json_extract(properties, '$.at') AS json_query FROM nodes)")
def json_exists(spark, d):
    n = fixtures.nodes(spark, d)
    return n.select("id", jsonops.exists("properties", "$.at.nation").alias("ex"), jsonops.value("properties", "$.cents").alias("val"), jsonops.query("properties", "$.at").alias("obj"))


@query("json_merge", f"""WITH {fixtures.NODES_SQL} SELECT id, '{{"segment":"' || (properties ->> '$.segment') || '","cents":' || (properties ->> '$.cents') || ',"at":2,"flag":1}}' AS merged FROM nodes WHERE node_type = 'Customer'""")
def json_merge(spark, d):
    n = fixtures.nodes(spark, d).where("node_type = 'Customer'")
    return n.select("id", jsonops.merge("properties", F.lit('{"flag":1,"at":2}')).alias("merged"))


@query("json_set_remove", f"""WITH {fixtures.NODES_SQL} SELECT id, '{{"segment":"' || (properties ->> '$.segment') || '","cents":0,"at":{{"nation":' || (properties ->> '$.at.nation') || '}}}}' AS edited,
       '{{"segment":"' || (properties ->> '$.segment') || '","at":{{"nation":' || (properties ->> '$.at.nation') || '}}}}' AS dropped, '{{"segment":"' || (properties ->> '$.segment') || '","cents":' || (properties ->> '$.cents') || ',"at":{{}}}}' AS pruned
       FROM nodes WHERE node_type = 'Customer'""")
def json_set_remove(spark, d):
    n = fixtures.nodes(spark, d).where("node_type = 'Customer'")
    return n.select("id", jsonops.jsonb_set("properties", ["cents"], "0").alias("edited"), jsonops.remove_key("properties", "cents").alias("dropped"), jsonops.remove_at("properties", ["at", "nation"]).alias("pruned"))


@query("json_path_match", "SELECT event_id FROM events WHERE CAST(props ->> '$.k' AS DOUBLE) > 50")
def json_path_match(spark, d):
    return table(spark, d, "events").where(jsonops.matches("props", "$.k", ">", 50)).select("event_id")


@query("json_to_json", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS doc FROM nation""")
def json_to_json(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("doc"))


@query("json_cse_wide", "SELECT event_id, " + ", ".join(f"CAST(props ->> '$.k' AS BIGINT) + {i} AS k{i}" for i in range(20)) + " FROM events")
def json_cse_wide(spark, d):
    """Twenty uses of one extraction, which common-subexpression elimination parses once."""
    k = jsonops.get_text("props", "k").cast("long")
    return table(spark, d, "events").select("event_id", *((k + i).alias(f"k{i}") for i in range(20)))


# --- scalars


@query(
    "cast_rules",
    """SELECT * FROM (VALUES ('12', 12, NULL::BOOLEAN), ('3.9', 3, NULL), ('yes', NULL, true), ('F', NULL, false), ('1', 1, true), ('x', NULL, NULL)) v(t, i, b)""",
)
def cast_rules(spark, d):
    v = spark.createDataFrame([(t,) for t in ("12", "3.9", "yes", "F", "1", "x")], "t string")
    return v.select("t", scalars.to_int("t").cast("int").alias("i"), scalars.to_bool("t").alias("b"))


@query("interval_rules", "SELECT event_id, ts + INTERVAL 36 HOUR AS a, ts - INTERVAL 30 DAY AS b FROM events")
def interval_rules(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", (F.col("ts") + scalars.interval(1.5, "days")).alias("a"), (F.col("ts") - scalars.interval(1, "month")).alias("b"))


@query("round_rules", "SELECT p_partkey, round(p_retailprice / 7, 2) AS r2, round(p_size / 10.0) AS r0 FROM part")
def round_rules(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.round_half_up(F.col("p_retailprice") / 7, 2).alias("r2"), scalars.round_half_up(F.col("p_size") / F.lit(10.0)).alias("r0"))


# --- REL and the search language


@query("rel_filter", f"WITH {fixtures.NODES_SQL} SELECT id FROM nodes WHERE node_type = 'Customer' AND CAST(properties ->> '$.cents' AS DOUBLE) > 500000 AND (properties ->> '$.segment') LIKE 'A%' AND starts_with(path, '/')")
def rel_filter(spark, d):
    text = "node_type == 'Customer' && properties.cents > 500000 && properties.segment.startsWith('A') && path.descendantOf('/')"
    return fixtures.nodes(spark, d).where(rel.compile_rel(text)).select("id")


@query("rel_paths", f"WITH {fixtures.NODES_SQL} SELECT id, {_DEPTH} + 1 AS deeper, upper(name) || '!' AS loud FROM nodes WHERE {_DEPTH} = 2")
def rel_paths(spark, d):
    n = fixtures.nodes(spark, d).where(rel.compile_rel("path.depth() == 2"))
    return n.select("id", (rel.compile_rel("path.depth() + 1")).cast("long").alias("deeper"), rel.compile_rel("name.toUpperCase() + '!'").alias("loud"))


@query("dsl_search", f"WITH {fixtures.NODES_SQL} SELECT id, path FROM nodes WHERE (node_type = 'geo:Nation' OR name LIKE '%99%') AND NOT id = 'n3' ORDER BY path DESC LIMIT 20 OFFSET 5")
def dsl_search(spark, d):
    q = {"and": [{"or": [{"node_type": {"eq": "geo:Nation"}}, {"name": {"like": "99"}}]}, {"not": {"id": {"eq": "n3"}}}], "order_by": {"path": "desc"}, "limit": 20, "offset": 5}
    return dsl.search(fixtures.nodes(spark, d), q).select("id", "path")


# --- SQL front end


def _engine(spark, d):
    engine = sqlfront.Engine(spark)
    engine.register("nodes", fixtures.nodes(spark, d))
    return engine


@query("sql_paths", f"WITH {fixtures.NODES_SQL} SELECT id, {_DEPTH} AS depth, CASE WHEN {_DEPTH} = 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS up FROM nodes WHERE starts_with(path, '/ASIA/') AND {_DEPTH} = 2")
def sql_paths(spark, d):
    return _engine(spark, d).sql("SELECT id, CAST(DEPTH(path) AS BIGINT) AS depth, PARENT(path) AS up FROM nodes WHERE CHILD_OF('/ASIA')")


@query("sql_json", f"WITH {fixtures.NODES_SQL} SELECT id, properties ->> '$.segment' AS segment, CAST(properties ->> '$.at.nation' AS BIGINT) AS nation FROM nodes WHERE list_contains(json_keys(properties), 'segment') AND properties ->> '$.segment' = 'BUILDING'")
def sql_json(spark, d):
    return _engine(spark, d).sql("""SELECT id, properties->>'segment' AS segment, CAST(properties->'at'->>'nation' AS BIGINT) AS nation FROM nodes WHERE properties ? 'segment' AND properties @> '{"segment":"BUILDING"}'""")


@query("sql_distinct_on", f"WITH {fixtures.NODES_SQL} SELECT node_type, id FROM (SELECT node_type, id, row_number() OVER (PARTITION BY node_type ORDER BY node_type, path DESC) AS k FROM nodes) WHERE k = 1")
def sql_distinct_on(spark, d):
    return _engine(spark, d).sql("SELECT DISTINCT ON (node_type) node_type, id FROM nodes ORDER BY node_type, path DESC")


# --- full text


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("text_match", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE list_contains(w, 'the') AND (list_contains(w, 'license') OR len(list_filter(w, lambda x: starts_with(x, 'gener'))) > 0) AND NOT list_contains(w, 'mit')")
def text_match(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", "text")
    return search.fulltext_match(docs, "text", "the & (license | gener:*) & !mit").select("doc_id")


_BM25 = f"""
docs AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
tf AS (SELECT doc_id, len(w) AS n, t, len(list_filter(w, lambda x: x = t)) AS tf FROM docs, (VALUES ('license'), ('general'), ('public')) q(t)),
stats AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM docs),
df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t),
bm AS (SELECT doc_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS rank FROM tf JOIN df USING (t), stats GROUP BY doc_id HAVING max(tf) > 0)"""


@query("text_bm25", f"WITH {_BM25} SELECT doc_id, round(rank, 9) AS rank FROM bm")
def text_bm25(spark, d):
    return search.bm25(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), "doc_id", "text", ["license", "general", "public"]).select("doc_id", F.round("rank", 9).alias("rank"))


@query("text_search", f"WITH {_BM25} SELECT doc_id, round(rank, 9) AS rank FROM bm JOIN docs USING (doc_id) WHERE list_contains(w, 'license') AND list_contains(w, 'general') AND list_contains(w, 'public') ORDER BY bm.rank DESC, doc_id LIMIT 20")
def text_search(spark, d):
    found = search.fulltext_search(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), "doc_id", "text", "license & general & public", 20)
    return found.select("doc_id", F.round("rank", 9).alias("rank"))


@query("text_search_index", ORACLES["text_search"])
def text_search_index(spark, d):
    """The same search on an index; users write ``postings`` and ``text_lengths`` once."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    index, lengths = search.postings(docs, "doc_id", "text"), search.text_lengths(docs, "doc_id", "text")
    return search.index_search(index, lengths, "doc_id", "license & general & public", 20).select("doc_id", F.round("rank", 9).alias("rank"))


@query("text_fuzzy", f"SELECT DISTINCT w AS term FROM (SELECT unnest({_TOKENS}) AS w FROM documents) WHERE damerau_levenshtein(w, 'license') <= 1")
def text_fuzzy(spark, d):
    words = spread(table(spark, d, "documents").select("doc_id", "text", "lang")).select(F.explode(search.tokens("text")).alias("term")).distinct()
    return search.fuzzy_terms(words, "term", "license")


@query("text_wildcard", f"WITH {fixtures.NODES_SQL} SELECT id FROM nodes WHERE regexp_matches(name, '(?is)^nation_1.?$')")
def text_wildcard(spark, d):
    return fixtures.nodes(spark, d).where(search.wildcard("name", "nation_1*") & (F.length("name") <= 9)).select("id")


@query("text_postings", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE lang = 'de') GROUP BY ALL")
def text_postings(spark, d):
    return search.postings(spread(table(spark, d, "documents").select("doc_id", "text", "lang")).where("lang = 'de'"), "doc_id", "text")


@query("text_chunks")
def text_chunks(spark, d):
    return search.chunks(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), "doc_id", "text", 1000, 100)


# --- vectors

_QUERY = [((i * 37) % 19 - 9) / 30 for i in range(64)]
_LIST = "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in _QUERY) + "]"
_EMB = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"

for _metric, _sql in (("l2", f"list_distance(e, {_LIST})"), ("cosine", f"list_cosine_distance(e, {_LIST})"), ("inner_product", f"-list_inner_product(e, {_LIST})"), ("cosine_unit", f"1 - list_inner_product(e, {_LIST})")):

    @query(f"knn_{_metric}", f"SELECT vec_id, round({_sql}, 9) AS distance FROM {_EMB} ORDER BY {_sql}, vec_id LIMIT 10")
    def knn(spark, d, metric=_metric):
        found = search.nearest(table(spark, d, "embeddings"), "embedding", _QUERY, 10, "vec_id", metric)
        return found.select("vec_id", F.round("distance", 9).alias("distance"))


@query("knn_threshold", f"SELECT vec_id, round(list_distance(e, {_LIST}), 9) AS distance FROM {_EMB} WHERE list_distance(e, {_LIST}) < 1.6 ORDER BY list_distance(e, {_LIST}), vec_id LIMIT 50")
def knn_threshold(spark, d):
    return search.nearest(table(spark, d, "embeddings"), "embedding", _QUERY, 50, "vec_id", "l2", 1.6).select("vec_id", F.round("distance", 9).alias("distance"))


@query("knn_documents", f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(1 - list_inner_product(e, {_LIST}), 12), vec_id) AS k, 1 - list_inner_product(e, {_LIST}) AS dist FROM {_EMB}) WHERE k = 1 ORDER BY dist, label LIMIT 5")
def knn_documents(spark, d):
    """The nearest chunk of each of the nearest documents (labels stand for documents)."""
    return search.nearest_documents(table(spark, d, "embeddings"), "embedding", _QUERY, 5, "label", "vec_id").select("label", "vec_id")


@query("vector_hamming", "SELECT a.vec_id, CAST(len(list_filter(list_zip(a.embedding, b.embedding), lambda x: x[1] <> x[2])) AS INTEGER) AS apart FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def vector_hamming(spark, d):
    e = table(spark, d, "embeddings")
    one = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("other")).limit(1))  # one row
    return e.crossJoin(one).select("vec_id", vectors.hamming("embedding", "other").alias("apart"))


@query(
    "hybrid_rrf",
    f"""WITH {_BM25},
    t AS (SELECT doc_id, row_number() OVER (ORDER BY round(rank, 9) DESC, doc_id) AS r FROM (SELECT * FROM bm ORDER BY round(rank, 9) DESC, doc_id LIMIT 50)),
    v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY dist, vec_id) AS r FROM (SELECT vec_id, round(list_distance(e, {_LIST}), 9) AS dist FROM {_EMB} ORDER BY dist, vec_id LIMIT 50))
    SELECT doc_id, round(sum(1.0 / (60 + r)), 12) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY doc_id ORDER BY sum(1.0 / (60 + r)) DESC, doc_id""",
)
def hybrid_rrf(spark, d):
    text = search.bm25(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), "doc_id", "text", ["license", "general", "public"]).select("doc_id", F.round("rank", 9).alias("rank"))
    text = text.orderBy(F.desc("rank"), "doc_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rank"), "doc_id")))  # 50 rows
    near = search.nearest(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "embedding", _QUERY, 50, "doc_id").select("doc_id", F.round("distance", 9).alias("dist"))
    near = near.withColumn("rank", F.row_number().over(Window.orderBy("dist", "doc_id")))
    return search.reciprocal_rank_fusion([text, near], "doc_id").withColumn("score", F.round("score", 12))


# --- geometry

_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(50.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(50.0)) * pow(sin((radians(10.0) - radians(lon)) / 2), 2))))"


@query("geo_distance", f"WITH {fixtures.POINTS_SQL} SELECT id, round({_HAVERSINE}, 3) AS metres FROM points")
def geo_distance(spark, d):
    p = fixtures.points(spark, d)
    return p.select("id", F.round(geo.haversine("lon", "lat", F.lit(10.0), F.lit(50.0)), 3).alias("metres"))


@query("geo_dwithin", f"WITH {fixtures.POINTS_SQL} SELECT id FROM points WHERE {_HAVERSINE} <= 2000000")
def geo_dwithin(spark, d):
    """A bounding box that a scan can use, then the exact distance."""
    return fixtures.points(spark, d).where(geo.point_dwithin("lon", "lat", (10.0, 50.0), 2_000_000)).select("id")


@query("geo_knn", f"WITH {fixtures.POINTS_SQL} SELECT id, round({_HAVERSINE}, 3) AS metres FROM points ORDER BY {_HAVERSINE}, id LIMIT 12")
def geo_knn(spark, d):
    p = fixtures.points(spark, d).withColumn("m", geo.haversine("lon", "lat", F.lit(10.0), F.lit(50.0)))
    return p.orderBy("m", "id").limit(12).select("id", F.round("m", 3).alias("metres"))


@query("geo_points", f"""WITH {fixtures.POINTS_SQL} SELECT id, lon AS x, lat AS y, 'ST_Point' AS kind, 4326 AS srid FROM points""")
def geo_points(spark, d):
    p = fixtures.points(spark, d).withColumn("g", geo.st("st_point", "lon", "lat"))
    return p.select("id", geo.st("st_x", "g").alias("x"), geo.st("st_y", "g").alias("y"), geo.st("st_geometrytype", "g").alias("kind"), geo.st("st_srid", "g").alias("srid"))


@query("geo_contains", f"WITH {fixtures.POINTS_SQL} SELECT id FROM points WHERE lon > -20 AND lon < 40 AND lat > 0 AND lat < 60")
def geo_contains(spark, d):
    """Points in a polygon: its box first, the polygon test for what is left."""
    box = '{"type":"Polygon","coordinates":[[[-20,0],[40,0],[40,60],[-20,60],[-20,0]]]}'
    p = fixtures.points(spark, d).where("lon BETWEEN -20 AND 40 AND lat BETWEEN 0 AND 60").withColumn("g", geo.point("lon", "lat"))
    return p.where(geo.st("st_contains", F.lit(box), "g")).select("id")
