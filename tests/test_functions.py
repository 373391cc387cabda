"""Functions on hand-made rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from polyquarry.functions import geo, jsonops, paths, scalars, vectors
from polyquarry.functions import geometry as g
from polyquarry.plans import dsl, rel


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("path, depth, up, first", [("/", 0, "", ""), ("/a", 1, "/", "/a"), ("/a/", 1, "/", "/a"), ("/a/b/c", 3, "/a/b", "/a"), ("", 0, "", ""), (None, None, None, None)])
def test_paths(spark, path, depth, up, first):
    row = spark.createDataFrame([(path,)], "p string").select(paths.depth("p").alias("d"), paths.parent("p").alias("u"), paths.ancestor("p", 1).alias("a")).first()
    assert (None if path is None else row.d, row.u, row.a) == (depth, up, first)


def test_path_predicates(spark):
    df = spark.createDataFrame([(p,) for p in ("/a", "/a/b", "/a/b/c", "/ab/x")], "path string")
    get = lambda c: sorted(r.path for r in df.where(c).collect())
    assert get(paths.child_of("path", "/a")) == ["/a/b"]
    assert get(paths.child_of("path", "/a", slash_safe=False)) == ["/a/b", "/ab/x"]
    assert get(paths.descendant_of("path", "/a")) == ["/a/b", "/a/b/c"] and get(paths.descendant_of("path", "/a", 1)) == ["/a/b"]


def test_references(spark):
    doc = json.dumps({"tags": [{"workspace": "w", "path": "/t/x.y", "id": "1"}]})
    assert one(spark, paths.references(F.lit(doc), "w:/t/x.y")) is True
    assert one(spark, paths.references(F.lit(doc), "v:/t/x.y")) is False and one(spark, paths.references(F.lit(None).cast("string"), "w:/t")) is False


DOC = '{"a":{"b":[1,{"c":"x"}]},"n":null,"s":"t","k":2.5}'


def test_json_reads(spark):
    d = F.lit(DOC)
    assert one(spark, jsonops.get_text(d, "a", "b", 1, "c")) == "x" and one(spark, jsonops.get(d, "s")) == '"t"'
    assert one(spark, jsonops.has_key(d, "n")) and not one(spark, jsonops.has_key(d, "z"))
    assert one(spark, jsonops.get_typed(d, "double", "k")) == 2.5 and one(spark, jsonops.get_typed(d, "bigint", "s")) is None
    assert one(spark, jsonops.query(d, "$.a.b")) == '[1,{"c":"x"}]' and one(spark, jsonops.query(d, "$.k", "WITH")) == "[2.5]"
    assert one(spark, jsonops.query(d, "$.k")) is None and one(spark, jsonops.query(d, "$.z", on_empty="EMPTY ARRAY")) == "[]"
    with pytest.raises(Exception, match="no scalar"):
        one(spark, jsonops.value(d, "$.a"))


def test_json_trees():
    doc = json.loads(DOC)
    assert jsonops.contains_tree(doc, {"a": {"b": [{"c": "x"}]}}) and not jsonops.contains_tree(doc, {"k": True})
    assert jsonops.set_path(doc, ["a", "b", "0"], 9)["a"]["b"][0] == 9 and jsonops.set_path(doc, ["q"], 1, create=False) == doc
    assert "b" not in jsonops.remove_path(doc, ["a", "b"])["a"]


def test_json_edits(spark):
    d = F.lit(DOC)
    assert json.loads(one(spark, jsonops.jsonb_set(d, ["z"], "[1]")))["z"] == [1]
    assert json.loads(one(spark, jsonops.merge(d, F.lit('{"s":1}'))))["s"] == 1 and one(spark, jsonops.merge(F.lit(None).cast("string"), d)) == DOC
    assert one(spark, jsonops.contains(d, '{"a":{"b":[1]}}')) and one(spark, jsonops.contains(d, '{"s":"t"}'))


def test_scalars(spark):
    assert one(spark, scalars.to_int(F.lit("3.9"))) == 3 and one(spark, scalars.to_int(F.lit("x"))) is None
    assert one(spark, scalars.to_bool(F.lit(" YES "))) is True
    assert str(one(spark, scalars.to_timestamp(F.lit("2024-03-01 04:05:06")))) == "2024-03-01 04:05:06"
    assert one(spark, scalars.interval(1, "year")).total_seconds() == 31_557_600


def test_vectors(spark):
    a, b = vectors.vector([1, 0]), vectors.vector([0.6, 0.8])
    assert one(spark, vectors.l2(a, b)) == pytest.approx(math.sqrt(0.8)) and one(spark, vectors.cosine(a, b)) == pytest.approx(0.4)
    assert one(spark, vectors.inner_product(a, b)) == pytest.approx(-0.6) and one(spark, vectors.hamming(a, b)) == 2


SQUARE, SHIFTED, INNER = (g.make("Polygon", [[[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]]) for x, y, n in ((0, 0, 4), (2, 2, 4), (1, 1, 1)))


def planar(shape):
    return sum(g.ring_area(r) for rings in g.polygons(shape) for r in rings)


def test_overlays():
    for kind, want in (("union", 28), ("intersection", 4), ("difference", 12), ("symdifference", 24)):
        assert planar(g.overlay(SQUARE, SHIFTED, kind)) == pytest.approx(want)
    assert planar(g.overlay(SQUARE, INNER, "difference")) == pytest.approx(15) and g.overlay(SQUARE, SQUARE, "difference")["coordinates"] == []


def test_predicates():
    line, point = g.make("LineString", [[-1, 1], [5, 1]]), g.make("Point", [4, 2])
    beside = g.make("Polygon", [[[4, 0], [5, 0], [5, 4], [4, 4], [4, 0]]])
    assert g.contains(SQUARE, INNER) and not g.contains(SQUARE, SHIFTED) and g.overlaps(SQUARE, SHIFTED)
    assert g.touches(SQUARE, beside) and g.touches(point, SQUARE) and not g.touches(SQUARE, INNER)
    assert g.crosses(line, SQUARE) and g.intersects(line, SQUARE) and not g.intersects(INNER, g.make("Point", [9, 9]))
    assert g.covers(SQUARE, SQUARE) and g.equals(SQUARE, SQUARE) and not g.equals(SQUARE, g.reverse(SQUARE))


def test_measures():
    assert g.haversine([0, 0], [0, 1]) == pytest.approx(111_195, rel=1e-4)
    degree = g.make("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]])
    assert g.area(degree) == pytest.approx(1.2364e10, rel=1e-3) and g.azimuth([0, 0], [1, 0]) == pytest.approx(math.pi / 2)
    assert g.centroid(SQUARE) == pytest.approx([2, 2]) and len(g.buffer(SQUARE, 10)["coordinates"][0]) == 33
    assert g.simplify(g.make("LineString", [[0, 0], [1, 0.01], [2, 0]]), 0.1)["coordinates"] == [[0, 0], [2, 0]]
    assert g.point_on(g.make("LineString", [[0, 0], [4, 0]]), 0.25)["coordinates"] == [1, 0]
    assert len(g.convex_hull(g.make("MultiPoint", [[0, 0], [2, 0], [1, 1], [2, 2], [0, 2]]))["coordinates"][0]) == 5


TWO = "point makepoint makeline collect distance azimuth contains within intersects touches crosses overlaps disjoint equals covers coveredby buffer simplify union intersection difference symdifference pointn lineinterpolatepoint".split()


def test_every_geo_function_gives_null_for_null(spark):
    none = F.lit(None).cast("string")
    arity = {"st_makeenvelope": 4, "st_dwithin": 3} | {f"st_{n}": 2 for n in TWO}
    row = spark.range(1).select(*(geo.udf(n)(*[none] * arity.get(n, 1)).alias(n) for n in geo.FUNCTIONS)).first()
    assert len(geo.FUNCTIONS) == 49 and all(v is None for v in row)


def test_geo_columns(spark):
    square = json.dumps(SQUARE)
    df = spark.createDataFrame([(square,), (None,)], "s string")
    rows = df.select(geo.st("st_area", "s").alias("a"), geo.st("st_centroid", "s").alias("c"), geo.st("st_contains", "s", F.lit('{"type":"Point","coordinates":[1,1]}')).alias("i")).collect()
    assert rows[0].a > 0 and json.loads(rows[0].c)["coordinates"] == pytest.approx([2, 2]) and rows[0].i and rows[1].a is None


@pytest.mark.parametrize(
    "text, want",
    [("1 + 2 * 3 == 7", True), ("!(1 > 2) && 'a' < 'b'", True), ("name.length() == 3", True), ("name.substring(1, 2)", "b"), ("tags[1]", "y"), ("tags.last()", "z"), ("properties.n > 3", True), ("properties.s.toUpperCase()", "HI"), ("path.parent()", "/p"), ("'/p'.ancestorOf(path)", True), ("missing.length()", None), ("name + '!'", "abc!")],
)
def test_rel(spark, text, want):
    df = spark.createDataFrame([("abc", ["x", "y", "z"], '{"n":5,"s":"hi"}', "/p/q", None)], "name string, tags array<string>, properties string, path string, missing string")
    assert df.select(rel.compile_rel(text).alias("x")).first().x == want


def test_rel_errors():
    for text in ("1 +", "a..b", "x.nope()", "(1", "1 2"):
        with pytest.raises(ValueError):
            rel.compile_rel(text)


def test_dsl(spark):
    df = spark.createDataFrame([("1", "a", '{"n":5}'), ("2", "b", "{}"), ("3", None, '{"n":1}')], "id string, name string, properties string")
    get = lambda q: sorted(r.id for r in dsl.search(df, q).collect())
    assert get({"n": {"gte": 2}}) == ["1"] and get({"name": {"exists": False}}) == ["3"] and get({"not": {"name": {"eq": "a"}}}) == ["2", "3"]
    assert get({"or": [{"id": {"in": ["1"]}}, {"name": {"ne": "a"}}]}) == ["1", "2", "3"] and get({}) == ["1", "2", "3"]
