"""A query for each ST_ function, on boxes and lines whose results plain arithmetic gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyquarry.functions.geo import st
from polyquarry.plans.registry import registry
from polyquarry.sources.tables import dealt, table

QUERIES, ORACLES, query = registry()

#: Corners of two boxes for each customer, in whole degrees.
_CORNERS = {"ax0": "c_custkey % 7", "ay0": "c_custkey % 5", "ax1": "c_custkey % 7 + 4", "ay1": "c_custkey % 5 + 4", "bx0": "c_custkey * 3 % 9", "by0": "c_custkey * 5 % 8", "bx1": "c_custkey * 3 % 9 + 1 + c_custkey % 4", "by1": "c_custkey * 5 % 8 + 1 + c_custkey % 3"}
_BOXES = "WITH boxes AS (SELECT c_custkey AS id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _CORNERS.items()) + " FROM customer)"
_MEET = "ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1"
_INNER = "ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1"
_A_HAS_B = "ax0 <= bx0 AND bx1 <= ax1 AND ay0 <= by0 AND by1 <= ay1"
_B_HAS_A = "bx0 <= ax0 AND ax1 <= bx1 AND by0 <= ay0 AND ay1 <= by1"


def _area(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"(6371008.8 * 6371008.8 * radians({x1} - {x0}) * (sin(radians({y1})) - sin(radians({y0}))))"


_A, _B = _area("ax0", "ay0", "ax1", "ay1"), _area("bx0", "by0", "bx1", "by1")
_I = f"(CASE WHEN {_INNER} THEN {_area('greatest(ax0, bx0)', 'greatest(ay0, by0)', 'least(ax1, bx1)', 'least(ay1, by1)')} ELSE 0 END)"


def _boxes(spark, d):
    """id, corners, and the boxes ``a`` and ``b`` as polygons."""
    rows = dealt(table(spark, d, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), *(F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in _CORNERS.items()))
    box = lambda n: st("st_makeenvelope", *(f"{n}{c}" for c in ("x0", "y0", "x1", "y1")))
    return rows.withColumns({"a": box("a"), "b": box("b")})


def _relation(name: str, sql: str) -> None:
    query(f"geo_{name}_boxes", f"{_BOXES} SELECT id, {sql} AS holds FROM boxes")(lambda spark, d: _boxes(spark, d).select("id", st(f"st_{name}", "a", "b").alias("holds")))


for _name, _sql in {
    "intersects": f"({_MEET})",
    "disjoint": f"NOT ({_MEET})",
    "touches": f"({_MEET}) AND NOT ({_INNER})",
    "overlaps": f"({_INNER}) AND NOT ({_A_HAS_B}) AND NOT ({_B_HAS_A})",
    "contains": f"({_A_HAS_B})",
    "within": f"({_B_HAS_A})",
    "covers": f"({_A_HAS_B})",
    "coveredby": f"({_B_HAS_A})",
    "equals": f"({_A_HAS_B}) AND ({_B_HAS_A})",
    "crosses": "false",
}.items():
    _relation(_name, _sql)


@query("geo_crosses_lines", f"{_BOXES} SELECT id, (bx0 < 5.5 AND bx1 > 5.5 AND by1 > 0 AND by0 < 9) AS through, (bx0 < 5.5 AND bx1 > 5.5 AND by1 > 0 AND by0 < 9) OR (bx0 <= 5.5 AND bx1 >= 5.5 AND by1 >= 0 AND by0 <= 9) AS meets FROM boxes")
def geo_crosses_lines(spark, d):
    """A line from (5.5, 0) to (5.5, 9), longer than any box is high."""
    line = st("st_makeline", st("st_makepoint", F.lit(5.5), F.lit(0.0)), st("st_makepoint", F.lit(5.5), F.lit(9.0)))
    rows = _boxes(spark, d).withColumn("line", line)
    return rows.select("id", st("st_crosses", "line", "b").alias("through"), st("st_intersects", "line", "b").alias("meets"))


@query(
    "geo_overlay_areas",
    f"""{_BOXES} SELECT id, round({_I} / 1e6) AS both, round(({_A} + {_B} - {_I}) / 1e6) AS all_, round(({_A} - {_I}) / 1e6) AS first, round(({_A} + {_B} - 2 * {_I}) / 1e6) AS one FROM boxes""",
)
def geo_overlay_areas(spark, d):
    """Square kilometres of ST_INTERSECTION, ST_UNION, ST_DIFFERENCE and ST_SYMDIFFERENCE."""
    area = lambda n: F.round(st("st_area", st(n, "a", "b")) / 1e6)
    return _boxes(spark, d).select("id", area("st_intersection").alias("both"), area("st_union").alias("all_"), area("st_difference").alias("first"), area("st_symdifference").alias("one"))


@query(
    "geo_measures",
    f"""{_BOXES}, sides AS (SELECT *, 2 * 6371008.8 * radians(ay1 - ay0) AS up,
      2 * 6371008.8 * (asin(cos(radians(ay0)) * sin(radians(ax1 - ax0) / 2)) + asin(cos(radians(ay1)) * sin(radians(ax1 - ax0) / 2))) AS along FROM boxes)
    SELECT id, round({_A} / 1e6) AS km2, round((up + along) / 1e3, 3) AS around, round(6371008.8 * radians(ay1 - ay0) / 1e3, 3) AS length, 0.0 AS north FROM sides""",
)
def geo_measures(spark, d):
    """ST_AREA, ST_PERIMETER, ST_LENGTH along a meridian, ST_AZIMUTH to the north."""
    rows = _boxes(spark, d)
    low, high = st("st_makepoint", "ax0", "ay0"), st("st_makepoint", "ax0", "ay1")
    return rows.select(
        "id",
        F.round(st("st_area", "a") / 1e6).alias("km2"),
        F.round(st("st_perimeter", "a") / 1e3, 3).alias("around"),
        F.round(st("st_length", st("st_makeline", low, high)) / 1e3, 3).alias("length"),
        F.round(st("st_azimuth", low, high), 9).alias("north"),
    )


@query(
    "geo_line_parts",
    f"""{_BOXES} SELECT id, 2 AS n, 1 AS parts, ax0 AS first_x, ay0 AS first_y, bx1 AS last_x, by1 AS last_y, bx1 AS second_x, ax0 AS back_x, ax0 = bx1 AND ay0 = by1 AS closed, false AS empty, true AS simple, 'ST_LineString' AS kind FROM boxes""",
)
def geo_line_parts(spark, d):
    line = st("st_makeline", st("st_makepoint", "ax0", "ay0"), st("st_makepoint", "bx1", "by1"))
    rows = _boxes(spark, d).withColumn("line", line)
    at = lambda c, g: st(c, g)
    return rows.select(
        "id",
        st("st_numpoints", "line").alias("n"),
        st("st_numgeometries", "line").alias("parts"),
        at("st_x", st("st_startpoint", "line")).alias("first_x"),
        at("st_y", st("st_startpoint", "line")).alias("first_y"),
        at("st_x", st("st_endpoint", "line")).alias("last_x"),
        at("st_y", st("st_endpoint", "line")).alias("last_y"),
        at("st_x", st("st_pointn", "line", F.lit(2))).alias("second_x"),
        at("st_x", st("st_endpoint", st("st_reverse", "line"))).alias("back_x"),
        st("st_isclosed", "line").alias("closed"),
        st("st_isempty", "line").alias("empty"),
        st("st_issimple", "line").alias("simple"),
        st("st_geometrytype", "line").alias("kind"),
    )


@query(
    "geo_shapes",
    f"""{_BOXES} SELECT id, (bx0 + bx1) / 2 AS centre_x, (by0 + by1) / 2 AS centre_y, 'ST_LineString' AS edge, 5 AS hull_points, true AS valid, 5 AS round_trip, 2 AS parts, least(ax0, bx0) AS low, 5 AS simple FROM boxes""",
)
def geo_shapes(spark, d):
    """Centroid, boundary, hull, validity, GeoJSON both ways, a ring made a polygon, a collection and its envelope, simplification."""
    rows = _boxes(spark, d).withColumn("both", st("st_collect", "a", "b"))
    ring = st("st_makepolygon", st("st_boundary", "b"))
    envelope = F.get_json_object(st("st_envelope", "both"), "$.coordinates[0][0][0]").cast("double")
    return rows.select(
        "id",
        F.round(st("st_x", st("st_centroid", "b")), 9).alias("centre_x"),
        F.round(st("st_y", st("st_centroid", "b")), 9).alias("centre_y"),
        st("st_geometrytype", st("st_boundary", "b")).alias("edge"),
        st("st_numpoints", st("st_convexhull", "b")).alias("hull_points"),
        st("st_isvalid", "b").alias("valid"),
        st("st_numpoints", st("st_geomfromgeojson", st("st_asgeojson", ring))).alias("round_trip"),
        st("st_numgeometries", "both").alias("parts"),
        envelope.alias("low"),
        st("st_numpoints", st("st_simplify", "b", F.lit(0.1))).alias("simple"),
    )


@query(
    "geo_near",
    f"""{_BOXES} SELECT id, round(6371008.8 * radians(ay1 - ay0) / 1e3, 3) AS apart, true AS near, false AS nearer, round(ay0 + 0.25 * (ay1 - ay0), 6) AS quarter, true AS around FROM boxes""",
)
def geo_near(spark, d):
    """ST_DISTANCE and ST_DWITHIN of points on a meridian, ST_LINEINTERPOLATEPOINT, ST_BUFFER around its own point."""
    low, high = st("st_makepoint", "ax0", "ay0"), st("st_makepoint", "ax0", "ay1")
    rows = _boxes(spark, d).withColumns({"low": low, "high": high})
    return rows.select(
        "id",
        F.round(st("st_distance", "low", "high") / 1e3, 3).alias("apart"),
        st("st_dwithin", "low", "high", F.lit(445_000.0)).alias("near"),
        st("st_dwithin", "low", "high", F.lit(444_000.0)).alias("nearer"),
        F.round(st("st_y", st("st_lineinterpolatepoint", st("st_makeline", "low", "high"), F.lit(0.25))), 6).alias("quarter"),
        st("st_contains", st("st_buffer", "low", F.lit(1000.0)), "low").alias("around"),
    )
