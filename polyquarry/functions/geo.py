"""ST_ functions on GeoJSON text columns.

Points have native forms (``point_*``) that stay in generated code and prune by bounding box; everything else parses GeoJSON
in Arrow-batched pandas UDFs. All give null for null.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyquarry.functions import geometry as g


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- native, for points


def point(lon, lat) -> Column:
    """ST_POINT and ST_MAKEPOINT."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(_c(lon).cast("double"), _c(lat).cast("double")).alias("coordinates")))


def x(geom) -> Column:
    return F.get_json_object(_c(geom), "$.coordinates[0]").try_cast("double")


def y(geom) -> Column:
    return F.get_json_object(_c(geom), "$.coordinates[1]").try_cast("double")


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Metres between two points given as columns of degrees."""
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), 2)
    return F.lit(2 * g.RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_box(lon, lat, at: tuple[float, float], metres: float) -> Column:
    """A box around a literal point that holds all points within ``metres``: comparisons that a scan can use."""
    dlat = math.degrees(metres / g.RADIUS) * 1.000001 + 1e-9
    box = _c(lat).between(at[1] - dlat, at[1] + dlat)
    top = max(abs(at[1] - dlat), abs(at[1] + dlat))
    if top >= 90:
        return box
    s = math.sin(metres / g.RADIUS / 2) / math.cos(math.radians(at[1]))
    ratio = math.sin(min(math.pi / 2, metres / g.RADIUS)) / math.cos(math.radians(at[1]))
    if ratio >= 1 or s >= 1:
        return box
    dlon = math.degrees(math.asin(ratio)) * 1.000001 + 1e-9
    if at[0] - dlon < -180 or at[0] + dlon > 180:
        return box
    return box & _c(lon).between(at[0] - dlon, at[0] + dlon)


def point_dwithin(lon, lat, at: tuple[float, float], metres: float) -> Column:
    """ST_DWITHIN of column points and a literal point."""
    if metres < 0:
        raise ValueError("distance must not be negative")
    return within_box(lon, lat, at, metres) & (haversine(lon, lat, F.lit(at[0]), F.lit(at[1])) <= metres)


def geometry_type(geom) -> Column:
    return F.concat(F.lit("ST_"), F.get_json_object(_c(geom), "$.type"))


def srid(geom) -> Column:
    return F.when(_c(geom).isNotNull(), F.lit(4326))


def is_simple(geom) -> Column:
    """TRUE for every geometry, as documented."""
    return F.when(_c(geom).isNotNull(), F.lit(True))


# --- by name


def _geom(v):
    return json.loads(v) if isinstance(v, str) else v


def _need(shape, *kinds):
    if shape["type"] not in kinds:
        raise ValueError(f"unexpected geometry {shape['type']}")
    return shape


def _from_geojson(text):
    shape = json.loads(text)
    if shape.get("type") not in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"):
        raise ValueError("no GeoJSON geometry")
    return shape


def _make_polygon(line):
    ring = _need(line, "LineString")["coordinates"]
    if len(ring) < 4 or not g.same(ring[0], ring[-1]):
        raise ValueError("a ring needs four positions and the first again at the end")
    return g.make("Polygon", [ring])


def _number(kind: str):
    def count(shape):
        c = shape.get("coordinates")
        if kind == "points":
            return 1 if shape["type"] == "Point" else len(g.points(shape))
        if shape["type"] == "GeometryCollection":
            return len(shape["geometries"])
        return len(c) if shape["type"].startswith("Multi") else 1

    return count


def _nth(line, n):
    path = _need(line, "LineString")["coordinates"]
    return g.make("Point", path[int(n) - 1]) if 1 <= n <= len(path) else None


def _inside(a, b):
    return g.in_any(b["coordinates"], a) > 0 if b["type"] == "Point" else g.contains(a, b)


def _covering(a, b):
    return g.in_any(b["coordinates"], a) >= 0 if b["type"] == "Point" else g.covers(a, b)


def _close(a, b, metres):
    if metres < 0:
        raise ValueError("distance must not be negative")
    return g.distance(a, b) <= metres


#: name -> (function on parsed geometries, result type); "geometry" results are GeoJSON text.
FUNCTIONS = {
    "st_point": (lambda a, b: g.make("Point", [a, b]), "geometry"),
    "st_makepoint": (lambda a, b: g.make("Point", [a, b]), "geometry"),
    "st_geomfromgeojson": (_from_geojson, "geometry"),
    "st_makeline": (lambda a, b: g.make("LineString", [a["coordinates"], b["coordinates"]]), "geometry"),
    "st_makepolygon": (_make_polygon, "geometry"),
    "st_makeenvelope": (lambda x0, y0, x1, y1: g.make("Polygon", [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]), "geometry"),
    "st_collect": (lambda a, b: {"type": "GeometryCollection", "geometries": [a, b]}, "geometry"),
    "st_asgeojson": (lambda a: a, "geometry"),
    "st_distance": (g.distance, "double"),
    "st_dwithin": (_close, "boolean"),
    "st_area": (lambda a: float(g.area(a)), "double"),
    "st_length": (lambda a: float(g.length(a)), "double"),
    "st_perimeter": (g.perimeter, "double"),
    "st_azimuth": (lambda a, b: g.azimuth(a["coordinates"], b["coordinates"]), "double"),
    "st_contains": (lambda a, b: _inside(_need(a, "Polygon", "MultiPolygon"), b), "boolean"),
    "st_within": (lambda a, b: _inside(_need(b, "Polygon", "MultiPolygon"), a), "boolean"),
    "st_intersects": (g.intersects, "boolean"),
    "st_touches": (g.touches, "boolean"),
    "st_crosses": (g.crosses, "boolean"),
    "st_overlaps": (g.overlaps, "boolean"),
    "st_disjoint": (lambda a, b: not g.intersects(a, b), "boolean"),
    "st_equals": (g.equals, "boolean"),
    "st_covers": (lambda a, b: _covering(_need(a, "Polygon", "MultiPolygon"), b), "boolean"),
    "st_coveredby": (lambda a, b: _covering(_need(b, "Polygon", "MultiPolygon"), a), "boolean"),
    "st_x": (lambda a: float(_need(a, "Point")["coordinates"][0]), "double"),
    "st_y": (lambda a: float(_need(a, "Point")["coordinates"][1]), "double"),
    "st_geometrytype": (lambda a: "ST_" + a["type"], "string"),
    "st_numpoints": (_number("points"), "int"),
    "st_numgeometries": (_number("geometries"), "int"),
    "st_srid": (lambda a: 4326, "int"),
    "st_isvalid": (g.is_valid, "boolean"),
    "st_isempty": (lambda a: not g.points(a), "boolean"),
    "st_isclosed": (g.is_closed, "boolean"),
    "st_issimple": (lambda a: True, "boolean"),
    "st_buffer": (g.buffer, "geometry"),
    "st_centroid": (lambda a: g.make("Point", g.centroid(a)), "geometry"),
    "st_envelope": (g.envelope, "geometry"),
    "st_convexhull": (g.convex_hull, "geometry"),
    "st_simplify": (g.simplify, "geometry"),
    "st_reverse": (g.reverse, "geometry"),
    "st_boundary": (g.boundary, "geometry"),
    "st_union": (g.union, "geometry"),
    "st_intersection": (lambda a, b: g.overlay(a, b, "intersection"), "geometry"),
    "st_difference": (lambda a, b: g.overlay(a, b, "difference"), "geometry"),
    "st_symdifference": (lambda a, b: g.overlay(a, b, "symdifference"), "geometry"),
    "st_startpoint": (lambda a: _nth(a, 1), "geometry"),
    "st_endpoint": (lambda a: _nth(a, len(a["coordinates"])), "geometry"),
    "st_pointn": (_nth, "geometry"),
    "st_lineinterpolatepoint": (lambda a, f: g.point_on(_need(a, "LineString"), f), "geometry"),
}


#: Results that a task keeps for arguments that come again.
KEPT = 1 << 14


def udf(name: str):
    """The pandas UDF of an ST_ function: GeoJSON texts and numbers in, GeoJSON text or a scalar out.

    The functions are pure, so what a task has computed for equal arguments is used again; it keeps ``KEPT`` results at most.
    """
    function, kind = FUNCTIONS[name.lower()]
    known, most, missing = {}, KEPT, object

    def over(*columns):
        import pandas as pd

        out = []
        for row in zip(*columns, strict=True):
            if any(v is None or v != v for v in row):
                out.append(None)
                continue
            key = tuple(v or repr(v) for v in row)  # 0.0 and -0.0 are equal, but not as text
            made = known.get(key, missing)
            if made is missing:
                made = function(*(row if name.lower() == "st_geomfromgeojson" else map(_geom, row)))
                if kind == "geometry" and made is not None:
                    made = json.dumps(made, separators=(",", ":"))
                if len(known) >= most:
                    known.clear()
                known[key] = made
            out.append(made)
        return pd.Series(out, dtype="object")

    shape = {1: lambda a: over(a), 2: lambda a, b: over(a, b), 3: lambda a, b, c: over(a, b, c), 4: lambda a, b, c, d: over(a, b, c, d)}
    return lambda *args: F.pandas_udf(shape[len(args)], "string" if kind == "geometry" else kind)(*args)


def st(name: str, *args) -> Column:
    """``st("st_area", "geom")``; numbers may be literals."""
    native = {"st_x": x, "st_y": y, "st_geometrytype": geometry_type, "st_srid": srid, "st_issimple": is_simple, "st_point": point, "st_makepoint": point}
    if name.lower() in native:
        return native[name.lower()](*args)
    return udf(name)(*map(_c, args))
