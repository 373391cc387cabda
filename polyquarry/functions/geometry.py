"""Geometry on parsed GeoJSON (lon/lat degrees, metres on a sphere). Plain Python; ``geo`` makes columns of it."""

from __future__ import annotations

import math

RADIUS = 6_371_008.8
EPS = 1e-12


def points(g) -> list:
    """All positions."""
    kind = g["type"]
    if kind == "GeometryCollection":
        return [p for x in g["geometries"] for p in points(x)]
    c = g["coordinates"]
    if kind == "Point":
        return [c] if c else []
    if kind in ("LineString", "MultiPoint"):
        return list(c)
    if kind in ("Polygon", "MultiLineString"):
        return [p for r in c for p in r]
    return [p for poly in c for r in poly for p in r]


def polygons(g) -> list:
    """Rings of each polygon."""
    return [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] if g["type"] == "MultiPolygon" else []


def lines(g) -> list:
    return [g["coordinates"]] if g["type"] == "LineString" else g["coordinates"] if g["type"] == "MultiLineString" else []


def make(kind: str, coordinates) -> dict:
    return {"type": kind, "coordinates": coordinates}


def haversine(a, b) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def same(a, b) -> bool:
    return abs(a[0] - b[0]) <= EPS and abs(a[1] - b[1]) <= EPS


def ring_area(ring) -> float:
    """Signed planar area."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def centroid(g):
    """Area-weighted for polygons, length-weighted for lines, else the mean."""
    if polys := polygons(g):
        sx = sy = sa = 0.0
        for rings in polys:
            for k, ring in enumerate(rings):
                sign = 1 if (ring_area(ring) > 0) == (k == 0) else -1
                for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
                    w = sign * (a[0] * b[1] - b[0] * a[1])
                    sx, sy, sa = sx + (a[0] + b[0]) * w, sy + (a[1] + b[1]) * w, sa + 3 * w
        if abs(sa) > EPS:
            return [sx / sa, sy / sa]
    if parts := lines(g):
        sx = sy = sl = 0.0
        for part in parts:
            for a, b in zip(part, part[1:], strict=False):
                n = math.dist(a[:2], b[:2])
                sx, sy, sl = sx + (a[0] + b[0]) / 2 * n, sy + (a[1] + b[1]) / 2 * n, sl + n
        if sl > EPS:
            return [sx / sl, sy / sl]
    all_ = points(g)
    return [sum(p[0] for p in all_) / len(all_), sum(p[1] for p in all_) / len(all_)] if all_ else None


def distance(g, h) -> float:
    return haversine(centroid(g), centroid(h))


def spherical_area(ring) -> float:
    """Chamberlain and Duquette's polygon area on a sphere."""
    r = ring[:-1] if same(ring[0], ring[-1]) else ring
    n, total = len(r), 0.0
    for i in range(n):
        before, here, after = r[i - 1], r[i], r[(i + 1) % n]
        total += math.radians(after[0] - before[0]) * math.sin(math.radians(here[1]))
    return abs(total) * RADIUS**2 / 2


def area(g) -> float:
    return sum(spherical_area(rings[0]) - sum(map(spherical_area, rings[1:])) for rings in polygons(g))


def _along(path) -> float:
    return sum(haversine(a, b) for a, b in zip(path, path[1:], strict=False))


def length(g) -> float:
    return sum(_along(rings[0]) for rings in polygons(g)) or sum(map(_along, lines(g)))


def perimeter(g) -> float:
    return float(sum(_along(r) for rings in polygons(g) for r in rings))


def azimuth(a, b) -> float:
    p, q, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
    return math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d)) % (2 * math.pi)


# --- predicates


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on_segment(p, a, b) -> bool:
    # the box first: it needs no length and rejects most
    for k in (0, 1):
        low, high = (a[k], b[k]) if a[k] <= b[k] else (b[k], a[k])
        if not low - EPS <= p[k] <= high + EPS:
            return False
    return abs(_side(a, b, p)) <= EPS * max(1.0, math.dist(a[:2], b[:2]))


def edges(rings) -> list:
    return [(a, b) for r in rings for a, b in zip(r, r[1:], strict=False) if not same(a, b)]


def locate(p, rings) -> int:
    """1 inside, 0 on the boundary, -1 outside; holes count."""
    return _locate(p[0], p[1], edges(rings))


def _locate(x: float, y: float, sides) -> int:
    """``locate`` by the edges of the rings."""
    inside = False
    for a, b in sides:
        ay, by = a[1], b[1]
        if (ay if ay < by else by) - EPS <= y <= (by if ay < by else ay) + EPS:
            if on_segment((x, y), a, b):
                return 0
            if (ay > y) != (by > y) and x < (b[0] - a[0]) * (y - ay) / (by - ay) + a[0]:
                inside = not inside
    return 1 if inside else -1


def in_any(p, g) -> int:
    return max((locate(p, rings) for rings in polygons(g)), default=-1)


def crossing(a, b, c, d):
    """Whether two segments cross at a point inner to both."""
    s, t, u, v = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    return s * t < 0 and u * v < 0


def meet(a, b, c, d) -> bool:
    return crossing(a, b, c, d) or on_segment(a, c, d) or on_segment(b, c, d) or on_segment(c, a, b) or on_segment(d, a, b)


def boundary_edges(g) -> list:
    return [e for rings in polygons(g) for e in edges(rings)] or [(a, b) for part in lines(g) for a, b in zip(part, part[1:], strict=False)]


def intersects(g, h) -> bool:
    p, q = boundary_edges(g), boundary_edges(h)
    if any(meet(a, b, c, d) for a, b in p for c, d in q):
        return True
    for one, other, own in ((g, h, q), (h, g, p)):
        for x in points(one)[:1] if boundary_edges(one) else points(one):
            if in_any(x, other) >= 0 or any(on_segment(x, a, b) for a, b in own):
                return True
            if not own and any(same(x, y) for y in points(other)):
                return True
    return False


def _between(g, h) -> list:
    """Points of ``g``'s boundary that stand for its pieces: vertices and middles of the parts that ``h`` cuts."""
    out, other = list(points(g)), boundary_edges(h)
    for a, b in boundary_edges(g):
        cuts = sorted({0.0, 1.0, *(t for c, d in other for t in _cuts(a, b, c, d))})
        out += [[a[0] + (b[0] - a[0]) * (s + t) / 2, a[1] + (b[1] - a[1]) * (s + t) / 2] for s, t in zip(cuts, cuts[1:], strict=False) if t - s > 1e-9]
    return out


def covers(g, h) -> bool:
    """Every point of ``h`` lies in polygon ``g`` or on its boundary."""
    if any(in_any(p, g) < 0 for p in _between(h, g)):
        return False
    # a hole of g inside h would be uncovered
    return not polygons(h) or all(in_any(p, h) <= 0 for rings in polygons(g) for hole in rings[1:] for p in hole)


def contains(g, h) -> bool:
    """Like covers, and not on the boundary alone; points on the boundary are not contained."""
    return covers(g, h) and any(in_any(p, g) > 0 for p in [*_between(h, g), *([centroid(h)] if polygons(h) else [])])


def touches(g, h) -> bool:
    """They meet, but only on boundaries."""
    if not intersects(g, h):
        return False
    if g["type"] == h["type"] == "Point":
        return False
    if g["type"] == "Point":
        return in_any(g["coordinates"], h) == 0
    if h["type"] == "Point":
        return in_any(h["coordinates"], g) == 0
    return not interiors_meet(g, h)


def interiors_meet(g, h) -> bool:
    if any(in_any(p, h) > 0 for p in _between(g, h)) or any(in_any(p, g) > 0 for p in _between(h, g)):
        return True
    return bool(polygons(g) and polygons(h)) and (in_any(interior_point(g), h) > 0 or in_any(interior_point(h), g) > 0)


def interior_point(g):
    """A point inside a polygon."""
    c = centroid(g)
    if in_any(c, g) > 0:
        return c
    for rings in polygons(g):
        ys = sorted({p[1] for p in rings[0]})
        for low, high in zip(ys, ys[1:], strict=False):
            y = (low + high) / 2
            xs = sorted(a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in edges(rings) if (a[1] > y) != (b[1] > y))
            if len(xs) > 1:
                return [(xs[0] + xs[1]) / 2, y]
    return c


def crosses(g, h) -> bool:
    if lines(g) and lines(h):
        return any(crossing(a, b, c, d) for a, b in boundary_edges(g) for c, d in boundary_edges(h))
    if not lines(g) and not lines(h):  # two areas overlap or touch, points lie inside or not
        return False
    line, area_ = (g, h) if lines(g) else (h, g)
    if not polygons(area_):
        return False
    where = {in_any(p, area_) for p in _between(line, area_)}
    return 1 in where and -1 in where


def overlaps(g, h) -> bool:
    if g["type"] == h["type"] == "Point":
        return False
    if lines(g) and lines(h):
        shared = any(any(on_segment(p, c, d) for c, d in boundary_edges(h)) and any(on_segment(q, c, d) for c, d in boundary_edges(h)) for p, q in _pieces(g, h))
        apart = lambda x, y: any(not any(on_segment(p, c, d) for c, d in boundary_edges(y)) for p in _between(x, y))
        return shared and apart(g, h) and apart(h, g)
    return interiors_meet(g, h) and not covers(g, h) and not covers(h, g)


def _pieces(g, h) -> list:
    out = []
    for a, b in boundary_edges(g):
        cuts = sorted({0.0, 1.0, *(t for c, d in boundary_edges(h) for t in _cuts(a, b, c, d))})
        at = [[a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t] for t in cuts]
        out += [(p, q) for p, q in zip(at, at[1:], strict=False) if not same(p, q)]
    return out


def equals(g, h) -> bool:
    """Same type and the same positions in the same order."""
    p, q = points(g), points(h)
    return g["type"] == h["type"] and len(p) == len(q) and all(abs(a[0] - b[0]) < 1e-10 and abs(a[1] - b[1]) < 1e-10 for a, b in zip(p, q, strict=True))


# --- overlays


def _boxes_meet(a, b, c, d) -> bool:
    """Whether the boxes of two segments meet, or nearly."""
    for k in (0, 1):
        (low, high), (first, last) = ((u[k], v[k]) if u[k] <= v[k] else (v[k], u[k]) for u, v in ((a, b), (c, d)))
        if first > high + 1e-9 or low > last + 1e-9:
            return False
    return True


def _cuts(a, b, c, d) -> list[float]:
    """Positions on a-b where c-d meets it."""
    dx, dy, ex, ey = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    cross = dx * ey - dy * ex
    if abs(cross) <= EPS:
        n = dx * dx + dy * dy
        return [t for p in (c, d) if on_segment(p, a, b) and 0 < (t := ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n) < 1]
    t, u = ((c[0] - a[0]) * ey - (c[1] - a[1]) * ex) / cross, ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / cross
    return [t] if -EPS < t < 1 + EPS and -EPS < u < 1 + EPS else []


def _oriented(g) -> list:
    """Polygons with the area to the left of each edge."""
    return [[r if (ring_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)] for rings in polygons(g)]


def overlay(g, h, keep: str) -> dict:
    """union, intersection, difference or symdifference of polygons.

    Both boundaries are cut where they meet. A piece stays if, for the operation, exactly one of its sides belongs to the
    result; pieces are turned so that the result lies to the left, then joined into rings.
    """
    wanted = {"union": lambda x, y: x or y, "intersection": lambda x, y: x and y, "difference": lambda x, y: x and not y, "symdifference": lambda x, y: x != y}[keep]
    own = [e for rings in _oriented(g) for e in edges(rings)]
    others = [e for rings in _oriented(h) for e in edges(rings)]
    parts_g, parts_h = ([edges(rings) for rings in polygons(x)] for x in (g, h))
    within = lambda p, parts: any(_locate(p[0], p[1], sides) > 0 for sides in parts)
    key = lambda p: (round(p[0], 9), round(p[1], 9))
    pieces = {}
    for some, rest in ((own, others), (others, own)):
        for a, b in some:
            cuts = sorted({0.0, 1.0, *(min(1.0, max(0.0, t)) for c, d in rest if _boxes_meet(a, b, c, d) for t in _cuts(a, b, c, d))})
            at = [[a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t] for t in cuts]
            for p, q in zip(at, at[1:], strict=False):
                if key(p) != key(q):
                    pieces[min(key(p), key(q)), max(key(p), key(q))] = (p, q)
    out = []
    for p, q in pieces.values():
        n = math.dist(p, q)
        mx, my, off = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, max(1e-7, n * 1e-6)
        left = [mx - (q[1] - p[1]) / n * off, my + (q[0] - p[0]) / n * off]
        right = [mx + (q[1] - p[1]) / n * off, my - (q[0] - p[0]) / n * off]
        inside_left, inside_right = (wanted(within(s, parts_g), within(s, parts_h)) for s in (left, right))
        if inside_left != inside_right:
            out.append((key(p), key(q)) if inside_left else (key(q), key(p)))
    return _rings_to_geometry(_join(out))


def _join(parts) -> list:
    """Rings of directed pieces; at a fork the sharpest turn to the left keeps rings simple."""
    following = {}
    for a, b in parts:
        following.setdefault(a, []).append(b)
    rings = []
    while following:
        start = next(iter(following))
        ring, here, before = [start], start, None
        while True:
            choices = following[here]
            if before is None or len(choices) == 1:
                there = choices.pop()
            else:
                back = math.atan2(before[1] - here[1], before[0] - here[0])
                there = max(choices, key=lambda c: (math.atan2(c[1] - here[1], c[0] - here[0]) - back) % (2 * math.pi))
                choices.remove(there)
            if not following[here]:
                del following[here]
            ring.append(there)
            before, here = here, there
            if here == start or here not in following:
                break
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append([list(p) for p in ring])
    return rings


def _rings_to_geometry(rings) -> dict:
    outer = [[r] for r in rings if ring_area(r) > EPS]
    for hole in (r for r in rings if ring_area(r) < -EPS):
        home = [o for o in outer if locate(hole[0], o[:1]) >= 0 and all(locate(p, o[:1]) >= 0 for p in hole)]
        if home:
            min(home, key=lambda o: ring_area(o[0])).append(hole)
    if len(outer) == 1:
        return make("Polygon", outer[0])
    return make("MultiPolygon", outer)


def union(g, h) -> dict:
    if g["type"] == h["type"] == "Point":
        return make("MultiPoint", [g["coordinates"], h["coordinates"]])
    return overlay(g, h, "union")


# --- makers and editors


def buffer(g, metres: float) -> dict:
    """A 32-gon around the centroid."""
    x, y = centroid(g)
    ring = [[x + metres * math.cos(t) / (111_320 * math.cos(math.radians(y))), y + metres * math.sin(t) / 110_540] for t in (2 * math.pi * i / 32 for i in range(32))]
    return make("Polygon", [[*ring, ring[0]]])


def envelope(g) -> dict:
    p = points(g)
    x0, x1, y0, y1 = min(q[0] for q in p), max(q[0] for q in p), min(q[1] for q in p), max(q[1] for q in p)
    return make("Polygon", [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]])


def convex_hull(g) -> dict:
    """Andrew's monotone chain."""
    p = sorted({(q[0], q[1]) for q in points(g)})
    if len(p) < 3:
        return make("Point", list(p[0])) if len(p) == 1 else make("LineString", [list(q) for q in p])
    half = []
    for run in (p, p[::-1]):
        chain = []
        for q in run:
            while len(chain) > 1 and _side(chain[-2], chain[-1], q) <= 0:
                chain.pop()
            chain.append(q)
        half += chain[:-1]
    return make("Polygon", [[list(q) for q in [*half, half[0]]]])


def _thin(path, tolerance: float) -> list:
    """Douglas and Peucker's line simplification, without recursion."""
    keep, stack = {0, len(path) - 1}, [(0, len(path) - 1)]
    while stack:
        i, j = stack.pop()
        a, b = path[i], path[j]
        n = math.dist(a[:2], b[:2])
        far, at = max(((abs(_side(a, b, path[k])) / n if n else math.dist(a[:2], path[k][:2]), k) for k in range(i + 1, j)), default=(0, 0))
        if far > tolerance:
            keep.add(at)
            stack += [(i, at), (at, j)]
    return [path[k] for k in sorted(keep)]


def simplify(g, tolerance: float) -> dict:
    if g["type"] == "LineString":
        return make("LineString", _thin(g["coordinates"], tolerance))
    if g["type"] == "Polygon":
        thin = [_thin(r, tolerance) for r in g["coordinates"]]
        return make("Polygon", [t if len(t) > 3 else r for t, r in zip(thin, g["coordinates"], strict=True)])
    return g


def reverse(g) -> dict:
    if g["type"] == "LineString":
        return make("LineString", g["coordinates"][::-1])
    if g["type"] == "Polygon":
        return make("Polygon", [r[::-1] for r in g["coordinates"]])
    return g


def boundary(g) -> dict:
    if g["type"] == "Polygon":
        return make("LineString", g["coordinates"][0]) if len(g["coordinates"]) == 1 else make("MultiLineString", g["coordinates"])
    if g["type"] == "LineString" and not same(g["coordinates"][0], g["coordinates"][-1]):
        return make("MultiPoint", [g["coordinates"][0], g["coordinates"][-1]])
    return {"type": "GeometryCollection", "geometries": []}


def is_valid(g) -> bool:
    """Structure only: pairs of finite numbers, lines of two, closed rings of four."""
    try:
        if g["type"] == "GeometryCollection":
            return all(map(is_valid, g["geometries"]))
        fine = all(len(p) >= 2 and all(isinstance(v, (int, float)) and math.isfinite(v) for v in p[:2]) for p in points(g))
        rings = [r for rings in polygons(g) for r in rings]
        return fine and all(len(r) >= 4 and same(r[0], r[-1]) for r in rings) and all(len(x) >= 2 for x in lines(g))
    except (KeyError, TypeError):
        return False


def is_closed(g) -> bool:
    return all(len(x) > 0 and same(x[0], x[-1]) for x in lines(g))


def point_on(g, fraction: float) -> dict:
    """At a share of a line's planar length."""
    path = g["coordinates"]
    left = fraction * sum(math.dist(a[:2], b[:2]) for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(path, path[1:], strict=False):
        n = math.dist(a[:2], b[:2])
        if left <= n and n:
            return make("Point", [a[0] + (b[0] - a[0]) * left / n, a[1] + (b[1] - a[1]) * left / n])
        left -= n
    return make("Point", path[-1])
