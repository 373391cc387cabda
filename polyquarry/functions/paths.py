"""Hierarchy functions on slash-separated paths: plain column expressions, so filters on them still reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segments(path) -> Column:
    """Non-empty parts."""
    return F.filter(F.split(_c(path), "/"), lambda x: x != "")


def depth(path) -> Column:
    """Number of segments; the root has none."""
    return F.size(segments(path))


def parent(path, levels: int = 1) -> Column:
    """The path ``levels`` up (0 counts as 1); the root is the parent of top-level paths, and nothing ('') lies above it."""
    s, up = segments(path), max(1, levels)
    rest = F.concat(F.lit("/"), F.array_join(F.slice(s, 1, F.greatest(F.size(s) - up, F.lit(0))), "/"))
    return F.when(_c(path).isNull(), F.lit(None)).when(F.size(s) < up, "").otherwise(rest)


def ancestor(path, at: int) -> Column:
    """The first ``at`` segments as a path; '' if there are fewer or ``at`` is not positive."""
    s = segments(path)
    if at <= 0:
        return F.when(_c(path).isNotNull(), F.lit(""))
    return F.when(_c(path).isNull(), F.lit(None)).when(F.size(s) < at, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(s, 1, at), "/")))


def path_starts_with(path, prefix: str) -> Column:
    """Plain string prefix; pushed to the scan as a prefix filter."""
    return _c(path).startswith(prefix)


def _below(prefix: str) -> str:
    return prefix if prefix.endswith("/") else prefix + "/"


def child_of(path, prefix: str, slash_safe: bool = True) -> Column:
    """Direct children of ``prefix``. Without ``slash_safe`` any path that begins with the letters of ``prefix`` and is one deeper counts."""
    level = len([s for s in prefix.split("/") if s])
    start = _below(prefix) if slash_safe else prefix
    return _c(path).startswith(start) & (depth(path) == level + 1)


def descendant_of(path, prefix: str, most: int | None = None) -> Column:
    """Below ``prefix``, itself excluded; at most ``most`` levels deeper."""
    level = len([s for s in prefix.split("/") if s])
    inside = _c(path).startswith(_below(prefix)) & (depth(path) > level)
    return inside if most is None else inside & (depth(path) <= level + most)


def references(properties, target: str) -> Column:
    """Whether JSON ``properties`` hold, at any depth, an object with the workspace and the path of ``workspace:/path``.

    Only documents that hold the workspace's name at all are parsed.
    """
    import json

    from polyquarry.functions.jsonops import _per_row, refers_to

    named = F.contains(_c(properties), F.lit(target.partition(":")[0]))
    found = _per_row(lambda d: refers_to(json.loads(d), target), "boolean")(F.when(named, _c(properties)))
    return F.coalesce(found, F.lit(False))
