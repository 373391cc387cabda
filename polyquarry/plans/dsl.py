"""The JSON search language for nodes: and, or, not; eq, ne, like, contains, in, exists, gt, lt, gte, lte; order_by, limit, offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of fields and the columns that hold them. Fixed values.
FIELDS = {"id": "id", "name": "name", "path": "path", "node_type": "node_type", "nodeType": "node_type", "parent": "parent_path"}


def _field(name: str, sample) -> Column:
    """A node's own column, or a property read with the type of what it is compared with."""
    if name in FIELDS:
        return F.col(FIELDS[name])
    kind = "boolean" if isinstance(sample, bool) else "double" if isinstance(sample, (int, float)) else "string"
    return F.try_variant_get(F.try_parse_json(F.col("properties")), f"$.{name}", kind)


def _test(name: str, op: str, value) -> Column:
    sample = value[0] if op == "in" and value else value
    x = _field(name, None if op == "exists" else sample)
    if op == "exists":
        return x.isNotNull() if value else x.isNull()
    if op == "in":
        return F.coalesce(x.isin(list(value)), F.lit(False)) if value else F.lit(False)
    made = {
        "eq": lambda: x.eqNullSafe(F.lit(value)),
        "ne": lambda: ~x.eqNullSafe(F.lit(value)),
        "like": lambda: F.contains(F.coalesce(x, F.lit("")), F.lit(value)),
        "contains": lambda: F.contains(x, F.lit(value)),
        "gt": lambda: x > F.lit(value),
        "lt": lambda: x < F.lit(value),
        "gte": lambda: x >= F.lit(value),
        "lte": lambda: x <= F.lit(value),
    }
    if op not in made:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(made[op](), F.lit(False))


def condition(tree: dict) -> Column:
    """A filter; keys of one object are ANDed, an empty one holds for all."""
    out = F.lit(True)
    for key, value in tree.items():
        if key == "and":
            part = F.lit(True)
            for t in value:
                part = part & condition(t)
        elif key == "or":
            part = F.lit(False)
            for t in value:
                part = part | condition(t)
        elif key == "not":
            part = ~condition(value)
        else:
            part = F.lit(True)
            for op, operand in value.items():
                part = part & _test(key, op, operand)
        out = out & part
    return out


def search(nodes: DataFrame, query: dict) -> DataFrame:
    """``query``: the filter, with ``order_by`` {field: asc or desc}, ``limit`` and ``offset`` beside it."""
    rest = {k: v for k, v in query.items() if k not in ("order_by", "limit", "offset")}
    out = nodes.where(condition(rest))
    if query.get("order_by"):
        out = out.orderBy(*(F.col(FIELDS.get(f, f)).desc_nulls_last() if str(d).lower() == "desc" else F.col(FIELDS.get(f, f)).asc_nulls_last() for f, d in query["order_by"].items()))
    if query.get("offset"):
        out = out.offset(query["offset"])
    return out if query.get("limit") is None else out.limit(query["limit"])
