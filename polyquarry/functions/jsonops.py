"""PostgreSQL's JSON operators and SQL/JSON functions on JSON text columns.

Extraction compiles to ``get_json_object`` and stays in generated code. Containment and edits of whole documents need
a JSON tree and run as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dollar(*keys: str | int) -> str:
    """``$``-path of keys and array positions."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) or k.isdigit() else f"['{k}']" if not k.replace("_", "a").isalnum() else f".{k}" for k in keys)


def get_text(doc, *keys) -> Column:
    """``->>`` and ``#>>``: scalars as text, objects and arrays as JSON text; null if missing or JSON null."""
    return F.get_json_object(_c(doc), dollar(*keys))


def get(doc, *keys) -> Column:
    """``->`` and ``#>``: the value as JSON text (strings keep their quotes)."""
    return F.to_json(F.try_variant_get(F.try_parse_json(_c(doc)), dollar(*keys), "variant"))


def get_typed(doc, kind: str, *keys) -> Column:
    """JSON_GET_INT, _DOUBLE, _BOOL and _TEXT: null where the value has another type."""
    return F.try_variant_get(F.try_parse_json(_c(doc)), dollar(*keys), kind)


def has_key(doc, key: str) -> Column:
    """``?``: a top-level key exists, even if its value is null."""
    return F.array_contains(F.json_object_keys(_c(doc)), key)


def has_any_key(doc, keys: list[str]) -> Column:
    """``?|``"""
    return F.arrays_overlap(F.json_object_keys(_c(doc)), F.array(*map(F.lit, keys)))


def has_all_keys(doc, keys: list[str]) -> Column:
    """``?&``"""
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(_c(doc)))) == 0


def exists(doc, path: str) -> Column:
    """JSON_EXISTS and ``@?``: the path leads somewhere, JSON null included."""
    return F.coalesce(F.expr("true").isNotNull() & F.try_variant_get(F.try_parse_json(_c(doc)), path, "variant").isNotNull(), F.lit(False))


def value(doc, path: str) -> Column:
    """JSON_VALUE: a scalar as text; null for no match; an object or array raises."""
    v = F.try_variant_get(F.try_parse_json(_c(doc)), path, "variant")
    kind = F.schema_of_variant(v)
    bad = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(bad, F.raise_error(F.lit(f"JSON_VALUE: {path} is no scalar"))).otherwise(F.get_json_object(_c(doc), path))


def query(doc, path: str, wrapper: str = "WITHOUT", on_empty: str = "NULL", on_error: str = "NULL") -> Column:
    """JSON_QUERY: an object or array as JSON.

    wrapper: WITHOUT (a scalar is an error), WITH (always an array around it), CONDITIONAL (around scalars only).
    on_empty, on_error: NULL, ERROR, EMPTY ARRAY, EMPTY OBJECT.
    """
    fallback = {"NULL": F.lit(None).cast("string"), "EMPTY ARRAY": F.lit("[]"), "EMPTY OBJECT": F.lit("{}")}
    v = F.try_variant_get(F.try_parse_json(_c(doc)), path, "variant")
    text, kind = F.to_json(v), F.schema_of_variant(v)
    composed = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    around = F.concat(F.lit("["), text, F.lit("]"))
    empty = fallback.get(on_empty, F.raise_error(F.lit("JSON_QUERY: no match")))
    error = fallback.get(on_error, F.raise_error(F.lit("JSON_QUERY: a scalar without a wrapper")))
    found = {"WITH": around, "CONDITIONAL": F.when(composed, text).otherwise(around), "WITHOUT": F.when(composed, text).otherwise(error)}[wrapper]
    return F.when(_c(doc).isNull(), F.lit(None).cast("string")).when(v.isNull(), empty).otherwise(found)


# --- trees


def contains_tree(left, right) -> bool:
    """``left @> right``: objects by key, arrays by element, scalars by equality."""
    if isinstance(left, dict) and isinstance(right, dict):
        return all(k in left and contains_tree(left[k], v) for k, v in right.items())
    if isinstance(left, list) and isinstance(right, list):
        return all(any(contains_tree(x, y) for x in left) for y in right)
    return type(left) is type(right) and left == right or (isinstance(left, (int, float)) and isinstance(right, (int, float)) and not isinstance(left, bool) and not isinstance(right, bool) and left == right)


def set_path(tree, keys: list[str], new, create: bool = True):
    """A copy of ``tree`` with the value at ``keys`` replaced; missing last keys are added if ``create``."""
    if not keys:
        return new
    head, rest = keys[0], keys[1:]
    if isinstance(tree, dict):
        if head in tree:
            return {**tree, head: set_path(tree[head], rest, new, create)}
        return {**tree, head: new} if create and not rest else tree
    if isinstance(tree, list) and head.lstrip("-").isdigit():
        at = int(head)
        if -len(tree) <= at < len(tree):
            at %= len(tree)
            return [*tree[:at], set_path(tree[at], rest, new, create), *tree[at + 1 :]]
        return [*tree, new] if create and not rest else tree
    return tree


def remove_path(tree, keys: list[str]):
    """``#-``: a copy of ``tree`` without what lies at ``keys``."""
    head, rest = keys[0], keys[1:]
    if isinstance(tree, dict) and head in tree:
        return {k: v for k, v in tree.items() if k != head} if not rest else {**tree, head: remove_path(tree[head], rest)}
    if isinstance(tree, list) and head.lstrip("-").isdigit() and -len(tree) <= int(head) < len(tree):
        at = int(head) % len(tree)
        return tree[:at] + tree[at + 1 :] if not rest else [*tree[:at], remove_path(tree[at], rest), *tree[at + 1 :]]
    return tree


def refers_to(tree, target: str) -> bool:
    """Whether a tree holds, at any depth, an object with the workspace and the path of ``workspace:/path``."""
    workspace, _, path = target.partition(":")
    live = [tree]
    while live:
        x = live.pop()
        if isinstance(x, dict):
            if x.get("workspace") == workspace and x.get("path") == path:
                return True
            live.extend(x.values())
        elif isinstance(x, list):
            live.extend(x)
    return False


def _per_row(function, kind: str):
    """A pandas UDF over JSON text; null or broken JSON gives null."""

    def over(*columns):
        import pandas as pd

        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append(None if row[0] is None else function(*row))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype="object")

    if kind == "boolean":
        return F.pandas_udf(lambda s: over(s), "boolean")
    return F.pandas_udf(lambda s: over(s), kind)


def _dump(tree) -> str:
    return json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


def contains(doc, pattern: str) -> Column:
    """``@>`` with a literal pattern. A flat object of strings, booleans or integers compiles to comparisons."""
    wanted = json.loads(pattern)
    if isinstance(wanted, dict) and wanted and all(isinstance(v, str) for v in wanted.values()):
        checks = [F.coalesce((get(doc, k) == F.lit(_dump(v))), F.lit(False)) for k, v in wanted.items()]
        both = checks[0]
        for c in checks[1:]:
            both = both & c
        return F.when(_c(doc).isNotNull(), both)
    return _per_row(lambda d: contains_tree(json.loads(d), wanted), "boolean")(_c(doc))


def jsonb_set(doc, path: list[str], new: str, create: bool = True) -> Column:
    """JSONB_SET with a literal path and JSON value."""
    tree = json.loads(new)
    return _per_row(lambda d: _dump(set_path(json.loads(d), path, tree, create)), "string")(_c(doc))


def remove_key(doc, key: str) -> Column:
    """``-``: without a top-level key (or equal strings of an array)."""

    def run(d):
        tree = json.loads(d)
        if isinstance(tree, list):
            return _dump([x for x in tree if x != key])
        return _dump(remove_path(tree, [key]))

    return _per_row(run, "string")(_c(doc))


def remove_at(doc, path: list[str]) -> Column:
    """``#-``"""
    return _per_row(lambda d: _dump(remove_path(json.loads(d), path)), "string")(_c(doc))


def merge(left, right) -> Column:
    """``||``: objects are merged one level deep, anything else gives the right side; null with x gives x."""

    def over(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(y if x is None else x)
                continue
            p, q = json.loads(x), json.loads(y)
            out.append(_dump({**p, **q}) if isinstance(p, dict) and isinstance(q, dict) else _dump(q))
        return pd.Series(out, dtype="object")

    return F.pandas_udf(over, "string")(_c(left), _c(right))


def matches(doc, path: str, test: str, operand) -> Column:
    """``@@``: a JSONPath comparison ``path test operand`` on a scalar; null where the path leads nowhere."""
    kind = "boolean" if isinstance(operand, bool) else "double" if isinstance(operand, (int, float)) else "string"
    v = F.try_variant_get(F.try_parse_json(_c(doc)), path, kind)
    return {"==": v == F.lit(operand), "!=": v != F.lit(operand), "<": v < F.lit(operand), "<=": v <= F.lit(operand), ">": v > F.lit(operand), ">=": v >= F.lit(operand)}[test]
