"""Data changes as new snapshots: each statement maps a table of nodes to the table after it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.functions import paths


def insert(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT; an id that exists raises when the rows are read."""
    known = nodes.select("id", F.lit(True).alias("_known"))
    fresh = rows.join(known, "id", "left").withColumn("id", F.when(F.col("_known"), F.raise_error(F.concat(F.lit("duplicate id "), F.col("id").cast("string")))).otherwise(F.col("id"))).drop("_known")
    return nodes.unionByName(fresh.select(*rows.columns), allowMissingColumns=True)


def upsert(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """UPSERT: rows of an existing id replace it; missing columns keep their value."""
    given = [c for c in rows.columns if c != "id"]
    new = rows.select("id", F.struct(*given).alias("_new"))
    joined = nodes.join(new, "id", "full")
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in given else F.col(c)
    return joined.select(*(value(c).alias(c) for c in nodes.columns))


def update(nodes: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE: rows for which ``where`` is null stay as they are."""
    hit = F.coalesce(where, F.lit(False))
    return nodes.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in nodes.columns))


def delete(nodes: DataFrame, where: Column) -> DataFrame:
    """DELETE; null conditions keep the row."""
    return nodes.where(~F.coalesce(where, F.lit(False)))


def delete_tree(nodes: DataFrame, path: str) -> DataFrame:
    """A node and all below it."""
    return delete(nodes, (F.col("path") == path) | paths.descendant_of("path", path))


def _moved(path: str, new: str) -> Column:
    return F.concat(F.lit(new), F.substring("path", len(path) + 1, 1 << 30))


def _at_new_path(nodes: DataFrame, moved: Column) -> dict[str, Column]:
    """The path and what the table derives from it: parent_path, parent_name, depth."""
    up = paths.parent(moved)
    derived = {"path": moved, "parent_path": up, "parent_name": F.element_at(F.split(up, "/"), -1), "depth": paths.depth(moved)}
    return {c: v.cast(nodes.schema[c].dataType) for c, v in derived.items() if c in nodes.columns}


def move(nodes: DataFrame, path: str, new_parent: str) -> DataFrame:
    """MOVE: the subtree at ``path`` hangs below ``new_parent``."""
    name = path.rstrip("/").rsplit("/", 1)[1]
    new = f"{new_parent.rstrip('/')}/{name}"
    if new == path or new.startswith(path + "/"):
        raise ValueError("a node can't move below itself")
    return update(nodes, (F.col("path") == path) | paths.descendant_of("path", path), _at_new_path(nodes, _moved(path, new)))


def copy(nodes: DataFrame, path: str, new_parent: str, new_name: str | None = None, tree: bool = True) -> DataFrame:
    """COPY: the subtree (or the node alone) again below ``new_parent``, with ids made from the old ones and the new path."""
    new = f"{new_parent.rstrip('/')}/{new_name or path.rstrip('/').rsplit('/', 1)[1]}"
    chosen = (F.col("path") == path) | paths.descendant_of("path", path) if tree else F.col("path") == path
    copied = nodes.where(chosen).withColumns(_at_new_path(nodes, _moved(path, new))).withColumn("id", F.concat(F.col("id").cast("string"), F.lit("@"), F.col("path")))
    if new_name and "name" in nodes.columns:
        copied = copied.withColumn("name", F.when(F.col("path") == new, F.lit(new_name)).otherwise(F.col("name")))
    return nodes.unionByName(copied)


def reorder(nodes: DataFrame, path: str, anchor: str, after: bool = True, order: str = "order_key") -> DataFrame:
    """ORDER: a sibling gets a key next to ``anchor``'s; keys are doubles and halves fall between neighbours."""
    family = nodes.where(paths.parent("path") == paths.parent(F.lit(anchor)))
    at = family.where(F.col("path") == anchor).select(F.col(order).alias("_at"))
    beyond = family.where(F.col("path") != path).join(F.broadcast(at), F.col(order) > F.col("_at") if after else F.col(order) < F.col("_at"))  # at: one row
    edge = beyond.agg((F.min(order) if after else F.max(order)).alias("_edge"))
    step = 1.0 if after else -1.0
    key = at.crossJoin(edge).select(((F.col("_at") + F.coalesce("_edge", F.col("_at") + 2 * step)) / 2).alias("_key"))
    return nodes.join(F.broadcast(key), F.col("path") == path, "left").withColumn(order, F.coalesce("_key", order)).drop("_key")


def translate(translations: DataFrame, rows: DataFrame) -> DataFrame:
    """TRANSLATE: overlay rows (id, locale, columns); the later ones win."""
    kept = translations.join(rows.select("id", "locale"), ["id", "locale"], "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def relate(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """RELATE: adds edges (src, dst, relation_type, weight); an edge that exists gets the new weight."""
    keys = ["src", "dst", "relation_type"]
    return edges.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def unrelate(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """UNRELATE: ``rows`` with src, dst and perhaps relation_type."""
    keys = [c for c in ("src", "dst", "relation_type") if c in rows.columns]
    return edges.join(rows.select(*keys), keys, "left_anti")


# --- node types


@dataclass
class Property:
    kind: str
    required: bool = False
    default: str | None = None
    allowed: Sequence[str] | None = None


@dataclass
class NodeType:
    """CREATE NODETYPE; ``mixins`` lend their properties."""

    name: str
    properties: dict[str, Property] = field(default_factory=dict)
    mixins: Sequence[NodeType] = ()
    family: str = "NODETYPE"

    def all_properties(self) -> dict[str, Property]:
        out: dict[str, Property] = {}
        for mixin in self.mixins:
            out |= mixin.all_properties()
        return out | self.properties

    def altered(self, add: Mapping[str, Property] = {}, drop: Sequence[str] = ()) -> NodeType:  # noqa: B006
        """ALTER NODETYPE."""
        return NodeType(self.name, {k: v for k, v in (self.properties | dict(add)).items() if k not in drop}, self.mixins, self.family)


#: Property kinds and the JSON types that they accept. Fixed values.
JSON_KINDS = {"String": "STRING", "Number": "BIGINT|DOUBLE|DECIMAL", "Boolean": "BOOLEAN", "Array": "ARRAY", "Object": "OBJECT", "Date": "STRING", "URL": "STRING", "Geometry": "OBJECT", "Reference": "OBJECT"}


def violations(nodes: DataFrame, kind: NodeType, properties: str = "properties") -> DataFrame:
    """``nodes`` of the type with ``problems``: an array of texts, empty where all is well."""
    doc = F.try_parse_json(F.col(properties))
    found = []
    for name, rule in kind.all_properties().items():
        v = F.try_variant_get(doc, f"$.{name}", "variant")
        if rule.required:
            found.append(F.when(v.isNull(), F.lit(f"{name} is missing")))
        if rule.kind in JSON_KINDS:
            found.append(F.when(v.isNotNull() & ~F.schema_of_variant(v).rlike(f"^({JSON_KINDS[rule.kind]})"), F.lit(f"{name} is no {rule.kind}")))
        if rule.allowed is not None:
            found.append(F.when(F.try_variant_get(doc, f"$.{name}", "string").isNotNull() & ~F.try_variant_get(doc, f"$.{name}", "string").isin(list(rule.allowed)), F.lit(f"{name} has a value that is not allowed")))
    problems = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return nodes.where(F.col("node_type") == kind.name).withColumn("problems", problems)
