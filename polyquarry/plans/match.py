"""Graph patterns (GRAPH_TABLE's MATCH and Cypher's MATCH, WHERE, RETURN) compiled to joins.

Patterns become left-deep joins of an edge and a node table; nothing is collected. Comma-separated patterns join on shared variables, or
cross if they share none. Any aggregate in the output groups by the plain columns.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.functions.jsonops import dollar
from polyquarry.operators import graph_algos
from polyquarry.plans.expressions import closing, split_top
from polyquarry.plans.sqltext import Operand, Rewriter, find_call, quote
from polyquarry.session import checkpoint

AGGREGATES = re.compile(r"\b(count|sum|avg|min|max|collect|collect_list|array_agg)\s*\(", re.I)
#: Hops of ``*`` without bounds: paths are simple, so they end by themselves.
MOST_HOPS = 1 << 30
#: Edges of one node that meet the rows bound so far in one place; a hub's are dealt over several.
HUB = 4096


@dataclass
class Node:
    name: str
    labels: tuple[str, ...]
    where: str | None


@dataclass
class Edge:
    name: str
    types: tuple[str, ...]
    direction: str  # out, in, any
    hops: tuple[int, int] | None
    where: str | None


def parse_node(text: str, fresh) -> Node:
    """``v:A|B WHERE ...`` or ``v:A {key: value}``"""
    where = None
    if m := re.search(r"\bWHERE\b(.*)$", text, re.I | re.S):
        where, text = m[1].strip(), text[: m.start()]
    if m := re.search(r"\{(.*)\}", text, re.S):
        name = text.split(":")[0].split("{")[0].strip()
        tests = [f"{name or '_'}.{k.strip()} = {v.strip()}" for k, v in (part.split(":", 1) for part in split_top(m[1]))]
        where, text = " AND ".join([*([where] if where else []), *tests]), text[: m.start()]
    name, _, labels = text.strip().partition(":")
    name = name.strip() or fresh()
    return Node(name, tuple(x.strip() for x in re.split(r"[|:]", labels) if x.strip()), where.replace("_.", f"{name}.") if where and where.startswith("_.") else where)


def parse_edge(text: str, direction: str, fresh) -> Edge:
    """``r:T1|T2*1..3 WHERE ...``"""
    where, hops = None, None
    if m := re.search(r"\bWHERE\b(.*)$", text, re.I | re.S):
        where, text = m[1].strip(), text[: m.start()]
    if m := re.search(r"\*\s*(\d+)?\s*(\.\.)?\s*(\d+)?|\{\s*(\d+)\s*(,)?\s*(\d+)?\s*\}", text):
        low, dots, high = (m[1], m[2], m[3]) if m[0].startswith("*") else (m[4], m[5], m[6])
        hops = (int(low or 1), int(high) if high else int(low) if low and not dots else MOST_HOPS)
        text = text[: m.start()]
    name, _, types = text.strip().partition(":")
    return Edge(name.strip() or fresh(), tuple(x.strip().strip("'`") for x in re.split(r"[|:]", types) if x.strip()), direction, hops, where)


def parse_pattern(text: str, fresh) -> tuple[Node, list[tuple[Edge, Node]]]:
    """One chain of nodes and edges."""
    text = text.strip()
    end = closing(text, 0)
    first, rest, steps = parse_node(text[1:end], fresh), text[end + 1 :].strip(), []
    while rest:
        m = re.match(r"(<)?-\s*", rest)
        if not m:
            raise ValueError(f"expected an edge at {rest[:20]!r}")
        rest, inner = rest[m.end() :], ""
        if rest.startswith("["):
            end = closing(rest, 0)
            inner, rest = rest[1:end], rest[end + 1 :].strip()
        n = re.match(r"-?\s*(>)?\s*", rest)
        rest = rest[n.end() :]
        direction = "in" if m[1] and not n[1] else "out" if n[1] and not m[1] else "any"
        end = closing(rest, 0)
        steps.append((parse_edge(inner, direction, fresh), parse_node(rest[1:end], fresh)))
        rest = rest[end + 1 :].strip()
    return first, steps


@dataclass
class Value(Operand):
    """An operand whose kind is known: number, truth, text; or property, a value in JSON whose kind only the data know."""

    kind: str | None = None


ARITHMETIC, COMPARISONS = ("+", "-", "*", "/", "%"), ("=", "<>", "!=", "<", "<=", ">", ">=")


class GraphExpressions(Rewriter):
    """Expressions over variables: a.name, r.weight, CARDINALITY(r), and Cypher's operators, as Spark SQL.

    Properties of nodes compare by what they are compared with: with a number as numbers, with true or false as truths, with text as
    text. Two properties compare as numbers if both are, as text if they are of one other kind; in arithmetic they are numbers. A value of another
    kind gives null, never an error.
    """

    def __init__(self, kinds: dict[str, str], columns: set[str]):
        renamed = {"tolower": "lower", "toupper": "upper", "collect": "collect_list", "size": "size", "substring": "substring"}
        casts = {"tointeger": "BIGINT", "tofloat": "DOUBLE", "tostring": "STRING"}
        own = {
            "cardinality": self._hops,
            "length": self._hops,
            "type": lambda args: Value(f"{args[0].sql}.type", kind="text") if kinds.get(args[0].sql) == "edge" else None,
            "id": lambda args: Value(f"{args[0].sql}.id") if args[0].sql in kinds else None,
            "labels": lambda args: Value(f"array({args[0].sql}.node_type)"),
            "keys": lambda args: Value(f"json_object_keys({args[0].sql}.properties)"),
            "properties": lambda args: Value(f"{args[0].sql}.properties", True),
            **{name: (lambda args, to=to: Value(f"{to}({', '.join(self._text(a) for a in args)})")) for name, to in renamed.items()},
            **{name: (lambda args, to=to: Value(f"TRY_CAST({self._text(args[0])} AS {to})", kind="text" if to == "STRING" else "number")) for name, to in casts.items()},
            **{name: (lambda args, n=name: Value(f"{n}({self._number(args[0])})", kind="number")) for name in ("sum", "avg", "abs", "ceil", "floor", "sqrt", "exp", "ln", "sign")},
        }
        super().__init__((), own)
        self.kinds, self.columns = kinds, columns

    def _hops(self, args):
        return Value(f"{args[0].sql}.hops", kind="number") if self.kinds.get(args[0].sql) == "edge" else Value(f"length({self._text(args[0])})", kind="number")

    # --- kinds

    @staticmethod
    def _text(x: Operand) -> str:
        return x.sql

    @staticmethod
    def _json(x: Operand) -> str:
        return f"try_variant_get(try_parse_json({x.base}), {quote(dollar(*x.keys))}, 'variant')"

    def _number(self, x: Operand) -> str:
        """A property as a number; text that looks like one is none."""
        if getattr(x, "kind", None) != "property":
            return x.sql
        v = self._json(x)
        return f"CASE WHEN schema_of_variant({v}) RLIKE '^(BIGINT|DOUBLE|DECIMAL|FLOAT)' THEN try_variant_get({v}, '$', 'double') END"

    def _truth(self, x: Operand) -> str:
        v = self._json(x)
        return f"CASE WHEN schema_of_variant({v}) = 'BOOLEAN' THEN try_variant_get({v}, '$', 'boolean') END"

    def _atom(self, kind: str, t: str) -> Operand:
        if kind == "number":
            return Value(t, kind="number")
        if kind == "string":
            made = super()._atom(kind, t)
            return Value(made.sql, text=made.text, kind="text")
        if kind == "name":
            parts = [x.strip().strip('`"') for x in t.split(".")]
            if t.lower() in ("true", "false"):
                return Value(t, kind="truth")
            if len(parts) > 1 and parts[0] in self.kinds:
                if self.kinds[parts[0]] == "edge":
                    return Value(f"{parts[0]}.`{parts[1]}`", kind="number" if parts[1] in ("weight", "hops") else None)
                if parts[1] in self.columns and len(parts) == 2:
                    return Value(f"{parts[0]}.`{parts[1]}`", parts[1] == "properties")
                base = f"{parts[0]}.properties"
                return Value(f"get_json_object({base}, {quote(dollar(*parts[1:]))})", base=base, keys=tuple(parts[1:]), kind="property")
        return super()._atom(kind, t)

    def _call(self, name: str, inner) -> Operand | None:
        low = name.lower()
        if low in ("count", "collect", "collect_list", "array_agg") and inner and inner[-1][0] == "name" and inner[-1][1] in self.kinds:
            field = ".id" if self.kinds[inner[-1][1]] == "node" else ""
            shown = f"{'DISTINCT ' if len(inner) > 1 else ''}{inner[-1][1]}{field}"
            return Value(f"{low if low == 'count' else 'collect_list'}({shown})", kind="number" if low == "count" else None)
        if inner and inner[0][1].lower() == "distinct":
            return None
        return super()._call(name, inner)

    # --- operators

    def _run(self, found) -> str:
        """OR binds least, then XOR, then AND."""
        for word in ("or", "xor"):
            parts = self._split(found, word)
            if len(parts) > 1 and any(k == "name" and t.lower() == "xor" for k, t in found):
                made = [self._run(p) for p in parts]
                if word == "or":
                    return " OR ".join(f"({m})" for m in made)
                out = made[0]
                for m in made[1:]:
                    out = f"(({out}) <> ({m}))"
                return out
        return super()._run(found)

    def _one(self, found) -> Operand:
        if any(k == "name" and t.lower() == "xor" for k, t in found):
            return Value(self._run(found), kind="truth")
        return super()._one(found)

    @staticmethod
    def _split(found, word: str) -> list:
        parts, depth = [[]], 0
        for kind, t in found:
            depth += (kind == "op") * ((t in "([{") - (t in ")]}"))
            if not depth and kind == "name" and t.lower() == word:
                parts.append([])
            else:
                parts[-1].append((kind, t))
        return parts

    def _pieces(self, found) -> list:
        joined, at = [], 0
        while at < len(found):  # operators of two words, and those written as words
            kind, t = found[at]
            low = t.lower() if kind == "name" else ""
            if low in ("starts", "ends") and at + 1 < len(found) and found[at + 1][1].lower() == "with":
                joined.append(("op", f"{low} with"))
                at += 2
            elif kind == "op" and t == "=" and found[at + 1 : at + 2] == [("op", "~")]:
                joined.append(("op", "=~"))
                at += 2
            elif low in ("contains", "between", "in") and found[at + 1 : at + 2] != [("op", "(")] or low == "in":
                joined.append(("op", low))
                at += 1
            else:
                joined.append((kind, t))
                at += 1
        return super()._pieces(joined)

    def _operator(self, left: Operand, op: str, found, at: int) -> tuple[Operand, int] | None:
        is_property = getattr(left, "kind", None) == "property"
        if op in ("starts with", "ends with", "contains", "=~"):
            right, end = self._primary(found, at)
            call = {"starts with": "startswith", "ends with": "endswith", "contains": "contains"}.get(op)
            return Value(f"{call}({left.sql}, {right.sql})" if call else f"({left.sql} RLIKE concat('^(?:', {right.sql}, ')$'))", kind="truth"), end
        if op == "in":
            end = self._group(found, at)
            values = self._arguments(found[at + 1 : end - 1])
            numbers = bool(values) and all(getattr(v, "kind", None) == "number" for v in values)
            if not values:
                return Value("false", kind="truth"), end
            return Value(f"{self._number(left) if numbers else left.sql} IN ({', '.join(v.sql for v in values)})", kind="truth"), end
        if op == "between":
            low, end = self._primary(found, at)
            high, end = self._primary(found, end + 1)  # behind AND
            numbers = getattr(low, "kind", None) == getattr(high, "kind", None) == "number"
            a, b, c = (self._number(x) if numbers else x.sql for x in (left, low, high))
            return Value(f"{a} BETWEEN {b} AND {c}", kind="truth"), end
        if op == "^":
            right, end = self._primary(found, at)
            return Value(f"pow({self._number(left)}, {self._number(right)})", kind="number"), end
        if op in ARITHMETIC or op in COMPARISONS:
            if op in ARITHMETIC and (left.text is not None or found[at][0] == "string"):
                right, end = self._primary(found, at)
                return (Value(f"concat({left.sql}, {right.sql})", kind="text"), end) if op == "+" else None
            right, end = self._primary(found, at)
            further = end < len(found) and found[end][1] in (*ARITHMETIC, "^")
            if op in ARITHMETIC:
                return Value(f"{self._number(left)} {op} {self._number(right)}", kind="number"), end
            while end < len(found) and found[end][1] in (*ARITHMETIC, "^") and (more := self._operator(right, found[end][1], found, end + 1)):
                right, end = more
            sign, other = "<>" if op == "!=" else op, getattr(right, "kind", None)
            mine = getattr(left, "kind", None)
            if is_property and other == "property" and not further:
                a, b = self._number(left), self._number(right)
                test = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} {sign} {b} WHEN schema_of_variant({self._json(left)}) = schema_of_variant({self._json(right)}) THEN {left.sql} {sign} {right.sql} END"
            elif "number" in (mine, other):
                test = f"{self._number(left)} {sign} {self._number(right)}"
            elif "truth" in (mine, other):
                test = f"{self._truth(left) if is_property else left.sql} {sign} {self._truth(right) if other == 'property' else right.sql}"
            else:
                test = f"{left.sql} {sign} {right.sql}"
            return Value(f"({test})", kind="truth"), end
        return super()._operator(left, op, found, at)


class Graph:
    """``nodes``: id, node_type, properties (JSON) and more; ``edges``: src, dst, relation_type, weight."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    # --- tables of one element

    def _node_table(self, node: Node) -> DataFrame:
        """``name`` as a struct of the node's columns, filtered by label (any case, also after a colon) and its WHERE."""
        rows = self.nodes
        if node.labels:
            low = F.lower("node_type")
            test = F.lit(False)
            for label in node.labels:
                test = test | (low == label.lower()) | low.endswith(":" + label.lower())
            rows = rows.where(test)
        out = rows.select(F.struct(*rows.columns).alias(node.name))
        return out.where(F.expr(self.expression(node.where, {node.name: "node"}))) if node.where else out

    def _edge_table(self, edge: Edge) -> DataFrame:
        """_from, _to and ``name``: a struct of type, weight and hops (and the path of a variable-length edge)."""
        rows = self.edges.where(F.col("relation_type").isin(list(edge.types))) if edge.types else self.edges
        own = F.struct("src", "dst", "relation_type").alias("edge")
        flat = rows.select("src", "dst", "relation_type", F.col("weight").cast("double").alias("weight"), own)
        turned = flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation_type", "weight", "edge")
        steps = {"out": flat, "in": turned, "any": flat.unionByName(turned)}[edge.direction]
        if edge.hops is None:
            kept = steps.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.struct(F.col("relation_type").alias("type"), "weight", F.lit(1).alias("hops"), F.array("src", "dst").alias("path"), "edge").alias(edge.name))
        else:
            kept = self._paths(steps, *edge.hops).select("_from", "_to", F.struct("type", "weight", (F.size("path") - 1).alias("hops"), "path").alias(edge.name))
        return kept.where(F.expr(self.expression(edge.where, {edge.name: "edge"}))) if edge.where else kept

    @staticmethod
    def _paths(steps: DataFrame, low: int, high: int) -> DataFrame:
        """Simple paths of ``low`` to ``high`` hops: a self-join for each hop, no cap on their number."""
        steps = checkpoint(steps.where("src <> dst"))
        live = steps.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.array("src", "dst").alias("path"), F.col("relation_type").alias("type"), "weight")
        out = live if low <= 1 <= high else None
        for hop in range(2, high + 1):
            longer = live.join(steps.select("src", "dst", F.col("weight").alias("_w")), F.col("_to") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            live = longer.select("_from", F.col("dst").alias("_to"), F.concat("path", F.array("dst")).alias("path"), "type", (F.col("weight") + F.col("_w")).alias("weight"))
            live = checkpoint(live)
            if hop >= low:
                out = live if out is None else out.unionByName(live)
            if live.isEmpty():
                break
        if out is None:
            out = live.limit(0)
        if low == 0:
            zero = steps.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
            out = out.unionByName(zero.select(F.col("n").alias("_from"), F.col("n").alias("_to"), F.array("n").alias("path"), F.lit(None).cast("string").alias("type"), F.lit(0.0).alias("weight")))
        return out

    # --- matching

    def bind(self, patterns: str, kinds: dict[str, str] | None = None, bound: DataFrame | None = None, distinct_edges: bool = False, optional: str | None = None) -> DataFrame:
        """Bindings of all variables of comma-separated patterns; ``kinds`` learns which are nodes and which edges.

        ``bound`` holds what is bound already; patterns join on variables that they share with it. ``distinct_edges``: no two single
        hops of these patterns are one edge, as Cypher has it; GRAPH_TABLE lets edges repeat. ``optional`` (a condition, or
        empty): rows of ``bound`` without a match stay, with nulls.
        """
        kinds = {} if kinds is None else kinds
        count = iter(range(10_000))
        taken = set() if bound is None else set(bound.columns)
        fresh = lambda: next(n for n in (f"_anon{next(count)}" for _ in range(10_000)) if n not in taken)
        if optional is not None:
            found = self.bind(patterns, kinds, None, distinct_edges)
            known = [c for c in found.columns if c in taken]
            renamed = found.withColumnsRenamed({c: f"_other_{c}" for c in known})
            same = F.lit(True)
            for c in known:
                same = same & self._same(bound, renamed, c, kinds)
            both = bound.join(renamed, same & F.expr(self.expression(optional, kinds)) if optional else same, "left")
            return both.drop(*(f"_other_{c}" for c in known))
        hops = []
        for text in split_top(patterns):
            first, steps = parse_pattern(text, fresh)
            hops += [e for e, _ in steps if e.hops is None]
            part = self._chain(first, steps, kinds)
            if bound is None:
                bound = part
                continue
            shared = [c for c in part.columns if c in bound.columns]
            if not shared:
                bound = bound.crossJoin(part)  # patterns that share nothing: every pair is asked for
                continue
            renamed = part.withColumnsRenamed({c: f"_other_{c}" for c in shared})
            same = F.lit(True)
            for c in shared:
                same = same & self._same(bound, renamed, c, kinds)
            bound = bound.join(renamed, same).drop(*(f"_other_{c}" for c in shared))
        if distinct_edges:
            for i, a in enumerate(hops):
                for b in hops[:i]:
                    if a.name != b.name and (not a.types or not b.types or set(a.types) & set(b.types)):
                        bound = bound.where(F.col(a.name)["edge"] != F.col(b.name)["edge"])
        return bound

    @staticmethod
    def _same(bound: DataFrame, renamed: DataFrame, c: str, kinds: dict[str, str]):
        field = {"node": "id", "edge": "edge"}.get(kinds.get(c, ""))
        return bound[c][field] == renamed[f"_other_{c}"][field] if field else bound[c] == renamed[f"_other_{c}"]

    def _chain(self, first: Node, steps, kinds) -> DataFrame:
        kinds[first.name] = "node"
        rows = self._node_table(first)
        if not steps:
            # a single node: only such as have an edge
            ends = self.edges.select(F.col("src").alias("_end")).union(self.edges.select("dst")).distinct()
            return rows.join(ends, F.col(first.name)["id"] == F.col("_end"), "left_semi")
        here = first.name
        for number, (edge, node) in enumerate(steps):
            kinds[edge.name] = "edge"
            links = self._edge_table(edge)
            if number and node.name not in rows.columns:
                kinds[node.name] = "node"
                rows, here = self._fan_out(rows, here, links, node), node.name
                continue
            rows = rows.join(links, F.col(here)["id"] == F.col("_from"))
            if node.name in rows.columns:
                rows = rows.where(F.col(node.name)["id"] == F.col("_to"))
            else:
                kinds[node.name] = "node"
                rows = rows.join(self._node_table(node), F.col("_to") == F.col(node.name)["id"])
            rows = rows.drop("_from", "_to")
            here = node.name
        return rows

    def _fan_out(self, rows: DataFrame, here: str, links: DataFrame, node: Node) -> DataFrame:
        """``rows`` with a further edge and node. At a hub each row meets all edges, pairs that may be many more than either.

        So the edges get their nodes before, not the pairs after; and a hub's edges are dealt over places of about ``HUB``, where copies of its
        rows meet them. One row is broadcast for ``HUB`` edges at most.
        """
        hubs = links.groupBy("_from").agg(F.ceil(F.count("*") / F.lit(HUB)).cast("int").alias("_of")).where("_of > 1")
        ends = links.join(self._node_table(node), F.col("_to") == F.col(node.name)["id"])
        dealt = ends.join(F.broadcast(hubs), "_from", "left").withColumn("_place", F.pmod(F.xxhash64("_to"), F.coalesce("_of", F.lit(1))).cast("int")).drop("_of", "_to")
        held = rows.join(F.broadcast(hubs.withColumnRenamed("_from", "_hub")), F.col(here)["id"] == F.col("_hub"), "left")
        held = held.withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_of", F.lit(1)) - 1))).drop("_of", "_hub")
        return held.join(dealt, (F.col(here)["id"] == F.col("_from")) & (F.col("_at") == F.col("_place"))).drop("_from", "_at", "_place")

    # --- expressions

    def expression(self, text: str, kinds: dict[str, str]) -> str:
        """Spark SQL for an expression over variables (see ``GraphExpressions``)."""
        return GraphExpressions(kinds, set(self.nodes.columns)).rewrite(text)

    def carry(self, rows: DataFrame, columns: str, kinds: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
        """WITH: only what is named goes on; variables stay variables, aggregates group by the rest."""
        if columns.strip() == "*":
            return rows, kinds
        plain, folded, kept, order = [], [], {}, []
        distinct = re.match(r"DISTINCT\b", columns, re.I)
        for text in split_top(columns[distinct.end() :] if distinct else columns):
            parts = split_top(text, "as")
            name = parts[1].strip("`") if len(parts) > 1 else parts[0]
            order.append(name)
            if parts[0] in kinds:
                kept[name] = kinds[parts[0]]
                plain.append(F.col(parts[0]).alias(name))
            else:
                (folded if AGGREGATES.search(parts[0]) else plain).append(F.expr(self.expression(parts[0], kinds)).alias(name))
        if folded:
            out = rows.groupBy(*plain).agg(*folded) if plain else rows.agg(*folded)
        else:
            out = rows.select(*plain).distinct() if distinct else rows.select(*plain)
        return out.select(*order), kept

    def _graph_functions(self, rows: DataFrame, text: str) -> tuple[DataFrame, str]:
        """Calls of graph algorithms become columns: an algorithm runs once over the whole graph and is joined to its variable's ids.

        Edges are written once for all of them; one that counts another's groups shares its result.
        """
        number, made, found, edges = 0, {}, {}, None
        while call := find_call(text, ALGORITHMS):
            name, start, begin, end = call
            args = [a.strip() for a in split_top(text[begin:end]) if a.strip()]
            function, column, *of = ALGORITHMS[name]
            if (name, *args) not in made:
                column_name, number = f"_graph{number}_{name.lower()}", number + 1
                edges = checkpoint(self.edges.select("src", "dst", "weight")) if edges is None else edges
                base = of[0] if of else function
                if (base, *args[1:]) not in found:
                    found[base, *args[1:]] = base(edges, *map(json.loads, args[1:]))
                values = function(found[base, *args[1:]]) if of else found[base, *args[1:]]
                if column is None:  # one number for the graph
                    rows = rows.withColumn(column_name, F.lit(values))
                else:
                    of = values.select(F.col("id").alias("_of"), F.col(column).alias(column_name))
                    rows = rows.join(of, F.col(args[0])["id"] == F.col("_of"), "left").drop("_of")
                made[name, *args] = column_name
            text = text[:start] + made[name, *args] + text[end + 1 :]
        return rows, text

    def project(self, rows: DataFrame, columns: str, kinds: dict[str, str], distinct: bool = False) -> DataFrame:
        """``expression [AS name], ...``; aggregates group by the rest; ``*`` gives the ids of named nodes and types of named edges."""
        plain, folded, order = [], [], []
        rows, columns = self._graph_functions(rows, columns)
        for i, text in enumerate(split_top(columns)):
            if text == "*":
                for name, kind in kinds.items():
                    if not name.startswith("_anon"):
                        plain.append(F.expr(f"{name}.{'id' if kind == 'node' else 'type'}").alias(name))
                        order.append(name)
                continue
            parts = split_top(text, "as")
            source = parts[0]
            name = parts[1].strip("`\"") if len(parts) > 1 else source.replace(".", "_") if re.fullmatch(r"[\w.]+", source) else f"col{i}"
            if source in kinds:
                source = f"{source}.{'id' if kinds[source] == 'node' else 'type'}"
            name = re.sub(r"^_graph\d+_", "", name)
            made = F.expr(self.expression(source, kinds)).alias(name)
            (folded if AGGREGATES.search(source) else plain).append(made)
            order.append(name)
        if folded:
            out = rows.groupBy(*plain).agg(*folded) if plain else rows.agg(*folded)
            return out.select(*order)
        out = rows.select(*plain).select(*order)
        return out.distinct() if distinct else out


def _distinct_communities(edges: DataFrame) -> int:
    return graph_algos.louvain(edges).select("community").distinct().count()


def _components(edges: DataFrame) -> DataFrame:
    return graph_algos.components(edges)


def _degrees(edges: DataFrame) -> DataFrame:
    return graph_algos.degrees(edges)


def _one_sided(column: str):
    return _degrees, column


#: Names of graph functions in COLUMNS and RETURN -> what computes them, its column (None: one number), and whose result it takes instead of the edges.
ALGORITHMS = {
    **dict.fromkeys(("PAGERANK", "PAGE_RANK"), (lambda e, damping=0.85, rounds=100: graph_algos.pagerank(e, damping=damping, rounds=int(rounds)), "rank")),
    **dict.fromkeys(("WCC", "CONNECTED_COMPONENT", "COMPONENT_ID", "COMPONENTID"), (_components, "component")),
    **dict.fromkeys(("CDLP", "COMMUNITY_DETECTION"), (lambda e, rounds=10: graph_algos.cdlp(e, rounds=int(rounds)), "community")),
    **dict.fromkeys(("LOUVAIN", "COMMUNITY_ID", "COMMUNITYID"), (lambda e: graph_algos.louvain(e), "community")),
    **dict.fromkeys(("LCC", "LOCAL_CLUSTERING_COEFFICIENT", "CLUSTERING_COEFFICIENT"), (lambda e: graph_algos.clustering(e), "lcc")),
    **dict.fromkeys(("TRIANGLE_COUNT", "TRIANGLECOUNT"), (lambda e: graph_algos.triangles(e), "triangles")),
    **dict.fromkeys(("BETWEENNESS", "BETWEENNESS_CENTRALITY"), (lambda e: graph_algos.betweenness(e), "betweenness")),
    **dict.fromkeys(("CLOSENESS", "CLOSENESS_CENTRALITY"), (lambda e: graph_algos.closeness(e), "closeness")),
    "DEGREE": _one_sided("degree"),
    "IN_DEGREE": _one_sided("in_degree"),
    "OUT_DEGREE": _one_sided("out_degree"),
    **dict.fromkeys(("COMPONENT_COUNT", "COMPONENTCOUNT"), (lambda found: found.agg(F.countDistinct("component")).first()[0], None, _components)),
    **dict.fromkeys(("COMMUNITY_COUNT", "COMMUNITYCOUNT"), (_distinct_communities, None)),
    **dict.fromkeys(("BFS", "BREADTH_FIRST_SEARCH"), (lambda e, start: graph_algos.bfs(e, e.sparkSession.createDataFrame([(start,)], ["id"])), "distance")),
    **dict.fromkeys(("SSSP", "SHORTEST_PATH_DISTANCE"), (lambda e, start: graph_algos.sssp(e, start), "distance")),
}


def graph_table(graph: Graph, text: str) -> DataFrame:
    """``MATCH patterns [WHERE condition] COLUMNS (...)``, with or without GRAPH_TABLE( name ... ) around it."""
    if m := re.match(r"\s*GRAPH_TABLE\s*\(", text, re.I):
        text = text[m.end() : closing(text, m.end() - 1)]
    m = re.search(r"\bMATCH\b", text, re.I)
    body = text[m.end() :]
    c = re.search(r"\bCOLUMNS\s*\(", body, re.I)
    columns = body[c.end() : closing(body, c.end() - 1)]
    body = body[: c.start()]
    parts = split_top(body, "where")
    kinds: dict[str, str] = {}
    rows = graph.bind(parts[0], kinds)
    if len(parts) > 1:
        rows = rows.where(F.expr(graph.expression(parts[1], kinds)))
    return graph.project(rows, columns, kinds)


def cypher(graph: Graph, text: str, parameters: dict | None = None) -> DataFrame:
    """``[OPTIONAL] MATCH ... [WHERE ...] [WITH ...] [UNWIND list AS x] RETURN [DISTINCT] ... [ORDER BY ...] [SKIP n] [LIMIT n]``; ``$name`` parameters.

    A further MATCH goes on from the rows found so far. Within one MATCH no edge is used twice by single hops.
    """
    for name, value in (parameters or {}).items():
        shown = "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else "null" if value is None else str(value)
        text = re.sub(rf"\${name}\b", lambda _, s=shown: s, text)
    text = re.sub(r'"([^"]*)"', lambda m: "'" + m[1].replace("'", "''") + "'", text)
    clauses = re.split(r"\b(OPTIONAL\s+MATCH|MATCH|WHERE|UNWIND|RETURN|ORDER\s+BY|SKIP|LIMIT|CREATE|MERGE|SET|DELETE|REMOVE|WITH)\b(?=(?:[^']*'[^']*')*[^']*$)", re.sub(r"\b(STARTS|ENDS)\s+WITH\b", r"\1_WITH_", text, flags=re.I), flags=re.I)
    kinds: dict[str, str] = {}
    rows, out = None, None
    pairs = list(zip(clauses[1::2], clauses[2::2], strict=True))
    for number, (word, body) in enumerate(pairs):
        word, body = re.sub(r"\s+", " ", word.upper()), re.sub(r"\b(STARTS|ENDS)_WITH_", r"\1 WITH", body, flags=re.I).strip()
        if word == "MATCH":
            rows = graph.bind(body, kinds, rows, distinct_edges=True)
        elif word == "OPTIONAL MATCH":
            following = pairs[number + 1] if number + 1 < len(pairs) else ("", "")
            condition = re.sub(r"\b(STARTS|ENDS)_WITH_", r"\1 WITH", following[1], flags=re.I).strip() if following[0].upper() == "WHERE" else ""
            rows = graph.bind(body, kinds, rows, distinct_edges=True, optional=condition)
        elif word == "WHERE" and number and re.sub(r"\s+", " ", pairs[number - 1][0].upper()) == "OPTIONAL MATCH":
            continue  # a part of it
        elif word == "WITH":
            rows, kinds = graph.carry(rows, body, kinds)
        elif word == "WHERE":
            rows = rows.where(F.expr(graph.expression(body, kinds)))
        elif word == "UNWIND":
            source, name = split_top(body, "as")
            listed = re.sub(r"^\[(.*)\]$", r"array(\1)", source, flags=re.S)
            rows = (rows if rows is not None else graph.nodes.sparkSession.range(1)).withColumn(name, F.explode(F.expr(graph.expression(listed, kinds))))
        elif word == "RETURN":
            distinct = re.match(r"DISTINCT\b", body, re.I)
            out = graph.project(rows, body[distinct.end() :] if distinct else body, kinds, bool(distinct))
        elif word == "ORDER BY":
            keys = []
            for key in split_top(body):
                m = re.fullmatch(r"(.*?)(?:\s+(ASC|DESC))?", key, re.I | re.S)
                column = m[1].strip() if m[1].strip() in out.columns else m[1].strip().replace(".", "_")
                keys.append(F.col(column).desc_nulls_last() if (m[2] or "").upper() == "DESC" else F.col(column).asc_nulls_last())
            out = out.orderBy(*keys)
        elif word == "SKIP":
            out = out.offset(int(body))
        elif word == "LIMIT":
            out = out.limit(int(body))
        else:
            raise ValueError(f"{word} does not run in a query")
    if out is None:
        raise ValueError("RETURN is missing")
    return out


def neighbors(graph: Graph, node, direction: str = "OUT", relation: str | None = None) -> DataFrame:
    """NEIGHBORS: nodes one hop away with relation_type and weight; OUT, IN or BOTH."""
    if direction not in ("OUT", "IN", "BOTH"):
        raise ValueError("direction is OUT, IN or BOTH")
    edges = graph.edges if relation is None else graph.edges.where(F.col("relation_type") == relation)
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "relation_type", "weight")
    back = edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "relation_type", "weight")
    return {"OUT": out, "IN": back, "BOTH": out.unionByName(back)}[direction].join(graph.nodes, "id")
