"""Rewriting of SQL text token by token: operators and functions that Spark's parser lacks become expressions that it has.

Strings, quoted names and comments are tokens, so nothing inside them is touched. An operator takes the operand before it and the one
behind it (a name, literal, call or bracketed expression with its casts); operators of this kind bind alike, from the left.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from polyquarry.functions.jsonops import dollar
from polyquarry.functions.scalars import UNITS
from polyquarry.operators.search import parse_tsquery, query_terms

TOKENS = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^']|'')*')
      | (?P<name>(?:[A-Za-z_]\w*|`[^`]*`|"[^"]*")(?:\s*\.\s*(?:[A-Za-z_]\w*|`[^`]*`|"[^"]*"|\*))*)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<param>:[A-Za-z_]\w*|\$\d+)
      | (?P<op>->>|\#>>|<->|<=>|<\#>|->|\#>|\#-|@>|<@|@@|@\?|\?\||\?&|\|\||::|<=|>=|<>|!=|=>|[^\s\w])""",
    re.X | re.S,
)
#: Words that are no operand, whatever stands behind them.
KEYWORDS = set("select from where and or not in is null like ilike between case when then else end as on join left right full inner outer cross lateral group order by having limit offset union all distinct values set interval exists asc desc nulls first last over partition rows range filter with recursive intersect except using returning default rlike escape any some".split()) - {"null", "left", "right", "first", "last", "any", "some"}
#: Columns that hold JSON text unless told otherwise.
JSON_COLUMNS = ("properties", "translations", "relations")
DISTANCES = {"<->": "l2", "<=>": "cosine", "<#>": "inner"}
KINDS = {"json": "string", "jsonb": "string", "path": "string", "uuid": "string", "text": "string", "integer": "int", "int4": "int", "int8": "bigint", "real": "float", "numeric": "decimal(38,10)", "timestamptz": "timestamp", "bool": "boolean"}


@dataclass
class Operand:
    """SQL of a value; whether it is JSON text; for a chain of arrows, what it starts from and its keys; of a string, what it says."""

    sql: str
    is_json: bool = False
    base: str | None = None
    keys: tuple = ()
    vector: str | None = None  # text behind a to_tsvector
    query: str | None = None  # of a to_tsquery
    text: str | None = None


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of all tokens but blanks and comments."""
    return [(m.lastgroup, m[0]) for m in TOKENS.finditer(text) if m.lastgroup != "space"]


def literal(token: str) -> str:
    """What a string token says."""
    return token[1:-1].replace("''", "'")


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _variant(doc: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get(try_parse_json({doc}), {quote(path)}, '{kind}')"


def _array_keys(text: str) -> tuple:
    """Keys of ``{a,b,0}``."""
    return tuple(int(k) if k.strip().isdigit() else k.strip().strip('"') for k in text.strip().strip("{}").split(",") if k.strip())


def contains(doc: str, pattern) -> str:
    """``doc @> pattern``: a known pattern becomes tests of its leaves; arrays go to a function over JSON trees."""

    def test(tree, keys) -> str:
        path = dollar(*keys)
        if isinstance(tree, dict):
            inner = [f"coalesce(schema_of_variant({_variant(doc, path)}) LIKE 'OBJECT%', false)", *(test(v, (*keys, k)) for k, v in tree.items())]
            return "(" + " AND ".join(inner) + ")"
        if isinstance(tree, list):
            return f"coalesce(json_contains(to_json({_variant(doc, path)}), {quote(json.dumps(tree))}), false)"
        if isinstance(tree, (int, float)) and not isinstance(tree, bool):
            number = f"schema_of_variant({_variant(doc, path)}) RLIKE '^(BIGINT|DOUBLE|DECIMAL|FLOAT)'"
            return f"coalesce({number} AND {_variant(doc, path, 'double')} = {float(tree)!r}D, false)"
        return f"coalesce(to_json({_variant(doc, path)}) = {quote(json.dumps(tree, ensure_ascii=False))}, false)"

    return f"CASE WHEN {doc} IS NOT NULL THEN {test(pattern, ())} END"


def path_test(doc: str, text: str) -> str:
    """``doc @@ '$.a.b > 1 && $.c == "x"'``: comparisons of scalars joined by && and ||; null where a path leads nowhere."""

    def compare(part: str) -> str:
        m = re.fullmatch(r"\s*(\$[^=!<>]*?)\s*(==|!=|<>|<=|>=|<|>)\s*(.+?)\s*", part, re.S)
        if not m:
            raise ValueError(f"no comparison: {part!r}")
        value = json.loads(m[3]) if not m[3].startswith("'") else m[3].strip("'")
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        shown = str(value).lower() if kind == "boolean" else f"{float(value)!r}D" if kind == "double" else quote(value)
        return f"({_variant(doc, m[1], kind)} {'=' if m[2] == '==' else m[2]} {shown})"

    return "(" + " OR ".join(" AND ".join(compare(p) for p in either.split("&&")) for either in text.split("||")) + ")"


def text_test(text: str, query: str) -> str:
    """``to_tsvector(text) @@ to_tsquery(query)`` on the words of the text."""
    words = text_words(text)

    def test(tree) -> str:
        if tree[0] == "term":
            return f"array_contains({words}, {quote(tree[1])})"
        if tree[0] == "prefix":
            return f"exists({words}, w -> startswith(w, {quote(tree[1])}))"
        if tree[0] == "not":
            return f"(NOT {test(tree[1])})"
        return f"({test(tree[1])} {tree[0].upper()} {test(tree[2])})"

    return test(parse_tsquery(query))


def text_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '([\\\\p{{L}}\\\\p{{N}}]+)', 1)"


def text_rank(text: str, query: str) -> str:
    """A rank without the corpus: the mean over the query's words of tf / (tf + 1)."""
    terms = query_terms(parse_tsquery(query))
    parts = [f"(1D - 1D / (1 + size(filter({text_words(text)}, w -> w = {quote(t)}))))" for t in terms]
    return f"(({' + '.join(parts)}) / {len(parts)})" if parts else "0D"


class Rewriter:
    """``json_columns``: names of columns that hold JSON; ``calls``: further functions by lower-cased name, given their arguments."""

    def __init__(self, json_columns: Iterable[str] = JSON_COLUMNS, calls: dict[str, Callable[[list[Operand]], Operand | None]] | None = None):
        self.json_columns, self.calls = {c.lower() for c in json_columns}, {**CALLS, **(calls or {})}

    def rewrite(self, text: str) -> str:
        return self._run(tokens(text))

    # --- structure

    @staticmethod
    def _group(found, at: int) -> int:
        """Place behind the bracket that closes the one at ``at``."""
        depth = 0
        for i in range(at, len(found)):
            if found[i][0] == "op":
                depth += (found[i][1] in "([{") - (found[i][1] in ")]}")
                if not depth:
                    return i + 1
        raise ValueError("a bracket is not closed")

    def _arguments(self, found) -> list[Operand]:
        parts, start, depth = [], 0, 0
        for i, (kind, t) in enumerate(found):
            if kind == "op":
                depth += (t in "([{") - (t in ")]}")
                if t == "," and not depth:
                    parts.append(found[start:i])
                    start = i + 1
        return [self._one(p) for p in [*parts, found[start:]] if p]

    def _one(self, found) -> Operand:
        pieces = self._pieces(found)
        if len(pieces) == 1 and isinstance(pieces[0], Operand):
            return pieces[0]
        return Operand(self._join(pieces), any(isinstance(p, Operand) and p.is_json for p in pieces[:1]) and len(pieces) == 1)

    def _primary(self, found, at: int) -> tuple[Operand, int]:
        """The operand at ``at`` with its calls, subscripts and casts, and the place behind it."""
        kind, t = found[at]
        low, behind = t.lower(), at + 1
        opens = found[behind][1] if behind < len(found) and found[behind][0] == "op" else ""
        if kind == "name" and low == "array" and opens == "[":
            end = self._group(found, behind)
            made = Operand(f"array({self._run(found[behind + 1 : end - 1])})")
        elif kind == "name" and opens == "(" and low not in KEYWORDS:
            end = self._group(found, behind)
            inner = found[behind + 1 : end - 1]
            made = self._call(t, inner) or Operand(f"{t}({self._run(inner)})")
        elif kind == "op" and t == "(":
            end = self._group(found, at)
            inner = found[at + 1 : end - 1]
            one = self._one(inner) if inner and inner[0][1].lower() not in ("select", "with", "values") else Operand(self._run(inner))
            made = Operand(f"({one.sql})", one.is_json, vector=one.vector, query=one.query, text=one.text)
        elif kind == "op" and t == "$" and opens == "." and behind + 1 < len(found) and found[behind + 1][0] == "name":
            # $.column.key[0].key: the value at a path of a JSON column, as text
            column, *keys = (x.strip(' `"') for x in found[behind + 1][1].split("."))
            end = behind + 2
            while end < len(found) and found[end][1] in ("[", "."):
                if found[end][1] == "[":
                    keys.append(int(found[end + 1][1]))
                    end += 3
                else:
                    keys += [x.strip(' `"') for x in found[end + 1][1].split(".")]
                    end += 2
            return (self._at_path(column, tuple(keys), True) if keys else Operand(column, True)), end
        elif kind == "name" and low == "interval" and behind < len(found) and found[behind][0] == "string" and (flat := _duration(literal(found[behind][1]))):
            return Operand(flat), behind + 1
        elif kind == "op" and t in "-+" and behind < len(found):
            one, end = self._primary(found, behind)
            made = Operand(f"{t}{one.sql}")
        else:
            end = behind
            made = self._atom(kind, t)
        while end < len(found) and found[end] == ("op", "["):
            close = self._group(found, end)
            made, end = Operand(f"{made.sql}[{self._run(found[end + 1 : close - 1])}]"), close
        while end < len(found) and found[end] == ("op", "::"):
            made, end = self._cast(made, found, end + 1)
        return made, end

    def _atom(self, kind: str, t: str) -> Operand:
        if kind == "string":
            return Operand("'" + t[1:-1].replace("''", "\\'") + "'", text=literal(t))
        if kind == "name":
            t = t.replace('"', "`")
            return Operand(t, t.split(".")[-1].strip(" `").lower() in self.json_columns)
        return Operand(t)

    def _cast(self, made: Operand, found, at: int) -> tuple[Operand, int]:
        name, end, size = found[at][1].lower(), at + 1, ""
        if end < len(found) and found[end] == ("op", "("):
            close = self._group(found, end)
            size, end = "".join(t for _, t in found[end:close]), close
        if name == "vector":
            return Operand(f"from_json({made.sql}, 'array<double>')"), end
        if name in ("json", "jsonb"):
            return Operand(made.sql, True, text=made.text), end
        if name == "string" or KINDS.get(name) == "string":
            return Operand(f"CAST({made.sql} AS STRING)"), end
        return Operand(f"CAST({made.sql} AS {KINDS.get(name, name)}{size})"), end

    def _call(self, name: str, inner) -> Operand | None:
        known = self.calls.get(name.lower())
        return known(self._arguments(inner)) if known else None

    def _run(self, found) -> str:
        return self._join(self._pieces(found))

    @staticmethod
    def _join(pieces) -> str:
        out = ""
        for p in pieces:
            t = p.sql if isinstance(p, Operand) else p
            out += t if not out or t in (",", ")", "]", ".") or out[-1] in "([." else f" {t}"
        return out

    def _pieces(self, found) -> list:
        out: list = []
        at = 0
        while at < len(found):
            kind, t = found[at]
            left = out[-1] if out and isinstance(out[-1], Operand) else None
            if kind == "op" and left is not None and at + 1 < len(found) and (made := self._operator(left, t, found, at + 1)):
                out[-1], at = made
                continue
            is_duration = t.lower() == "interval" and at + 1 < len(found) and found[at + 1][0] == "string" and _duration(literal(found[at + 1][1]))
            if kind == "name" and t.lower() in KEYWORDS and not is_duration:
                out.append(t)
                at += 1
            elif kind == "op" and t not in "($":
                out.append(t)
                at += 1
            else:
                made, at = self._primary(found, at)
                out.append(made)
        return out

    # --- operators

    def _operator(self, left: Operand, op: str, found, at: int) -> tuple[Operand, int] | None:
        kind, t = found[at]
        if op in ("->", "->>"):
            if kind != "string" and not (kind == "number" and (left.is_json or op == "->>")):
                return None  # a lambda's arrow
            base = left.base or left.sql
            keys = (*left.keys, literal(t) if kind == "string" else int(t))
            return self._at_path(base, keys, op == "->>"), at + 1
        if op in ("#>", "#>>"):
            base = left.base or left.sql
            right, end = self._primary(found, at)
            return self._at_path(base, (*left.keys, *_array_keys(literal(t))) if kind == "string" else (), op == "#>>"), end
        if op in DISTANCES:
            right, end = self._primary(found, at)
            return _distance(DISTANCES[op])([left, right]), end
        if op in ("@>", "<@"):
            right, end = self._primary(found, at)
            doc, pattern = (left, right) if op == "@>" else (right, left)
            if pattern.text is not None:
                return Operand(f"({contains(doc.sql, json.loads(pattern.text))})"), end
            return Operand(f"json_contains({doc.sql}, {pattern.sql})"), end
        if op == "?" and kind == "string":
            return Operand(f"array_contains(json_object_keys({left.sql}), {quote(literal(t))})"), at + 1
        if op in ("?|", "?&"):
            right, end = self._primary(found, at)
            keys = f"json_object_keys({left.sql})"
            return Operand(f"arrays_overlap({keys}, {right.sql})" if op == "?|" else f"(size(array_except({right.sql}, {keys})) = 0)"), end
        if op == "#-":
            right, end = self._primary(found, at)
            return Operand(f"json_remove_path({left.sql}, {right.sql})", True), end
        if op == "-" and left.is_json:
            right, end = self._primary(found, at)
            return Operand(f"json_remove_key({left.sql}, {right.sql})", True), end
        if op == "||":
            right, end = self._primary(found, at)
            while end + 1 < len(found) and found[end][1] in ("->", "->>", "#>", "#>>") and (more := self._operator(right, found[end][1], found, end + 1)):
                right, end = more
            if left.is_json or right.is_json:
                return Operand(f"json_merge({left.sql}, {right.sql})", True), end
            return Operand(f"{left.sql} || {right.sql}"), end
        if op == "@?" and kind == "string":
            return Operand(f"({_variant(left.sql, literal(t))} IS NOT NULL)"), at + 1
        if op == "@@":
            right, end = self._primary(found, at)
            if right.query is not None:
                return Operand(text_test(left.vector if left.vector is not None else left.sql, right.query)), end
            if kind == "string":
                return Operand(path_test(left.sql, literal(t))), end
        return None

    @staticmethod
    def _at_path(base: str, keys: tuple, as_text: bool) -> Operand:
        path = dollar(*keys)
        sql = f"get_json_object({base}, {quote(path)})" if as_text else f"to_json({_variant(base, path)})"
        return Operand(sql, not as_text, None if as_text else base, () if as_text else keys)


def _as_vector(right: Operand) -> str:
    return f"from_json({right.sql}, 'array<double>')" if right.text is not None else right.sql


# --- functions


def _duration(text: str) -> str | None:
    """An interval of ``3 days 2 hours``: flat durations, a month being 30 days, a year 365; None for other wordings."""
    parts = re.fullmatch(r"\s*((?:-?\d+(?:\.\d+)?\s*[A-Za-z]+\s*)+)", text)
    if not parts:
        return None
    micros = 0
    for amount, unit in re.findall(r"(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)", text):
        if unit.lower().rstrip("s") not in UNITS:
            return None
        micros += round(float(amount) * UNITS[unit.lower().rstrip("s")])
    return f"make_dt_interval(0, 0, 0, CAST({micros} AS DECIMAL(30, 6)) / 1000000)"


def _invoke(args):
    """INVOKE('function', arguments...): a registered function by its name."""
    return Operand(f"{_plain(args[0])}({', '.join(a.sql for a in args[1:])})")


def _plain(op: Operand) -> str:
    if op.text is None:
        raise ValueError(f"a literal is needed, not {op.sql}")
    return op.text


def _typed(kind: str):
    def get(args):
        path = _plain(args[1])
        return Operand(_variant(args[0].sql, path if path.startswith("$") else dollar(*path.split(".")), kind))

    return get


def _json_get(args):
    """JSON_GET(document, 'a.b' or '$.a.b'): the value as JSON."""
    path = _plain(args[1])
    return Operand(f"to_json({_variant(args[0].sql, path if path.startswith('$') else dollar(*path.split('.')))})", True)


def _json_value(args):
    """JSON_VALUE(document, path [RETURNING type])"""
    m = re.fullmatch(r"('(?:[^']|'')*')(?:\s+RETURNING\s+(\w+))?", args[1].sql, re.I)
    if not m:
        return None
    value = f"get_json_object({args[0].sql}, {m[1]})"
    return Operand(f"TRY_CAST({value} AS {KINDS.get(m[2].lower(), m[2])})" if m[2] else value)


def _json_exists(args):
    return Operand(f"({_variant(args[0].sql, _plain(args[1]))} IS NOT NULL)")


def _json_query(args):
    """JSON_QUERY(document, path [WITH [CONDITIONAL] WRAPPER]): an object or array; a scalar only with a wrapper."""
    m = re.fullmatch(r"'((?:[^']|'')*)'(?:\s+(WITH|WITHOUT)\s*(CONDITIONAL|UNCONDITIONAL)?\s*(?:ARRAY\s+)?WRAPPER)?", args[1].sql, re.I)
    if not m:
        return None
    v = _variant(args[0].sql, m[1].replace("''", "'"))
    composed = f"schema_of_variant({v}) RLIKE '^(OBJECT|ARRAY)'"
    wrapped = f"concat('[', to_json({v}), ']')"
    if not m[2] or m[2].upper() == "WITHOUT":
        return Operand(f"CASE WHEN {composed} THEN to_json({v}) END", True)
    return Operand(f"CASE WHEN {composed} THEN to_json({v}) ELSE {wrapped} END" if (m[3] or "").upper() == "CONDITIONAL" else wrapped, True)


def _distance(kind: str):
    """Written out, since functions made by CREATE FUNCTION can't stand in ORDER BY. Cosine is that of unit vectors."""

    def call(args):
        a, b = (_as_vector(x) for x in args)
        if kind == "l2":
            return Operand(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x))")
        dot = f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
        return Operand(f"(1D - {dot})" if kind == "cosine" else f"(-{dot})")

    return call


def _segments(path: str) -> str:
    return f"filter(split({path}, '/'), x -> x <> '')"


def _depth(args):
    return Operand(f"size({_segments(args[0].sql)})")


def _parent(args):
    p = args[0].sql
    rest = f"concat('/', array_join(slice({_segments(p)}, 1, greatest(size({_segments(p)}) - 1, 0)), '/'))"
    return Operand(f"CASE WHEN {p} IS NULL THEN NULL WHEN size({_segments(p)}) < 1 THEN '' ELSE {rest} END")


def _ancestor(args):
    p, d = args[0].sql, args[1].sql
    first = f"concat('/', array_join(slice({_segments(p)}, 1, greatest({d}, 1)), '/'))"
    return Operand(f"CASE WHEN {p} IS NULL THEN NULL WHEN {d} <= 0 OR size({_segments(p)}) < {d} THEN '' ELSE {first} END")


def _path_starts_with(args):
    return Operand(f"startswith({args[0].sql}, {args[1].sql})")


def _jsonb_set(args):
    return Operand(f"jsonb_set({', '.join(a.sql for a in args)})", True)


def _tsvector(args):
    return Operand(text_words(args[-1].sql), vector=args[-1].sql)


def _tsquery(args):
    return Operand(args[-1].sql, query=_plain(args[-1]))


def _ts_rank(args):
    return Operand(text_rank(args[0].vector or args[0].sql, args[1].query if args[1].query is not None else _plain(args[1])))


def _references(args):
    """REFERENCES('workspace:/path') on the column properties, or REFERENCES(document, 'workspace:/path')."""
    doc, target = ("properties", args[0]) if len(args) == 1 else (args[0].sql, args[1])
    return Operand(f"json_references({doc}, {target.sql})")


CALLS: dict[str, Callable] = {
    "json_get": _json_get,
    "json_get_text": _typed("string"),
    "json_get_double": _typed("double"),
    "json_get_int": _typed("bigint"),
    "json_get_bool": _typed("boolean"),
    "json_value": _json_value,
    "json_exists": _json_exists,
    "json_query": _json_query,
    "jsonb_set": _jsonb_set,
    "to_tsvector": _tsvector,
    "to_tsquery": _tsquery,
    "ts_rank": _ts_rank,
    "references": _references,
    "invoke": _invoke,
    "invoke_sync": _invoke,
    "depth": _depth,
    "parent": _parent,
    "ancestor": _ancestor,
    "path_starts_with": _path_starts_with,
    "vector_l2_distance": _distance("l2"),
    "vector_cosine_distance": _distance("cosine"),
    "vector_inner_product": _distance("inner"),
}


# --- places in a text


def spans(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of all tokens but blanks and comments."""
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKENS.finditer(text) if m.lastgroup != "space"]


def find_call(text: str, names: Iterable[str]) -> tuple[str, int, int, int] | None:
    """The first call of one of ``names`` outside strings: name, where it starts, where its arguments start, where they end."""
    wanted, found = {n.upper() for n in names}, spans(text)
    for i, (kind, t, start, _) in enumerate(found[:-1]):
        if kind == "name" and t.upper() in wanted and found[i + 1][1] == "(":
            end = Rewriter._group([(k, x) for k, x, _, _ in found], i + 1)
            return t.upper(), start, found[i + 1][3], found[end - 1][2]
    return None


def table_uses(text: str, names: Iterable[str]) -> list[tuple[str, str, int, int]]:
    """Uses of ``names`` behind FROM, JOIN or a comma of a FROM list: table, alias, start and end of the name in ``text``."""
    known, found, out, listing = {n.lower(): n for n in names}, spans(text), [], False
    levels: list[bool] = []
    for i, (kind, t, start, end) in enumerate(found):
        low = t.lower()
        if t == "(":
            levels.append(listing)
            listing = False
        elif t == ")":
            listing = levels.pop() if levels else False
        elif low == "from" or low == "join":
            listing = True
        elif kind == "name" and low in ("where", "group", "order", "having", "limit", "on", "union", "select", "set"):
            listing = low == "on" and listing
        if kind == "name" and low in known and listing and i and found[i - 1][1].lower() in ("from", "join", ","):
            after = [x for x in found[i + 1 : i + 3]]
            alias = after[1][1] if len(after) > 1 and after[0][1].lower() == "as" else after[0][1] if after and after[0][0] == "name" and after[0][1].lower() not in KEYWORDS | {"left", "right", "full", "natural", "tablesample"} else known[low]
            out.append((known[low], alias, start, end))
    return out
