"""SQL front end: constructs that Spark's parser lacks are rewritten, the rest goes to ``spark.sql`` and Catalyst.

Path, JSON, text and vector functions and operators are written out as native expressions (``sqltext``); table functions become views;
a branch or revision in the WHERE clause picks a state of the log; data changes replace the table's snapshot or are appended to its log.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.functions import geo, jsonops
from polyquarry.operators import dml, search, versioning
from polyquarry.plans import match, sqltext, statements
from polyquarry.plans.expressions import closing, split_top
from polyquarry.session import checkpoint

TABLE_FUNCTIONS = ("GRAPH_TABLE", "CYPHER", "NEIGHBORS", "KNN", "FULLTEXT_SEARCH", "HYBRID_SEARCH")


class Engine:
    """Tables by name, kept as DataFrames; ``sql`` runs one statement, ``batch`` several."""

    def __init__(self, spark: SparkSession, udfs: bool = True):
        self.spark, self.tables, self.graphs, self.logs, self.functions = spark, {}, {}, {}, {}
        self.branch, self.types, self.translations = "main", {}, {}
        self.text: dict[str, tuple[str, str]] = {}
        self.vectors: dict[str, tuple[str, str]] = {}
        self.json_columns = set(sqltext.JSON_COLUMNS)
        self.policies: dict[str, str | None] = {}
        self.embed: Callable[[str], list[float]] | None = None
        self.saved: dict | None = None
        if udfs:
            for name, (function, kind) in JSON_UDFS.items():
                spark.udf.register(name, F.pandas_udf(function, kind))
            for name, (function, kind) in geo.FUNCTIONS.items():
                if name not in ("st_srid",):
                    spark.udf.register(name, _geo_udf(function, kind, name == "st_geomfromgeojson"))

    def register(self, name: str, df: DataFrame, json_columns: Sequence[str] = ()) -> None:
        """``json_columns``: columns of JSON text, besides those called properties, translations or relations."""
        self.tables[name] = df
        self.json_columns |= set(json_columns)
        self._show(name)

    def _show(self, name: str) -> None:
        """The view of a table: without what its policy hides."""
        hidden, df = self.policies.get(name), self.tables[name]
        (df.where(F.expr(self.rewrite(hidden))) if hidden else df).createOrReplaceTempView(name)

    def register_policy(self, name: str, condition: str | None, hide_root: bool = True) -> None:
        """Rows that queries see of a table: those that meet ``condition``, and without ``hide_root``'s exception not the node at '/'.

        Statements that change the table still work on all its rows. A condition is put into every view, so it reaches the scan.
        """
        parts = [f"({condition})"] if condition else []
        if hide_root and "path" in self.tables[name].columns:
            parts.append("coalesce(path <> '/', true)")
        self.policies[name] = " AND ".join(parts) or None
        self._show(name)

    def register_aggregate(self, name: str, function: Callable, kind: str) -> None:
        """An aggregate: ``function`` maps pandas Series of a group to one value."""
        from pyspark.sql.pandas.functions import PandasUDFType

        self.spark.udf.register(name, F.pandas_udf(function, kind, PandasUDFType.GROUPED_AGG))

    def register_table_function(self, name: str, maker: type, schema: str) -> None:
        """A table function: a class whose ``eval`` yields rows."""
        self.spark.udtf.register(name, F.udtf(maker, returnType=schema))

    def register_embedding(self, function: Callable[[str], list[float]]) -> None:
        """What EMBEDDING('text') calls, once for each literal of a statement."""
        self.embed = function

    def register_graph(self, graph: match.Graph, name: str = "NODES_GRAPH") -> None:
        self.graphs[name] = graph

    def register_log(self, name: str, log: DataFrame, branches: DataFrame) -> None:
        """A table kept as a revision log; ``__branch`` and ``__revision`` in a WHERE clause choose its state, else main's head."""
        self.logs[name] = (log, branches)
        self.register(name, versioning.branch_state(log, branches, "main"))

    def register_text(self, name: str, key: str, column: str) -> None:
        self.text[name] = (key, column)

    def register_vectors(self, name: str, key: str, column: str) -> None:
        self.vectors[name] = (key, column)

    def register_function(self, name: str, function: Callable, kind: str) -> None:
        """INVOKE's functions: vectorised over pandas Series."""
        self.spark.udf.register(name, F.pandas_udf(function, kind))

    # --- statements

    def batch(self, text: str) -> list[DataFrame]:
        return [self.sql(s) for s in split_top(text, ";") if s]

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        text = text.strip().rstrip(";")
        head = text.split(None, 1)[0].upper()
        if (made := statements.run(self, text)) is not None:
            return made
        if head in ("INSERT", "UPSERT", "UPDATE", "DELETE") and (made := self._change(head, text)) is not None:
            return made
        if head == "EXPLAIN":
            m = re.match(r"EXPLAIN\s+(VERBOSE\s+|ANALYZE\s+)?", text, re.I)
            shown = self.sql(text[m.end() :])._jdf.queryExecution()
            lines = (shown.toString() if m[1] else shown.simpleString()).splitlines()
            return self.spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line int, plan string")
        if head == "SHOW" and text.upper().split()[1:2] == ["TABLES"]:
            return self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "name string")
        query = self.rewrite(text)
        return self.spark.sql(query, args=args) if args else self.spark.sql(query)

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().toString()

    # --- rewriting

    def rewrite(self, text: str) -> str:
        text = self._versions(text)
        text = self._table_functions(text)
        text = self._distinct_on(text)
        return sqltext.Rewriter(self.json_columns, CALLS | {"embedding": self._embedding, "fulltext_match": self._fulltext_match}).rewrite(text)

    def _embedding(self, args):
        if self.embed is None:
            raise ValueError("EMBEDDING needs a function: register_embedding")
        return sqltext.Operand("array(" + ", ".join(f"{float(x)!r}D" for x in self.embed(sqltext._plain(args[0]))) + ")")

    def _fulltext_match(self, args):
        """FULLTEXT_MATCH(query, language) on the registered text column; FULLTEXT_MATCH(column, query, language) on any."""
        if len(args) == 3:
            return sqltext.Operand(sqltext.text_test(args[0].sql, sqltext._plain(args[1])))
        _, (_, column) = next(iter(self.text.items()))
        return sqltext.Operand(sqltext.text_test(f"`{column}`", sqltext._plain(args[0])))

    def _view(self, df: DataFrame) -> str:
        name = f"_view_{len(self.functions)}"
        self.functions[name] = df
        df.createOrReplaceTempView(name)
        return name

    def _versions(self, text: str) -> str:
        """Each use of a log becomes its state; ``alias.__branch = 'x'`` and ``alias.__revision <= n`` mean that use, without an alias all."""
        uses = sqltext.table_uses(text, self.logs)
        if not uses:
            return text
        chosen, cuts = {}, []
        found = sqltext.spans(text)
        for (kind, name, start, _), (_, op, _, _), (right, value, _, end) in zip(found, found[1:], found[2:], strict=False):
            alias, _, column = name.rpartition(".")
            if kind == "name" and column == "__branch" and op == "=" and right == "string":
                chosen[alias, column] = sqltext.literal(value)
            elif kind == "name" and column == "__revision" and op in ("=", "<=") and right == "number":
                chosen[alias, column] = int(value)
            else:
                continue
            cuts.append((start, end, "TRUE"))
        for name, alias, start, end in uses:
            log, branches = self.logs[name]
            branch, revision = (chosen.get((alias, c), chosen.get(("", c))) for c in ("__branch", "__revision"))
            view = self._view(versioning.branch_state(log, branches, branch or self.branch, revision))
            cuts.append((start, end, f"{view} AS {name}" if alias == name else view))
        for start, end, new in sorted(cuts, reverse=True):
            text = text[:start] + new + text[end:]
        return text

    def _table_functions(self, text: str) -> str:
        while call := sqltext.find_call(text, TABLE_FUNCTIONS):
            kind, start, begin, end = call
            inner = text[begin:end]
            if kind == "GRAPH_TABLE":
                name = re.match(r"\s*(\w+)\s+MATCH\b", inner, re.I)
                made = match.graph_table(self.graphs[name[1] if name and name[1].upper() != "MATCH" else "NODES_GRAPH"], inner)
            else:
                named = [re.fullmatch(r"(\w+)\s*=>\s*(.*)", a, re.S) for a in split_top(inner)]
                args = [_literal(a, self.embed) for a, n in zip(split_top(inner), named, strict=True) if not n]
                made = getattr(self, f"_{kind.lower()}")(*args, **{n[1].lower(): _literal(n[2], self.embed) for n in named if n})
            text = f"{text[:start]}{self._view(made)}{text[end + 1 :]}"
        return text

    def _cypher(self, query, *_):
        return match.cypher(self.graphs["NODES_GRAPH"], query)

    def _neighbors(self, node, direction="OUT", relation=None):
        return match.neighbors(self.graphs["NODES_GRAPH"], node, direction, relation)

    @staticmethod
    def _chosen(known: dict, name: str | None, what: str):
        """A registered table by name; without a name the only one."""
        if name is None and len(known) != 1:
            raise ValueError(f"{what} needs table => one of {sorted(known)}")
        return name or next(iter(known)), known[name or next(iter(known))]

    def _knn(self, vector, k, condition=None, metric="l2", table=None):
        """KNN(vector, k [, condition] [, metric => 'cosine'] [, table => 'name']): the k nearest of the rows that meet the condition, with distance and node_id."""
        name, (key, column) = self._chosen(self.vectors, table, "KNN")
        rows = self.tables[name] if condition is None else self.tables[name].where(F.expr(self.rewrite(condition)))
        return search.nearest(rows, column, vector, int(k), key, metric).withColumn("node_id", F.col(key))

    def _fulltext_search(self, query, language=None, limit=1000, table=None):
        name, (key, column) = self._chosen(self.text, table, "FULLTEXT_SEARCH")
        rows = self.tables[name]
        if language is not None and "lang" in rows.columns:
            rows = rows.where(F.col("lang") == language)
        return search.fulltext_search(rows, key, column, query, int(limit))

    def _hybrid_search(self, query, k, vector=None, candidates=None, table=None, vectors=None):
        """Text ranking, fused with a vector ranking of the same keys where a query vector is given; each list holds
        ``candidates`` rows, by default 20 times k and 1000 at least."""
        depth = int(candidates or max(1000, 20 * int(k)))
        name, (key, column) = self._chosen(self.text, table, "HYBRID_SEARCH")
        ranked = [_ranked(search.fulltext_search(self.tables[name], key, column, query, depth), F.desc("rank"), key)]
        if vector is not None:
            vname, (vkey, vcolumn) = self._chosen(self.vectors, vectors, "HYBRID_SEARCH")
            near = search.nearest(self.tables[vname], vcolumn, vector, depth, vkey)
            ranked.append(_ranked(near.withColumnRenamed(vkey, key), F.col("distance"), key))
        return search.reciprocal_rank_fusion(ranked, key, limit=int(k))

    def _distinct_on(self, text: str) -> str:
        m = re.match(r"\s*SELECT\s+DISTINCT\s+ON\s*\(", text, re.I)
        if not m:
            return text
        end = closing(text, m.end() - 1)
        keys, rest = text[m.end() : end], text[end + 1 :]
        columns, tail = split_top(rest, "from")[0], "FROM " + "from ".join(split_top(rest, "from")[1:])
        parts = re.split(r"\bORDER\s+BY\b", tail, flags=re.I)
        order = parts[1].strip() if len(parts) > 1 else keys
        names = ", ".join(split_top(c, "as")[-1].split(".")[-1] for c in split_top(columns))
        return f"SELECT {names} FROM (SELECT {columns}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _nth {parts[0]}) WHERE _nth = 1"

    # --- data changes

    def _change(self, head: str, text: str) -> DataFrame | None:
        if head in ("INSERT", "UPSERT"):
            m = re.match(r"\w+\s+INTO\s+(\w+)\s*\(([^)]*)\)\s*VALUES\s*(.*)$", text, re.I | re.S)
            if not m or m[1] not in self.tables:
                return None
            table, columns = self.tables[m[1]], [c.strip() for c in m[2].split(",")]
            rows = self.spark.sql(f"SELECT * FROM VALUES {m[3]} AS t({', '.join(columns)})")
            rows = rows.select(*(F.col(c).cast(table.schema[c].dataType) for c in columns))
            new = dml.insert(table, rows) if head == "INSERT" else dml.upsert(table, rows)
        elif head == "UPDATE":
            m = re.match(r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$", text, re.I | re.S)
            if not m or m[1] not in self.tables:
                return None
            pairs = (s.split("=", 1) for s in split_top(m[2]))
            new = dml.update(self.tables[m[1]], F.expr(self.rewrite(m[3] or "TRUE")), {k.strip(): F.expr(self.rewrite(v)) for k, v in pairs})
        else:
            m = re.match(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", text, re.I | re.S)
            if not m or m[1] not in self.tables:
                return None
            new = dml.delete(self.tables[m[1]], F.expr(self.rewrite(m[2] or "TRUE")))
        if m[1] in self.logs:
            return self._written(m[1], new)
        self.register(m[1], new)
        return new

    def _written(self, name: str, new: DataFrame) -> DataFrame:
        """Rows that a statement added, changed or removed, appended to the log as one revision of the current branch."""
        log, branches = self.logs[name]
        columns = [c for c in log.columns if c not in ("id", "revision", "branch", "deleted")]
        side = lambda df, n: df.select("id", F.struct(*columns).alias(n))
        both = side(self.tables[name], "o").join(side(new, "n"), "id", "full").where(~F.col("o").eqNullSafe(F.col("n")))
        at = (log.agg(F.max("revision")).first()[0] or 0) + 1
        made = {"revision": F.lit(at).cast("long"), "branch": F.lit(self.branch), "deleted": F.col("n").isNull(), "id": F.col("id")}
        made |= {c: F.coalesce(F.col("n"), F.col("o"))[c] for c in columns}
        rows = both.select(*(made[c].alias(c) for c in log.columns))
        self.logs[name] = (checkpoint(log.unionByName(rows)), branches)
        self.register(name, versioning.branch_state(*self.logs[name], self.branch))
        return self.tables[name]

    # --- transactions: tables are snapshots, so what was is only remembered

    def begin(self) -> None:
        if self.saved is not None:
            raise ValueError("a transaction is open")
        graphs = {n: (g, g.nodes, g.edges) for n, g in self.graphs.items()}
        self.saved = {"tables": dict(self.tables), "logs": dict(self.logs), "graphs": graphs, "branch": self.branch, "types": dict(self.types), "translations": dict(self.translations)}

    def end(self, keep: bool) -> None:
        if self.saved is None:
            raise ValueError("no transaction is open")
        saved, self.saved = self.saved, None
        if keep:
            return
        for name in set(self.tables) - set(saved["tables"]):
            self.spark.catalog.dropTempView(name)
        self.tables, self.logs, self.branch, self.types, self.translations = (saved[k] for k in ("tables", "logs", "branch", "types", "translations"))
        for name in self.tables:
            self._show(name)
        self.graphs = {n: g for n, (g, _, _) in saved["graphs"].items()}
        for g, nodes, edges in saved["graphs"].values():
            g.nodes, g.edges = nodes, edges


def _literal(text: str, embed: Callable | None = None):
    text = text.strip()
    if m := re.fullmatch(r"EMBEDDING\s*\(\s*('(?:[^']|'')*')\s*\)", text, re.I):
        if embed is None:
            raise ValueError("EMBEDDING needs a function: register_embedding")
        return embed(sqltext.literal(m[1]))
    text = re.sub(r"^ARRAY\s*(?=\[)|::\s*vector(\(\d+\))?$", "", text, flags=re.I)
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    if text.upper() == "NULL":
        return None
    return json.loads(text)


def _ranked(df: DataFrame, order, key: str) -> DataFrame:
    """Positions from 1; ``df`` holds a bounded top-k."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, key)))


def _over_rows(function):
    """Over rows of columns; null in any gives null, broken JSON too."""

    def run(*columns):
        import pandas as pd

        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append(None if any(v is None for v in row) else function(*row))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype="object")

    return run


def _keys(path: str) -> list[str]:
    return [k.strip().strip('"') for k in path.strip().strip("{}").split(",") if k.strip()]


def _dump(tree) -> str:
    return json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


def _remove_key(doc: str, key: str) -> str:
    tree = json.loads(doc)
    return _dump([x for x in tree if x != key] if isinstance(tree, list) else jsonops.remove_path(tree, [key]))


def _merge(left: str, right: str) -> str:
    a, b = json.loads(left), json.loads(right)
    if isinstance(a, dict) and isinstance(b, dict):
        return _dump({**a, **b})
    listed = lambda x: x if isinstance(x, list) else [x]
    return _dump(listed(a) + listed(b))


#: Functions over JSON trees, Arrow-batched, for what native expressions can't say.
JSON_UDFS = {
    "json_contains": (_over_rows(lambda d, p: jsonops.contains_tree(json.loads(d), json.loads(p))), "boolean"),
    "jsonb_set": (_over_rows(lambda d, p, v, create=True: _dump(jsonops.set_path(json.loads(d), _keys(p), json.loads(v), bool(create)))), "string"),
    "json_remove_key": (_over_rows(_remove_key), "string"),
    "json_remove_path": (_over_rows(lambda d, p: _dump(jsonops.remove_path(json.loads(d), _keys(p)))), "string"),
    "json_merge": (_over_rows(_merge), "string"),
    "json_references": (_over_rows(lambda d, t: jsonops.refers_to(json.loads(d), t)), "boolean"),
}


def _geo_udf(function, kind, text_in):
    """A row-wise UDF by name, Arrow-transferred; used from SQL text, where argument counts vary."""

    def call(*row):
        if any(v is None for v in row):
            return None
        made = function(*(row if text_in else (json.loads(v) if isinstance(v, str) else v for v in row)))
        return json.dumps(made, separators=(",", ":")) if kind == "geometry" and made is not None else made

    return F.udf(call, "string" if kind == "geometry" else kind, useArrow=True)


def _below(deeper: bool):
    """CHILD_OF(['path column',] '/a') and DESCENDANT_OF(['path column',] '/a' [, n]) as prefix tests, which reach the scan, and a depth."""

    def call(args):
        column = "path" if args[0].text is not None else args[0].sql
        prefix = sqltext._plain(args[0] if column == "path" and args[0].text is not None else args[1])
        rest = args[1:] if args[0].text is not None else args[2:]
        level = len([s for s in prefix.split("/") if s])
        inside = f"startswith({column}, {sqltext.quote(prefix.rstrip('/') + '/')})"
        depth = sqltext._depth([sqltext.Operand(column)]).sql
        if not deeper:
            return sqltext.Operand(f"({inside} AND {depth} = {level + 1})")
        most = f" AND {depth} <= {level + int(rest[0].sql)}" if rest else ""
        return sqltext.Operand(f"({inside} AND {depth} > {level}{most})")

    return call


CALLS = {"child_of": _below(False), "descendant_of": _below(True)}

__all__ = ["Engine"]
