"""Statements on trees, edges, branches and node types: text to the functions of ``dml`` and ``versioning``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.operators import dml, versioning
from polyquarry.plans.expressions import split_top

REFERENCE = r"(path|id)\s*=\s*'([^']*)'"
BRANCH = r"(?:\s+IN\s+BRANCH\s+'[^']*')?"


def _path(nodes: DataFrame, kind: str, value: str) -> str:
    """The path that a reference means; an id is looked up."""
    if kind.lower() == "path":
        return value
    found = nodes.where(F.col("id") == value).select("path").first()
    if found is None:
        raise ValueError(f"no node {value}")
    return found.path


def _id(nodes: DataFrame, kind: str, value: str):
    if kind.lower() == "id":
        return value
    found = nodes.where(F.col("path") == value).select("id").first()
    if found is None:
        raise ValueError(f"no node at {value}")
    return found.id


def _tree(engine, m) -> DataFrame:
    """MOVE, COPY [TREE] and ORDER."""
    verb, tree, table, k1, v1, word, k2, v2, name = m.groups()
    nodes = engine.tables[table]
    source, target = _path(nodes, k1, v1), _path(nodes, k2, v2)
    if verb.upper() == "MOVE":
        new = dml.move(nodes, source, target)
    elif verb.upper() == "COPY":
        new = dml.copy(nodes, source, target, name, tree=bool(tree))
    else:
        new = dml.reorder(nodes, source, target, after=word.upper() == "BELOW")
    engine.register(table, new)
    return new


def _relate(engine, m) -> DataFrame:
    """RELATE and UNRELATE on the default graph."""
    verb, k1, v1, k2, v2, kind, weight = m.groups()
    graph = engine.graphs["NODES_GRAPH"]
    row = (_id(graph.nodes, k1, v1), _id(graph.nodes, k2, v2))
    if verb.upper() == "RELATE":
        rows = engine.spark.createDataFrame([(*row, kind or "RELATED", float(weight or 1))], "src string, dst string, relation_type string, weight double")
        graph.edges = dml.relate(graph.edges, rows)
    else:
        rows = engine.spark.createDataFrame([(*row, kind)] if kind else [row], "src string, dst string" + (", relation_type string" if kind else ""))
        graph.edges = dml.unrelate(graph.edges, rows)
    return graph.edges


def _translate(engine, m) -> DataFrame:
    """UPDATE table FOR LOCALE 'x' SET column = 'text' WHERE ...: an overlay row for each node that is meant."""
    table, locale, changes, where = m.groups()
    pairs = [s.split("=", 1) for s in split_top(changes)]
    meant = engine.tables[table].where(F.expr(engine.rewrite(where)))
    rows = meant.select("id", F.lit(locale).alias("locale"), *(F.expr(v.strip()).alias(k.strip()) for k, v in pairs))
    known = engine.translations.get(table)
    engine.translations[table] = rows if known is None else dml.translate(known, rows)
    return engine.translations[table]


def _only_log(engine) -> str:
    if len(engine.logs) != 1:
        raise ValueError("branch statements need one registered log")
    return next(iter(engine.logs))


def _refresh(engine, name: str, log: DataFrame, branches: DataFrame) -> DataFrame:
    engine.logs[name] = (log, branches)
    engine.register(name, versioning.branch_state(log, branches, engine.branch))
    return branches


def _revision(log: DataFrame, text: str) -> int:
    """A number, HEAD, or HEAD~n: n distinct revisions back."""
    if m := re.fullmatch(r"HEAD(?:~(\d+))?", text, re.I):
        back = int(m[1] or 0)
        rows = log.select("revision").distinct().orderBy(F.desc("revision")).limit(back + 1).collect()
        return rows[-1].revision
    return int(text)


def _create_branch(engine, m) -> DataFrame:
    name = _only_log(engine)
    log, branches = engine.logs[name]
    parent = m[2] or engine.branch
    seen = versioning.on_branch(log, branches, parent)
    at = _revision(seen, m[3] or "HEAD")
    return _refresh(engine, name, log, versioning.create_branch(engine.spark, branches, m[1], parent, at))


def _drop_branch(engine, m) -> DataFrame:
    name = _only_log(engine)
    log, branches = engine.logs[name]
    if not m[1] and not branches.where(F.col("name") == m[2]).count():
        raise ValueError(f"no branch {m[2]}")
    return _refresh(engine, name, log.where(F.col("branch") != m[2]), versioning.drop_branch(branches, m[2]))


def _rename_branch(engine, m) -> DataFrame:
    name = _only_log(engine)
    log, branches = engine.logs[name]
    new = lambda c: F.when(F.col(c) == m[1], m[2]).otherwise(F.col(c)).alias(c)
    engine.branch = m[2] if engine.branch == m[1] else engine.branch
    return _refresh(engine, name, log.withColumn("branch", new("branch")), branches.select(new("name"), new("parent"), "fork_revision"))


def _merge_branch(engine, m) -> DataFrame:
    name = _only_log(engine)
    log, branches = engine.logs[name]
    source, target, strategy, answers = m.groups()
    if strategy and strategy.upper() == "FAST_FORWARD" and not versioning.fast_forward(log, branches, target, source):
        raise ValueError(f"{target} has moved on; it can't be fast-forwarded")
    cast = int if log.schema["id"].dataType.simpleString() in ("int", "bigint") else str
    resolved = {cast(k): v.upper() for k, v in re.findall(r"\(\s*'([^']*)'\s*,\s*(\w+)", answers or "")}
    return _refresh(engine, name, log.unionByName(versioning.merge_branch(log, branches, source, target, resolved)), branches)


def _use_branch(engine, m) -> DataFrame:
    name = _only_log(engine)
    versioning.lineage(engine.logs[name][1], m[1])
    engine.branch = m[1]
    return _refresh(engine, name, *engine.logs[name])


def _restore(engine, m) -> DataFrame:
    """RESTORE [TREE] NODE path|id TO REVISION r."""
    name = _only_log(engine)
    log, branches = engine.logs[name]
    tree, kind, value, revision = m.groups()
    seen = versioning.on_branch(log, branches, engine.branch)
    wanted = _revision(seen, revision)
    old = versioning.as_of(seen, wanted)
    if kind.lower() == "id":
        ids = engine.spark.createDataFrame([(value,)], "id string").select(F.col("id").cast(log.schema["id"].dataType).alias("id"))
    else:
        ids = old.where((F.col("path") == value) | (F.startswith("path", F.lit(value.rstrip("/") + "/")) if tree else F.lit(False))).select("id")
    at = log.agg(F.max("revision")).first()[0] + 1
    back = versioning.restore(seen, wanted, at, ids).withColumn("branch", F.lit(engine.branch))
    return _refresh(engine, name, log.unionByName(back), branches)


def _properties(text: str) -> dict[str, dml.Property]:
    """``name Kind [REQUIRED] [DEFAULT 'x'], ...``"""
    found = {}
    for part in split_top(text):
        m = re.fullmatch(r"'?(\w+)'?\s+(\w+)(\s+REQUIRED)?(?:\s+DEFAULT\s+'?([^']*)'?)?(\s+REQUIRED)?", part.strip(), re.I)
        if not m:
            raise ValueError(f"no property: {part!r}")
        found[m[1]] = dml.Property(m[2], required=bool(m[3] or m[5]), default=m[4])
    return found


def _create_type(engine, m) -> DataFrame:
    """CREATE NODETYPE | MIXIN | ARCHETYPE | ELEMENTTYPE name [EXTENDS base] [MIXINS (a, b)] (property Kind [REQUIRED], ...); a base and mixins lend their properties."""
    kind, name, base, mixins, body = m[1].upper(), m[2], m[3], m[4], m[5]
    if name in engine.types:
        raise ValueError(f"{name} exists")
    lent = [x.strip().strip("'") for x in (mixins or "").split(",") if x.strip()] + ([base] if base else [])
    if missing := [x for x in lent if x not in engine.types]:
        raise ValueError(f"no type {missing[0]}")
    engine.types[name] = dml.NodeType(name, _properties(body), [engine.types[x] for x in lent], kind)
    return _types(engine)


def _alter_type(engine, m) -> DataFrame:
    """ALTER NODETYPE ... name ADD [PROPERTY] p Kind [REQUIRED], DROP [PROPERTY] q; types that borrow from it follow."""
    old, add, drop = engine.types[m[2]], {}, []
    for change in split_top(m[3]):
        word, rest = re.fullmatch(r"(ADD|DROP)\s+(?:PROPERTY\s+)?(.*)", change.strip(), re.I | re.S).groups()
        if word.upper() == "ADD":
            add |= _properties(rest)
        else:
            drop.append(rest.strip().strip("'"))
    if missing := [p for p in drop if p not in old.properties]:
        raise ValueError(f"{m[2]} has no property {missing[0]}")
    new = old.altered(add, drop)
    follow = lambda t: new if t is old else dml.NodeType(t.name, t.properties, [follow(x) for x in t.mixins], t.family)
    engine.types = {k: follow(t) for k, t in engine.types.items()}
    return _types(engine)


def _drop_type(engine, m) -> DataFrame:
    if m[1] not in engine.types:
        raise ValueError(f"no type {m[1]}")
    if users := [t.name for t in engine.types.values() if any(x.name == m[1] for x in t.mixins)]:
        raise ValueError(f"{users[0]} borrows from {m[1]}")
    del engine.types[m[1]]
    return _types(engine)


def _types(engine) -> DataFrame:
    rows = [(t.name, k, p.kind, p.required) for t in engine.types.values() for k, p in t.all_properties().items()]
    return engine.spark.createDataFrame(rows, "node_type string, property string, kind string, required boolean")


def _transaction(engine, m) -> DataFrame:
    """BEGIN remembers the tables, ROLLBACK brings them back."""
    word = m[1].upper()
    if word in ("BEGIN", "START"):
        engine.begin()
    else:
        engine.end(word == "COMMIT")
    return engine.spark.createDataFrame([(word,)], "done string")


#: pattern of a whole statement -> what it does
STATEMENTS = [
    (rf"(MOVE|COPY|ORDER)(\s+TREE)?\s+(\w+){BRANCH}\s+SET\s+{REFERENCE}\s+(TO|ABOVE|BELOW)\s+{REFERENCE}(?:\s+AS\s+'([^']*)')?", _tree),
    (rf"(RELATE|UNRELATE){BRANCH}\s+FROM\s+{REFERENCE}(?:\s+IN\s+WORKSPACE\s+'[^']*')?\s+TO\s+{REFERENCE}(?:\s+IN\s+WORKSPACE\s+'[^']*')?(?:\s+TYPE\s+'([^']*)')?(?:\s+WEIGHT\s+([\d.]+))?", _relate),
    (r"UPDATE\s+(\w+)\s+FOR\s+LOCALE\s+'([^']*)'\s+SET\s+(.*?)\s+WHERE\s+(.*)", _translate),
    (r"CREATE\s+BRANCH\s+'([^']*)'(?:\s+FROM\s+'([^']*)')?(?:\s+AT\s+REVISION\s+(HEAD(?:~\d+)?|\d+))?", _create_branch),
    (r"DROP\s+BRANCH\s+(IF\s+EXISTS\s+)?'([^']*)'", _drop_branch),
    (r"ALTER\s+BRANCH\s+'([^']*)'\s+RENAME\s+TO\s+'([^']*)'", _rename_branch),
    (r"MERGE\s+BRANCH\s+'([^']*)'\s+INTO\s+'([^']*)'(?:\s+USING\s+(FAST_FORWARD|THREE_WAY))?(?:\s+MESSAGE\s+'[^']*')?(?:\s+RESOLVE\s+CONFLICTS\s*\((.*)\))?", _merge_branch),
    (r"(?:USE|CHECKOUT)\s+BRANCH\s+'([^']*)'", _use_branch),
    (r"SHOW\s+BRANCHES", lambda e, m: e.logs[_only_log(e)][1]),
    (r"SHOW\s+CURRENT\s+BRANCH", lambda e, m: e.spark.createDataFrame([(e.branch,)], "branch string")),
    (r"DESCRIBE\s+BRANCH\s+'([^']*)'", lambda e, m: e.logs[_only_log(e)][1].where(F.col("name") == m[1])),
    (rf"RESTORE(\s+TREE)?\s+NODE\s+{REFERENCE}\s+TO\s+REVISION\s+(HEAD(?:~\d+)?|\d+)", _restore),
    (r"CREATE\s+(NODETYPE|MIXIN|ARCHETYPE|ELEMENTTYPE)\s+'?([\w:]+)'?(?:\s+EXTENDS\s+'?([\w:]+)'?)?(?:\s+MIXINS\s*\(([^)]*)\))?\s*\((.*)\)", _create_type),
    (r"ALTER\s+(NODETYPE|MIXIN|ARCHETYPE|ELEMENTTYPE)\s+'?([\w:]+)'?\s+(.*)", _alter_type),
    (r"DROP\s+(?:NODETYPE|MIXIN|ARCHETYPE|ELEMENTTYPE)\s+'?([\w:]+)'?", _drop_type),
    (r"SHOW\s+TYPES", lambda e, m: _types(e)),
    (r"(BEGIN|START|COMMIT|ROLLBACK)(?:\s+(?:TRANSACTION|WORK))?(?:\s+WITH\s+MESSAGE\s+'[^']*')?", _transaction),
]


def run(engine, text: str) -> DataFrame | None:
    """The statement's result, or None if it is none of these."""
    for pattern, action in STATEMENTS:
        if m := re.fullmatch(pattern, text.strip(), re.I | re.S):
            return action(engine, m)
    return None
