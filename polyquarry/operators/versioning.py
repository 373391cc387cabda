"""Revisions, branches, locales and merges over an append-only log.

A log row is one write: branch, revision, id, deleted and the node's columns. State is the last write of each id that a branch
sees; a branch sees its own writes and those of its parent up to the fork revision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BRANCHES = "name string, parent string, fork_revision long"


def as_of(log: DataFrame, revision: int | None = None, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Live rows at ``revision`` (None: the head). The last write is taken before tombstones are dropped.

    One aggregate with map-side combining: the newest row of each id by ``max_by``, so no sort of a node's whole history.
    """
    seen = log if revision is None else log.where(F.col("revision") <= revision)
    rest = [c for c in log.columns if c not in keys]
    newest = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("_row"))
    return newest.select(*keys, "_row.*").where(~F.coalesce(F.col("deleted"), F.lit(False))).select(*log.columns)


def lineage(branches: DataFrame, name: str) -> list[tuple[str, int | None]]:
    """A branch and its ancestors with the revision up to which each is seen."""
    known = {r.name: (r.parent, r.fork_revision) for r in branches.collect()}  # one row a branch
    if name not in known:
        raise ValueError(f"no branch {name}")
    out, most = [], None
    while name is not None:
        out.append((name, most))
        parent, fork = known[name]
        if fork is not None:
            most = fork if most is None else min(most, fork)
        name = parent
    return out


def on_branch(log: DataFrame, branches: DataFrame, name: str) -> DataFrame:
    """All writes a branch sees; filters on branch and revision reach the scan."""
    condition = F.lit(False)
    for branch, most in lineage(branches, name):
        part = F.col("branch") == branch
        condition = condition | (part if most is None else part & (F.col("revision") <= most))
    return log.where(condition)


def branch_state(log: DataFrame, branches: DataFrame, name: str, revision: int | None = None) -> DataFrame:
    return as_of(on_branch(log, branches, name), revision)


def create_branch(spark: SparkSession, branches: DataFrame, name: str, parent: str | None, fork_revision: int | None) -> DataFrame:
    if branches.where(F.col("name") == name).count():
        raise ValueError(f"branch {name} exists")
    return branches.unionByName(spark.createDataFrame([(name, parent, fork_revision)], BRANCHES))


def drop_branch(branches: DataFrame, name: str) -> DataFrame:
    if branches.where(F.col("parent") == name).count():
        raise ValueError(f"branch {name} has branches of its own")
    return branches.where(F.col("name") != name)


def divergence(log: DataFrame, branches: DataFrame, ours: str, theirs: str) -> DataFrame:
    """One row: ahead and behind, the numbers of writes since the two branches parted."""
    a, b = lineage(branches, ours), lineage(branches, theirs)
    common = next((n for n, _ in a if n in {m for m, _ in b}), None)
    if common is None:
        raise ValueError("no common ancestor")
    limit_a, limit_b = dict(a)[common], dict(b)[common]
    base = min((x for x in (limit_a, limit_b) if x is not None), default=None)

    def own(name):
        seen = on_branch(log, branches, name)
        return seen.where((F.col("branch") != common) | (F.col("revision") > base)) if base is not None else seen.where(F.lit(False))

    return own(ours).agg(F.count("*").alias("ahead")).crossJoin(own(theirs).agg(F.count("*").alias("behind")))


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, columns: Sequence[str], resolve: str = "conflict") -> DataFrame:
    """id, status, and the merged ``columns``: full outer joins of three states by id.

    status: same, ours, theirs (only that side changed, adds and deletes included), both (equal changes), conflict. Conflicts
    follow ``resolve``: ours (KEEP OURS), theirs (KEEP THEIRS), delete, or conflict (columns null, to be decided). Deleted rows
    have ``gone`` true.
    """
    side = lambda df, n: df.select("id", F.struct(*columns).alias(n))
    all_ = side(base, "b").join(side(ours, "o"), "id", "full").join(side(theirs, "t"), "id", "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    status = F.when(same("o", "t"), F.when(same("o", "b"), "same").otherwise("both")).when(same("t", "b"), "ours").when(same("o", "b"), "theirs").otherwise("conflict")
    blank = F.lit(None).cast(all_.schema["o"].dataType)
    settled = {"ours": F.col("o"), "theirs": F.col("t"), "delete": blank, "conflict": blank}[resolve]
    row = F.when(F.col("status") == "theirs", F.col("t")).when(F.col("status") == "conflict", settled).otherwise(F.col("o"))
    merged = all_.withColumn("status", status).withColumn("_row", row)
    gone = F.col("_row").isNull() & ~((F.col("status") == "conflict") & F.lit(resolve == "conflict"))
    return merged.select("id", "status", gone.alias("gone"), *(F.col(f"_row.{c}").alias(c) for c in columns))


def merge_branch(log: DataFrame, branches: DataFrame, source: str, target: str, resolutions: dict | None = None, at: int | None = None) -> DataFrame:
    """New log rows on ``target`` that merge ``source`` into it; ``at`` numbers them (one beyond the last revision).

    resolutions: id -> KEEP_OURS, KEEP_THEIRS or DELETE. Conflicts without one raise. Rows that ``target`` has already aren't written again.
    """
    fork = branches.where(F.col("name") == source).first()
    if fork is None or fork.parent != target:
        raise ValueError(f"{source} is no branch of {target}")
    spark, columns = log.sparkSession, [c for c in log.columns if c not in ("id", "revision", "branch", "deleted")]
    base = branch_state(log, branches, target, fork.fork_revision)
    ours, theirs = branch_state(log, branches, target), branch_state(log, branches, source)
    merged = three_way_merge(base, ours, theirs, columns)
    kind = log.schema["id"].dataType.simpleString()
    chosen = spark.createDataFrame([(k, v) for k, v in (resolutions or {}).items()], f"id {kind}, choice string")
    side = theirs.select("id", F.struct(*columns).alias("_theirs"))
    settled = merged.join(F.broadcast(chosen), "id", "left").join(side, "id", "left")  # the statement's own resolutions
    open_ = settled.where("status = 'conflict' AND choice IS NULL").count()
    if open_:
        raise ValueError(f"{open_} conflicts are not resolved")
    written = settled.where("status = 'theirs' OR (status = 'conflict' AND choice <> 'KEEP_OURS')")
    gone = F.when(F.col("status") == "theirs", F.col("gone")).otherwise((F.col("choice") == "DELETE") | F.col("_theirs").isNull())
    at = at if at is not None else log.agg(F.max("revision")).first()[0] + 1
    made = {"revision": F.lit(at).cast("long"), "branch": F.lit(target), "deleted": gone, "id": F.col("id")}
    made |= {c: F.when(F.col("status") == "theirs", F.col(c)).otherwise(F.col(f"_theirs.{c}")) for c in columns}
    return written.select(*(made[c].alias(c) for c in log.columns))


def fast_forward(log: DataFrame, branches: DataFrame, target: str, source: str) -> bool:
    """Whether ``target`` has no writes since ``source`` forked from it."""
    return divergence(log, branches, target, source).first().ahead == 0


def restore(log: DataFrame, revision: int, at: int, ids: DataFrame | None = None) -> DataFrame:
    """New log rows, numbered ``at``, that bring back the state of an old revision (for ``ids``, or all)."""
    old = as_of(log, revision)
    now = as_of(log)
    if ids is not None:
        old, now = old.join(ids, "id", "left_semi"), now.join(ids, "id", "left_semi")
    back = old.withColumn("revision", F.lit(at).cast("long"))
    lost = now.join(old.select("id"), "id", "left_anti").withColumn("revision", F.lit(at).cast("long")).withColumn("deleted", F.lit(True))
    return back.unionByName(lost)


def localise(nodes: DataFrame, translations: DataFrame, locales: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each node and asked locale, with its ``columns`` overlaid by translations (id, locale, columns); missing ones fall back."""
    wanted = nodes.withColumn("locale", F.explode(F.array(*map(F.lit, locales))))
    over = translations.where(F.col("locale").isin(list(locales))).select("id", "locale", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = wanted.join(over, ["id", "locale"], "left")
    picked = {c: F.coalesce(f"_{c}", c) for c in columns}
    return joined.select(*(picked[c].alias(c) if c in picked else F.col(c) for c in [*nodes.columns, "locale"]))


def history(log: DataFrame, changed: Column) -> DataFrame:
    """Each write with the revision it replaced and whether ``changed`` differs from that one."""
    w = Window.partitionBy("id").orderBy("revision")
    return log.withColumn("previous", F.lag("revision").over(w)).withColumn("differs", ~changed.eqNullSafe(F.lag(changed).over(w)))
