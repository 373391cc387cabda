"""Entropy balancing: document rates that meet token targets by source, rounded into copies."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import boxed, cut, quoted, table, with_positions, word_count

#: The most sources whose totals the driver may hold.
MAX_SOURCES = 100_000


def targets_by_weight(totals: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """``share`` of all tokens dealt by weight; none above ``cap`` times its total, the excess reshared by weight."""
    left, open_, out = Fraction(share) * sum(totals), [i for i, n in enumerate(totals) if n], [Fraction(0)] * len(totals)
    weights, cap = [Fraction(w) for w in weights], Fraction(cap)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if not whole or left * weights[i] > cap * totals[i] * whole]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = cap * totals[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return [float(x) for x in out]


def balance(cells: DataFrame, totals: dict[int, tuple[int, float]], cap: float, tolerance: float = 1e-7) -> dict[int, float]:
    """The dual's solution: one tilt for each source.

    Rates minimise the sum of r ln r - r + 1 over documents, with 0 <= r <= cap and the rates times the sizes of each
    source adding up to its target. The dual is convex, its solution r = min(cap, exp(tilt * size / mean size)).
    Each Newton round is one distributed aggregate (``cells``: sid, size, n) that gives the gradient and the
    diagonal Hessian. Steps that leave the bracket found so far, and every third one that has not halved it since, go to its
    middle; so rounds end, when each source meets its target or its bracket is as narrow as doubles can be.
    """
    spark = cells.sparkSession
    tilt = {s: 0.0 for s in totals}
    low, high = {s: -700.0 for s in totals}, {s: 700.0 for s in totals}
    width, turn = {s: 1400.0 for s in totals}, 0
    busy = set(totals)
    while busy:
        turn += 1
        at = spark.createDataFrame([(s, tilt[s], float(totals[s][1])) for s in sorted(busy)], "sid int, tilt double, mean double")
        x = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        tokens = F.col("n") * F.col("size")
        got = (
            cells.join(F.broadcast(at), "sid")
            .groupBy("sid")
            .agg(F.sum(tokens * F.least(F.lit(float(cap)), free)).alias("f"), F.sum(F.when(free < cap, tokens * x * free).otherwise(0.0)).alias("h"))
            .collect()
        )
        for r in got:
            s, target = r.sid, totals[r.sid][0]
            miss = r.f - target
            if abs(miss) <= max(tolerance * target, 1e-9):
                busy.discard(s)
                continue
            if miss > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            middle = (low[s] + high[s]) / 2
            step = tilt[s] - miss / r.h if r.h > 0 else middle
            if turn % 3 == 0:
                step = middle if high[s] - low[s] > width[s] / 2 else step
                width[s] = high[s] - low[s]
            tilt[s] = step if low[s] < step < high[s] else middle
            if not low[s] < tilt[s] < high[s]:
                busy.discard(s)
    return tilt


def _copies_by_cell(cap: float):
    """Copies of each cell (documents of a source with one size), from the largest size down, carrying the rest on."""

    def diffuse(part):
        import numpy as np

        part = part.sort_values("size", ascending=False, kind="stable")
        size, n = part["size"].to_numpy(), part["n"].to_numpy()
        rate = np.minimum(cap, np.exp(np.minimum(part["tilt"].to_numpy() * size / part["mean"].to_numpy(), 700.0)))
        copies, carry = np.zeros(len(part), dtype=np.int64), 0.0
        for i in range(len(part)):
            if size[i] == 0:
                copies[i] = n[i]
                continue
            wanted = carry + n[i] * rate[i] * size[i]
            copies[i] = min(max(round(wanted / size[i]), 0), int(cap * n[i]))
            carry = wanted - copies[i] * size[i]
        return part.assign(base=copies // n, more=copies % n)[["sid", "size", "base", "more"]]

    return diffuse


def mix_to_targets(
    docs: DataFrame,
    key: str,
    source: str,
    size: str,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """``docs`` with source_size, target, copies and taken.

    Sources in code point order, null last, weigh ``weights``, repeating. Documents get whole copies, at most
    ``cap``; a source's taken tokens miss its target by less than about half its smallest documents' sizes. Documents
    of size 0 (null, negative too) stay once. Equal inputs give equal results: which of the documents of one size get the further
    copy is decided by a hash of ``key``; among rows of equal keys it may be any. Repeated rows count each. Empty tables give
    empty results. Columns called like the new ones are replaced, others may have any names. The driver holds one row for
    each source, at most ``max_sources`` (more raise).
    """
    spark = docs.sparkSession
    new = ("source_size", "target", "copies", "taken")
    sized = cut(
        docs.select(
            boxed(docs, but=new),
            F.col(quoted(key)).alias("key"),
            F.greatest(F.coalesce(F.col(quoted(size)).cast("long"), F.lit(0)), F.lit(0)).alias("size"),
            F.col(quoted(source)).isNull().alias("none"),
            F.coalesce(F.col(quoted(source)).cast("string"), F.lit("")).alias("source"),
        )
    )
    by_source = sized.groupBy("none", "source").agg(F.sum("size").alias("total"), F.count("*").alias("docs")).orderBy("none", "source").limit(max_sources + 1).collect()
    if len(by_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals = [int(r.total or 0) for r in by_source]
    targets = targets_by_weight(totals, [weights[i % len(weights)] for i in range(len(totals))], share, cap)
    rows = [(i, r.none, r.source, totals[i], targets[i], max(totals[i] / r.docs, 1.0)) for i, r in enumerate(by_source)]
    known = F.broadcast(spark.createDataFrame(rows, "sid int, none boolean, source string, source_size long, target double, mean double"))
    dealt = sized.join(known, ["none", "source"]).drop("none", "source")
    cells = cut(dealt.groupBy("sid", "size").agg(F.count("*").alias("n")))
    tilt = balance(cells, {i: (targets[i], rows[i][5]) for i in range(len(rows)) if totals[i]}, cap)
    at = F.broadcast(spark.createDataFrame([(r[0], float(tilt.get(r[0], 0.0)), r[5]) for r in rows], "sid int, tilt double, mean double"))
    # a source's cells are as many as its documents have different sizes
    copies = cut(cells.join(at, "sid").groupBy("sid").applyInPandas(_copies_by_cell(cap), "sid int, size long, base long, more long"))
    placed = with_positions(dealt, ["sid", "size"], ["key"], "at", copies)
    placed = placed.withColumn("copies", F.col("base") + (F.col("at") < F.col("more")).cast("long"))
    return placed.select("row.*", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_entropy_mix(spark, sf_dir):
    """All documents mixed to the sources' targets; size is the number of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_to_targets(docs, "doc_id", "source", "size").drop("source")


QUERIES = {"op2_entropy_mix": op2_entropy_mix}
ORACLES: dict[str, str] = {}
