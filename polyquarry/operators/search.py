"""Vector, full-text and hybrid search; text chunking."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.functions import vectors
from polyquarry.session import checkpoint

# --- vectors


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, metric: str = "l2", most: float | None = None) -> DataFrame:
    """The k nearest rows with ``distance``, ties by ``key``: an exact scan that keeps k rows per task (TakeOrderedAndProject).

    Vectors of another length or null take no part; ``most`` drops rows at that distance or beyond.
    """
    rows = df.where(F.size(vector) == len(query)).withColumn("distance", vectors.DISTANCES[metric](vector, vectors.vector(query)))
    if most is not None:
        rows = rows.where(F.col("distance") < most)
    return rows.orderBy("distance", key).limit(k)


def vector_cells(df: DataFrame, vector: str, key: str, cells: int = 64, sample: int = 10_000, rounds: int = 5, seed: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """An inverted file: ``df`` with ``cell``, the nearest of ``cells`` centres; and the centres.

    Centres are fitted to about ``sample`` vectors (the documented bound; chosen by a hash of ``key``) by rounds of k-means, every row
    gets its cell. Write the table partitioned by cell: a search then reads the partitions of the cells that it probes.
    """
    import numpy as np

    rows = df.where(F.col(vector).isNotNull())
    count = rows.count()
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(u < sample / max(1, count)).select(vector).limit(2 * sample).collect()
    points = np.array([r[0] for r in picked], dtype=np.float64)
    if not len(points):
        return df.withColumn("cell", F.lit(0)), []
    centres = points[np.random.default_rng(seed).permutation(len(points))[: min(cells, len(points))]]
    for _ in range(rounds):
        near = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1) if len(points) * len(centres) < 1 << 24 else np.array([((p - centres) ** 2).sum(1).argmin() for p in points])
        centres = np.array([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    shared = df.sparkSession.sparkContext.broadcast(centres)  # cells x dimensions

    def cell(vectors):
        import pandas as pd

        c = shared.value
        norms = (c**2).sum(1)
        return pd.Series([0 if v is None or len(v) != c.shape[1] else int((norms - 2 * (c @ np.asarray(v, dtype=np.float64))).argmin()) for v in vectors], dtype="int32")

    return df.withColumn("cell", F.pandas_udf(cell, "int")(F.col(vector))), centres.tolist()


def nearest_in_cells(indexed: DataFrame, centres: list[list[float]], vector: str, query: Sequence[float], k: int, key: str, probes: int = 16) -> DataFrame:
    """The k nearest by L2 among the rows of the ``probes`` cells whose centres are nearest to the query: approximate, exact if all cells are probed."""
    order = sorted(range(len(centres)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centres[i], query, strict=True)))
    return nearest(indexed.where(F.col("cell").isin(order[:probes])), vector, query, k, key).drop("cell")


def nearest_documents(chunks: DataFrame, vector: str, query: Sequence[float], k: int, document: str, chunk: str, metric: str = "cosine_unit") -> DataFrame:
    """The k documents whose best chunk is nearest."""
    scored = chunks.withColumn("distance", vectors.DISTANCES[metric](vector, vectors.vector(query)))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(document).orderBy("distance", chunk))).where("_n = 1").drop("_n")
    return best.orderBy("distance", document).limit(k)


def position_weight(index: Column, decay: float = 0.1, boost: float = 1.0) -> Column:
    """Weight of a chunk by its position: max(1 - decay * index, 0.5), the first one boosted."""
    return F.greatest(F.lit(1.0) - F.lit(decay) * index, F.lit(0.5)) * F.when(index == 0, boost).otherwise(1.0)


def chunk_text(text: str, size: int, overlap: int, separators: Sequence[str] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, split at the first separator that helps, with ``overlap`` characters repeated."""

    def split(part: str, level: int) -> list[str]:
        if len(part) <= size or level >= len(separators):
            return [part]
        mark = separators[level]
        if not mark:
            return [part[i : i + size] for i in range(0, len(part), size)]
        cut = part.split(mark)
        parts = [c + mark for c in cut[:-1]] + [cut[-1]]
        return [q for p in parts if p for q in split(p, level + 1)]

    out, held = [], ""
    for piece in split(text, 0):
        if held and len(held) + len(piece) > size:
            out.append(held)
            keep = min(overlap, max(0, size - len(piece)))
            held = held[-keep:] if keep else ""
        held += piece
    return [*out, held] if held else out


def chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``key``, chunk_index, chunk; null and empty texts have none."""

    def run(values):
        return values.map(lambda v: chunk_text(v, size, overlap) if v else [])

    parts = F.pandas_udf(run, "array<string>")(F.col(text))
    return df.select(key, F.posexplode(parts).alias("chunk_index", "chunk"))


# --- full text

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(f"({TOKEN})"), 1)


def parse_tsquery(query: str):
    """``&`` AND, ``|`` OR, ``!`` NOT, ``:*`` prefix, parentheses; a tree of tuples. Adjacent words are ANDed."""
    parts = re.findall(r"[&|!()]|[^\s&|!()]+", query)
    at = 0

    def word():
        nonlocal at
        if at >= len(parts):
            raise ValueError("query ends too early")
        part = parts[at]
        at += 1
        if part == "!":
            return ("not", word())
        if part == "(":
            inner = either()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError("missing )")
            at += 1
            return inner
        if part in "&|)":
            raise ValueError(f"unexpected {part}")
        low = part.strip("'").lower()
        return ("prefix", low[:-2]) if low.endswith(":*") else ("term", low)

    def both():
        nonlocal at
        left = word()
        while at < len(parts) and parts[at] not in "|)":
            if parts[at] == "&":
                at += 1
            left = ("and", left, word())
        return left

    def either():
        nonlocal at
        left = both()
        while at < len(parts) and parts[at] == "|":
            at += 1
            left = ("or", left, both())
        return left

    tree = either()
    if at != len(parts):
        raise ValueError("unexpected )")
    return tree


def matches(words: Column, tree) -> Column:
    """Whether an array of tokens satisfies a parsed query."""
    kind = tree[0]
    if kind == "term":
        return F.array_contains(words, tree[1])
    if kind == "prefix":
        return F.exists(words, lambda w: w.startswith(tree[1]))
    if kind == "not":
        return ~matches(words, tree[1])
    left, right = matches(words, tree[1]), matches(words, tree[2])
    return left & right if kind == "and" else left | right


def query_terms(tree) -> list[str]:
    """Positive terms, for ranking."""
    if tree[0] == "term":
        return [tree[1]]
    if tree[0] in ("not", "prefix"):
        return []
    return list(dict.fromkeys(query_terms(tree[1]) + query_terms(tree[2])))


def fulltext_match(df: DataFrame, text: str, query: str) -> DataFrame:
    """``to_tsvector(text) @@ to_tsquery(query)``"""
    return df.where(matches(tokens(text), parse_tsquery(query)))


def bm25(df: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key`` and ``rank`` of rows that hold a term: sum of idf * tf (k1 + 1) / (tf + k1 (1 - b + b * length / mean length)).

    idf = ln(1 + (N - n + 0.5) / (n + 0.5)). Only the counts of the query's terms are kept from a text (checkpointed, so texts are read once), and nothing is shuffled but one row of totals.
    """
    words = tokens(text)
    size = F.size(words)
    # removing a term and counting what is left stays in generated code, where the tokens are made once for all terms
    counted = checkpoint(df.select(key, size.alias("_len"), *((size - F.size(F.array_remove(words, t))).alias(f"_tf{i}") for i, t in enumerate(terms))))
    totals = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("mean"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        n = totals[f"df{i}"] or 0
        idf = math.log(1 + (totals["n"] - n + 0.5) / (n + 0.5))
        tf = F.col(f"_tf{i}")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_len") / F.lit(totals["mean"] or 1.0)))
    found = F.lit(False)
    for i in range(len(terms)):
        found = found | (F.col(f"_tf{i}") > 0)
    return counted.where(found).select(key, score.alias("rank"))


def fulltext_search(df: DataFrame, key: str, text: str, query: str, limit: int = 1000) -> DataFrame:
    """FULLTEXT_SEARCH: matching rows by descending BM25 rank, ties by key; at most ``limit``, as the feature has it."""
    tree = parse_tsquery(query)
    hits = df.where(matches(tokens(text), tree)).select(key)
    ranked = hits.join(bm25(df, key, text, query_terms(tree)), key, "left").select(key, F.coalesce("rank", F.lit(0.0)).alias("rank"))
    return ranked.orderBy(F.desc("rank"), key).limit(limit)


def fuzzy_terms(words: DataFrame, word: str, term: str, distance: int = 1) -> DataFrame:
    """Distinct words within an edit distance of ``term``; a swap of neighbours counts as one edit."""
    swapped = [term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)]
    close = F.levenshtein(F.col(word), F.lit(term), distance) >= 0
    return words.where(close | F.col(word).isin(swapped)).select(word).distinct()


def wildcard(column: str, pattern: str) -> Column:
    """``*`` any run, ``?`` one character, ignoring case, over the whole value."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return F.col(column).rlike(f"(?is)^{regex}$")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf: an inverted index, to be written partitioned or bucketed by term."""
    return df.select(key, F.explode(tokens(text)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def text_lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, length: the number of words of every text, for ranks from an index."""
    return df.select(key, F.size(tokens(text)).alias("length")).where("length >= 0")


def _index_terms(tree) -> list[tuple[str, str]]:
    if tree[0] in ("term", "prefix"):
        return [(tree[0], tree[1])]
    return list(dict.fromkeys(x for part in tree[1:] for x in _index_terms(part)))


def _needs_all(tree) -> bool:
    """Whether texts without any of the query's words may match."""
    if tree[0] in ("term", "prefix"):
        return False
    if tree[0] == "not":
        return True
    left, right = _needs_all(tree[1]), _needs_all(tree[2])
    return (left and right) if tree[0] == "and" else (left or right)


def index_search(index: DataFrame, lengths: DataFrame, key: str, query: str, limit: int = 1000, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``fulltext_search`` on a written index (``postings``, ``text_lengths``): no text is read.

    Only the postings of the query's words are, which is a partition or bucket each where the index is written by term, or a pushed
    filter. Texts that a purely negative query wants come from ``lengths``.
    """
    tree = parse_tsquery(query)
    wanted, terms = _index_terms(tree), query_terms(tree)
    test = F.lit(False)
    for kind, word in wanted:
        test = test | (F.col("term") == word if kind == "term" else F.col("term").startswith(word))
    held = {w: f"_t{i}" for i, w in enumerate(wanted)}
    sums = [F.sum(F.when(F.col("term") == w if kind == "term" else F.col("term").startswith(w), F.col("tf")).otherwise(0)).alias(c) for (kind, w), c in held.items()]
    found = checkpoint(index.where(test).groupBy(key).agg(*sums))
    counts = found.agg(*(F.count_if(F.col(held["term", t]) > 0).alias(f"df{i}") for i, t in enumerate(terms))).first() if terms else ()
    total = lengths.agg(F.count("*"), F.avg("length")).first()

    def holds(t) -> Column:
        if t[0] in ("term", "prefix"):
            return F.coalesce(F.col(held[t[0], t[1]]), F.lit(0)) > 0
        if t[0] == "not":
            return ~holds(t[1])
        return holds(t[1]) & holds(t[2]) if t[0] == "and" else holds(t[1]) | holds(t[2])

    rows = lengths.join(found, key, "left" if _needs_all(tree) else "inner").where(holds(tree))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        n, tf = counts[f"df{i}"] or 0, F.coalesce(F.col(held["term", t]), F.lit(0))
        score = score + F.lit(math.log(1 + (total[0] - n + 0.5) / (n + 0.5))) * tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.lit(total[1] or 1.0)))
    return rows.select(key, score.alias("rank")).orderBy(F.desc("rank"), key).limit(limit)


# --- hybrid


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], key: str, k: int = 60, limit: int | None = None) -> DataFrame:
    """key, score = sum of 1 / (k + rank) over the rankings (``key``, ``rank`` from 1) that hold it; best first, ties by key."""
    parts = None
    for ranking in rankings:
        part = ranking.select(key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key)
    return fused.limit(limit) if limit is not None else fused
