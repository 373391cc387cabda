"""Exact top-k by integer inner product: a Voronoi join of queries and data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.llm.common import cut, table

#: Rows of one side that a task compares at once.
BLOCK = 8192
#: Number of the group into which groups are merged that need most rows.
MERGED = -1


def quantised(df: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """``key``, dim and packed: floor(scale * x) of each component as 64-bit little-endian integers.

    Rows whose vector is null or holds null or non-finite components are left out. Components must lie within 2^52 after
    scaling; larger ones raise. Null keys and repeated rows stay, empty tables stay empty, other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        for batch in batches:
            keys, vectors = batch.column(0), batch.column(1)
            kept, dims, packed = [], [], []
            for i, v in enumerate(vectors):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(x * scale)
                if np.abs(q).max(initial=0) > 2**52:
                    raise ValueError("vector components are too large to score exactly")
                kept.append(i)
                dims.append(len(q))
                packed.append(q.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept, pa.int64())), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=[key, "dim", "packed"])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, dim int, packed binary")


def _matrix(column, dim: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), dim)


def scores(q, x):
    """Exact integer inner products: by doubles where these are exact, else in 64-bit integers.

    Products beyond 64 bits raise.
    """
    import numpy as np

    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    bound = int(np.abs(q).max()) * int(np.abs(x).max()) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ x.T
    raise ValueError("inner products exceed 64 bits")


def _best(ids, values, k: int):
    """Positions of the k highest values, ties to the smaller id, best first."""
    import numpy as np

    if len(values) > 4 * k + 64:
        floor = np.partition(values, len(values) - k)[len(values) - k]
        at = np.nonzero(values >= floor)[0]
        return at[np.lexsort((ids[at], -values[at]))[:k]]
    return np.lexsort((ids, -values))[:k]


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, pivots: int = 48, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over all data but its own id.

    ``queries`` and ``data`` hold vec_id, row, dim, packed (see ``quantised``), checkpointed; ids are not null; ``row`` is another number
    for each row, and the same for a query and its own row in the data. Vectors of other dimensions than the query's take no
    part. Fewer than k: all. Ties go to the smaller vec_id. A repeated id is a row of its own: a candidate for its like, and as a
    query it has results of its own. Empty tables give empty results.

    1. Pivots (a bounded sample of the queries of each dimension) cut the space into Voronoi groups; each query
       joins its nearest pivot. Summaries of a group: size, and radius, its queries' largest distance to the pivot.
    2. For q in a group, q.x lies within pivot.x -/+ radius * |x|. One pass over the data keeps, for each group, the
       k + 1 highest lower bounds: any query of the group has k others that score at least the last of these.
    3. A data row goes only to groups where its upper bound reaches that bound, as (group, block) with blocks of
       bounded size, so neither large groups nor copies of one vector meet in one task. Groups that need over half of the rows
       of their dimension are merged into one, which gets a row once instead of nearly as often as there are groups.
    4. Tasks solve their blocks; the k best of each query are merged.

    The driver holds ``pivots`` vectors and ``pivots`` * (k + 1) bounds for each dimension.
    """
    spark = queries.sparkSession
    import numpy as np

    some = queries.select("dim", "packed").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("packed"), "packed"))).where(F.col("nth") <= pivots)
    picked = {}
    for r in some.orderBy("dim", "nth").collect():
        picked.setdefault(r.dim, []).append(np.frombuffer(bytes(r.packed), dtype="<i8").astype(np.float64))
    picked = {dim: np.stack(rows) for dim, rows in picked.items()}
    centres = spark.sparkContext.broadcast(picked)

    def nearest(batches):
        import pyarrow as pa
        import pyarrow.compute

        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in set(t["dim"].to_pylist()):
                part = t.filter(pa.compute.equal(t["dim"], dim))
                v = _matrix(part["packed"], dim).astype(np.float64)
                c = centres.value[dim]
                apart = (v**2).sum(1)[:, None] - 2 * v @ c.T + (c**2).sum(1)[None, :]
                best = apart.argmin(1)
                far = np.sqrt(((v - c[best]) ** 2).sum(1))
                yield from part.append_column("grp", pa.array(best, pa.int32())).append_column("far", pa.array(far)).to_batches()

    grouped = cut(queries.select("vec_id", "row", "dim", "packed").mapInArrow(nearest, "vec_id long, row long, dim int, packed binary, grp int, far double"))
    summary = {(r.dim, r.grp): (r.n, r.radius) for r in grouped.groupBy("dim", "grp").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    held = spark.sparkContext.broadcast(summary)

    def bounds(v, dim, groups):
        """Lower and upper bounds of q.x for the groups' queries and each x, a little widened for rounding."""
        c = centres.value[dim][groups]
        middle = c @ v.T
        size = np.sqrt((v**2).sum(1))
        slack = np.array([held.value[dim, g][1] for g in groups])[:, None] * size[None, :]
        slack = slack + 1e-9 * (np.sqrt((c**2).sum(1))[:, None] * size[None, :] + slack) + 1e-6
        return middle - slack, middle + slack

    def lower(batches):
        import pyarrow as pa
        import pyarrow.compute

        best: dict = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in set(t["dim"].to_pylist()):
                groups = sorted(g for d, g in held.value if d == dim)
                if not groups:
                    continue
                part = t.filter(pa.compute.equal(t["dim"], dim))
                low, _ = bounds(_matrix(part["packed"], dim).astype(np.float64), dim, groups)
                for i, g in enumerate(groups):
                    best[dim, g] = np.sort(np.concatenate([best.get((dim, g), np.empty(0)), low[i]]))[-k - 1 :]
        rows = [(d, g, float(x)) for (d, g), xs in best.items() for x in xs]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["dim", "grp", "low"])

    nth = F.row_number().over(Window.partitionBy("dim", "grp").orderBy(F.desc("low")))
    at_last = data.select("dim", "packed").mapInArrow(lower, "dim int, grp int, low double").withColumn("nth", nth).where(F.col("nth") <= k + 1).where(F.col("nth") == k + 1)
    lows = {(r.dim, r.grp): r.low for r in at_last.collect()}  # a number for each group; none where rows are too few
    floors = spark.sparkContext.broadcast(lows)

    def route(batches):
        import pyarrow as pa
        import pyarrow.compute

        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in set(t["dim"].to_pylist()):
                groups = sorted(g for d, g in held.value if d == dim)
                if not groups:
                    continue
                part = t.filter(pa.compute.equal(t["dim"], dim))
                v = _matrix(part["packed"], dim).astype(np.float64)
                _, high = bounds(v, dim, groups)
                need = high >= np.array([floors.value.get((dim, g), -np.inf) for g in groups])[:, None]
                # groups that need a row are listed with it, so that it is sent once here and copied in the shuffle only
                rows = np.nonzero(need.any(0))[0]
                lists = [[groups[i] for i in np.nonzero(need[:, r])[0]] for r in rows]
                yield from part.take(pa.array(rows)).append_column("grps", pa.array(lists, pa.list_(pa.int32()))).to_batches()

    routed = cut(data.select("vec_id", "row", "dim", "packed").mapInArrow(route, "vec_id long, row long, dim int, packed binary, grps array<int>"))
    whole = {r[0]: r[1] for r in data.groupBy("dim").count().collect()}
    needs = {(r.dim, r.grp): r.n for r in routed.select("dim", F.explode("grps").alias("grp")).groupBy("dim", "grp").agg(F.count("*").alias("n")).collect()}
    merged = {(d, g): MERGED if 2 * n > whole[d] else g for (d, g), n in needs.items()}
    to = F.broadcast(spark.createDataFrame([(d, g, m) for (d, g), m in merged.items()], "dim int, grp int, to int"))  # at most pivots rows for each dimension
    wide = {d: sorted(g for (e, g), m in merged.items() if e == d and m == MERGED) for d in whole}
    any_wide = F.lit(False)
    for d, groups in wide.items():
        if groups:
            any_wide |= (F.col("dim") == d) & F.arrays_overlap("grps", F.array(*map(F.lit, groups)))
    narrow = F.filter("grps", lambda g: ~F.concat_ws(":", F.col("dim").cast("string"), g.cast("string")).isin([f"{d}:{g}" for d, groups in wide.items() for g in groups]))
    spread = routed.select("vec_id", "row", "dim", "packed", F.explode(F.concat(F.when(any_wide, F.array(F.lit(MERGED))).otherwise(F.array().cast("array<int>")), narrow)).alias("grp"))
    grouped = grouped.join(to, ["dim", "grp"]).select("vec_id", "row", "dim", "packed", F.col("to").alias("grp"))
    asked, sizes = ({(r.dim, r.grp): r.n for r in t.groupBy("dim", "grp").agg(F.count("*").alias("n")).collect()} for t in (grouped, spread))
    shape = [(d, g, -(-asked[d, g] // block), -(-n // block)) for (d, g), n in sizes.items()]
    blocks = F.broadcast(spark.createDataFrame(shape, "dim int, grp int, qblocks int, dblocks int"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = grouped.join(blocks, ["dim", "grp"]).withColumn("qb", F.pmod(F.xxhash64("row"), F.col("qblocks")).cast("int")).withColumn("db", span("dblocks"))
    right = spread.join(blocks, ["dim", "grp"]).withColumn("db", F.pmod(F.xxhash64("row"), F.col("dblocks")).cast("int")).withColumn("qb", span("qblocks"))

    def solve(key, qs, xs):
        import pyarrow as pa
        import pyarrow.compute

        dim, out = key[0].as_py(), ([], [], [], [])
        if qs.num_rows and xs.num_rows:
            qid, qrow, xid, xrow = qs["vec_id"].to_numpy(), qs["row"].to_numpy(), xs["vec_id"].to_numpy(), xs["row"].to_numpy()
            x, q = _matrix(xs["packed"], dim), _matrix(qs["packed"], dim)
            for at in range(0, len(q), 256):
                s = scores(q[at : at + 256], x)
                for i in range(len(s)):
                    best = _best(xid, s[i], k + 1)
                    best = best[xrow[best] != qrow[at + i]][:k]  # but its own row
                    out[0].extend([qid[at + i]] * len(best))
                    out[1].extend([qrow[at + i]] * len(best))
                    out[2].extend(xid[best])
                    out[3].extend(s[i][best])
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "row", "vec_id", "score"), out, strict=True)})

    keys = ["dim", "grp", "qb", "db"]
    found = left.select(*keys, "vec_id", "row", "packed").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "row", "packed").groupBy(*keys)).applyInArrow(solve, "query_id long, row long, vec_id long, score long")
    found = cut(found)
    w = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_voronoi_top5(spark, sf_dir):
    """Queries: every vec_id divisible by 50; candidates: every row but the query's own."""
    rows = quantised(table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull()), "vec_id", "embedding")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


_ORACLE = """
WITH usable AS (
    SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

QUERIES = {"op4_voronoi_top5": op4_voronoi_top5}
ORACLES = {"op4_voronoi_top5": _ORACLE}
