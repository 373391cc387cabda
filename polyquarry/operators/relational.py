"""Relational operators beyond plain DataFrame calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyquarry.session import checkpoint


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """DISTINCT ON: the first row of each group of ``keys`` in ``order``, which must be total to be reproducible."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark prunes to ``n`` per task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def in_subquery(df: DataFrame, column: str, values: DataFrame, negated: bool = False, null_aware: bool = True) -> DataFrame:
    """[NOT] IN: a semi or anti join.

    Standard NOT IN keeps nothing if the set holds a null, and never a null value unless the set is empty. Without
    ``null_aware`` nulls are ordinary values that match nothing.
    """
    inner = values.select(F.col(values.columns[0]).alias("_v"))
    if not negated:
        return df.join(inner, df[column] == inner["_v"], "left_semi")
    kept = df.join(inner, df[column] == inner["_v"], "left_anti")
    if not null_aware:
        return kept
    facts = inner.agg(F.count("*").alias("_all"), F.count("_v").alias("_known"))  # one row
    allowed = (F.col("_all") == 0) | ((F.col("_all") == F.col("_known")) & F.col(column).isNotNull())
    return kept.join(F.broadcast(facts), allowed, "inner").drop("_all", "_known")


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on pairs of columns; ``null_safe`` lets nulls match each other."""
    both = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on]
    condition = both[0]
    for c in both[1:]:
        condition = condition & c
    return left.join(right, condition, how)


def lookup_join(outer: DataFrame, inner: DataFrame, key: str, rows: int, most: int = 100_000, how: str = "inner") -> DataFrame:
    """Few outer rows against a large table by its key: the outer side is broadcast while its known size ``rows`` is at most ``most``."""
    side = F.broadcast(outer) if rows <= most and how == "inner" else outer
    return side.join(inner, key, how)


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with ``low <= at < high``: ranges are listed in the buckets of ``width`` they cover, so it is an equi-join.

    Choose ``width`` near the usual range, since each range is copied once a bucket.
    """
    a = points.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
    spans = ranges.where(F.col(high) > F.col(low))
    b = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.ceil(F.col(high) / width).cast("long"))))
    return a.join(b, "_bucket").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, by: str, at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its ``by`` at or before its ``at``: one sort of both sides, no pairs."""
    a = left.select("*", F.lit(1).alias("_side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values))
    b = right.select(*(F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("_side"), *(F.col(v).alias(f"_{v}") for v in values))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_{v}").alias(v) for v in values))), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_seen", seen).where("_side = 1").select(*left.columns, *(F.col(f"_seen.{v}").alias(v) for v in values))


def cursor_page(df: DataFrame, order: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """Keyset pagination: rows after the last seen key, in ascending order; a scan filter instead of an offset."""
    if after is not None:
        condition = F.lit(False)
        for i in range(len(order)):
            same = F.lit(True)
            for c, v in zip(order[:i], after[:i], strict=True):
                same = same & (F.col(c) == F.lit(v))
            condition = condition | (same & (F.col(order[i]) > F.lit(after[i])))
        df = df.where(condition)
    return df.orderBy(*order).limit(limit)


def array_agg(column: str, order: Sequence[str]) -> Column:
    """ARRAY_AGG in ``order`` that keeps nulls."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(column).alias("_v"))))
    return F.transform(rows, lambda x: x["_v"][column])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, ``median``: the middle value or the mean of the two middle ones; nulls don't count, null for no values.

    Equal values are counted, the counts dealt by range, and only the ranges that hold the middle are numbered. The driver sees one count a
    range; no task holds all values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    dealt = checkpoint(values.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sizes = sorted((r.p, r.n) for r in dealt.groupBy("p").agg(F.sum("n").alias("n")).collect())
    whole, before, parts = sum(n for _, n in sizes), 0, []
    middle = {(whole - 1) // 2, whole // 2}
    for p, n in sizes:
        parts += [(p, k - before) for k in sorted(middle) if before <= k < before + n]
        before += n
    found = [F.when((F.col("p") == p) & (F.col("upto") - F.col("n") <= k) & (F.lit(k) < F.col("upto")), F.col("v")) for p, k in parts]
    held = dealt.where(F.col("p").isin([p for p, _ in parts])) if parts else dealt.limit(0)
    upto = held.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    means = [F.max(x) for x in found] or [F.lit(None).cast("double")]
    return upto.agg((sum(means[1:], means[0]) / len(means)).alias("median"))
