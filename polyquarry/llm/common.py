"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyquarry.session import checkpoint as cut
from polyquarry.session import checkpoint_folder

__all__ = ["WORD", "boxed", "checkpoint_folder", "cut", "partitions_of", "quoted", "remove", "table", "unlike", "values", "with_positions", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder wherever Spark keeps it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unlike(name: str, taken) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``taken``."""
    while name in taken:
        name += "_"
    return name


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as SQL VALUES; ``rows`` hold plain words and numbers."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds, strict=True))} FROM VALUES {values} AS t({', '.join(names)})")


def boxed(df: DataFrame, box: str = "row", but: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` but some as one struct, so that columns of an operator's own can't clash with them.

    ``select(f"{box}.*")`` takes them out again.
    """
    return F.struct(*(F.col(quoted(c)) for c in df.columns if c not in but)).alias(box)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t..\\r; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_positions(df: DataFrame, keys: list[str], order: list[str], out: str, extra: DataFrame | None = None, salts: int | None = None) -> DataFrame:
    """Adds ``out``: gapless positions from 0 among the rows that share ``keys``.

    A hot key is not ranked in one task: rows are dealt to ``salts`` sub-groups by a hash of ``order``,
    numbered there, and shifted by the sizes of the sub-groups before theirs. ``keys`` hold no nulls.
    ``df`` is read twice, so give it checkpointed. ``extra`` (one row for each of ``keys``) adds columns. A column called
    ``out`` is replaced, others may have any names.
    """
    salts = salts or max(8, 2 * partitions_of(df.sparkSession))
    names, by = [f"k{i}" for i in range(len(keys))], [F.col(quoted(c)) for c in order]
    own = [F.col(quoted(c)).alias(n) for c, n in zip(keys, names, strict=True)]
    hashed = F.xxhash64(*by)
    salted = df.select(boxed(df, but=(out,)), *own, hashed.alias("h"), F.struct(*by).alias("o"), F.pmod(hashed, F.lit(salts)).cast("int").alias("salt"))
    ranked = salted.select("row", *names, "salt", (F.row_number().over(Window.partitionBy(*names, "salt").orderBy("h", "o")) - 1).alias("rank"))
    before = Window.partitionBy(*names).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*names, "salt").agg(F.count("*").alias("n")).select(*names, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    added = []
    if extra is not None:
        further = extra.select(*(F.col(quoted(c)).alias(n) for c, n in zip(keys, names, strict=True)), boxed(extra, "extra", tuple(keys)))
        starts, added = starts.join(further, names), ["extra.*"]
    return ranked.join(starts, [*names, "salt"]).select("row.*", *added, (F.col("start") + F.col("rank")).cast("long").alias(out))
