"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import cut, table, with_positions

SHARDS = 24


def rendezvous(keys: Sequence[str | Column], weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``keys``: the least ``-ln(u) / weight``, ``u`` a hash of keys and shard in (0, 1).

    A shard's share is its weight over all weights. A further shard takes rows only into itself, since the
    scores of the others don't change; a removed one spreads its rows over the rest. A weight of 0 takes
    nothing. Null keys hash like any other value, ties go to the smaller shard.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, and one above 0")
    bids = []
    for shard, weight in enumerate(weights):
        if weight:
            u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            bids.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*bids))["shard"]


def shard_rows(df: DataFrame, keys: Sequence[str], weights: Sequence[float], order: Sequence[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with the shard of each row and its gapless slot there.

    ``order`` names the columns that fix the slots; rows equal in all of them may swap slots. An empty table
    stays empty, repeated rows take a slot each. Columns of ``df`` called like the new ones are replaced.
    """
    dealt = cut(df.withColumn(shard, rendezvous(list(keys), weights)))
    return with_positions(dealt, [shard], list(order), slot)


def op1_rendezvous_shards(spark, sf_dir):
    """All documents over 24 equal shards; law ``key``: doc_id and the number of shards decide."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(["doc_id"], [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
    out = shard_rows(docs, ["doc_id"], [1.0] * SHARDS, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op1_rendezvous_shards": op1_rendezvous_shards}
ORACLES: dict[str, str] = {}
