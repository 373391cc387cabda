"""Event subscriptions, triggers and index upkeep on Structured Streaming.

Events: event_type, workspace, path, node_type, node_id, ts and perhaps properties.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyquarry.operators import search


def path_matches(path: str, pattern: str) -> Column:
    """``*`` within a segment, ``**`` across segments; a pattern that ends in ``/**`` also holds for its own root."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "(?:/.*)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return F.col(path).rlike(f"^{out}$")


@dataclass
class Subscription:
    """What a subscriber hears of; empty filters let all pass."""

    workspaces: Sequence[str] = ()
    paths: Sequence[str] = ()
    event_types: Sequence[str] = ()
    node_types: Sequence[str] = ()
    where: Column | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        for column, values in (("workspace", self.workspaces), ("event_type", self.event_types), ("node_type", self.node_types)):
            if values:
                out = out & F.col(column).isin(list(values))
        if self.paths:
            some = F.lit(False)
            for pattern in self.paths:
                some = some | path_matches("path", pattern)
            out = out & some
        return out if self.where is None else out & self.where

    def apply(self, events: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        """Works alike on streams and tables; ``nodes`` (id) adds the node by a stream-static join."""
        heard = events.where(self.condition())
        if nodes is None:
            return heard
        body = nodes.select(F.col("id").alias("node_id"), F.struct(*nodes.columns).alias("node"))
        return heard.join(body, "node_id", "left")


@dataclass
class Trigger:
    """A handler called with each micro-batch's matching events; higher priorities first."""

    name: str
    subscription: Subscription
    handler: Callable[[DataFrame, int], None]
    priority: int = 0
    enabled: bool = field(default=True)


def run_triggers(events: DataFrame, triggers: Sequence[Trigger], checkpoint: str, **options) -> StreamingQuery:
    """Runs the triggers on a stream; a batch that is run again after a failure has the same number, so handlers can skip it."""
    ordered = sorted((t for t in triggers if t.enabled), key=lambda t: -t.priority)

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        for trigger in ordered:
            trigger.handler(trigger.subscription.apply(batch), number)
        batch.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def maintain_postings(texts: DataFrame, key: str, text: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes each micro-batch's inverted index to ``target``; a repeated batch overwrites its own folder.

    A further row of a key is an update, one with a null text a deletion: ``live_postings`` reads what holds now. Every row of a
    batch leaves a row with a null term, which says that the key's older postings are void. Of several rows of a key in
    one batch the one with the greatest text counts, unless the stream has a column ``version``.
    """

    def handle(batch: DataFrame, number: int) -> None:
        newest = F.struct("version", F.col(text).alias("t")) if "version" in batch.columns else F.struct(F.col(text).alias("t"))
        last = batch.groupBy(key).agg(F.max(newest)["t"].alias(text))
        marks = last.select(F.lit(None).cast("string").alias("term"), key, F.lit(0).cast("long").alias("tf"))
        search.postings(last, key, text).unionByName(marks).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = texts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def live_postings(postings: DataFrame, key: str) -> DataFrame:
    """term, key, tf as of the last batch of each key; ``postings`` is what ``maintain_postings`` has written."""
    last = postings.where("term IS NULL").groupBy(key).agg(F.max("batch").alias("batch"))
    return postings.where("term IS NOT NULL").join(last, [key, "batch"], "left_semi").select("term", key, "tf")


def windowed_counts(events: DataFrame, ts: str, width: str, slide: str | None = None, late: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Counts in tumbling or sliding event-time windows behind a watermark."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(window, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Session windows: events of a key with less than ``gap`` between them."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    made = timed.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return made.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
