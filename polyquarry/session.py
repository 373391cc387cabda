"""Session defaults; a cluster's own settings win over them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    cpus = cpus or min(8, os.cpu_count() or 1)
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only a local master may run without that setting; driver and executor are one process there, and a temporary folder serves.
    Checkpoints are removed when their tables are dropped if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as in ``DEFAULTS``.
    """
    import tempfile

    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="polyquarry-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Estimated bytes of a checkpoint from which its estimate is dropped.
MOST_ESTIMATED = 1 << 62


def _bounded(df):
    """The checkpoint ``df`` without its estimated size, if that is beyond all bounds.

    A checkpoint inherits the estimate of its plan, which for a join is the product of both sides. In a loop that joins a table with
    itself the number's digits double each round, until the driver's memory holds little else. Without it Spark takes the table for
    large, as before; partitioning and order are kept.
    """
    plan, option = df._jdf.queryExecution().logical(), df.sparkSession._jvm.scala.Option
    try:
        if plan.computeStats().sizeInBytes() < MOST_ESTIMATED:
            return df
    except ValueError:  # more digits than Python reads
        pass
    session, none = df.sparkSession._jsparkSession, option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, none, option.apply(plan.constraints()))
    return type(df)(df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def checkpoint(df, dealt: bool = False):
    """``df`` written once to the shared checkpoint folder, without lineage.

    ``dealt``: joins later know how it is partitioned and sorted. Adaptive execution, which doesn't tell, is off while it is made.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    # a checkpointed table inherits its plan's constraints, which grow exponentially over rounds of a loop; and what was
    # shuffled to make it is of no more use once it is written
    own = {"spark.sql.constraintPropagation.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if dealt:
        own["spark.sql.adaptive.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        return _bounded(df.select("*").checkpoint())  # a new plan, made under these settings
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
