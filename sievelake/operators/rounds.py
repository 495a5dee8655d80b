"""What iterative operators share: results of a round, kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FOLDED = 16  # rounds after which the parts of a result become one
NO_SIZE = 1 << 128  # bytes, more than any table has


def _ensure(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='spark-')}")


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and checkpointed, so that the next round's plan starts from them and lost executors cost nothing.

    The folder is that of spark.checkpoint.dir. Where the session has none, a local master gets a temporary one; elsewhere that is an error.
    """
    _ensure(df.sparkSession)
    out = df.checkpoint()
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() < NO_SIZE:
        return out
    # a join's estimated size is the product of its sides', and a checkpoint hands it on: over rounds its digits double each time until they fill the driver
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), df.sparkSession)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share, as ``kept`` finds it."""
    _ensure(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
