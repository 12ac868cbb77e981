"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; where that is unset in local mode, as in tests, in one of our own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.TemporaryDirectory(prefix="findling-")
        atexit.register(own.cleanup)
        at = f"file://{own.name}"
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/findling-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written once and read back: what follows does not make it again."""
    at, schema = folder(df.sparkSession), df.schema
    df.write.parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)
