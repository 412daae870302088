"""Tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str = "stream") -> str:
    """A new folder where the session keeps its checkpoints; a local session without
    one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once and read from there, so that what made it runs once
    however many readers there are, and a lost executor repeats tasks of the readers only."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
