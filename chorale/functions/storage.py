"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = tempfile.mkdtemp(prefix="chorale-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later readers survive the loss of executors, and an expensive stage runs once however often
    its result is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chorale-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
