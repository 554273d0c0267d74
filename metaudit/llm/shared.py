"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """The table, computed once, written as Parquet and read back, so that it survives lost executors.

    A session on one machine (master ``local``) without the setting uses a temporary folder; on a
    cluster the setting is required. The folder's owner removes the tables, as with checkpoints.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="metaudit-")
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
