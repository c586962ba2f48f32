"""Tables that cut lineage: written once to the folder all nodes share, so lost executors cost no work done before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir; a folder of our own only on a local master where that is unset."""
    shared, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quarrygraph-tables-"))
    return f"{shared.rstrip('/')}/quarrygraph-tables-{app}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of its own."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's tables; frames over them can't be read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
