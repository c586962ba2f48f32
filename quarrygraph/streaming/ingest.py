"""Incremental ingest: files that arrive are parsed as a stream, and a changed file's facts replace its earlier ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cfacts import COLUMNS
from ..operators.cst import file_facts
from ..sources import scratch
from ..sources.writers import shelf

FILES = "file string, content binary"


def fact_stream(files: DataFrame, mode: str = "intended") -> DataFrame:
    """A stream of (file, content) to a stream of facts; parsing is stateless, so any output mode goes."""
    return file_facts(files, mode)


def c_file_stream(spark: SparkSession, directory: str) -> DataFrame:
    """(file, content) of C files as they appear below a directory."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(directory)
    return raw.where(F.lower("path").rlike(r"\.(c|h)$")).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "content")


def upsert_facts(batch: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """A foreachBatch body: the batch's files replace their rows in the fact table, other files' rows stay.

    The table lies on a bounded number of shelves by the hash of file names; only the batch's shelves are written anew.
    ``files`` (a column file) names files that changed, for those of which no fact is left.
    """
    spark, batch = batch.sparkSession, scratch.kept(batch, "batch")
    names = batch.select("file").union(files.select("file")) if files is not None else batch.select("file")
    names = scratch.kept(names.distinct().withColumn("shelf", shelf(F.col("file"))), "names")
    rows = batch.withColumn("shelf", shelf(F.col("file")))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.schema(f"{COLUMNS}, shelf string").parquet(path)
        # at most 16 ** SHELF_DIGITS rows
        here = F.broadcast(names.select("shelf").distinct())
        old = scratch.kept(old.join(here, "shelf", "left_semi").join(names.select("file"), "file", "left_anti"), "old")
        rows = rows.unionByName(old)
    gone = names.join(rows.select("shelf").distinct(), "shelf", "left_anti").select("shelf").distinct()
    rows.repartition("shelf").sortWithinPartitions("shelf", "file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shelf").parquet(path)
    for row in gone.collect():  # shelves that hold nothing any more, at most 16 ** SHELF_DIGITS
        empty = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shelf={row['shelf']}")
        empty.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(empty, True)


def functions_of_stream(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The functions of files fed through a stream until it is drained: file, name, start_line."""
    at = f"{scratch.folder(spark)}/ingest-{uuid.uuid4().hex}"
    files.select("file", "content").write.parquet(f"{at}/in")
    stream = fact_stream(spark.readStream.schema(FILES).parquet(f"{at}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(COLUMNS).parquet(f"{at}/out")
    return out.where("kind = 'FUNCTION'").select("file", "name", F.col("start_line").cast("long").alias("start_line"))
