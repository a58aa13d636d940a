"""Tables between the rounds of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where nothing sets it, a folder made for this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str, part: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor loses nothing.

    part: a condition; rows go to a folder part=true or part=false by it, and the table has it as a column.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    if part is not None:
        df = df.withColumn("part", F.expr(part))
    (df.write.partitionBy("part") if part is not None else df.write).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._shared_path = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Removes what settled() made, once nothing that is still to run reads it."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
