"""Scratch tables in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet to spark.checkpoint.dir (a temporary folder where that is unset and all runs on one machine) and
    read back, so that what reads it several times does not work it out again. The files go when the session's JVM ends."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="memgate-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/memgate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
