"""Lineage cuts by writing to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Only used on one machine, where the session names no folder, as in tests.
LOCAL_FOLDER = "/tmp/stringloom-shared"


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below `spark.checkpoint.dir`, which the JVM deletes when it ends.  Where that is unset, a
    local session uses a folder of its own, and a session on a cluster is an error: its machines would not see each other's files."""
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        base = LOCAL_FOLDER
    folder = f"{base.rstrip('/')}/stringloom-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
