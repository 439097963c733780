"""Shared folders, durable tables and row-free lineage cuts for the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stringloom.sources.durable import shared_folder, written

__all__ = ["bounded_batches", "bucketed", "shared_folder", "shuffle_partitions", "table", "written"]


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Write `df` as a table bucketed by `key` in the shared folder, so that later joins on `key` leave its rows in place.  The
    catalogue forgets the table when the driver ends."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, key).format("parquet").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    # a session that was stopped before has taken a catalogue of its own with it
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


#: Rows and bytes of an Arrow batch at most: texts can be long, and a batch is held by the JVM and the Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
ROWS_KEY, BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's Arrow batches held to `BATCH_ROWS` rows and, beyond one row, `BATCH_BYTES` bytes: Spark has no
    setting for one query, and smaller batches change no result."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ROWS_KEY)) <= BATCH_ROWS:
        conf.set(ROWS_KEY, str(BATCH_ROWS))
    conf.set(BYTES_KEY, f"{BATCH_BYTES}b")
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Python workers started from here on find this package wherever the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
