"""String collections in files: one file is one string, its base name is its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_name(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def read_collection(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id string, text string` for the files of a folder; sub-folders are not entered."""
    files = spark.read.option("recursiveFileLookup", "false").text(folder, wholetext=True)
    return files.select(base_name(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def file_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id string, n_bytes long`, without reading contents."""
    return spark.read.format("binaryFile").load(folder).select(base_name(F.col("path")).alias("doc_id"), F.col("length").alias("n_bytes"))


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """`line string`, from at most `partitions` tasks."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.coalesce(partitions) if partitions else lines


def read_lines_of_whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n")).alias("line")).where("line != ''")


def write_result(lines: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write `file, line` as one text folder for each file name, replacing earlier results or, by mode, adding to them."""
    lines.select("file", "line").write.mode(mode).partitionBy("file").text(folder)


def read_result(spark: SparkSession, folder: str) -> DataFrame:
    """`file, line` of a written result."""
    return spark.read.text(folder).select("file", F.col("value").alias("line"))


def write_collection(corpus: DataFrame, folder: str) -> None:
    corpus.write.mode("overwrite").parquet(folder)
