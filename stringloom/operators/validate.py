"""Reading result lines and comparing two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.operators.joins import merged


def parsed_lines(lines: DataFrame) -> DataFrame:
    """`name, depth` of the lines with exactly two fields parted by a space; other lines are dropped.  Both stay strings."""
    fields = F.split("line", " ")
    return lines.where(F.size(fields) == 2).select(fields[1].alias("name"), fields[0].alias("depth"))


def parsed_files(files: DataFrame) -> DataFrame:
    """The same for whole file contents `content`."""
    return parsed_lines(files.select(F.explode(F.split("content", "\n")).alias("line")))


def compared(correct: DataFrame, judged: DataFrame) -> DataFrame:
    """`name, correct_res, judge_res` of the names both sides have."""
    return merged(correct.select("name", F.col("depth").alias("correct_res")), judged.select("name", F.col("depth").alias("judge_res")), "name")


def mismatches(correct: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows whose depths differ as strings."""
    return compared(correct, judged).where("judge_res != correct_res")


def summary(correct: DataFrame, judged: DataFrame) -> DataFrame:
    """`n_correct, n_judged, n_both, n_different`."""
    both = compared(correct, judged).agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("judge_res") != F.col("correct_res")).alias("n_different"))
    one = correct.agg(F.count(F.lit(1)).alias("n_correct"))
    two = judged.agg(F.count(F.lit(1)).alias("n_judged"))
    return one.crossJoin(two).crossJoin(both)
