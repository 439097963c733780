"""Corpora, offsets of their strings in one merged string, and splits of it.

A corpus is `doc_id, text`; a null text has no characters.  Positions count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.sources.durable import written

#: Ranges of ids over which running sums are cut.
RANGES = 64


def corpus(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def merge_offsets(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """`doc_id, start_at, end_at`: half-open ranges of the strings, merged by id.

    The running sum is cut at quantiles of the id: sums inside a range run in parallel, and the sums before each range are a
    table of at most `ranges` rows.  Null ids are the first; strings are ranged by an exchange, whose ranges hold once written."""
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    if dict(docs.dtypes)["doc_id"] == "string":
        ranged = written(sized.repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id()), "ranged-ids")
    else:
        cuts = sized.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
        ranged = sized.crossJoin(F.broadcast(cuts)).withColumn("range", F.size(F.filter(F.coalesce("cuts", F.array()), lambda c: c < F.col("doc_id")))).drop("cuts")
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.withColumn("upto", inside).join(F.broadcast(before), "range")
    return joined.select("doc_id", (F.col("before") + F.col("upto") - F.col("n")).alias("start_at"), (F.col("before") + F.col("upto")).alias("end_at"))


def input_splits(docs: DataFrame, partitions: int) -> DataFrame:
    """`split_id, doc_id, seg_start, seg_len, remain, merged_at`: near-equal splits of the merged string, as string segments.
    `remain` counts the characters of the string after the segment."""
    offsets = merge_offsets(docs)
    width = offsets.agg(F.greatest(F.ceil(F.max("end_at") / partitions), F.lit(1)).alias("width"))
    full = offsets.where("end_at > start_at").crossJoin(F.broadcast(width))
    each = full.withColumn("split_id", F.explode(F.expr("sequence(start_at div width, (end_at - 1) div width)")))
    begin = F.greatest("start_at", F.col("split_id") * F.col("width"))
    end = F.least("end_at", (F.col("split_id") + 1) * F.col("width"))
    return each.select("split_id", "doc_id", (begin - F.col("start_at")).alias("seg_start"), (end - begin).alias("seg_len"), (F.col("end_at") - end).alias("remain"), begin.alias("merged_at"))


def split_content(docs: DataFrame, partitions: int, overlap: int) -> DataFrame:
    """`split_id, doc_id, seg_start, content`: each segment's characters, with up to `overlap` more after a split's last one."""
    splits = input_splits(docs, partitions)
    last = F.row_number().over(Window.partitionBy("split_id").orderBy(F.desc("merged_at"))) == 1
    extra = F.when(F.col("last"), F.least(F.col("remain"), F.lit(overlap))).otherwise(0)
    rows = splits.withColumn("last", last).join(docs.select("doc_id", "text"), "doc_id")
    return rows.select("split_id", "doc_id", "seg_start", F.col("text").substr((F.col("seg_start") + 1).cast("int"), (F.col("seg_len") + extra).cast("int")).alias("content"))


def split_check(docs: DataFrame, partitions: int) -> DataFrame:
    """`split_id, n_segments, split_len, contiguous`: a split's segments follow each other without a gap."""
    order = Window.partitionBy("split_id").orderBy("merged_at")
    rows = input_splits(docs, partitions).withColumn("gap", F.col("merged_at") - F.lag(F.col("merged_at") + F.col("seg_len")).over(order))
    return rows.groupBy("split_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("seg_len").alias("split_len"), F.coalesce(F.max(F.abs("gap")) == 0, F.lit(True)).alias("contiguous")
    )


def suffixes(docs: DataFrame) -> DataFrame:
    """`doc_id, pos, suf` for every start of every string."""
    full = docs.where(F.length("text") > 0)
    at = full.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    return at.select("doc_id", (F.col("at") - 1).cast("long").alias("pos"), F.expr("substring(text, at)").alias("suf"))
