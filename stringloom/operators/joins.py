"""Joins whose sides are not sized by Spark's estimate before a run.

That estimate takes an exploded row for one row and a compressed file for its rows, so that all suffixes of a small file seem
small enough to be sent to the driver and broadcast.  A hint holds before a run and in adaptive planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.sources.durable import written

#: Bytes of keys, with `ROW_BYTES` more for each row, up to which a counted table is broadcast.
LOOKUP_BYTES = 4 << 20
ROW_BYTES = 64


def merged(one: DataFrame, two: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides, whatever their estimated sizes."""
    return one.join(two.hint("merge"), on, how)


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", limit: int = LOOKUP_BYTES) -> DataFrame:
    """`rows` joined with a table of string keys by `key`.  The table is counted: a small one is broadcast, else both sides are
    shuffled.  The rows, which may be all suffixes, are never broadcast.  The table should be written, since it is read twice."""
    count = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("size")).first()
    small = count["size"] + ROW_BYTES * count["n"] <= limit
    return rows.join(table.hint("broadcast"), key, how) if small else merged(rows, table, key, how)


def narrowed(rows: DataFrame, places: DataFrame, limit: int = LOOKUP_BYTES) -> DataFrame:
    """`rows(doc_id, pos)` without those that cannot join with `places(doc_id, pos)`, before they are shuffled: of each document what
    is between its first and last place.  Where too many documents have places for a broadcast, all rows stay."""
    spans = places.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    spans = written(spans, "spans")
    if ROW_BYTES * spans.count() > limit:
        return rows
    spans = spans.select(F.col("doc_id").alias("of_doc"), "first", "last").hint("broadcast")
    return rows.join(spans, (F.col("doc_id") == F.col("of_doc")) & F.col("pos").between(F.col("first"), F.col("last")), "left_semi")
