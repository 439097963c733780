"""The index build as one program: a folder of strings in, result files out, in rounds of buckets of roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.operators import corpus, grouping, tree
from stringloom.operators.config import IndexConfig
from stringloom.operators.joins import merged
from stringloom.sources.durable import written
from stringloom.sources.files import read_collection, write_result


def checked_alphabet(docs: DataFrame, alphabet: int) -> DataFrame:
    """`docs`, with an error when a text has a character that is not one of the first `alphabet` code points."""
    outside = F.exists(F.split("text", ""), lambda c: F.ascii(c) >= alphabet)
    message = F.concat(F.lit(f"a character beyond the first {alphabet} in "), F.col("doc_id").cast("string"))
    return docs.withColumn("text", F.when(F.coalesce(outside, F.lit(False)), F.raise_error(message).cast("string")).otherwise(F.col("text")))


def build_rounds(suffixes: DataFrame, config: IndexConfig) -> tuple[DataFrame, DataFrame, int]:
    """(leaves that are interior prefixes, roots with their `bucket` and `iteration`, number of rounds): the roots of the cover are
    put into buckets, and a round takes as many buckets as there are partitions, so a round's working set is bounded by
    partitions times bucket budget.  `tree.leaves_of_roots` takes the roots of one round, or of all as one plan."""
    roots, inside = (written(df, "build-roots") for df in tree.interior(suffixes, config.max_count, config.start_len, config.step))
    assignment = grouping.assigned(roots.select("prefix", "cnt"), config.grouping, config.bucket_budget, config.n_partitions)
    rounds = written(merged(roots, grouping.iterations(assignment, config.n_partitions), "prefix"), "build-rounds")
    last = rounds.agg(F.max("iteration")).first()[0]
    return tree.interior_leaves(suffixes, inside), rounds, 0 if last is None else last + 1


def build(spark: SparkSession, config: IndexConfig) -> int:
    """Build the index of the strings in `config.input_dir` and write its result lines to `config.output_location`, replacing
    what is there; gives the number of rounds.  An empty folder gives an empty result."""
    docs = checked_alphabet(read_collection(spark, config.input_dir), config.alphabet)
    suffixes = corpus.suffixes(docs)
    interior, rounds, n = build_rounds(suffixes, config)
    write_result(tree.lines_of(interior), config.output_location)
    for i in range(n):
        write_result(tree.lines_of(tree.leaves_of_roots(suffixes, rounds.where(F.col("iteration") == i))), config.output_location, "append")
    return n
