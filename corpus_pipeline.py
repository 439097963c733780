"""Corpus pipeline: five stages from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of `documents`.

Every stage takes null ids, null and empty texts, repeated rows, empty tables and further columns, which it keeps as they are;
what it does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import dart_minhash, decontaminate, lang_id, sentencepiece_viterbi, substring_dedup
from stringloom.llm.shared import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or explained by no language that could be learned, go; all others
    stay as they are, repeated rows as often as they occur."""
    return lang_id.known_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays, a null id being the least, in all rows that repeat its id
    and text; documents without a word are in no group and stay."""
    return dart_minhash.one_of_each(docs)


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 13 and more words that a smaller document id has are cut out of the text, and `n_chars`, where there is such a
    column, counts what is left; no document goes.  Null texts stay null, rows of one id do not cut each other."""
    cut = substring_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else cut


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark window go; null and empty texts contain none.  Repeated rows go or stay together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `piece_ids` (null for a null text, none for an empty one), their number `n_pieces`, and `round_trip`, whether decoding
    them gives the text back; input columns of these three names are replaced."""
    back = max(docs.columns, key=len) + "_decoded"
    both = sentencepiece_viterbi.encoded(docs, sentencepiece_viterbi.Vocabulary.of_model(), back_col=back)
    return both.withColumns({"n_pieces": F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long"), "round_trip": F.col(back).eqNullSafe(F.col("text"))}).drop(back)


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", one_of_each_group),
    ("substring_dedup", without_repeated_spans),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: The stages' similarity joins, automata and models have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
