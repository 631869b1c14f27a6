"""Cleaning a corpus: language ID, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of their input, further ones too, whatever their names. Ids may repeat or
be NULL, as may all columns; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.byte_bpe import token_digests
from barloom.llm.decontaminate import drop_contaminated
from barloom.llm.language_id import drop_unreadable, learned
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.ngram_join import one_of_each
from barloom.llm.queries import vocabulary
from barloom.llm.storage import fresh, own_columns, stored


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter go: no language can be told."""
    return drop_unreadable(docs, learned(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites, short ones too, stay in their first document; a document whose lines all go stays with an
    empty text."""
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    cut = dedup_lines(docs, n_lines=n_lines, n_removed=n_removed)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*own_columns(docs))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays, of rows that repeat too. Documents without words all stay."""
    return one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty stands in a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return token_digests(docs, *vocabulary())


STAGES = [("language_id", languages), ("line_dedup", lines), ("ngram_jaccard_join", copies), ("benchmark_decontamination", benchmarks), ("byte_bpe", tokens)]
#: SQL can't express the language model, MinHash classes and the merges of byte pairs; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
