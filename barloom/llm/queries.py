"""The registered query of each operator, and its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_language_id")
def language(spark, sf_dir):
    from barloom.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def decontamination(spark, sf_dir):
    from barloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op9_byte_bpe")
def byte_bpe(spark, sf_dir):
    from barloom.llm.byte_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), *vocabulary())


_TOP = """
WITH whole AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 20
"""


@query("op10_exact_topk", _TOP)
def topk(spark, sf_dir):
    from barloom.llm.exact_topk import every, top_k, whole_vectors

    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, every(vectors, 20))


from barloom.llm import collocations, line_dedup, quality_rules, quotations, spelling_variants  # noqa: E402


@query("op3_line_dedup", line_dedup.SQL)
def lines(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_quotation_linking", quotations.SQL)
def quotes(spark, sf_dir):
    return quotations.link_quotes(table(spark, sf_dir, "conversations"))


@query("op5_main_text")
def main_text(spark, sf_dir):
    from barloom.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op7_private_data")
def private_data(spark, sf_dir):
    from barloom.llm.private_data import find_private, learn

    docs = table(spark, sf_dir, "documents")
    return find_private(docs, learn(docs))


@query("op8_suffix_array_dedup")
def substrings(spark, sf_dir):
    from barloom.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op2_ngram_jaccard_join")
def near_duplicates(spark, sf_dir):
    from barloom.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_quality_rules", quality_rules.SQL)
def quality(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants", spelling_variants.SQL)
def spelling(spark, sf_dir):
    return spelling_variants.spelling(table(spark, sf_dir, "documents"), damage=spelling_variants.DAMAGE)


@query("op13_collocations", collocations.SQL)
def phrases(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
