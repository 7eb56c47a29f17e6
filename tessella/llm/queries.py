"""The registered queries of the corpus operators, each over its whole table with production parameters.

None has SQL: each needs trained weights, random draws, hashes or recursion that DuckDB cannot express. The
tests compare them with brute force on small tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.toxicity import fit_toxicity, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.nndescent import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id")))


@query
def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.lmscore import fit_network, pseudo_likelihood

    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood(docs, fit_network(docs))


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.html import main_text, train

    return main_text(table(spark, sf_dir, "pages"), train())


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality import fit_quality, quality_rules

    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.bpe import Vocabulary, digests, encode, load_ranks

    vocabulary = Vocabulary(load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return digests(encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN), vocabulary)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.linededup import removed_lines

    return removed_lines(table(spark, sf_dir, "documents"))
