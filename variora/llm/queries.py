"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variora.llm import bm25_search, decontaminate, jaccard_join, language_id, language_model, quality, sentencepiece_codec, suffix_dedup, token_counts, url_filter
from variora.llm.common import crc_mod


#: Rows in one Arrow batch: texts are long, and batches are held on both sides.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trie = language_model.train(docs.where(crc_mod("doc_id", 10) != 0))
    scored = language_model.score(docs, trie)
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_model())


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), "digest")


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, language_id.not_held_out())
    return language_id.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_bm25_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bm25_search.search(docs, docs.where("doc_id % 100 = 0"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model(), "digest")


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_lm_score, op3_token_counts, op4_suffix_dedup, op5_language_id, op6_bm25_search, op7_decontaminate, op8_sentencepiece, op9_ngram_jaccard, op10_quality,
)}

ORACLE_SQL = {
    "op1_url_filter": url_filter.oracle_sql(), "op4_suffix_dedup": suffix_dedup.oracle_sql(), "op6_bm25_search": bm25_search.oracle_sql(),
    "op9_ngram_jaccard": jaccard_join.oracle_sql(),
}
