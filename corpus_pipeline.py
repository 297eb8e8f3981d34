"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Its result
is written to the shared folder and read again before the next begins. Columns other than
doc_id and text pass through all stages but the last, whatever their names and nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variora.llm import decontaminate, jaccard_join, quality, sentencepiece_codec, suffix_dedup
from variora.llm.common import materialise, own_columns, without
from variora.llm.queries import piece_model, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.3 or more).

    Every row is judged by its own text, repeated ids and rows without id too. A null or empty
    text is judged as a text without words. Without labels, or with those of one class alone,
    all rows have that class's score (0.5 without labels).
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model).where("predicted = 1")
    return scored.select(*own_columns(scored)[: len(docs.columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the
    one with the smallest id.

    Rows without id, and null or wordless texts, stay. Rows that share an id are linked each by
    its own text; they go together, where any of them is linked to a smaller id.
    """
    groups = jaccard_join.join_components(docs, jaccard_join.Rule(words=5, percent=80))
    return without(docs, groups.where("component_id <> doc_id").select("doc_id"), "near-duplicates")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages of 100 bytes that an earlier document or an
    earlier place has; a character that lost a byte goes whole. ``n_chars``, if there, follows.

    A null text becomes empty. Rows without id come first; rows that share an id are documents
    of their own unless their texts are equal, which then repeat nothing in each other.
    """
    docs = suffix_dedup.remove_repeats(docs, "text")
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Every row is judged by its own text, repeated ids and rows without id too. Null and wordless
    texts hold none; null and wordless items are held by none.
    """
    keyed = docs.withColumn("_leak_text", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    leaks = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_column="_leak_text")
    return without(keyed, leaks.select("_leak_text"), "leaks", "_leak_text").drop("_leak_text")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the end of the last
    piece's source span: one row for each document. A null or empty text has no ids."""
    return sentencepiece_codec.encode_documents(docs, piece_model(), "digest")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: A trained network, alignments and byte pieces can't be said in SQL; tests/llm/test_pipeline.py
#: holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
