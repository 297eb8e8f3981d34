"""Deduplication on normalised keys and decontamination on word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variora.functions.text import dedup_key, shingle_hashes, shingles, strip


def contamination_index(held_out: DataFrame, text: str = "text", n: int = 8) -> DataFrame:
    return held_out.select(F.explode(shingles(dedup_key(F.col(text)), n)).alias("shingle")).distinct()


def contaminated(rows: DataFrame, held_out: DataFrame, key: str, text: str = "text", n: int = 8) -> DataFrame:
    """Keys of rows that share a shingle with the held-out texts.

    Shingles meet by their 64-bit hash, and only rows with a hit are compared word by word.
    """
    index = hashed_index(held_out, text, n)
    return met(rows, index, index.select("h").distinct(), key, text, n)


def hashed_index(held_out: DataFrame, text: str = "text", n: int = 8) -> DataFrame:
    """Each shingle of the held-out texts with its hash ``h``."""
    return contamination_index(held_out, text, n).select("shingle", F.xxhash64("shingle").alias("h"))


def met(rows: DataFrame, index: DataFrame, hashes: DataFrame, key: str, text: str = "text", n: int = 8) -> DataFrame:
    """Keys of rows that share a shingle with an index (``hashed_index``) with these distinct hashes."""
    hashed = rows.select(key, F.explode(shingle_hashes(dedup_key(F.col(text)), n)).alias("h"))
    hits = hashed.join(hashes, "h", "left_semi").select(key).distinct()
    some = rows.select(key, text).join(hits, key, "left_semi")
    own = some.select(key, F.explode(shingles(dedup_key(F.col(text)), n)).alias("shingle"))
    return own.join(index.select("shingle"), "shingle", "left_semi").select(key).distinct()


def first_of_each(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Rows whose normalised text no earlier row has; empty texts are left out. ``order`` tells rows
    apart."""
    keyed = rows.select(order, F.sha2(dedup_key(F.col(text)), 256).alias("_k")).where(strip(F.coalesce(F.col(text), F.lit(""))) != "")
    firsts = keyed.groupBy("_k").agg(F.min(order).alias(order)).select(order)
    return rows.join(firsts, order, "left_semi")


def screen(rows: DataFrame, held_out: DataFrame, key: str, text: str = "text", n: int = 8) -> DataFrame:
    """Rows that are the first with their text and share no shingle with the held-out texts."""
    return first_of_each(rows, text, key).join(contaminated(rows, held_out, key, text, n), key, "left_anti")
