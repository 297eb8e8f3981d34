"""Lookup plans: verses, passages and references over a token table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(
    table: DataFrame, book: str | None = None, pericope: str | None = None, splits: DataFrame | None = None, split: str | None = None,
    punctuation: bool = False
) -> DataFrame:
    """Token filter; without a split table the split isn't looked at."""
    if book is not None:
        table = table.where(F.col("book") == book)
    if pericope is not None:
        table = table.where(F.col("pericope_id") == pericope)
    if split is not None and splits is not None:
        table = table.join(splits.where(F.col("split") == split).select("pericope_id"), "pericope_id", "left_semi")
    return table if punctuation else table.where(~F.coalesce("is_punctuation", F.lit(False)))


def verse(table: DataFrame, book: str, chapter: int, verse: int) -> DataFrame:
    return passage(table, book, (chapter, verse))


def passage(table: DataFrame, book: str, start: tuple[int, int], end: tuple[int, int] | None = None) -> DataFrame:
    """Rows from start to end (chapter, verse), across chapters, in order."""
    end = end or start
    at = F.struct(F.col("chapter").cast("int").alias("c"), F.col("verse").cast("int").alias("v"))
    bound = lambda x: F.struct(F.lit(x[0]).alias("c"), F.lit(x[1]).alias("v"))
    # the plain chapter range prunes row groups; the tuple comparison is exact
    near = table.where((F.col("book") == book) & F.col("chapter").between(start[0], end[0]))
    return near.where((bound(start) <= at) & (at <= bound(end))).orderBy("chapter", "verse", "position")


def pericopes(table: DataFrame, tradition: str | None = None, genre: str | None = None, books: list[str] = ()) -> DataFrame:
    """Pericopes by tradition, genre and all of ``books``."""
    if tradition is not None:
        table = table.where(F.col("tradition") == tradition)
    if genre is not None:
        table = table.where(F.col("genre") == genre)
    return table.where(F.size(F.array_except(F.array(*map(F.lit, books)), "books")) == 0) if books else table


def read(table: DataFrame, reference: str) -> DataFrame:
    """Rows of ``Mark 1:1-3`` or, for a bare chapter, of all its verses."""
    match = re.fullmatch(r"\s*((?:[1-3]\s*)?[^\d:]+?)\s+(\d+)(?::(\d+)(?:\s*[-–]\s*(\d+))?)?\s*", reference)
    if not match:
        raise ValueError(f"not a reference: {reference!r}")
    book, chapter, first, last = match[1], int(match[2]), match[3], match[4] or match[3]
    return passage(table, book, (chapter, int(first or 0)), (chapter, int(last) if last else (1 << 31) - 1))


def books(table: DataFrame, order: str) -> DataFrame:
    """Books in the order of their first row."""
    return table.groupBy("book").agg(F.min(order).alias("_o")).orderBy("_o").select("book")


def chapters(table: DataFrame, book: str) -> DataFrame:
    return table.where(F.col("book") == book).select("chapter").distinct().orderBy("chapter")


def verses(table: DataFrame, book: str, chapter: int) -> DataFrame:
    return table.where((F.col("book") == book) & (F.col("chapter") == chapter)).select("verse").distinct().orderBy("verse")
