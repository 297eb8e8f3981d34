"""Writers: tables, JSON lines and documents, the reader's index, the exported data set."""

from __future__ import annotations

import gzip
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The exported columns, and the names of split folders.
TOKEN_EXPORT = [
    "token_id", "book", "chapter", "verse", "position", "text", "normalized", "lemma", "pos", "morph", "pericope_id", "tradition", "genre", "books_in_pericope",
    "is_punctuation",
]
PERICOPE_EXPORT = ["pericope_id", "tradition", "genre", "books", "n_tokens", "n_alignment_pairs", "split"]
SPLITS = {"train": "train", "val": "validation", "test": "test"}


def write_table(rows: DataFrame, path: str) -> None:
    """Parquet, put in place by Spark's commit."""
    rows.write.mode("overwrite").parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_bytes(spark: SparkSession, raw: bytes, path: str) -> None:
    """One small file on any file system that Spark reads, put in place by a rename."""
    jvm = spark._jvm
    target, partial = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, path + ".partial"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(partial, True)
    out.write(bytearray(raw))
    out.close()
    fs.delete(target, False)
    if not fs.rename(partial, target):
        raise OSError(f"can't write {path}")


def write_document(spark: SparkSession, document, path: str, zipped: bool = False) -> None:
    """One small JSON document as a file. For reports and indexes, not for data."""
    raw = json.dumps(document, ensure_ascii=False, indent=None if zipped else 2, default=str).encode()
    write_bytes(spark, gzip.compress(raw, 9) if zipped else raw, path)


def write_corpus(tokens: DataFrame, pericopes: DataFrame, path: str) -> None:
    """Token and passage tables side by side; ``books`` as JSON, as other tools read it."""
    write_table(tokens, f"{path}/tokens.parquet")
    books = pericopes.withColumn("books", F.to_json("books")) if pericopes.schema["books"].dataType.simpleString() != "string" else pericopes
    write_table(books, f"{path}/pericopes.parquet")


def enriched_tokens(tokens: DataFrame, pericopes: DataFrame, splits: DataFrame) -> DataFrame:
    """Tokens with their passage's tradition, genre and books (empty, empty and ``[]`` without one)
    and split (empty without one)."""
    books = F.to_json("books") if pericopes.schema["books"].dataType.simpleString() != "string" else F.col("books")
    dimension = pericopes.select(
        "pericope_id", "tradition", "genre", books.alias("books_in_pericope")
    ).join(splits.select("pericope_id", "split"), "pericope_id", "left")
    joined = tokens.drop("tradition", "genre").join(dimension, "pericope_id", "left")
    defaults = {"tradition": "", "genre": "", "books_in_pericope": "[]", "split": ""}
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}).select(*TOKEN_EXPORT, "split")


def pericope_export(tokens: DataFrame, pericopes: DataFrame, alignments: DataFrame, splits: DataFrame) -> DataFrame:
    """Passages with the number of their tokens and of aligned places, and their split."""
    counts = tokens.groupBy("pericope_id").agg(F.count("*").alias("n_tokens"))
    pairs = alignments.groupBy("pericope_id").agg(F.sum(F.size("pairs")).alias("n_alignment_pairs"))
    books = F.to_json("books") if pericopes.schema["books"].dataType.simpleString() != "string" else F.col("books")
    out = pericopes.withColumn("books", books).join(counts, "pericope_id", "left").join(pairs, "pericope_id", "left").join(splits, "pericope_id", "left")
    return out.na.fill(0, ["n_tokens", "n_alignment_pairs"]).na.fill("", ["split"]).select(*PERICOPE_EXPORT)


def alignment_lines(alignments: DataFrame) -> DataFrame:
    """(key, pairs): key ``id|a|b`` and the pairs as JSON, gaps as null."""
    pairs = F.transform("pairs", lambda p: F.array(p["idx_a"], p["idx_b"]))
    return alignments.select(F.concat_ws("|", "pericope_id", "book_a", "book_b").alias("key"), F.to_json(pairs).alias("pairs"))


def export_dataset(tokens: DataFrame, pericopes: DataFrame, alignments: DataFrame, splits: DataFrame, path: str) -> None:
    """One folder a split (train, validation, test) of enriched tokens, the passage table and the
    alignments; tokens without split are in none."""
    rows = enriched_tokens(tokens, pericopes, splits)
    for split, name in SPLITS.items():
        write_table(rows.where(F.col("split") == split).drop("split"), f"{path}/data/{name}.parquet")
    write_table(pericope_export(tokens, pericopes, alignments, splits), f"{path}/pericopes.parquet")
    write_jsonl(alignment_lines(alignments), f"{path}/alignments.json")


def export_checks(spark: SparkSession, path: str, tokens: DataFrame, pericopes: DataFrame, splits: DataFrame) -> DataFrame:
    """One row of booleans: no assigned token lost, every split there and not empty, ids kept,
    passages kept, alignments readable."""
    parts = {split: spark.read.parquet(f"{path}/data/{name}.parquet") for split, name in SPLITS.items()}
    counts = {split: part.count() for split, part in parts.items()}
    own = tokens.join(splits.where(F.col("split").isin(*SPLITS)).select("pericope_id"), "pericope_id", "left_semi")
    ids = None
    for part in parts.values():
        one = part.select("pericope_id")
        ids = one if ids is None else ids.unionAll(one)
    lost = own.select("pericope_id").distinct().join(ids.distinct(), "pericope_id", "left_anti").isEmpty()
    kept = spark.read.parquet(f"{path}/pericopes.parquet").count() == pericopes.count()
    readable = spark.read.schema("key string, pairs string").json(f"{path}/alignments.json").where("key is null").isEmpty()
    checks = {
        "counts_kept": sum(counts.values()) == own.count(), "splits_filled": all(counts.values()), "ids_kept": lost, "pericopes_kept": kept,
        "alignments_readable": readable
    }
    return spark.createDataFrame([tuple(checks.values())], ", ".join(f"{c} boolean" for c in checks))


def index_rows(words: DataFrame, book_order: str = "book_number") -> DataFrame:
    """(book, number, chapters MAP<chapter, MAP<verse, ARRAY<JSON word>>>) of a reader's words, one
    row a book; words as lists of surface, lemma, pos, features, gloss, strong, after."""
    word = F.to_json(
        F.array(*[F.to_json(F.col(c)) if c == "features" else F.col(c) for c in ("surface", "lemma", "pos", "features", "gloss", "strong", "after")])
    )
    one = lambda key, value: F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), value)))
    verses = words.groupBy("book", "chapter", "verse").agg(
        F.min(book_order).alias("number"), F.array_sort(F.collect_list(F.struct("position", word.alias("w")))).alias("l")
    )
    verses = verses.select("book", "number", "chapter", "verse", F.transform("l", lambda x: x["w"]).alias("w"))
    chapters = verses.groupBy("book", "chapter").agg(F.min("number").alias("number"), one("verse", F.col("w")).alias("v"))
    return chapters.groupBy("book").agg(F.min("number").alias("number"), one("chapter", F.col("v")).alias("chapters"))


def index_document(words: DataFrame, name: str) -> dict:
    """The whole index as one document, on the driver: an edition's words, some hundred thousand."""
    books = index_rows(words).orderBy("number").collect()
    plain = {
        r["book"]: {
            c: {v: [[json.loads(x) if i == 3 and x else x for i, x in enumerate(json.loads(w))] for w in ws] for v, ws in vs.items()} for c,
            vs in r["chapters"].items()
        } for r in books
    }
    return {"schema": 1, "name": name, "book_order": [r["book"] for r in books], "books": plain}


def save_index(words: DataFrame, name: str, path: str) -> None:
    """The index document, gzipped, for other tools; ``save_index_table`` is what Spark reads."""
    write_document(words.sparkSession, index_document(words, name), path, zipped=True)


def save_index_table(words: DataFrame, path: str) -> None:
    words.write.mode("overwrite").partitionBy("book").parquet(path)


def report(rows: DataFrame) -> dict:
    """A one-row table as a document."""
    return rows.first().asDict(recursive=True)


def report_markdown(title: str, rows: DataFrame) -> str:
    """A small report table as Markdown; for one-row verdicts and censuses, not for data."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]])


class JsonLines(logging.Formatter):
    """Log records as JSON lines: time, level, name, message and what ``extra`` added."""

    _own = set(logging.LogRecord("", 0, "", 0, "", (), None).__dict__) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        said = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        said |= {k: v for k, v in record.__dict__.items() if k not in self._own}
        if record.exc_info:
            said["exception"] = self.formatException(record.exc_info)
        return json.dumps(said, ensure_ascii=False, default=str)
