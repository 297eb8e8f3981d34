"""Annotated editions as one table of words: which features hold what, lookups, model readers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variora.functions.labels import code_label, pos_label
from variora.functions.text import is_greek, words
from variora.operators.aggregates import label_index
from variora.operators.corpus import gloss_for
from variora.sources.readers import Features
from variora.storage import materialise


@dataclass(frozen=True)
class Schema:
    """An edition's feature names; of several candidates the first that the edition has is taken."""

    surface: str
    lemma: tuple[str, ...]
    gloss: tuple[str, ...]
    strong: tuple[str, ...]
    after: tuple[str, ...]
    pos: str
    features: dict[str, str] = field(default_factory=dict)


# Fixed values.
TESTAMENT = Schema(
    "text", ("lemma",), ("gloss",), ("strong",), ("trailer", "after"), "sp",
    {"person": "person", "tense": "tense", "voice": "voice", "mood": "mood", "case": "case", "gender": "gender", "number": "number", "degree": "degree"},
)
SEPTUAGINT = Schema(
    "word", ("lex", "bol_lexeme_dict", "freq_lemma"), ("gloss", "bol_gloss"), ("strongs", "strong"), ("trailer", "after"), "sp",
    {"person": "ps", "tense": "tense", "voice": "voice", "mood": "mood", "case": "case", "gender": "gn", "number": "nu", "degree": "degree"},
)


def detect(features: Features) -> Schema:
    """The edition's schema, by the feature that only one of them has."""
    return TESTAMENT if features.has("text") else SEPTUAGINT


def edition_words(features: Features, schema: Schema | None = None) -> DataFrame:
    """(book, book_number, chapter, verse, position, surface, lemma, pos, features MAP, gloss,
    strong, after, ref): every word that has a book, a chapter and a verse. Only the features
    that the schema names are read."""
    schema = schema or detect(features)
    named = {"surface": schema.surface, "sp": schema.pos}
    named |= {part: features.first_present(getattr(schema, part)) for part in ("lemma", "gloss", "strong", "after")}
    named |= {f"_{k}": v for k, v in schema.features.items() if features.has(v)}
    read = features.columns(sorted({"book", "chapter", "verse", *named.values()}))
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.col("book").alias("book"), F.col("chapter").cast("int").alias("chapter"), F.col("verse").cast("int").alias("verse")
    rows = read.where("book is not null and chapter is not null and verse is not null").select("node", *place, *[value(v).alias(k) for k, v in named.items()])
    rows = materialise(rows, "edition")
    given = [F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("v")) for k in schema.features if f"_{k}" in named]
    own = F.map_from_entries(F.filter(F.array(*given), lambda e: e["v"] != "")) if given else F.create_map().cast("map<string,string>")
    number = label_index(rows, "book", "node").select("book", F.col("index").cast("int").alias("book_number"))  # one row a book
    verse = rows.groupBy("book", "chapter", "verse").agg(F.sort_array(F.collect_list("node")).alias("_nodes"))
    place = verse.select(F.posexplode("_nodes").alias("position", "node"))
    rows = rows.join(F.broadcast(number), "book").join(place, "node")
    ref = F.concat("book", F.lit(" "), "chapter", F.lit(":"), "verse")
    after = F.when(F.col("after") == "", " ").otherwise(F.col("after"))
    return rows.select(
        "book", "book_number", "chapter", "verse", "position", "surface", "lemma", pos_label(
            F.col("sp")
        ).alias("pos"), own.alias("features"), "gloss", "strong",
        after.alias("after"), ref.alias("ref"),
    )


def analyse(
    texts: DataFrame, key: str, predict: Callable[[str, list[list[str]]], list[list[str]]], lexicon: DataFrame | None = None, text: str = "text", most: int = 80
) -> DataFrame:
    """(key, position, surface, lemma, pos, gloss, predicted): a model's analysis of the first
    ``most`` Greek words of each text.

    predict(task, lists of words) gives a list of labels for each list, for the tasks ``pos`` and
    ``lemma``. Where it gives another number of labels than words, the words are asked one by one.
    """
    asked = texts.select(F.col(key).cast("string").alias("_key"), F.slice(F.filter(words(F.col(text)), is_greek), 1, most).alias("w")).where(F.size("w") > 0)

    def aligned(task: str, lists: list[list[str]]) -> list[list[str]]:
        made = predict(task, lists)
        single = [i for i, (own, got) in enumerate(zip(lists, made)) if len(own) != len(got)]
        for i in single:
            made[i] = [" ".join(got) for got in predict(task, [[w] for w in lists[i]])]
        return made

    def run(batches):
        for part in batches:
            lists = [list(w) for w in part["w"]]
            pos = [[p.upper() for p in x] for x in aligned("pos", lists)]
            lemmas = aligned("lemma", lists)
            rows = [(k, i, *t) for k, w, l, p in zip(part["_key"], lists, lemmas, pos) for i, t in enumerate(zip(w, l, p))]
            yield pd.DataFrame(rows, columns=["_key", "position", "surface", "lemma", "pos"])

    made = asked.mapInPandas(run, "_key string, position int, surface string, lemma string, pos string")
    made = made.withColumns({"pos": code_label(F.col("pos")), "predicted": F.lit(True)}).withColumnRenamed("_key", key)
    return gloss_for(made, lexicon, "lemma", "gloss") if lexicon is not None else made.withColumn("gloss", F.lit(""))
