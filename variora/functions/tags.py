"""Tag sets: positional morphology tags, part-of-speech conversion, verse numbers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from variora.functions.text import strip_accents

# Fixed values.
PERSON = {"1": "first", "2": "second", "3": "third"}
TENSE = {"P": "present", "I": "imperfect", "F": "future", "A": "aorist", "X": "perfect", "Y": "pluperfect"}
VOICE = {"A": "active", "M": "middle", "P": "passive"}
MOOD = {"I": "indicative", "D": "imperative", "S": "subjunctive", "O": "optative", "N": "infinitive", "P": "participle"}
CASE = {"N": "nominative", "G": "genitive", "D": "dative", "A": "accusative", "V": "vocative"}
NUMBER = {"S": "singular", "P": "plural"}
GENDER = {"M": "masculine", "F": "feminine", "N": "neuter"}
DEGREE = {"C": "comparative", "S": "superlative"}
FEATURES = {"person": PERSON, "tense": TENSE, "voice": VOICE, "mood": MOOD, "case": CASE, "number": NUMBER, "gender": GENDER, "degree": DEGREE}
# Treebank tag to part-of-speech code; others are X-.
TREEBANK_POS = {
    "V-": "V-", "Nb": "N-", "Ne": "N-", "F-": "N-", "S-": "RA", "A-": "A-", "Ma": "A-", "Mo": "A-", "Ps": "A-", "Df": "D-", "Du": "D-",
    "R-": "P-", "C-": "C-", "G-": "C-", "Dq": "C-", "Pp": "RP", "Pk": "RP", "Pc": "RP", "Pr": "RR", "Pd": "RD", "Pi": "RI", "I-": "I-",
}
# Lemmas, without accents, whose code doesn't follow their tag.
LEMMA_POS = {
    "δε": "C-", "γαρ": "C-", "ουν": "C-", "μεν": "C-", "αρα": "C-", "μεντοι": "C-", "διο": "C-", "δη": "X-", "αν": "X-", "γε": "X-",
    "ιδου": "X-", "αμην": "X-", "ναι": "X-", "κυρηναιος": "N-", "κορινθιος": "N-", "χηρα": "A-",
}
# Short names of books.
BOOKS = {
    "Matt": "Matthew", "Mt": "Matthew", "Matthew": "Matthew", "Mark": "Mark", "Mk": "Mark", "Marc": "Mark", "Luke": "Luke", "Lk": "Luke",
    "Luk": "Luke", "John": "John", "Jn": "John"
}


def lookup(x: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain(*table.items())))[x], F.lit(None).cast("string") if otherwise is None else otherwise)


def part_of_speech(tag: Column, lemma: Column, overrides: dict[str, str] = LEMMA_POS) -> Column:
    """A treebank tag's code: by lemma first, then by tag; Px is RI for τις and A- else."""
    bare = strip_accents(lemma)
    by_tag = F.when(tag == "Px", F.when(bare == "τις", "RI").otherwise("A-")).otherwise(lookup(tag, TREEBANK_POS, F.lit("X-")))
    return lookup(bare, overrides, by_tag) if overrides else by_tag


def morphology(tag: Column) -> Column:
    """MAP<feature, value> of an eight-place tag; unknown places are left out."""
    entries = [F.struct(F.lit(name).alias("k"), lookup(F.substring(tag, i + 1, 1), table).alias("v")) for i, (name, table) in enumerate(FEATURES.items())]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def verse_span(ref: Column, books: dict[str, str] = BOOKS) -> Column:
    """struct(book, first, last) of ``Mk 6:45-50``, verses as chapter * 1000 + verse; null where
    it isn't a reference."""
    pattern = r"(?U)^\s*(\w+)\s+([0-9]+):([0-9]+)(?:-([0-9]+))?"
    part = lambda i: F.nullif(F.regexp_extract(ref, pattern, i), F.lit(""))
    at = lambda v: part(2).cast("int") * 1000 + v.cast("int")
    return F.when(
        ref.rlike(pattern),
        F.struct(lookup(part(1), books, part(1)).alias("book"), at(part(3)).alias("first"), at(F.coalesce(part(4), part(3))).alias("last"))
    )
