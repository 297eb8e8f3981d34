"""Labels, names and digests as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from variora.functions.tags import lookup
from variora.functions.text import alignment_key, is_greek, strip, strip_accents, words

# Fixed values.
POS_LABELS = {
    "subs": "noun", "noun": "noun", "verb": "verb", "art": "article", "adj": "adjective", "adv": "adverb", "prep": "preposition", "conj": "conjunction",
    "pron": "pronoun", "ptcl": "particle", "prt": "particle", "intj": "interjection", "num": "numeral", "det": "determiner", "advb": "adverb", "x": "other",
}
PERSON_LABELS = {
    "p1": "1st person", "p2": "2nd person", "p3": "3rd person", "first": "1st person", "second": "2nd person", "third": "3rd person",
    "1": "1st person", "2": "2nd person", "3": "3rd person",
}
POS_CODES = {
    "A-": "adjective", "C-": "conjunction", "D-": "adverb", "I-": "interjection", "N-": "noun", "P-": "preposition", "RA": "definite article",
    "RD": "demonstrative pronoun", "RI": "interrogative/indefinite pronoun", "RP": "personal pronoun", "RR": "relative pronoun", "V-": "verb", "X-": "particle",
}
BOOK_ALIASES = {
    "matt": "Matthew", "mt": "Matthew", "mk": "Mark", "mrk": "Mark", "lk": "Luke", "luk": "Luke", "jn": "John", "jhn": "John", "rom": "Romans", "gal": "Galatians",
    "eph": "Ephesians", "php": "Philippians", "phil": "Philippians", "col": "Colossians", "heb": "Hebrews", "jas": "James", "rev": "Revelation", "apoc": "Revelation",
}
#: Numbers and abbreviations of books in morphology files.
BOOK_NUMBERS = {"01": "Matthew", "02": "Mark", "03": "Luke", "04": "John"}
BOOK_ABBREVIATIONS = {"MAT": "Matthew", "MRK": "Mark", "LUK": "Luke", "JHN": "John"}


def greek_words(x: Column) -> Column:
    """The words that hold a Greek letter."""
    return F.filter(words(x), is_greek)


def canonical_book(x: Column, books: list[str], aliases: dict[str, str] = BOOK_ALIASES) -> Column:
    """A book's own spelling, whatever accents and case or alias it is asked by; others pass."""
    key = strip(strip_accents(x))
    bare = {_bare(b): b for b in books}
    known = {alias: book for alias, book in aliases.items() if _bare(book) in bare}
    return F.coalesce(lookup(key, {**known, **bare}), x)


def _bare(x: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower()


def format_range(c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """``c:v``, ``c:v-v2`` or ``c:v-c2:v2``."""
    start = F.concat(c1.cast("string"), F.lit(":"), v1.cast("string"))
    across = F.concat(F.lit("-"), c2.cast("string"), F.lit(":"), v2.cast("string"))
    end = F.when((c1 == c2) & (v1 == v2), F.lit("")).when(c1 == c2, F.concat(F.lit("-"), v2.cast("string"))).otherwise(across)
    return F.concat(start, end)


def pos_label(x: Column) -> Column:
    """A reader's word for an edition's part of speech; unknown codes pass."""
    return F.coalesce(lookup(F.lower(x), POS_LABELS), x)


def feature_value(feature: str, x: Column) -> Column:
    """A feature's value for display: persons become ordinals, others pass."""
    return F.coalesce(lookup(F.lower(x), PERSON_LABELS), x) if feature == "person" else x


def code_label(x: Column) -> Column:
    """A two-place code's word, also for a code without its hyphen; unknown codes pass."""
    code = F.upper(x)
    return F.coalesce(lookup(code, POS_CODES), lookup(F.rpad(code, 2, "-"), POS_CODES), x)


def expand_tag(x: Column, full: dict[str, str]) -> Column:
    """The full tag of a compact one; unknown ones in upper case."""
    return F.coalesce(lookup(F.upper(x), full), F.upper(x))


def register_of(source: Column) -> Column:
    return F.when(F.lower(source).rlike("lxx|septuagint|fathers|josephus|apostolic"), "koine").otherwise("classical")


def is_testament(source: Column) -> Column:
    """Whether a sentence's source is the New Testament."""
    return F.coalesce(F.lower(source).contains("new testament"), F.lit(False))


def stratum(tradition: Column, genre: Column) -> Column:
    return F.concat_ws("_", tradition, genre)


def token_key(lemma: Column, normalized: Column, pos: Column) -> Column:
    """struct(lemma, pos, normalized): what tokens are aligned by; an empty lemma gives way to
    the normalised form."""
    own = F.when(F.coalesce(lemma, F.lit("")) != "", lemma).otherwise(F.coalesce(normalized, F.lit("")))
    return F.struct(alignment_key(own).alias("lemma"), F.coalesce(pos, F.lit("")).alias("pos"), F.coalesce(normalized, F.lit("")).alias("normalized"))


def read_text(analysed: Column) -> Column:
    """The running text of ARRAY<struct(surface, after)>."""
    return strip(F.array_join(F.transform(analysed, lambda w: F.concat(w["surface"], F.coalesce(w["after"], F.lit("")))), ""))


def bare_form(x: Column) -> Column:
    """A form without accents and without signs at its end."""
    return strip_accents(F.rtrim(x, F.lit(",.:;·!?()")))


def canonical(value) -> str:
    """A value as JSON with sorted keys, without spaces; paths as text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def digest(value) -> str:
    """The hash of a configuration or of another small value: of its canonical JSON."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def fingerprint(config: dict) -> str:
    """Twelve hexadecimal digits that name a run."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def list_digest(x: Column) -> Column:
    """``digest`` of an array of strings, sorted."""
    return F.sha2(F.to_json(F.array_sort(x)), 256)


def plan_digest(assignment: Column, n_folds: int, seed: str) -> Column:
    """``digest`` of a fold plan; assignment: MAP<id, fold>."""
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries(assignment)))
    return F.sha2(F.concat(F.lit('{"assignment":'), F.to_json(sorted_map), F.lit(f',"n_folds":{n_folds},"seed":{json.dumps(seed)}}}')), 256)
