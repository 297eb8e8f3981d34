"""Text normalisers and string functions as column expressions.

Five normalisers differ on purpose: ``alignment_key`` folds case and accents and final sigma,
``dedup_key`` casefolds and collapses white space, ``loose`` keeps accents, ``strip_accents``
keeps final sigma, ``uncial`` shows capitals.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precomposed letters of Latin and Greek with their base letter, derived from Unicode itself.
_PRECOMPOSED = [chr(c) for a, b in ((0xC0, 0x250), (0x370, 0x400), (0x1E00, 0x2000)) for c in range(a, b)]
_PAIRS = [(c, d[0]) for c in _PRECOMPOSED if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.combining(x) for x in d[1:])]
_FROM, _TO = "".join(c for c, _ in _PAIRS), "".join(d for _, d in _PAIRS)

#: White space as Unicode has it, with the four separators of ASCII: a class of characters, for
#: patterns that begin with (?U).
SPACES = r"[\s\x1c-\x1f]"
_OTHER_SPACES = r"[\s\x1c-\x1f&&[^ ]]"
_SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Stripped from both ends of a word.
PUNCTUATION = ".,;:!?·()[]{}<>\"'«»“”‘’—–-…⸀⸁⸂⸃⸄⸅"


def drop_marks(x: Column) -> Column:
    """Base letters without combining marks (canonical decomposition, then \\p{M} dropped)."""
    bare = F.regexp_replace(F.translate(x, _FROM, _TO), r"\p{M}+", "")
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(bare)  # ASCII has none


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACE_CHARS))


def collapse(x: Column) -> Column:
    """Words parted by one blank; a single blank is never touched."""
    return F.trim(F.regexp_replace(x, f"(?U) {SPACES}+|{_OTHER_SPACES}{SPACES}*", " "))


def casefold(x: Column) -> Column:
    """Full case folding for Latin and Greek: lower case, ß to ss, final sigma to sigma."""
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def alignment_key(x: Column, movable_nu: dict[str, str] | None = None) -> Column:
    out = F.replace(drop_marks(F.lower(strip(x))), F.lit("ς"), F.lit("σ"))
    for with_nu, without in (movable_nu or {}).items():
        out = F.replace(out, F.lit(with_nu), F.lit(without))
    return out


def dedup_key(x: Column) -> Column:
    return collapse(casefold(drop_marks(x)))


def loose(x: Column) -> Column:
    return casefold(collapse(x))


def strip_accents(x: Column) -> Column:
    return F.lower(drop_marks(x))


def uncial(x: Column) -> Column:
    return F.upper(drop_marks(x))


def words(x: Column) -> Column:
    """White-space words, none for an empty text."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), f"(?U){SPACES}+"), lambda w: w != "")


def is_greek(x: Column) -> Column:
    return x.rlike("[\\u0370-\\u03ff\\u1f00-\\u1fff]")


def strip_punctuation(x: Column, chars: str = PUNCTUATION) -> Column:
    return F.btrim(x, F.lit(chars))


def is_punctuation(x: Column, chars: str = PUNCTUATION) -> Column:
    return (strip(x) != "") & (F.btrim(strip(x), F.lit(chars)) == "")


def _shingled(key: Column, n: int, made) -> Column:
    """``made`` of the words of each distinct n-gram, of all words if they are fewer."""

    def of(w):
        size = F.size(w)
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), size - n), lambda i: made(F.slice(w, i + 1, n))))
        return F.when(size == 0, F.slice(F.array(made(w)), 1, 0)).when(size < n, F.array(made(w))).otherwise(many)

    # the one-entry array binds the words, which else were split anew for each shingle
    return F.get(F.transform(F.array(words(key)), of), F.lit(0))


def shingles(key: Column, n: int = 8) -> Column:
    """Distinct word n-grams; a shorter text is one shingle, an empty one has none."""
    return _shingled(key, n, lambda w: F.array_join(w, " "))


def shingle_hashes(key: Column, n: int = 8) -> Column:
    """``xxhash64`` of each shingle."""
    return _shingled(key, n, lambda w: F.xxhash64(F.array_join(w, " ")))


def parse_reference(x: Column) -> Column:
    """struct(book, chapter, first, last) of ``1 John 1:1-3``; a bare chapter has no verses;
    null where it isn't a reference."""
    pattern = r"^\s*((?:[1-3]\s*)?[^\d:]+?)\s+(\d+)(?::(\d+)(?:\s*[-–]\s*(\d+))?)?\s*$"
    number = lambda i: F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).cast("int")
    return F.when(
        x.rlike(pattern),
        F.struct(
            F.regexp_extract(x, pattern, 1).alias("book"), number(2).alias("chapter"), number(3).alias("first"),
            F.coalesce(number(4), number(3)).alias("last")
        )
    )


def range_label(book: Column, c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """``B c:v``, ``B c:v-v2`` or ``B c:v-c2:v2``."""
    start = F.concat(book, F.lit(" "), c1.cast("string"), F.lit(":"), v1.cast("string"))
    end = F.when((c1 == c2) & (v1 == v2), F.lit("")).when(c1 == c2, F.concat(F.lit("-"), v2.cast("string"))).otherwise(
        F.concat(F.lit("-"), c2.cast("string"), F.lit(":"), v2.cast("string"))
    )
    return F.concat(start, end)


def compact_tag(x: Column) -> Column:
    """A positional tag without its padding hyphens."""
    return F.regexp_replace(x, "-+", "")


def describe_features(features: Column, order: list[str]) -> Column:
    """The features that a map has, in a fixed order, joined by a middle dot."""
    return F.array_join(F.filter(F.array(*[features[k] for k in order]), lambda v: v.isNotNull() & (v != "")), " · ")


def feats(x: Column) -> Column:
    """``A=x|B=y`` as a map; ``_`` and empty are empty maps."""
    return F.when(F.coalesce(x, F.lit("_")).isin("_", ""), F.expr("map()").cast("map<string,string>")).otherwise(F.str_to_map(x, F.lit(r"\|"), F.lit("=")))


def canonical_json(entries: Column) -> Column:
    """A map as JSON with sorted keys; entries: map column."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
