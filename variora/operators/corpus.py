"""Passages across parallel witnesses: lookups, censuses, nested records, alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variora.functions.text import strip_accents
from variora.operators import linking
from variora.operators.aggregates import classify, harvest
from variora.operators.alignment import align
from variora.operators.sampling import hash_order

# Traditions by the witnesses that hold a passage, the first that fits.
WITNESSES = ["Matthew", "Mark", "Luke"]
TRADITIONS = [
    (["Matthew", "Mark", "Luke"], "triple"), (["Matthew", "Mark"], "triple"), (["Mark", "Luke"], "triple"), (["Matthew", "Luke"], "double"),
]


def tradition(rows: DataFrame, key: str = "pericope_id", member: str = "book") -> DataFrame:
    """(key, class): by the exact set of the key's witnesses; any set not named is the third
    witness's own."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("_s"))
    cases = [*TRADITIONS, (["Matthew"], "matthean_unique"), (["Mark"], "mark_unique")]
    out = None
    for need, name in cases:
        same = F.col("_s") == F.array(*map(F.lit, sorted(need)))
        out = F.when(same, name) if out is None else out.when(same, name)
    return sets.select(key, out.otherwise("lukan_unique").alias("class"))


def members_of(ranges: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members): the sorted witnesses of each passage in a table of ranges."""
    return ranges.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))


def keys_of_class(ranges: DataFrame, key: str, member: str, cases, otherwise: str, wanted: str) -> DataFrame:
    """The sorted keys of one class."""
    return classify(ranges, key, member, cases, otherwise).where(F.col("class") == wanted).select(key).orderBy(key)


def with_default(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with a dimension's value, or the default."""
    return linking.enrich(rows, dimension, key, {value: default})


def assign_place(ranges: DataFrame, key: str, book: str, chapter: int, verse: int, cap: int = 40) -> DataFrame:
    """The first passage (in ``seq``) that holds a place; chapters before a range's last are
    taken to have ``cap`` verses. Ranges: key, seq, book, c1, v1, c2, v2."""
    near = ranges.where((F.col("book") == book) & (F.lit(chapter).between(F.col("c1"), F.col("c2"))))
    spans = linking.verse_ranges(near, cap).where((F.col("chapter") == chapter) & F.lit(verse).between(F.col("v_low"), F.col("v_high")))
    return spans.agg(F.min_by(key, "seq").alias(key))


def parallel_texts(place: DataFrame, ranges: DataFrame, tokens: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The text of every other witness of the passages that hold places (book, chapter, verse):
    (book, chapter, verse, key, other_book, text); witnesses without text there are left out."""
    found = linking.find_range(place, ranges, ["book"], ("chapter", "verse"), ("c1", "v1"), ("c2", "v2"), "seq", key).where(F.col(key).isNotNull())
    other = ranges.select(key, F.col("book").alias("other_book"), "c1", "v1", "c2", "v2", "seq")
    pairs = found.join(other, key).where(F.col("book") != F.col("other_book"))
    spans = pairs.withColumn("_c", F.explode(F.sequence("c1", "c2")))
    words = tokens.select(F.col("book").alias("other_book"), F.col("chapter").alias("_c"), F.col("verse").alias("_v"), "position", text)
    at, low, high = (F.struct(F.col(c).alias("c"), F.col(v).alias("v")) for c, v in (("_c", "_v"), ("c1", "v1"), ("c2", "v2")))
    held = spans.join(words, ["other_book", "_c"]).where((low <= at) & (at <= high))
    items = F.array_sort(F.collect_list(F.struct("_c", "_v", "position", F.col(text).alias("_t"))))
    made = held.groupBy("book", "chapter", "verse", key, "other_book").agg(F.array_join(F.transform(items, lambda x: x["_t"]), " ").alias(text))
    return made.where(F.col(text) != "")


def parallel_pairs(texts: DataFrame, alignments: DataFrame, key: str, member: str, value: str) -> DataFrame:
    """(key, a, b, value_a, value_b, pairs) for all pairs of members with text, a before b; an
    alignment filed as (b, a) is turned round, one that is missing is empty."""
    pairs = linking.unordered_pairs(texts.where(F.length(value) > 0), key, member, value)
    flipped = F.transform("pairs", lambda p: F.struct(p["idx_b"].alias("idx_a"), p["idx_a"].alias("idx_b")))
    either = alignments.select(
        key, F.least("book_a", "book_b").alias("a"), F.greatest("book_a", "book_b").alias("b"), F.col("book_a") > F.col("book_b"),
        F.when(F.col("book_a") > F.col("book_b"), flipped).otherwise(F.col("pairs")).alias("pairs")
    )
    either = either.toDF(key, "a", "b", "_turned", "pairs").groupBy(key, "a", "b").agg(F.min_by("pairs", "_turned").alias("pairs"))
    joined = pairs.join(either, [key, "a", "b"], "left")
    return joined.withColumn("pairs", F.coalesce("pairs", F.slice(F.array(F.struct(F.lit(0).alias("idx_a"), F.lit(0).alias("idx_b"))), 1, 0)))


def align_passages(tokens: DataFrame, key: str, member: str, order: list[str], what: Column) -> DataFrame:
    """(key, book_a, book_b, pairs) of all pairs of members within each key, aligned on ``what``;
    rows without key are left out."""
    own = tokens.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_w", what)
    lists = own.groupBy(key, member).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("_w").cast("string").alias("_w")))).alias("_l"))
    lists = lists.select(key, member, F.transform("_l", lambda x: x["_w"]).alias("_l"))
    pairs = linking.unordered_pairs(lists, key, member, "_l")
    made = align(pairs, [key, "a", "b"], "value_a", "value_b")
    return made.withColumnsRenamed({"a": "book_a", "b": "book_b"})


def nested_passages(tokens: DataFrame, alignments: DataFrame, classes: DataFrame, genres: DataFrame, order: list[str], value: str) -> DataFrame:
    """One record a passage: pericope_id, tradition, genre, books, tokens MAP<book, ARRAY> and
    alignment MAP<'a|b', pairs>, in the order of ids; tokens without passage are left out."""
    key = "pericope_id"
    own = tokens.where(F.coalesce(F.col(key), F.lit("")) != "")
    lists = own.groupBy(key, "book").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_l"))
    entry = F.struct("book", F.transform("_l", lambda x: x["_v"]))
    books = lists.groupBy(key).agg(F.array_sort(F.collect_list("book")).alias("books"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tokens"))
    named = F.struct(F.concat_ws("|", "book_a", "book_b"), "pairs")
    pairs = alignments.groupBy(key).agg(F.map_from_entries(F.collect_list(named)).alias("alignment"))
    out = books.join(classes.withColumnRenamed("class", "tradition"), key, "left").join(pairs, key, "left")
    return with_default(out, genres, key, "genre", "other").orderBy(key)


def lexicon(words: DataFrame, lemma: str, gloss: str, order: str) -> DataFrame:
    """(key, gloss): the first non-empty gloss of each accent-stripped lemma; empty lemmas go."""
    keyed = words.where(F.coalesce(F.col(lemma), F.lit("")) != "").withColumn("key", strip_accents(F.col(lemma)))
    return harvest(keyed, "key", gloss, order)


def gloss_for(rows: DataFrame, lexicon_: DataFrame, lemma: str, gloss: str) -> DataFrame:
    """rows with the gloss of their lemma, whatever its accents; empty without one."""
    keyed = rows.withColumn("_key", strip_accents(F.col(lemma)))
    joined = keyed.join(lexicon_.select(F.col("key").alias("_key"), F.col(gloss).alias("_g")), "_key", "left")
    return joined.withColumn(gloss, F.coalesce("_g", F.lit(""))).drop("_key", "_g")


def zip_features(slots: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """slots (node) with one column a sparse feature (node, value); a missing value is empty."""
    for name, feature in features.items():
        slots = slots.join(feature.select("node", F.col("value").alias(name)), "node", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return slots


def two_witness_units(tokens: DataFrame, key: str, member: str, a: str, b: str, tradition_: DataFrame, wanted: str = "double") -> DataFrame:
    """Passages of a class whose two witnesses both have words: (key, a, b) counts; punctuation
    isn't counted."""
    counts = token_counts(tokens, key, member, [a, b]).join(tradition_.where(F.col("class") == wanted).select(key), key, "left_semi")
    return counts.where((F.col(a) > 0) & (F.col(b) > 0))


def token_counts(tokens: DataFrame, key: str, member: str, members: list[str], punctuation: str | None = "is_punctuation") -> DataFrame:
    """(key, one count a member) of tokens that are no punctuation."""
    if punctuation:
        tokens = tokens.where(~F.coalesce(F.col(punctuation), F.lit(False)))
    return tokens.groupBy(key).agg(*[F.count_if(F.col(member) == m).alias(m) for m in members])


def passage_text(tokens: DataFrame, key: list[str], order: list[str], text: str = "text", punctuation: str | None = "is_punctuation") -> DataFrame:
    """(key, text): surface forms in order, without punctuation."""
    if punctuation:
        tokens = tokens.where(~F.coalesce(F.col(punctuation), F.lit(False)))
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return tokens.groupBy(*key).agg(F.array_join(F.transform(items, lambda x: x["_t"]), " ").alias(text))


def target_words(examples: DataFrame, key: str, target: Column) -> DataFrame:
    """(key, tokens): the words of all of a passage's targets."""
    return examples.groupBy(key).agg(F.sum(F.size(target)).alias("tokens"))


def census(triples: DataFrame, doubles: DataFrame, members: list[str], pair: list[str]) -> DataFrame:
    """One row of what the units hold: how many there are, their words by witness and genres by
    kind, the overlaps, the genres that the doubles have and the triples lack, and each triple's
    smallest witness. triples, doubles: pericope_id, genre, one count a witness; triples: core,
    extended too."""
    totals = lambda names: F.create_map(*[x for m in names for x in (F.lit(m), F.coalesce(F.sum(m), F.lit(0)).cast("long"))])
    genres = lambda df: df.groupBy("genre").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", "count")))).alias("g"))
    smallest = F.map_from_entries(F.array_sort(F.collect_list(F.struct("pericope_id", F.least(*members).alias("n")))))
    three = triples.agg(
        F.count("*").alias("n_triples"), totals(members).alias("triple_totals"), F.count_if("core").alias("n_core"), F.count_if("extended").alias("n_extended"),
        smallest.alias("triple_smallest"),
    )
    two = doubles.agg(F.count("*").alias("n_doubles"), totals(pair).alias("double_totals"))
    missing = doubles.select("genre").distinct().join(triples.select("genre").distinct(), "genre", "left_anti")
    missing = missing.agg(F.array_sort(F.collect_list("genre")).alias("unlearnable_genres"))
    kinds = genres(triples).withColumnRenamed("g", "triple_genres").join(genres(doubles).withColumnRenamed("g", "double_genres"))
    return three.join(two).join(kinds).join(missing)  # rows of one each


def split_counts(rows: DataFrame, splits: DataFrame, key: str, stratum: Column) -> DataFrame:
    """(split, stratum, n): keys of each stratum in each split; unknown keys are left out."""
    return rows.select(key, stratum.alias("stratum")).join(splits.select(key, "split"), key).groupBy("split", "stratum").agg(F.count("*").alias("n"))


def lemma_index(rows: DataFrame, form: Column, lemma: str, order: list[str]) -> DataFrame:
    """(form, lemmas): the distinct lemmas of each normalised form, in the order first met."""
    firsts = rows.groupBy(form.alias("form"), lemma).agg(F.min(F.struct(*order)).alias("_o"))
    items = F.array_sort(F.collect_list(F.struct("_o", F.col(lemma).alias("_l"))))
    return firsts.groupBy("form").agg(F.transform(items, lambda x: x["_l"]).alias("lemmas"))


def overlap_partition(units: DataFrame, key: str, core: list, extended: list, scope: str = "core") -> DataFrame:
    """units with ``overlap``: whether their id is in the scope's list."""
    if scope not in ("core", "extended"):
        raise ValueError(f"no such scope: {scope}")
    ids = core if scope == "core" else [*core, *extended]
    return units.withColumn("overlap", F.col(key).isin(*ids) if ids else F.lit(False))


def triple_ids(units: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """The ids of full units, of those alone that ``only`` holds."""
    return units.select(key) if only is None else units.select(key).join(only.select(key), key, "left_semi")


def group_ids(examples: DataFrame, key: str) -> DataFrame:
    return examples.select(key)


def corpus_sizes(tokens: DataFrame, pericopes: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("n_tokens")).join(pericopes.agg(F.count("*").alias("n_pericopes")))


def corpus_report(tokens: DataFrame, pericopes: DataFrame, pairs: DataFrame, tokens_between: tuple[int, int] = (45_000, 52_000), least_pericopes: int = 100, least_pairs: int = 50,
                  least_match: float = 0.70, sampled: int = 10) -> DataFrame:
    """One row of booleans that say whether a corpus is fit for use. pericopes: pericope_id,
    tradition; pairs: pericope_id, lemma_match_rate. The mean match rate is that of the pairs of
    ``sampled`` passages, the first by a hash of their ids."""
    sizes = corpus_sizes(tokens, pericopes).select(
        F.col("n_tokens").between(*tokens_between).alias("tokens_ok"), (F.col("n_pericopes") >= least_pericopes).alias("pericopes_ok")
    )
    kinds = pericopes.agg(
        (F.count_if(F.col("tradition") == "triple") > 0).alias("triples_ok"), (F.count_if(F.col("tradition") == "double") > 0).alias("doubles_ok")
    )
    triples = pericopes.where("tradition = 'triple'").select("pericope_id")
    enough = pairs.join(triples, "pericope_id", "left_semi").agg((F.count("*") >= least_pairs).alias("pairs_ok"))
    few = pairs.select("pericope_id").distinct().orderBy(hash_order("pericope_id"), "pericope_id").limit(sampled)
    match = pairs.join(few, "pericope_id", "left_semi").agg((F.coalesce(F.avg("lemma_match_rate"), F.lit(0.0)) >= least_match).alias("match_ok"))
    return sizes.join(kinds).join(enough).join(match)  # rows of one each
