"""Task pools, draws from them, length filters, packing, normalisation noise, corpus build."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variora.functions.labels import bare_form, register_of
from variora.functions.text import strip_accents, words
from variora.operators import examples, order, sampling, screening
from variora.operators.linking import numbered
from variora.storage import materialise

# Contracted words, without accents, and what they stand for; vowels that are
# written for others; shares.
CRASIS = {
    "καγω": "καὶ ἐγὼ", "καν": "καὶ ἐάν", "κακει": "καὶ ἐκεῖ", "κακειθεν": "καὶ ἐκεῖθεν", "κακεινος": "καὶ ἐκεῖνος", "κακεινοι": "καὶ ἐκεῖνοι",
    "καμοι": "καὶ ἐμοὶ", "καμε": "καὶ ἐμὲ", "τουναντιον": "τὸ ἐναντίον", "κακεινους": "καὶ ἐκείνους", "τουνομα": "τὸ ὄνομα",
}
ITACISMS = [("ει", "ι"), ("η", "ι"), ("οι", "υ"), ("αι", "ε"), ("ω", "ο")]
EDIT_RATE, LEAST_EDITS = 0.40, 2
EXEMPT = ["denoise", "pos", "synoptic"]

POOL_COLUMNS = ["task", "input_text", "target_text", "source", "register"]


def union_pools(pools: dict[str, DataFrame]) -> DataFrame:
    """One table of all tasks' examples (POOL_COLUMNS; missing ones are null). An empty source
    gives an empty pool."""
    out = None
    for task, rows in pools.items():
        rows = rows.withColumn("task", F.lit(task))
        for c in POOL_COLUMNS:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        rows = rows.select(*[F.col(c).cast("string").alias(c) for c in POOL_COLUMNS])
        out = rows if out is None else out.unionAll(rows)
    return out


def annotated_pools(tokens: DataFrame, key: str, order_by: list[str], form: str, pos: str, lemma: str, morph: str | None = None) -> dict[str, DataFrame]:
    """pos, lemma, denoise and, with ``morph``, morphology examples of annotated sentences, the
    task's name before the text."""
    labels = {"pos": pos, "lemma": lemma} | ({"morphology": morph} if morph else {})
    made = examples.annotated_examples(tokens, key, order_by, form, labels)
    said = F.concat("task", F.lit(": "), "input_text")
    pools = {task: made.where(F.col("task") == task).select(said.alias("input_text"), "target_text") for task in labels}
    return pools | {"denoise": made.where("task = 'raw'").select(F.col("input_text"))}


def task_pools(sentences: list[DataFrame], pairs: DataFrame | None, lexicon: DataFrame | None, seed: int = 42) -> DataFrame:
    """The seven pools: pos, lemma, morphology, denoise of annotated sentences (tables of key,
    position, form, pos, lemma, morph), synoptic pairs, and normalise and restore examples made
    from all their texts."""
    parts = [annotated_pools(s, "key", ["position"], "form", "pos", "lemma", "morph") for s in sentences]
    pools = {task: _union([p[task] for p in parts]) for task in ("pos", "lemma", "morphology", "denoise")}
    raw = pools["denoise"].select(F.col("input_text").alias("text"))
    pools["normalize"] = normalise_examples(raw, lexicon, seed=seed).select("input_text", "target_text")
    pools["restore"] = examples.restoration_examples(raw).select("input_text", "target_text")
    if pairs is not None:
        pools["synoptic"] = pairs
    return union_pools(pools)


def register_pools(sentences: list[DataFrame], pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """The five pools: pos, lemma and synoptic, and denoise and continuation by register; corpus:
    task, input_text, target_text, source, register, the register taken from the source if null."""
    parts = [annotated_pools(s, "key", ["position"], "form", "pos", "lemma") for s in sentences]
    own = corpus.withColumn("register", F.coalesce("register", register_of(F.col("source"))))
    denoise = _union([p["denoise"].withColumn("register", F.lit("koine")) for p in parts])
    pools = {"pos": _union([p["pos"] for p in parts]), "lemma": _union([p["lemma"] for p in parts]), "synoptic": pairs}
    generative = own.where("task in ('denoise', 'continuation')").select(*POOL_COLUMNS)
    return union_pools(pools | {"denoise": denoise}).unionAll(generative)


def four_pools(sentences: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """The four pools: pos, lemma, synoptic, denoise."""
    parts = [annotated_pools(s, "key", ["position"], "form", "pos", "lemma") for s in sentences]
    return union_pools({task: _union([p[task] for p in parts]) for task in ("pos", "lemma", "denoise")} | {"synoptic": pairs})


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neutral_mask(one: Column, two: Column) -> Column:
    """Array of booleans: where two conventions give a word the same tag."""
    return F.zip_with(one, two, lambda a, b: a.eqNullSafe(b))


def drop_overlong(rows: DataFrame, most: int, input_size: Column, target_size: Column, exempt: list[str] = ("denoise",)) -> DataFrame:
    """rows whose input and target have ``most`` tokens or fewer; exempt tasks stay whole."""
    return rows.where(F.col("task").isin(*exempt) | ((input_size <= most) & (target_size <= most)))


def overlong_report(rows: DataFrame, most: int, input_size: Column, target_size: Column, exempt: list[str] = ("denoise",)) -> DataFrame:
    """(task, n, dropped) of ``drop_overlong``."""
    over = ~F.col("task").isin(*exempt) & ((input_size > most) | (target_size > most))
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.count_if(over).alias("dropped"))


def truncate(rows: DataFrame, most: int, tokens: str) -> DataFrame:
    """rows with their arrays cut to ``most`` tokens, as the variants do that keep long examples."""
    return rows.withColumn(tokens, F.slice(tokens, 1, most))


def held_out_tasks(rows: DataFrame, key: str, k: int, seed: str = "7") -> DataFrame:
    """rows with ``held`` and, for held ones, the task's name taken off the text and ``gold``:
    the target's words, lower case but for morphology, which is upper case."""
    marked = sampling.hold_out(rows, key, "task", k, seed, EXEMPT)
    fold = F.when(F.col("task") == "morphology", F.upper("target_text")).otherwise(F.lower("target_text"))
    prefix = F.concat("task", F.lit(": "))
    text = F.when(F.startswith("input_text", prefix), F.expr("substr(input_text, length(task) + 3)")).otherwise(F.col("input_text"))
    return marked.withColumns({"text": F.when(F.col("held"), text), "gold": F.when(F.col("held"), words(fold))})


def register_draws(pools: DataFrame, weights: dict[str, float], registers: dict[str, float], slots: DataFrame, slot: str, seed: str = "42") -> DataFrame:
    """(slot, task, register, item): a task by weight for each slot, then, where its examples have
    registers, one of these by weight, then an item. pools: (task, register, n), a row a pool;
    empty ones, and tasks without weight, don't count."""
    given = pools.where(F.col("n") > 0)
    by_task = given.groupBy("task").agg(F.sum("n").alias("n")).withColumn("w", _weight("task", weights)).where("w > 0")
    tasks = sampling.draws(by_task, "task", "w", "n", slots, slot, seed).select(slot, F.col("pool").alias("task"))
    both = given.withColumn("w", F.coalesce(_weight("register", registers), F.lit(1.0)))
    band = Window.partitionBy("task").orderBy(F.col("register").asc_nulls_first())  # one row a pool
    share = both.withColumn("_high", F.sum("w").over(band) / F.sum("w").over(Window.partitionBy("task")))
    bands = share.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("_high", "register", "n"))).alias("_b"))
    drawn = tasks.join(bands, "task")
    u = sampling.uniform(slot, F.lit("register"), seed=seed)
    chosen = F.coalesce(F.get(F.filter("_b", lambda b: b["_high"] > u), F.lit(0)), F.element_at("_b", -1))
    item = F.floor(sampling.uniform(slot, F.lit("within"), seed=seed) * F.col("_c.n")).cast("long")
    return drawn.withColumn("_c", chosen).select(slot, "task", F.col("_c.register").alias("register"), item.alias("item"))


def _weight(column: str, weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col(column)]


def pack(rows: DataFrame, order_by: str, tokens: str, size: int = 512, least: int = 8) -> DataFrame:
    """(sequence, tokens): all tokens in order, cut into runs of ``size``; a last run of fewer
    than ``least`` goes. Every row's place among all tokens comes from numbered parts, and its
    tokens go to the sequences they belong to."""
    sized = materialise(numbered(rows.select(order_by, F.size(tokens).cast("long").alias("_n")), [order_by], "_r"), "sizes")
    width = F.lit(100_000)
    part = F.floor(F.col("_r") / width)
    sums = sized.groupBy(part.alias("_p")).agg(F.sum("_n").alias("_s"))
    before = sums.withColumn("_b", F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).select("_p", "_b")  # a row for 100,000 rows
    inside = F.sum("_n").over(Window.partitionBy("_p").orderBy("_r")) - F.col("_n")
    placed = sized.withColumn("_p", part).withColumn("_in", inside).join(before, "_p").select(order_by, (F.col("_in") + F.col("_b")).alias("_at"))
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.size(tokens) - 1) / size)
    cut = rows.join(placed, order_by).where(F.size(tokens) > 0).withColumn("sequence", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("sequence") * size - F.col("_at"))
    end = F.least(F.size(tokens).cast("long"), (F.col("sequence") + 1) * size - F.col("_at"))
    piece = F.slice(tokens, (begin + 1).cast("int"), (end - begin).cast("int"))
    items = F.array_sort(F.collect_list(F.struct("_at", piece.alias("_t"))))
    return cut.groupBy("sequence").agg(F.flatten(F.transform(items, lambda x: x["_t"])).alias("tokens")).where(F.size("tokens") >= least)


def mask_tokens(rows: DataFrame, key: str, tokens: str, share: float = 0.15, mask: int = 4, seed: str = "42") -> DataFrame:
    """rows with ``input_ids``: ``max(1, floor(n * share))`` of the tokens replaced by ``mask``,
    those whose place has the smallest hash, and ``labels``: the tokens."""
    kind = rows.schema[tokens].dataType.elementType
    n = F.greatest(F.lit(1), F.floor(F.size(tokens) * share).cast("int"))
    hashes = F.transform(F.col(tokens), lambda _, i: F.xxhash64(F.lit(seed), F.col(key), i))
    # the one-entry arrays bind the hashes and the largest that is hidden
    drawn = F.transform(F.array(F.struct(hashes.alias("h"))), lambda b: F.struct(b["h"].alias("h"), F.get(F.array_sort(b["h"]), n - 1).alias("last")))
    hidden = F.transform(drawn, lambda b: F.zip_with(F.col(tokens), b["h"], lambda x, h: F.when(h <= b["last"], F.lit(mask).cast(kind)).otherwise(x)))
    return rows.withColumns({"input_ids": F.when(F.size(tokens) > 0, F.get(hidden, F.lit(0))).otherwise(F.col(tokens)), "labels": F.col(tokens)})


def label_ids(tokens: DataFrame, key: list[str], order_by: list[str], text: str, label: str, size: int = 128, pad: int = -100) -> DataFrame:
    """(key, text, labels): each verse's text and its words' label numbers, padded to ``size``.
    Labels are numbered from 0 by first appearance in these rows; an empty one is ``pad``."""
    from variora.operators.aggregates import label_index

    some = tokens.where(F.coalesce(F.col(label), F.lit("")) != "").withColumn("_o", F.struct(*key, *order_by))
    index = label_index(some, label, "_o").select(F.col(label).alias("_label"), F.col("index").cast("int").alias("_i"))
    joined = tokens.join(index, tokens[label] == index["_label"], "left")
    items = F.array_sort(F.collect_list(F.struct(*order_by, F.col(text).alias("_t"), F.coalesce("_i", F.lit(pad)).alias("_i"))))
    made = joined.groupBy(*key).agg(items.alias("_l"))
    padded = F.slice(F.concat(F.transform("_l", lambda x: x["_i"]), F.array_repeat(F.lit(pad), size)), 1, size)
    return made.select(*key, F.array_join(F.transform("_l", lambda x: x["_t"]), " ").alias("text"), padded.alias("labels"))


def attested_forms(tokens: DataFrame, form: str) -> DataFrame:
    """(form): the distinct forms without accents and signs at their ends."""
    return tokens.select(bare_form(F.col(form)).alias("form")).distinct()


def crasis_examples(rows: DataFrame, text: str = "text", forms: dict[str, str] = CRASIS) -> DataFrame:
    """rows with input_text and target_text: texts with a contracted word, and the same with the
    first of these written out."""
    w = words(F.col(text))
    known = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    rows = rows.withColumn("_w", w).withColumn("_x", F.transform("_w", lambda x: known[bare_form(x)]))
    at = F.array_position(F.transform("_x", lambda x: x.isNotNull()), True)
    rows = rows.withColumn("_at", at).where("_at > 0")
    target = F.zip_with("_w", F.transform("_x", lambda x, i: F.when(i == F.col("_at") - 1, x)), lambda own, new: F.coalesce(new, own))
    return rows.withColumns({"input_text": F.concat(F.lit("normalize: "), F.col(text)), "target_text": F.array_join(target, " ")}).drop("_w", "_x", "_at")


def itacism_examples(
    rows: DataFrame, text: str, key: str, attested: DataFrame | None, seed: int = 42, rate: float = EDIT_RATE, least: int = LEAST_EDITS
) -> DataFrame:
    """rows with input_text and target_text: up to ``max(least, floor(rate * words))`` words with a
    vowel written as it sounds, and the text. A changed word that is itself attested isn't taken.

    Every word's possible changes are listed and tested by a join with the attested forms, and a
    hash of seed, key, place and change orders words and, within a word, changes."""
    split = rows.select(F.col(key).alias("_k"), F.posexplode(words(F.col(text))).alias("_i", "_w"))
    made = F.array(
        *[
            F.struct(F.lit(j).alias("j"), F.col("_w").contains(a).alias("has"), _replace_first(F.col("_w"), a, b).alias("new")) for j,
            (a, b) in enumerate(ITACISMS)
        ]
    )
    tried = split.select("_k", "_i", F.explode(F.filter(made, lambda x: x["has"])).alias("x")).select("_k", "_i", "x.j", "x.new")
    tried = tried.withColumn("form", strip_accents(F.col("new")))
    if attested is not None:
        tried = tried.join(attested, "form", "left_anti")
    rank = lambda *parts: sampling.hash_order("_k", *parts, seed=str(seed))
    each = tried.groupBy("_k", "_i").agg(F.min_by("new", rank("_i", "j")).alias("_new"))
    sized = rows.withColumn("_n", F.size(words(F.col(text)))).select(
        F.col(key).alias("_k"), F.greatest(F.lit(least), F.floor(F.col("_n") * rate)).alias("_budget")
    )
    chosen = each.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(rank("_i").alias("h"), "_i", "_new"))).alias("_c")).join(sized, "_k")
    chosen = chosen.select(
        "_k",
        F.map_from_entries(F.transform(F.slice("_c", F.lit(1), F.col("_budget").cast("int")), lambda x: F.struct(x["_i"], x["_new"]))).alias("_edits")
    )
    out = rows.join(chosen, rows[key] == chosen["_k"])
    changed = F.transform(words(F.col(text)), lambda w, i: F.coalesce(F.col("_edits")[i], w))
    return out.withColumns({"input_text": F.concat(F.lit("normalize: "), F.array_join(changed, " ")), "target_text": F.col(text)}).drop("_k", "_edits")


def _replace_first(x: Column, old: str, new: str) -> Column:
    at = F.instr(x, old)
    return F.concat(F.substring(x, F.lit(1), at - 1), F.lit(new), F.substring(x, at + len(old), F.length(x)))


def normalise_examples(rows: DataFrame, attested: DataFrame | None, text: str = "text", share: float = 1.0, seed: int = 42) -> DataFrame:
    """Contracted words written out where a text has one, else vowels to be set right, for a
    ``share`` of the texts by their hash. Equal texts give one example each."""
    distinct = rows.select(text).distinct().withColumn("_id", F.sha2(F.col(text), 256))
    short = materialise(crasis_examples(distinct, text), "crasis")
    rest = sampling.thin(distinct.join(short.select("_id"), "_id", "left_anti"), "_id", share, str(seed))
    made = itacism_examples(rest, text, "_id", attested, seed)
    return short.select("input_text", "target_text").unionByName(made.select("input_text", "target_text"))


def split_into_parts(n: int, k: int, rng: random.Random) -> list[int]:
    """A random composition of n into k positive parts."""
    cuts = [0, *sorted(rng.sample(range(1, n), k - 1)), n]
    return [b - a for a, b in zip(cuts, cuts[1:])]


def compositions(rows: DataFrame, key: str, n: str, k: str, seed: int = 42) -> DataFrame:
    """rows with ``parts``: a random composition of n into k (at most n) positive parts, by key."""

    @F.pandas_udf("array<int>")
    def cut(ids: pd.Series, total: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series(
            [split_into_parts(int(a), max(1, min(int(a), int(b))), random.Random(f"{seed}:{i}")) if a > 0 else [] for i, a, b in zip(ids, total, parts)]
        )

    return rows.withColumn("parts", cut(F.col(key).cast("string"), n, k))


def held_out_texts(tokens: DataFrame, splits: DataFrame, held: list[str]) -> DataFrame:
    """(pericope_id, book, text) of the passages in held-out splits: what training text must not
    share."""
    own = tokens.join(splits.where(F.col("split").isin(*held)).select("pericope_id"), "pericope_id", "left_semi")
    items = F.array_sort(F.collect_list(F.struct("chapter", "verse", "position", "text")))
    return own.groupBy("pericope_id", "book").agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"))


def build_corpus(
    passages: DataFrame, held_out: DataFrame, eval_share: float = 0.02, target: int = 150, most: int = 300, n: int = 8, least: int = 20,
    seed: str = "42"
) -> dict[str, DataFrame]:
    """The training artifact from passages (source, ord, ref, text): ``corpus`` (denoise and
    continuation rows of training windows), ``eval_perplexity``, ``eval_continuation`` and
    ``manifest`` (one row: settings and totals as JSON)."""
    every = materialise(order.passage_windows(passages, target, most).withColumn("id", F.concat_ws(":", "source", F.col("window").cast("string"))), "windows")
    dirty = materialise(screening.contaminated(every, held_out, "id", n=n), "dirty")
    clean = screening.first_of_each(every, "text", "id").join(dirty, "id", "left_anti").withColumn("register", register_of(F.col("source")))
    clean = materialise(sampling.carve(clean, "id", eval_share, seed), "clean")
    train, held = clean.where("split = 'train'"), clean.where("split = 'eval'")
    none = F.lit(None).cast("string")
    denoise = train.select(
        F.lit("denoise").alias("task"), F.col("text").alias("raw_text"), none.alias("input_text"), none.alias("target_text"), "source", "register"
    )
    going_on = order.continuations(train, least=least).select(
        F.lit("continuation").alias("task"), none.alias("raw_text"), "input_text", "target_text", "source", "register"
    )
    settings = json.dumps(
        {"target_words": target, "max_words": most, "eval_frac": eval_share, "shingle_n": n, "min_cont_words": least, "seed": seed}, sort_keys=True
    )
    totals = clean.agg(
        F.count("*").alias("clean_windows"), F.count_if(
            F.col("split") == "train"
        ).alias("train_windows"), F.count_if(F.col("split") == "eval").alias("eval_windows"),
        F.coalesce(F.sum(F.when(F.col("split") == "train", F.size(words(F.col("text"))))), F.lit(0)).alias("corpus_words"),
    )
    raw = every.agg(F.count("*").alias("raw_windows")).join(dirty.agg(F.count("*").alias("contaminated")))
    manifest = F.struct(
        F.lit(settings).alias("config"), "raw_windows", "contaminated", "clean_windows",
        (F.col("raw_windows") - F.col("clean_windows")).alias("dropped"), "train_windows", "eval_windows", "corpus_words"
    )
    return {
        "corpus": denoise.unionAll(going_on), "eval_perplexity": held.select("text", "source", "ref"),
        "eval_continuation": order.continuations(held, least=least).select(F.lit("continuation").alias("task"), "input_text", "target_text", "source"),
        "manifest": raw.join(totals).select(F.to_json(manifest).alias("manifest")),
    }
