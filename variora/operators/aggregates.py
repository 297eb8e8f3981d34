"""Groupings, text metrics and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variora.functions.text import loose, words


def nested(rows: DataFrame, key: str, member: str, order: list[str], value: str) -> DataFrame:
    """(key, members MAP<member, ARRAY<value>>), values in order; a null or empty key is
    ``__unassigned__``."""
    own = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "__unassigned__").otherwise(F.col(key).cast("string"))
    lists = rows.withColumn(key, own).groupBy(key, member).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("l"))
    return lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(member, F.transform("l", lambda x: x["_v"]))))).alias("members"))


def ordered_text(rows: DataFrame, keys: list[str], order: list[str], value: str, by: str = " ") -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["_v"]), by).alias("text"))


def classify(rows: DataFrame, key: str, member: str, cases: list[tuple[list[str], str]], otherwise: str) -> DataFrame:
    """(key, class): the first case all of whose members the key has."""
    sets = rows.groupBy(key).agg(F.collect_set(member).alias("_s"))
    out = None
    for need, name in cases:
        has = F.size(F.array_except(F.array(*map(F.lit, need)), "_s")) == 0
        out = F.when(has, name) if out is None else out.when(has, name)
    return sets.select(key, out.otherwise(otherwise).alias("class"))


def perplexity(rows: DataFrame, by: list[str], nll: str, tokens: str) -> DataFrame:
    """Token-weighted mean NLL and its exponential."""
    mean = F.sum(F.col(nll) * F.col(tokens)) / F.sum(tokens)
    return rows.groupBy(*by).agg(mean.alias("mean_nll"), F.exp(mean).alias("perplexity"), F.count("*").alias("n_chunks"), F.sum(tokens).alias("n_tokens"))


def pooled_accuracy(rows: DataFrame, subset: str, correct: Column) -> DataFrame:
    """Accuracy of each subset and over all rows: sums of numerators, not means of means."""
    rolled = rows.withColumn("_c", correct.cast("int")).rollup(subset).agg(F.sum("_c").alias("hits"), F.count("_c").alias("n"), F.grouping(subset).alias("_g"))
    return rolled.select(
        F.when(F.col("_g") == 1, "overall").otherwise(F.col(subset)).alias("subset"), "hits", "n", (F.col("hits") / F.col("n")).alias("accuracy")
    )


def token_f1(rows: DataFrame, key: str, pred: Column, gold: Column, normalise=lambda x: x, empty: float = 1.0) -> DataFrame:
    """(key, f1) of word multisets; ``empty``: the score where both are empty."""
    sides = rows.select(key, F.lit(1).alias("p"), F.lit(0).alias("g"), F.explode_outer(words(normalise(pred))).alias("w"))
    sides = sides.unionAll(rows.select(key, F.lit(0).alias("p"), F.lit(1).alias("g"), F.explode_outer(words(normalise(gold))).alias("w")))
    each = sides.groupBy(key, "w").agg(F.sum("p").alias("p"), F.sum("g").alias("g")).withColumns(
        {c: F.when(F.col("w").isNull(), 0).otherwise(F.col(c)) for c in ("p", "g")}
    )
    total = each.groupBy(key).agg(F.sum(F.least("p", "g")).alias("c"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    return total.select(
        key,
        F.when((F.col("p") == 0) & (F.col("g") == 0), empty).when(F.col("c") == 0, 0.0).otherwise(2.0 * F.col("c") / (F.col("p") + F.col("g"))).alias("f1")
    )


def exact_match_rate(rows: DataFrame, pred: Column, gold: Column, normalise=loose) -> DataFrame:
    """One row (rate); a pair with a null side is no match, no pairs at all give 0."""
    same = F.coalesce(normalise(pred) == normalise(gold), F.lit(False))
    return rows.agg(F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("rate"))


def harvest(rows: DataFrame, key: str, gloss: str, order: str) -> DataFrame:
    """(key, gloss): the first non-empty gloss in order, else empty."""
    own = F.coalesce(F.col(gloss), F.lit(""))
    return rows.groupBy(key).agg(F.coalesce(F.expr(f"min_by({gloss}, {order}) filter (where coalesce({gloss}, '') <> '')"), F.max_by(own, order)).alias(gloss))


def label_index(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, index): labels numbered from 0 by first appearance; one row a label."""
    from variora.operators.linking import numbered

    return numbered(rows.groupBy(label).agg(F.min(order).alias("_o")), ["_o"], "index").select(label, "index")


def census(rows: DataFrame, by: str, text: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("windows"), F.sum(F.size(words(F.col(text)))).alias("words"))


def code_conflicts(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Keys that more than one code maps to: an injective table has none."""
    return rows.groupBy(key).agg(F.countDistinct(code).alias("codes")).where("codes > 1")


def log_mean_exp(rows: DataFrame, by: list[str], value: str, name: str = "log_mean_exp") -> DataFrame:
    """(by, log of the mean of exp(value)), kept stable by each group's largest value."""
    most = rows.groupBy(*by).agg(F.max(value).alias("_most"))
    parts = rows.join(most, by) if by else rows.join(F.broadcast(most))
    total = F.max("_most") + F.log(F.avg(F.exp(F.col(value) - F.col("_most"))))
    return parts.groupBy(*by).agg(total.alias(name))


def bottleneck_nll(rows: DataFrame, by: list[str], nll: str) -> DataFrame:
    """(by, nll) of a mixture: minus the log of the mean likelihood of its samples."""
    made = log_mean_exp(rows.withColumn("_minus", -F.col(nll)), by, "_minus", "_l")
    return made.select(*by, (-F.col("_l")).alias("nll"))
