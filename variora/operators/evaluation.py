"""Scores of tagging, reconstruction and generation; gates and reports over score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variora.functions.text import strip_accents, words
from variora.operators.aggregates import perplexity, token_f1
from variora.operators.statistics import contamination_flag, difference_ci, mean_ci


def tagging_scores(rows: DataFrame, subset: str, gold: Column, predicted: Column, mask: Column | None = None, whole: bool = False) -> DataFrame:
    """(subset, tok, em, n): token accuracy and exact sentences of each subset, and ``overall``
    from summed counts. gold, predicted: arrays of tags; mask: array of booleans, the positions
    that are scored. A sentence is exact if all scored positions are right; ``whole``: if the two
    lists are equal."""
    keep = mask if mask is not None else F.transform(gold, lambda x: F.lit(True))
    each = F.zip_with(F.zip_with(gold, predicted, lambda g, p: g.eqNullSafe(p) & g.isNotNull()), keep, lambda hit, k: F.when(k, hit))
    made = rows.select(
        F.col(subset).alias("subset"), F.filter(F.slice(each, F.lit(1), F.size(gold)), lambda x: x.isNotNull()).alias("_e"),
        (gold == predicted).alias("_w")
    )
    made = made.select("subset", F.size("_e").alias("scored"), F.size(F.filter("_e", lambda x: x)).alias("hit"), "_w")
    exact = F.col("_w") if whole else F.col("hit") == F.col("scored")
    sums = made.rollup("subset").agg(
        F.sum("hit").alias("h"), F.sum("scored").alias("s"), F.count_if(exact).alias("e"), F.count("*").alias("n"), F.grouping("subset").alias("_g")
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(0.0))
    name = F.when(F.col("_g") == 1, "overall").otherwise(F.col("subset"))
    return sums.select(name.alias("subset"), share("h", "s").alias("tok"), share("e", "n").alias("em"), "n")


def compare_modes(rows: DataFrame, subset: str, gold: Column, one: Column, two: Column, neutral: Column) -> DataFrame:
    """(mode, subset, tok_one, tok_two, delta): two models' accuracy over all positions (full)
    and over those that the tag conventions agree on (neutral)."""
    out = None
    for mode, mask in (("full", None), ("neutral", neutral)):
        a = tagging_scores(rows, subset, gold, one, mask).select("subset", F.col("tok").alias("tok_one"))
        b = tagging_scores(rows, subset, gold, two, mask).select("subset", F.col("tok").alias("tok_two"))
        part = a.join(b, "subset").select(F.lit(mode).alias("mode"), "*", (F.col("tok_two") - F.col("tok_one")).alias("delta"))
        out = part if out is None else out.unionAll(part)
    return out


def reconstruction_scores(rows: DataFrame, key: str, predicted: Column, gold: Column, normalise=lambda x: x) -> DataFrame:
    """(key, f1, em) of each example: word F1 and whether the words are the same, in order."""
    f1 = token_f1(rows, key, predicted, gold, normalise)
    same = rows.select(key, (words(normalise(predicted)) == words(normalise(gold))).alias("em"))
    return f1.join(same, key)


def reconstruction_summary(scores: DataFrame) -> DataFrame:
    """One row: mean F1, share of exact matches and their number; zeros without examples."""
    rate = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scores.agg(rate(F.col("f1")).alias("f1"), rate(F.col("em").cast("double")).alias("em"), F.count("*").alias("n"))


def nearest_witness(rows: DataFrame, key: str, witnesses: str, gold: Column, normalise=lambda x: x) -> DataFrame:
    """(key, f1): the best F1 that copying one witness gives; witnesses: MAP<name, text>."""
    each = rows.select(key, gold.alias("_gold"), F.explode(witnesses).alias("_name", "_text")).withColumn("_one", F.struct(key, "_name"))
    scores = token_f1(each, "_one", F.col("_text"), F.col("_gold"), normalise)
    return scores.select(F.col(f"_one.{key}").alias(key), "f1").groupBy(key).agg(F.max("f1").alias("f1"))


def against_nearest(rows: DataFrame, key: str, predicted: Column, gold: Column, witnesses: str, n: int = 2_000, seed: str = "42") -> DataFrame:
    """One row: the clustered interval of F1 over that of the nearest witness."""
    own = token_f1(rows, key, predicted, gold)
    base = nearest_witness(rows, key, witnesses, gold).withColumnRenamed("f1", "_base")
    return mean_ci(own.join(base, key).withColumn("gain", F.col("f1") - F.col("_base")), key, "gain", n, seed)


def loose_f1(rows: DataFrame, key: str, predicted: Column, gold: Column) -> DataFrame:
    """(key, f1) without accents; 0 where either side has no words."""
    both = (F.size(words(predicted)) > 0) & (F.size(words(gold)) > 0)
    some = rows.withColumn("_both", both)
    scores = token_f1(some.where("_both"), key, predicted, gold, strip_accents)
    return some.select(key).join(scores, key, "left").select(key, F.coalesce("f1", F.lit(0.0)).alias("f1"))


def ease(scores: DataFrame, group: str, older: str, newer: str, control: str, nll: str = "nll", tokens: str = "tokens") -> DataFrame:
    """One row: the ratio of a group's perplexity to the control's, and the gap of log
    perplexities that the newer model has over the older one, the control's taken off.
    scores: model, group, nll and tokens of each chunk; groups ``group`` and ``control``."""
    by = perplexity(scores, ["model", "group"], nll, tokens)
    of = lambda model, name: F.max(F.when((F.col("model") == model) & (F.col("group") == name), F.col("mean_nll")))
    one = by.agg(of(older, group).alias("og"), of(older, control).alias("oc"), of(newer, group).alias("ng"), of(newer, control).alias("nc"))
    gap = (F.col("og") - F.col("oc")) - (F.col("ng") - F.col("nc"))
    return one.select(F.exp(F.col("nc") - F.col("ng")).alias("ease_ratio"), gap.alias("gap"))


def audit_report(scores: DataFrame, group: str, older: str, newer: str, control: str, match_rate: float | None = None) -> DataFrame:
    """``ease`` with the share of verbatim completions and whether memorisation is suspected;
    the gap is null unless both models were scored on both groups."""
    rate = F.lit(match_rate).cast("double")
    made = ease(scores, group, older, newer, control).withColumn("match_rate", rate)
    return made.withColumn("flagged", contamination_flag(F.col("gap"), F.col("match_rate"), F.col("ease_ratio")))


def memorisation_gap(rows: DataFrame, by: str, seen: Column, control: Column) -> DataFrame:
    """(by, gap, flagged): the difference of two means, null where either is missing."""
    none = F.lit(None).cast("double")
    made = rows.groupBy(by).agg((F.avg(seen) - F.avg(control)).alias("gap"))
    return made.withColumn("flagged", F.when(F.col("gap").isNotNull(), contamination_flag(F.col("gap"), none, none)))


def generation_scores(rows: DataFrame, key: str, nll: str, tokens: str, generated: Column, gold: Column, tags: Column, valid: list[str]) -> DataFrame:
    """One row: perplexity of the gold continuations, mean F1 of free ones, and the mean share of
    their words that are given a valid tag; tags: array, one a word. Wordless ones aren't judged
    by tags; without rows the perplexity is infinite and the rest 0."""
    f1 = loose_f1(rows, key, generated, gold).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"), F.count("*").alias("n"))
    mean = F.sum(F.col(nll) * F.col(tokens)) / F.greatest(F.sum(tokens), F.lit(1))
    ppl = rows.agg(F.coalesce(F.exp(mean), F.lit(float("inf"))).alias("ppl"))
    size = F.size(words(generated))
    right = F.size(F.filter(F.slice(tags, F.lit(1), size), lambda t: t.isin(*valid)))
    morph = rows.where(size > 0).agg(F.coalesce(F.avg(right / size), F.lit(0.0)).alias("morph"))
    return ppl.join(f1).join(morph)  # rows of one each


def passes_gates(pos: DataFrame, lemma: DataFrame, pos_nt: float, pos_classical: float, lemma_overall: float) -> DataFrame:
    """One row (passed): whether tagging scores reach what they must; a missing score doesn't."""
    tok = lambda df, name, least: df.agg(F.coalesce(F.max(F.when(F.col("subset") == name, F.col("tok"))) >= least, F.lit(False)).alias("ok"))
    a, b, c = (
        tok(*x).withColumnRenamed("ok", f"ok{i}") for i,
        x in enumerate([(pos, "nt", pos_nt), (pos, "classical", pos_classical), (lemma, "overall", lemma_overall)])
    )
    return a.join(b).join(c).select((F.col("ok0") & F.col("ok1") & F.col("ok2")).alias("passed"))


def gate_report(name: str, ci: DataFrame, detail: str = "") -> DataFrame:
    """One row: a gate's statistic with its interval, and whether that lies above zero."""
    columns = F.lit(name).alias("name"), F.col("estimate").alias("statistic"), "ci_low", "ci_high", (F.col("ci_low") > 0).alias("passed")
    return ci.select(*columns, F.lit(detail).alias("detail"))


def fold_verdicts(scores: DataFrame, fold: str, group: str, overlap: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """(fold, estimate, ci_low, ci_high, significant, did): the excess lift of each fold and, where
    it has both overlap units and others, their difference. Folds are few: a plan for each."""
    out = None
    rows = scores.withColumn("_excess", F.col("control") - F.col("added"))
    for k in [r[0] for r in scores.select(fold).distinct().orderBy(fold).collect()]:
        own = rows.where(F.col(fold) == k)
        seen = mean_ci(own, group, "_excess", n, seed).select(F.lit(k).alias(fold), "estimate", "ci_low", "ci_high", (F.col("ci_low") > 0).alias("significant"))
        means = own.agg((F.avg(F.when(F.col(overlap), F.col("_excess"))) - F.avg(F.when(~F.col(overlap), F.col("_excess")))).alias("did"))
        part = seen.join(means)
        out = part if out is None else out.unionAll(part)
    return out


def did_contrast(scores: DataFrame, group: str, overlap: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """One row: the interval of the excess lift of overlap units over that of the rest."""
    rows = scores.withColumn("_excess", F.col("control") - F.col("added"))
    return difference_ci(rows.where(overlap), rows.where(~F.col(overlap)), group, "_excess", n, seed)


def operator_passes(rows: DataFrame) -> DataFrame:
    """rows with ``passed``: the likelihood of a pair beats that without source and, where there
    are several pairs, that with another's source. rows: nll, source_free, mismatched."""
    other = F.when(F.count("*").over(_all()) > 1, F.col("nll") < F.col("mismatched")).otherwise(F.lit(True))
    return rows.withColumn("passed", (F.col("nll") < F.col("source_free")) & other)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # a few pairs


def correctness(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """rows with ``correct`` 0 or 1; a missing prediction or gold is an error."""
    right = F.when(
        F.col(gold).isNull() | F.col(predicted).isNull(), F.raise_error(F.lit("gold and predictions differ in length"))
    ).otherwise((F.col(gold) == F.col(predicted)).cast("double"))
    return rows.withColumn("correct", right)


def group_names(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows whose null groups are groups of their own, named by their key."""
    own = F.concat(F.lit("own:"), F.col(key).cast("string"))
    return rows.withColumn(group, F.coalesce(F.col(group).cast("string"), own))


def checked_perplexity(rows: DataFrame, by: list[str], nll: str, tokens: str) -> DataFrame:
    """``perplexity``; a group without tokens, or a chunk without a score, is an error."""
    made = perplexity(rows.withColumn(nll, F.coalesce(F.col(nll), F.raise_error(F.lit("a chunk has no score")).cast("double"))), by, nll, tokens)
    return made.withColumn("mean_nll", F.when(F.col("n_tokens") > 0, F.col("mean_nll")).otherwise(F.raise_error(F.lit("no tokens")).cast("double")))
