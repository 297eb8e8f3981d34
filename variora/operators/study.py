"""Study units, fold checks, reports and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variora.operators.statistics import difference_ci, lift_power, mean_ci, minimum_effect


def member_counts(rows: DataFrame, key: str, member: str, members: list[str]) -> DataFrame:
    """(key, one count a member)."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(member) == m).alias(m) for m in members])


def full_units(rows: DataFrame, key: str, member: str, members: list[str], flagged: list | None = None) -> DataFrame:
    """Groups that hold every member: their counts, the smallest, and whether ``flagged``."""
    counts = member_counts(rows, key, member, members)
    units = counts.where(F.least(*members) > 0).withColumn("smallest", F.least(*members))
    return units.withColumn("overlap", F.col(key).isin(flagged or []))


def unit_table(dimension: DataFrame, facts: dict[str, DataFrame], key: str) -> DataFrame:
    """The dimension's rows with the number of rows that each fact table has for them."""
    counted = [f.groupBy(key).agg(F.count("*").alias(name)) for name, f in facts.items()]
    return reduce(lambda d, c: d.join(c, key, "left"), counted, dimension).na.fill(0, list(facts))


def split_check(rows: DataFrame, key: str, split: str, known: DataFrame) -> DataFrame:
    """One row: whether splits share no key, and cover all and only the known ones."""
    own = rows.groupBy(key).agg(F.countDistinct(split).alias("n"))
    other = known.select(key).distinct().withColumn("known", F.lit(True))
    both = own.join(other, key, "full")
    return both.agg(
        (F.count_if(F.col("n") > 1) == 0).alias("disjoint"), (F.count_if(F.coalesce("n", F.lit(0)) == 0) == 0).alias("covering"),
        (F.count_if(F.col("known").isNull()) == 0).alias("closed")
    )


def word_aligned_scores(rows: DataFrame, gold: Column, predicted: Column, source: Column) -> DataFrame:
    """One row: token accuracy, exact matches, accuracy of a copy of the source, the lift over
    that, and the accuracy where gold and source differ. Arguments are arrays of words."""
    same = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() & x.eqNullSafe(y)), lambda x: x))
    edits = F.zip_with("g", "s", lambda x, y: F.when(~x.eqNullSafe(y), x))
    made = rows.select(gold.alias("g"), predicted.alias("p"), source.alias("s"))
    each = made.select(
        F.size("g").alias("n"), same("g", "p").alias("hit"), same("g", "s").alias("copied"), same(edits, F.col("p")).alias("edited"), (
            F.col("g") == F.col("p")
        ).cast("int").alias("em"),
    )
    sums = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "hit", "copied", "edited", "em")], F.count("*").alias("rows"))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    tok, copy = share(F.col("hit"), F.col("n")), share(F.col("copied"), F.col("n"))
    return sums.select(
        tok.alias("tok"), share(F.col("em"), F.col("rows")).alias("em"), copy.alias("copy"), (tok - copy).alias("lift"), share(
            F.col("edited"), F.col("n") - F.col("copied")
        ).alias("edit"), F.col("rows").alias("n"),
    )


def masked_nll(rows: DataFrame, by: list[str], nll: str, mask: str) -> DataFrame:
    """(by, sequence_nll): the mean over rows with a true mask, 0 without one."""
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(mask), F.col(nll))), F.lit(0.0)).alias("sequence_nll"))


def excess_lift(rows: DataFrame, group: str, base: str, added: str, control: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """One row: the clustered interval of control - added, whether it lies above zero, and the
    mean lifts of the added and of the control witness over the base."""
    rows = rows.withColumn("_excess", F.col(control) - F.col(added))
    means = rows.agg(F.avg(F.col(base) - F.col(added)).alias("raw_lift_mean"), F.avg(F.col(base) - F.col(control)).alias("control_lift_mean"))
    return mean_ci(rows, group, "_excess", n, seed).withColumn("significant", F.col("ci_low") > 0).join(means)


def recovery_gate(rows: DataFrame, group: str, wrong: str, correct: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """One row: the interval of wrong - correct and whether it lies above zero."""
    return mean_ci(rows.withColumn("_d", F.col(wrong) - F.col(correct)), group, "_d", n, seed).withColumn("passed", F.col("ci_low") > 0)


def pooled_verdict(scores: DataFrame, group: str, overlap: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """One row from (base, added, control, null_added): the excess lift, the null floor and
    whether it is cleared, and the contrast of overlap and rest (null with fewer than two
    overlap rows or no other)."""
    seen = excess_lift(scores, group, "base", "added", "control", n, seed)
    null = scores.select((F.col("control") - F.col("null_added")).alias("d")).agg(
        F.percentile("d", F.lit(0.95)).alias("threshold"), F.count("d").alias("null_n")
    )
    rows = scores.withColumn("_excess", F.col("control") - F.col("added"))
    enough = scores.agg(((F.count_if(overlap) >= 2) & (F.count_if(~F.col(overlap)) >= 1)).alias("e"))
    contrast = difference_ci(rows.where(overlap), rows.where(~F.col(overlap)), group, "_excess", n, seed)
    contrast = contrast.join(enough).select(*[F.when(F.col("e"), F.col(c)).alias(f"did_{c}") for c in ("estimate", "ci_low", "ci_high")])
    return seen.join(null).join(contrast).withColumn("clears_floor", F.col("estimate") > F.col("threshold"))


def difference_power(
    spark, effects: list[float], overlap: list[float], rest: list[float], tau: float, sims: int = 200, draws: int = 200, seed: int = 42
) -> DataFrame:
    """(effect, power): how often the interval of the difference of two simulated groups of
    units excludes zero; unit i has variance tau^2 + 1/weight and only the overlap the effect."""
    import numpy as np
    import pandas as pd

    sides = [(np.sqrt(tau**2 + 1 / np.asarray(w, float)), share) for w, share in ((overlap, 1.0), (rest, 0.0))]

    def run(parts):
        for part in parts:
            hits = []
            for effect, sim in zip(part["effect"], part["sim"]):
                rng = np.random.default_rng([seed, int(sim), int(round(effect * 1e6))])
                means = [rng.normal(effect * share, sd)[rng.integers(0, len(sd), (draws, len(sd)))].mean(1) for sd, share in sides]
                low, high = np.quantile(means[0] - means[1], [0.025, 0.975])
                hits.append(float(low > 0 or high < 0))
            yield pd.DataFrame({"effect": part["effect"], "hit": hits})

    grid = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.array(*map(F.lit, effects))).alias("effect"))
    return grid.repartition("sim").mapInPandas(run, "effect double, hit double").groupBy("effect").agg(F.avg("hit").alias("power"))


def best_record(rows: DataFrame, gate: Column, score: str) -> DataFrame:
    """The row that passes the gate and scores highest; without one, the highest of the rest."""
    top = rows.agg(F.max_by(F.struct(*rows.columns), F.struct(gate.alias("g"), F.col(score).alias("s"))).alias("r"))
    return top.where("r is not null").select("r.*")


def epoch_coverage(pools: DataFrame, size: str, weight: str, drawn: int) -> DataFrame:
    """pools with how often ``drawn`` draws by weight go through each; empty pools are left out."""
    full = pools.where(F.col(size) > 0)
    total = full.agg(F.sum(weight).alias("_t"))  # one row a pool
    return full.join(F.broadcast(total)).withColumn("epochs", drawn * F.col(weight) / F.col("_t") / F.col(size)).drop("_t")


def power_report(
    spark, taus: list[float], effects: list[float], lift: list[float], overlap: list[float], rest: list[float], sims: int = 2_000, draws: int = 800,
    target: float = 0.8
) -> DataFrame:
    """(tau, sample, effect): the smallest effect that is found with the target's power, for each
    spread between units and for the lift and the difference; infinite where none is."""
    out = None
    for tau in taus:
        for name, power in (
            ("lift", lift_power(spark, effects, lift, tau, sims, draws)),
            ("difference", difference_power(spark, effects, overlap, rest, tau, sims, draws))
        ):
            part = minimum_effect(power, target).select(F.lit(tau).alias("tau"), F.lit(name).alias("sample"), "effect")
            out = part if out is None else out.unionAll(part)
    return out
