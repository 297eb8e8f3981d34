"""Cluster bootstrap, differences, thresholds and power.

Replicates work on one (sum, count) a group, so their cost is replicates times groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variora.operators.linking import numbered
from variora.operators.sampling import uniform


def replicates(rows: DataFrame, group: str, values: list[str], n: int, seed: str = "42") -> DataFrame:
    """(replicate, <value>...): means over samples of groups drawn with replacement."""
    sums = rows.groupBy(group).agg(F.count("*").alias("_c"), *[F.sum(v).alias(v) for v in values])
    groups = sums.count()
    few = groups <= 100_000
    sums = sums.withColumn("_i", F.row_number().over(Window.orderBy(group)) - 1) if few else numbered(sums, [group], "_i")
    draws = rows.sparkSession.range(n).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))).alias("_j"))
    draws = draws.withColumn("_i", F.floor(uniform("replicate", "_j", seed=seed) * groups))
    return draws.join(F.broadcast(sums) if few else sums, "_i").groupBy("replicate").agg(*[(F.sum(v) / F.sum("_c")).alias(v) for v in values])


def summary(reps: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    return reps.agg(
        F.percentile(value, F.lit(tail)).alias("ci_low"), F.percentile(value, F.lit(1 - tail)).alias("ci_high"),
        F.avg(value).alias("boot_mean"), F.stddev_pop(value).alias("boot_std"), F.avg((F.col(value) > 0).cast("double")).alias("prob_positive"),
    )


def mean_ci(rows: DataFrame, group: str, value: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """One row: the mean with its clustered percentile interval."""
    seen = rows.agg(F.avg(value).alias("estimate"), F.countDistinct(group).alias("n_units"), F.count("*").alias("n_samples"))
    return seen.join(summary(replicates(rows, group, [value], n, seed), value))


def difference_ci(a: DataFrame, b: DataFrame, group: str, value: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """One row: mean of a minus mean of b, resampled independently."""
    left = replicates(a, group, [value], n, seed + "a").withColumnRenamed(value, "_a")
    right = replicates(b, group, [value], n, seed + "b").withColumnRenamed(value, "_b")
    reps = left.join(right, "replicate").select((F.col("_a") - F.col("_b")).alias("d"))
    seen = a.agg(F.avg(value).alias("_x")).join(b.agg(F.avg(value).alias("_y"))).select((F.col("_x") - F.col("_y")).alias("estimate"))
    return seen.join(summary(reps, "d"))


def paired_delta(rows: DataFrame, group: str, a: str, b: str, n: int = 10_000, seed: str = "42") -> DataFrame:
    """One row: mean a - mean b on the same draws, and how often it is positive."""
    reps = replicates(rows, group, [a, b], n, seed).select((F.col(a) - F.col(b)).alias("d"))
    return rows.agg((F.avg(a) - F.avg(b)).alias("estimate")).join(summary(reps, "d"))


def null_threshold(rows: DataFrame, value: str, quantile: float = 0.95) -> DataFrame:
    return rows.agg(
        F.percentile(value, F.lit(quantile)).alias("threshold"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.count(value).alias("n")
    )


def contamination_flag(gap, match_rate, ease):
    """Paired gap over .25 where there is one, else match rate over .10, else ease over 1.5."""
    return F.when(gap.isNotNull(), gap > 0.25).when(match_rate.isNotNull(), match_rate > 0.10).otherwise(F.coalesce(ease > 1.5, F.lit(False)))


def lift_power(spark, effects: list[float], weights: list[float], tau: float, sims: int = 200, replicates_: int = 200, seed: int = 42) -> DataFrame:
    """(effect, power): how often a simulated lift's lower bound is above zero; unit i is
    drawn with variance tau^2 + 1/weight. Simulations are spread over tasks."""
    import numpy as np
    import pandas as pd

    units = np.asarray(weights, float)

    def run(parts):
        for part in parts:
            out = []
            for effect, sim in zip(part["effect"], part["sim"]):
                rng = np.random.default_rng([seed, int(sim), int(round(effect * 1e6))])
                x = rng.normal(effect, np.sqrt(tau**2 + 1 / units))
                means = x[rng.integers(0, len(x), (replicates_, len(x)))].mean(1)
                out.append((effect, float(np.quantile(means, 0.025) > 0)))
            yield pd.DataFrame(out, columns=["effect", "hit"])

    grid = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.array(*map(F.lit, effects))).alias("effect"))
    return grid.repartition("sim").mapInPandas(run, "effect double, hit double").groupBy("effect").agg(F.avg("hit").alias("power"))


def minimum_effect(power: DataFrame, target: float = 0.8) -> DataFrame:
    """The smallest effect whose power reaches the target, else infinity."""
    return power.agg(F.coalesce(F.min(F.when(F.col("power") >= target, F.col("effect"))), F.lit(float("inf"))).alias("effect"))
