"""Deterministic orders, splits, folds and draws. Order comes from hashes of seed and id, so
that it doesn't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variora.operators.linking import join_null_safe, numbered, ranked


def hash_order(*parts: Column | str, seed: str = "42") -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]).cast("binary"))


def uniform(*parts: Column | str, seed: str = "42") -> Column:
    """In [0, 1), from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_order(*parts, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stratified_split(rows: DataFrame, key: str, stratum: str, train: float = 0.6, val: float = 0.2, test: float = 0.2, seed: str = "42") -> DataFrame:
    """rows with ``split``; a stratum of fewer than 3 is all train; sizes round half to even.
    The fractions must sum to 1."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError(f"fractions sum to {train + val + test}, not 1")
    placed = ranked(rows.withColumn("_h", hash_order(key, seed=seed)), [stratum], ["_h", key], "_r", "_n").drop("_h")
    n, r = F.col("_n"), F.col("_r") + 1
    n_train = F.greatest(F.lit(1), F.bround(n * train).cast("int"))
    n_val = F.greatest(F.lit(1), F.bround(n * val).cast("int"))
    n_val = F.when(n - n_train - n_val < 1, F.greatest(F.lit(1), n - n_train - 1)).otherwise(n_val)
    split = F.when(n < 3, "train").when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test")
    return placed.withColumn("split", split).drop("_n", "_r")


def folds(rows: DataFrame, key: str, strata: list[str], k: int, seed: str = "42") -> DataFrame:
    """rows with ``fold``: dealt round robin within strata, each starting one fold on. ``k`` is
    2 at least and at most the number of rows."""
    if k < 2:
        raise ValueError("two folds at least")
    if rows.limit(k).count() < k:
        raise ValueError(f"fewer rows than {k} folds")
    numbers = numbered(rows.select(*strata).distinct(), strata, "_s")
    placed = ranked(rows.withColumn("_h", hash_order(key, seed=seed)), strata, ["_h", key], "_r", "_n").drop("_h")
    dealt = F.pmod(F.col("_r") + F.col("_s"), F.lit(k)).cast("int")
    return join_null_safe(placed, numbers, strata).withColumn("fold", dealt).drop("_r", "_n", "_s")


def fold_members(rows: DataFrame, fold: int, held_out: bool) -> DataFrame:
    """The rows of a fold, or all others."""
    return rows.where(F.col("fold") == fold if held_out else F.col("fold") != fold)


def hold_out(rows: DataFrame, key: str, pool: str, k: int, seed: str = "42", exempt: list[str] = ()) -> DataFrame:
    """rows with ``held``: k of each pool that has 4k or more; ``exempt`` pools give none. Only
    the first k of each pool are ranked."""
    given = rows.where(~F.coalesce(F.col(pool).isin(*exempt), F.lit(False))) if exempt else rows
    large = given.groupBy(pool).count().where(F.col("count") >= 4 * k).select(pool)
    keyed = join_null_safe(given.select(key, pool, hash_order(key, seed=seed).alias("_h")), large, [pool], "left_semi")
    chosen = first_of_group(keyed, pool, k, "_h", key).select(key, pool, F.lit(True).alias("_held"))
    return join_null_safe(rows, chosen, [key, pool], "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_held")


def carve(rows: DataFrame, key: str, share: float, seed: str = "42") -> DataFrame:
    """rows with ``split``: ``max(1, floor(n * share))`` of them, in hash order, are eval, the
    rest train."""
    placed = numbered(rows.withColumn("_h", hash_order(key, seed=seed)), ["_h", key], "_r").drop("_h")
    most = max(1, int(rows.count() * share))
    return placed.withColumn("split", F.when(F.col("_r") < most, "eval").otherwise("train")).drop("_r")


def draws(pools: DataFrame, pool: str, weight: str, size: str, slots: DataFrame, slot: str, seed: str = "42") -> DataFrame:
    """(slot, pool, item): a pool by weight and an item number within it for each slot; empty
    pools don't count. pools: one row a pool."""
    full = pools.where(F.col(size) > 0)
    total = Window.orderBy(pool)  # one row a pool
    full = full.withColumn(
        "_high", F.sum(weight).over(total) / F.sum(weight).over(Window.partitionBy())
    ).withColumn("_low", F.coalesce(F.lag("_high").over(total), F.lit(0.0)))
    bands = full.agg(F.array_sort(F.collect_list(F.struct("_high", F.col(pool).alias("p"), F.col(size).alias("n")))).alias("_bands"))
    drawn = slots.select(slot).withColumn("_u", uniform(slot, F.lit("pool"), seed=seed)).join(F.broadcast(bands))
    chosen = F.coalesce(F.get(F.filter("_bands", lambda b: b["_high"] > F.col("_u")), F.lit(0)), F.element_at("_bands", -1))
    return drawn.withColumn("_b", chosen).select(
        slot, F.col("_b.p").alias("pool"), F.floor(uniform(slot, F.lit("item"), seed=seed) * F.col("_b.n")).cast("long").alias("item")
    )


def first_of_group(rows: DataFrame, by: str, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def thin(rows: DataFrame, key: str, share: float, seed: str = "42") -> DataFrame:
    """Each row with probability ``share``, by the hash of its key."""
    return rows.where(uniform(key, seed=seed) < share)


def interleave(a: DataFrame, b: DataFrame, position: str, parts: tuple[int, int] = (7, 3)) -> DataFrame:
    """Rows of two streams, numbered from 0 by ``position``, with the slot that each takes when
    ``parts`` rows of one and the other alternate."""
    x, y = parts
    slot = lambda n, first: (F.floor(F.col(position) / n) * (x + y) + first + F.col(position) % n).cast("long")
    return a.withColumn("slot", slot(x, 0)).unionByName(b.withColumn("slot", slot(y, x)))
