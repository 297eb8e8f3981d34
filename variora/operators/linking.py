"""Joins: keyed with fallback, intervals, parallels, pairs, rotations, dimensions."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_with_fallback(left: DataFrame, right: DataFrame, keys: list[str], order: str, fallback: list[str], value: str) -> DataFrame:
    """Left rows with ``value`` of the right row of the same ``keys`` (the last in ``order``
    where keys repeat), else of the first right row of the same ``fallback`` columns."""
    exact = right.groupBy(*keys).agg(F.max_by(value, order).alias("_exact"), F.lit(True).alias("_met"))
    near = right.groupBy(*fallback).agg(F.min_by(value, order).alias("_near"))
    return left.join(exact, keys, "left").join(near, fallback, "left").withColumn(
        value, F.when(F.col("_met"), F.col("_exact")).otherwise(F.col("_near"))
    ).drop("_exact", "_near", "_met")


def expand_ranges(ranges: DataFrame, low: str, high: str, point: str, by: list[str], first: str) -> DataFrame:
    """One row a point of each range; where ranges overlap, the first in ``first`` wins."""
    points = ranges.where(F.col(low) <= F.col(high)).withColumn(point, F.explode(F.sequence(low, high)))
    return points.groupBy(*by, point).agg(F.min_by(F.struct(*[c for c in ranges.columns if c not in by]), first).alias("_r")).select(*by, point, "_r.*")


def assign_intervals(points: DataFrame, ranges: DataFrame, low: str, high: str, point: str, first: str, by: list[str] = ()) -> DataFrame:
    """Left join of points with the first range that holds them: an equi-join on expanded
    ranges, where a BETWEEN join would compare all with all."""
    return points.join(expand_ranges(ranges, low, high, point, list(by), first), [*by, point], "left")


def verse_ranges(ranges: DataFrame, cap: int = 40) -> DataFrame:
    """(book, chapter, v_low, v_high, ...) of ranges (book, c1, v1, c2, v2): chapters before the
    last are taken to have ``cap`` verses."""
    rows = ranges.withColumn("chapter", F.explode(F.sequence("c1", "c2")))
    return rows.withColumn("v_low", F.when(F.col("chapter") == F.col("c1"), F.col("v1")).otherwise(1)).withColumn(
        "v_high", F.when(F.col("chapter") == F.col("c2"), F.col("v2")).otherwise(cap)
    )


def find_range(
    points: DataFrame, ranges: DataFrame, on: list[str], at: tuple[str, str], low: tuple[str, str], high: tuple[str, str], first: str, value: str
) -> DataFrame:
    """points with ``value`` of the first range (same ``on``) that holds ``at`` in tuple order:
    low <= at <= high, each (chapter, verse).

    Ranges are expanded to one row a chapter, so that a point meets those of its chapter alone;
    each place is looked up once, however many points share it.
    """
    chapter, verse = at
    last = F.lit((1 << 31) - 1)
    spans = ranges.where(F.col(low[0]) <= F.col(high[0])).withColumn("_c", F.explode(F.sequence(F.col(low[0]).cast("int"), F.col(high[0]).cast("int"))))
    spans = spans.select(
        *on, "_c", F.col(value).alias("_value"), F.col(first).alias("_first"),
        F.when(F.col("_c") == F.col(low[0]), F.col(low[1])).otherwise(-last).alias("_low"), F.when(
            F.col("_c") == F.col(high[0]), F.col(high[1])
        ).otherwise(last).alias("_high"),
    )
    places = points.select(*on, F.col(chapter).cast("int").alias("_c"), F.col(verse).alias("_v")).distinct()
    hits = places.join(spans, [*on, "_c"]).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    hits = hits.groupBy(*on, "_c", "_v").agg(F.min_by("_value", "_first").alias(value))
    keyed = points.withColumns({"_c": F.col(chapter).cast("int"), "_v": F.col(verse)})
    return keyed.join(hits, [*on, "_c", "_v"], "left").drop("_c", "_v")


def parallels(ranges: DataFrame, key: str, member: str) -> DataFrame:
    """Ordered pairs of different members of the same key."""
    other = ranges.select(F.col(key), *[F.col(c).alias(f"other_{c}") for c in ranges.columns if c != key])
    return ranges.join(other, key).where(F.col(member) != F.col(f"other_{member}"))


def unordered_pairs(rows: DataFrame, key: str, member: str, value: str) -> DataFrame:
    """(key, a, b, value_a, value_b) for all pairs of a key's members, a before b."""
    a = rows.select(key, F.col(member).alias("a"), F.col(value).alias("value_a"))
    b = rows.select(key, F.col(member).alias("b"), F.col(value).alias("value_b"))
    return a.join(b, key).where("a < b")


def rotate(rows: DataFrame, order: str, value: str, shifts: dict[str, int]) -> DataFrame:
    """rows with ``value`` of the row that many places later, wrapping around."""
    ranked = numbered(rows, [order])
    n = rows.count()
    out = ranked
    for name, shift in shifts.items():
        later = ranked.select(F.pmod(F.col("_n") - F.lit(shift), F.lit(max(n, 1))).alias("_n"), F.col(value).alias(name))
        out = out.join(later, "_n")
    return out.drop("_n")


def ranked(rows: DataFrame, by: list[str], order: list[str], place: str, size: str) -> DataFrame:
    """rows with their place (0 on) in their group and the group's size, by way of one order of
    all rows, so that no group has to fit into a task; nulls are a group."""
    placed = numbered(rows, [*by, *order], "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias(size))
    joined = join_null_safe(placed, groups, by)
    return joined.withColumn(place, F.col("_at") - F.col("_first")).drop("_at", "_first")


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which nulls meet; ``right``'s are dropped."""
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


#: Rows sampled for each part of a numbering; parts are then alike within a few percent.
SAMPLED = 60


def numbered(rows: DataFrame, order: list[str], name: str = "_n", parts: int | None = None) -> DataFrame:
    """Rows with their place (0 on) in the order of columns that no two rows share.

    The order is cut into ``parts`` at keys from a small sample. Which part a row is in depends
    on its key alone, so that recomputation and adaptive plans can't change it; parts are
    counted, and each is numbered in a task of its own.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = rows.select(*order)
    share = min(1.0, SAMPLED * parts / max(1, keys.count()))
    sample = sorted({tuple(r) for r in keys.sample(share, seed=7).collect()}, key=lambda k: [(v is not None, v) for v in k])
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if len(sample) >= parts else sample[1:]
    part = _part(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]), cuts, keys.schema)
    placed = rows.withColumn("_p", part)
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # one row a part
    before = list(accumulate((sizes.get(p, 0) for p in range(len(cuts) + 1)), initial=0))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn(name, (own + F.element_at(F.lit(before), F.col("_p") + 1) - 1).cast("long")).drop("_p")


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def _part(key: Column, cuts: list[tuple], schema) -> Column:
    """How many of the sorted ``cuts`` are at or before a key, by comparing first with every
    tenth or so and then with those between two of them."""
    if not cuts:
        return F.lit(0)
    literal = lambda cut: F.struct(*[_literal(v, f.dataType).alias(f"k{i}") for i, (v, f) in enumerate(zip(cut, schema))])
    step = max(1, int(len(cuts) ** 0.5))
    at_or_before = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = at_or_before(F.array(*[literal(c) for c in cuts[::step]]))
    fine = F.array(*[F.array(*map(literal, cuts[i : i + step])) for i in range(0, len(cuts), step)])
    within = lambda n: F.when(n == 0, 0).otherwise((n - 1) * step + at_or_before(F.get(fine, n - 1)))
    return F.transform(F.array(coarse), within)[0]


def enrich(facts: DataFrame, dimension: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with a dimension, its columns defaulted where there is no match."""
    joined = facts.join(dimension.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
