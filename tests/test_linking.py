import pytest
from pyspark.sql import functions as F

from variora.operators.linking import numbered, rotate


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_million_rows_keep_one_place_each(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        rows = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 64).alias("wide"), "id").repartition(13)
        got = numbered(rows, ["k"]).agg(F.count("*"), F.countDistinct("_n"), F.min("_n"), F.max("_n"), F.countDistinct("id"), F.sum(F.length("wide"))).first()
        assert tuple(got) == (n, n, 0, n - 1, n, 64 * n)
        turned = rotate(rows, "k", "k", {"one": 1, "two": 2}).agg(F.count("*"), F.countDistinct("one"), F.countDistinct("two"), F.sum(F.length("wide"))).first()
        assert tuple(turned) == (n, n, n, 64 * n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_places_are_those_of_a_sort(spark, parts):
    keys = [(None, 2), (None, 1), ("b", None), ("a", 3), ("", 0)] + [(f"k{i * 7919 % 101:03}", i % 3) for i in range(101)]
    rows = spark.createDataFrame(keys, "a string, b int").repartition(5)
    got = [(r.a, r.b) for r in numbered(rows, ["a", "b"], parts=parts).orderBy("_n").collect()]
    assert got == sorted(keys, key=lambda k: [(v is not None, v) for v in k])
    assert numbered(rows.limit(0), ["a"]).count() == 0 and numbered(rows.limit(1), ["a"]).first()["_n"] == 0


def test_rotation_wraps_around(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "k int")
    assert sorted((r.k, r.a, r.b) for r in rotate(rows, "k", "k", {"a": 1, "b": 7}).collect()) == [(i, (i + 1) % 5, (i + 2) % 5) for i in range(5)]
