import pytest
from pyspark.sql import functions as F

from variora.functions import tags
from variora.operators import examples, study
from variora.plans import reader


def test_corrupted_spans_can_be_undone(spark):
    lists = [None, [], ["a"], ["a", "b"], [f"w{i}" for i in range(200)]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id long, w array<string>")
    got = {r.id: r for r in examples.corrupt_spans(rows, "id", "w").collect()}
    for i, own in enumerate(lists):
        spans, name = {}, None
        for t in got[i].target[:-1]:
            if t.startswith("<extra_id_"):
                name = t
                spans[name] = []
            else:
                spans[name].append(t)
        assert [w for t in got[i].corrupted for w in spans.get(t, [t])] == (own or [])
        assert sum(map(len, spans.values())) == (30 if i == 4 else 1 if i == 3 else 0)
    assert examples.corrupt_spans(rows.limit(0), "id", "w").count() == 0


def test_tags(spark):
    row = spark.range(1).select(
        tags.morphology(F.lit("3AAI-S")).alias("m"), tags.verse_span(F.lit("Mk 6:45")).alias("v"), tags.verse_span(F.lit("no")).alias("n"), tags.part_of_speech(F.lit("Df"), F.lit("μέν")).alias("p"),
        tags.part_of_speech(F.lit("Df"), F.lit("μέν"), {}).alias("q"), tags.verse_span(F.lit(" Ματθαῖος 6:45-50")).alias("g"),
    ).first()
    assert tuple(row.g) == ("Ματθαῖος", 6045, 6050)
    assert row.m == {"person": "third", "tense": "aorist", "voice": "active", "mood": "indicative", "number": "singular"}
    assert tuple(row.v) == ("Mark", 6045, 6045) and row.n is None and (row.p, row.q) == ("C-", "D-")


def test_verdict_guards_its_contrast(spark):
    scores = [(str(i), 3.0, 1.0, 2.0, 2.0, i == 0) for i in range(6)]
    rows = spark.createDataFrame(scores, "unit string, base double, added double, control double, null_added double, overlap boolean")
    one = study.pooled_verdict(rows, "unit", "overlap", 50).first()
    assert one.significant and one.clears_floor and one.did_estimate is None and one.estimate == 1.0


def test_reader(spark):
    rows = spark.createDataFrame([("Mark", c, v, 0, f"{c}:{v}") for c in (1, 2) for v in (1, 2, 3)], "book string, chapter int, verse int, position int, text string")
    assert [r.text for r in reader.read(rows, "Mark 2").collect()] == ["2:1", "2:2", "2:3"]
    assert [r.text for r in reader.read(rows, "Mark 1:2-3").collect()] == ["1:2", "1:3"]
    assert [r.verse for r in reader.verses(rows, "Mark", 1).collect()] == [1, 2, 3] and reader.chapters(rows, "x").count() == 0
    with pytest.raises(ValueError):
        reader.read(rows, "nothing")
