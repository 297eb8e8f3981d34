"""Nulls in any column, repeated ids, clashing extra columns and empty tables, for each operator
and the pipeline's stages."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from variora.llm import bm25_search, decontaminate, jaccard_join, language_id, language_model, quality, sentencepiece_codec, suffix_dedup, token_counts, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASH = ["_text", "_t", "shard", "blob", "n", "n_tokens", "score", "predicted", "component_id", "rule", "verdict", "host", "query_id", "rank", "begin", "ids", "quality", "known"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (None, "no id but some words that are here", "en", None, None), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "\n \t", "fr", "s", 3),
    (4, "one two three four five six seven", "en", "s", 1), (5, "one two three four five six seven", None, None, None), (6, "word " * 50_000, "en", "s", 250_000), (7, "ÀÉ\u0000😀�", "fr", "s", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


OPERATORS = {
    "model": lambda d: language_model.score(d, language_model.train(d)),
    "counts": lambda d: token_counts.count_tokens(d, MODEL),
    "repeats": lambda d: suffix_dedup.remove_repeats(d, "digest"),
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "codec": lambda d: sentencepiece_codec.encode_documents(d, MODEL),
    "join": lambda d: jaccard_join.join_components(d),
    "quality": lambda d: quality.score_quality(d, quality.fit(d, d.select("doc_id", F.lit(1).alias("quality")))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(odd, name):
    assert OPERATORS[name](odd).count() == len(ROWS)
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_kept_texts_have_the_columns_of_their_rows(odd):
    kept = suffix_dedup.remove_repeats(odd, "text")
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_search_and_leaks(spark, odd):
    assert {r.query_id for r in bm25_search.search(odd, odd).collect()} == {4, 5, 6, 7}
    items = spark.createDataFrame([(None, "x y z"), (1, None), (2, "one two three four five six seven"), (2, "one two three four five six seven")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(odd, items.withColumns({c: F.lit("x") for c in CLASH})).collect()} == {4, 5}


def test_urls(spark):
    rows = spark.createDataFrame([(None, "http://a.com/"), (1, None), (1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string").withColumns({c: F.lit("x") for c in CLASH})
    assert url_filter.judge_urls(rows).count() == 4 and url_filter.judge_urls(rows.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, None, None), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)


def test_join_judges_repeated_ids_by_their_own_texts(spark, monkeypatch):
    import random

    draw = random.Random(3)
    made = lambda n: " ".join(draw.choice("abcdefghij") + str(draw.randint(0, 999)) for _ in range(n))
    a, b, c = made(60), made(60), made(60)
    rows = [(5, a), (5, b), (3, a + " one"), (9, b + " two"), (11, b), (7, c), (7, c + " x"), (7, None), (5, a), (None, a)]
    want = sorted([(5, 3), (5, 5), (3, 3), (9, 5), (11, 5), (7, 7), (7, 7), (7, 7), (5, 3)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, parts in ((jaccard_join.CHUNK, 1), (2, 5)):
        monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
        got = jaccard_join.join_components(docs.repartition(parts)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == want
        assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_a_common_line_makes_no_large_block(spark):
    import random

    draw = random.Random(4)
    line = " ".join(f"line{i}" for i in range(15))
    texts = [" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(draw.choice((8, 12, 60)))) + " " + line for _ in range(300)]
    texts += [t + " more" for t in texts[:9] + texts[:4]] + [line, line + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rule = jaccard_join.Rule()
    blocks = jaccard_join._blocks(jaccard_join.signatures(docs, rule, "doc_id", "text"), rule)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] < 40
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in map(str.split, texts)]
    near = list(range(len(texts)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    near[i] = near[j] = min(near[i], near[j])
    assert near[300:313] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 0, 1, 2, 3] and near[314] == 313
    assert {r.doc_id: r.component_id for r in jaccard_join.join_components(docs, rule).collect()} == dict(enumerate(near))


def test_repeats_by_any_id_under_any_column_name(spark):
    a, b = "a" * 150, "qwertyuiop" * 20 + "z" * 150
    rows = [(5, a, 1, "x"), (5, b, 2, "y"), (None, b, 3, "z"), (7, a + b, 4, None), (5, a, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `my-col` string").repartition(2)
    kept = suffix_dedup.remove_repeats(docs, "text")
    assert kept.columns == docs.columns
    got = {r["a.b"]: (r["doc_id"], r["my-col"]) for r in kept.collect()}
    assert got == {1: (5, "x"), 2: (5, "y"), 3: (None, "z"), 4: (7, None), 5: (5, "x")}

    def removed(texts):
        seen, out = set(), []
        for t in texts:
            gone = [False] * len(t)
            for j in range(len(t) - 99):
                if t[j : j + 100] in seen:
                    gone[j : j + 100] = [True] * 100
                seen.add(t[j : j + 100])
            out.append(sum(gone))
        return out

    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs, "digest").collect())
    # the two texts of id 5 come in the order of their hashes, equal rows count once
    either = []
    for first, second in ((a, b), (b, a)):
        n = dict(zip(("none", first, second, "last"), removed([b, first, second, a + b])))
        either.append(sorted([(-1, len(b), n["none"]), (5, len(a), n[a]), (5, len(a), n[a]), (5, len(b), n[b]), (7, len(a + b), n["last"])]))
    assert found in either
    named = spark.createDataFrame([("b", a), ("a", a), ("c", b[:90])], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(named, "digest").collect()} == {"a": 149, "b": 150, "c": 0}


def test_items_in_several_blocks_give_the_same_leaks(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(30)]
    docs = spark.createDataFrame([(i, f"before {t} after" if i % 2 else "before after") for i, t in items], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i, _ in items if i % 2}
    for name, value in (("HELD", decontaminate.HELD), ("BLOCK_ITEMS", 7), ("BLOCK_BYTES", 300)):
        monkeypatch.setattr(decontaminate, name, value)
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, asked).collect()} == want


def test_queries_in_several_blocks_give_the_same_best(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)], "doc_id long, text string")
    whole = sorted(map(tuple, bm25_search.search(docs, docs, 3).collect()))
    monkeypatch.setattr(bm25_search, "QUERIES", 11)
    assert sorted(map(tuple, bm25_search.search(docs, docs, 3).collect())) == whole and len(whole) == 180
    monkeypatch.setattr(bm25_search, "QUERIES", 4_000)
    for first, pivots in ((1, 1), (3, 2)):
        monkeypatch.setattr(bm25_search, "FIRST_BLOCKS", first)
        monkeypatch.setattr(bm25_search, "PIVOTS", pivots)
        monkeypatch.setattr(bm25_search, "BLOCK", 4)
        assert sorted(map(tuple, bm25_search.search(docs, docs, 3).collect())) == whole
