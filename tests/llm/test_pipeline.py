"""Every stage of the pipeline against a plain version on planted rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from variora.llm import decontaminate, quality
from variora.llm.common import text_buffer

rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(500)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def edited(text, every):
    return " ".join(f"edit{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


ITEMS = [(i, prose(30)) for i in range(6)] + [(6, None), (7, "")]
PASSAGE, COPIED, NEAR = prose(60), prose(90), prose(120)
GOOD = [prose(rng.randint(20, 140)) for _ in range(60)]
GOOD += [COPIED] * 5 + [NEAR, edited(NEAR, 60), edited(NEAR, 119)] + [f"{prose(40)} {PASSAGE} {prose(40)}" for _ in range(4)]
GOOD += [f"{prose(50)} {ITEMS[0][1]} {prose(50)}", f"{prose(50)} {edited(ITEMS[1][1], 5)} {prose(50)}", edited(ITEMS[2][1], 4), f"x {PASSAGE} é{PASSAGE}"]
BAD = ["".join(rng.choice("%$#@!<>{}") for _ in range(rng.randint(20, 200))) + " buy now" for _ in range(30)]
TEXTS = GOOD + BAD + [None, "", "  ", "日本 😀"]
ROWS = [(i * 3, t, "en", i, "x") for i, t in enumerate(TEXTS)] + [(None, GOOD[0], None, 1, None), (None, f"{prose(40)} {ITEMS[3][1]}", None, None, None)]
SCHEMA = "doc_id long, text string, lang string, `a.b` int, `my-col` string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(i < len(GOOD)), 0) for i, r in enumerate(ROWS[: len(GOOD) + len(BAD)]) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_keeps_what_its_network_keeps(spark, docs, folder):
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.score(model.pooled(*text_buffer(pa.array([r[1] for r in ROWS], pa.string()))))
    assert kept.columns == docs.columns and rows_of(kept) == sorted([r for r, s in zip(ROWS, score) if s >= 0.3], key=repr)
    ids = {r[1] for r in rows_of(kept)}
    assert set(GOOD) <= ids and not ids & set(BAD)


def test_one_of_each_near_duplicate_group_stays(spark, docs, folder):
    sets = {}
    for i, t, *_ in ROWS:
        w = (t or "").lower().split()
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    near = {i: i for i in sets}
    for _ in range(4):
        for i, a in sets.items():
            for j, b in sets.items():
                if a and 100 * len(a & b) >= 80 * len(a | b):
                    near[i] = near[j] = min(near[i], near[j])
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    assert kept.columns == docs.columns and rows_of(kept) == sorted([r for r in ROWS if r[0] is None or near[r[0]] == r[0]], key=repr)
    assert sum(r.text == COPIED for r in kept.collect()) == 1


def test_repeated_passages_go(spark, docs, folder):
    own = [r for r in ROWS if r[0] is not None]
    seen, want = set(), []
    for r in sorted(own):
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 99):
            gone[j : j + 100] |= raw[j : j + 100] in seen
            seen.add(raw[j : j + 100])
        want.append((r[0], bytes(np.frombuffer(raw, np.uint8)[~gone]).decode(errors="ignore"), *r[2:]))
    kept = corpus_pipeline.repeats_stage(spark, docs.where("doc_id is not null"), folder)
    assert kept.columns == docs.columns and rows_of(kept) == sorted(want, key=repr)
    assert sum(PASSAGE in r.text for r in kept.collect()) == 1
    assert corpus_pipeline.repeats_stage(spark, docs, folder).count() == len(ROWS)


def test_leaks_go_and_clean_documents_stay(spark, docs, folder):
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()], np.int64)
    clean = []
    for r in ROWS:
        scores = [decontaminate.align(code(t), code(r[1]))[0] / len(code(t)) for _, t in ITEMS if t]
        if max(scores) < decontaminate.MIN_SCORE:
            clean.append(r)
    kept = corpus_pipeline.decontamination_stage(spark, docs, folder)
    assert kept.columns == docs.columns and rows_of(kept) == sorted(clean, key=repr)
    assert len(ROWS) - len(clean) == 4 and sum(r[0] is None for r in clean) == 1


def test_encoding_is_the_librarys(spark, docs, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())) for i, t, *_ in ROWS for ids in [library.encode(t or "")]]
    assert rows_of(corpus_pipeline.encoding_stage(spark, docs, folder)) == sorted(want, key=repr)


def test_the_whole_run_is_the_stages_one_after_another(spark, docs, folder):
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        rows, columns = now.collect(), now.schema
        now = stage(spark, spark.createDataFrame(rows, columns), folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "encoding"]
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(now)
