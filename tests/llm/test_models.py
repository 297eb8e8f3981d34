"""The trained operators against plain versions of what they compute."""

import random

import numpy as np
import pyarrow as pa
import pytest

from variora.llm import language_id, language_model, quality
from variora.llm.common import mix, text_buffer, unmix

rng = random.Random(8)


def words_of(letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def prose(words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def symbols(model, raw):
    """Folded symbols with runs of spaces as one."""
    out = []
    for c in model.fold[np.frombuffer(raw, np.uint8)].tolist():
        if c or not out or out[-1]:
            out.append(c)
    return bytes(out)


def plain_phrases(sample, text):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("piece", [3, 64, 512])
def test_phrases_are_those_of_a_plain_parse(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    one, two = words_of("abcdeéñ z1", 30), words_of("abcxyü q", 30)
    samples = {"a": [prose(one, 200), prose(one, 50)], "b": [prose(two, 300)]}
    model = language_id.Model({k: [t.encode() for t in v] for k, v in samples.items()})
    texts = [prose(one, rng.randint(0, 90)) for _ in range(12)] + [prose(one + two, 400), "", "12 34", "日本abc 日", "日 abc", samples["a"][0], prose(two, 9) + samples["a"][0] * 2 + samples["b"][0]]
    buffer, offsets = text_buffer(pa.array(texts))
    counts, size = model.phrases(buffer, offsets)
    for i, t in enumerate(texts):
        folded = symbols(model, t.encode())
        assert size[i] == len(folded)
        assert counts[i].tolist() == [plain_phrases(symbols(model, " ".join(samples[k]).encode()), folded) for k in model.languages], t


def test_many_symbols_and_no_language():
    letters = [chr(c) for c in range(0x3B1, 0x3C9)] + [chr(c) for c in range(0x4E00, 0x4E60)] + [chr(c) for c in range(0x1F600, 0x1F640)]
    samples = {"x": ["".join(rng.choice(letters) for _ in range(300))], "y": ["plain words"]}
    model = language_id.Model({k: [t.encode() for t in v] for k, v in samples.items()})
    assert model.words > 1
    asked = [samples["x"][0][5:90], "words plain", "".join(rng.choice(letters) for _ in range(50))]
    buffer, offsets = text_buffer(pa.array(asked))
    want = [[plain_phrases(symbols(model, samples[k][0].encode()), symbols(model, t.encode())) for k in "xy"] for t in asked]
    assert model.phrases(buffer, offsets)[0].tolist() == want
    assert model.predict(pa.array(asked))[0][:2] == ["x", "y"]
    assert language_id.Model({}).predict(pa.array(["a", None]))[0] == ["und", "und"]


def test_languages_tie_and_copies_count_once(spark):
    rows = [(i, "the same words here", lang) for i, lang in enumerate(["b", "a", "a", "a", None])] + [(1, "the same words here", "a")] * 40 + [(None, "more words", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 4"))
    assert model.languages == ["a", "b"]
    got = {r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got == {"a"}  # equal rates: the first by name


def plain_units(text):
    """Letters, digits and signs in runs, cut at spaces and changes of class."""
    kinds = lambda b: 0 if b in b"\t\n\v\f\r " else 1 if chr(b).isascii() and chr(b).isalpha() or b >= 128 else 2 if chr(b).isdigit() else 3
    out, now = [], b""
    for b in text.encode():
        if now and kinds(now[-1]) != kinds(b):
            out.append(now)
            now = b""
        now = now + bytes([b]) if kinds(b) else b""
    return [u.lower() if u.isascii() else u for u in out + [now] if u and kinds(u[0])]


def test_units_and_pooling_are_those_of_a_plain_version():
    texts = ["", "  ", "Ab ab9 9ab!! x,y", "word word word", "é è 12.5%", "A" * 70_000 + " b"] + [prose(words_of("abAB1!é", 40), 60) for _ in range(8)]
    buffer, offsets = text_buffer(pa.array(texts))
    hashes, first = quality.units(buffer, offsets)
    for i, t in enumerate(texts):
        own = hashes[first[i] : first[i + 1]]
        alone, one = quality.units(*text_buffer(pa.array([t])))
        assert alone.tolist() == own.tolist()
        assert len(own) == len(plain_units(t)) + len(t.encode().split())  # units and one shape mark a word
    model = quality.train([t for t in texts * 20], np.arange(len(texts) * 20) % 2)
    pooled = model.pooled(buffer, offsets)
    vector = dict(zip(model.words.tolist(), model.vectors))
    for i in range(len(texts)):
        own = [vector.get(h, model.vectors[-1]) for h in hashes[first[i] : first[i + 1]].tolist()]
        assert np.allclose(pooled[i], np.mean(own, axis=0) if own else 0, atol=1e-3)


def test_context_vectors_are_summed_index_vectors_of_neighbours():
    texts = [prose(words_of("abc", 12), 40) for _ in range(6)] * 4
    model = quality.train(texts, np.arange(24) % 2)
    index = quality.index_vectors(model.words)
    at = {h: i for i, h in enumerate(model.words.tolist())}
    context = np.zeros_like(index)
    for t in texts:
        own = [at.get(h) for h in quality.units(*text_buffer(pa.array([t])))[0].tolist()]
        for i, a in enumerate(own):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if a is not None and 0 <= j < len(own) and own[j] is not None:
                    context[a] += index[own[j]]
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    assert np.allclose(model.vectors[:-1], index + np.divide(context, norm, out=np.zeros_like(context), where=norm > 0), atol=1e-4)


def test_the_network_gives_calibrated_probabilities():
    labels = np.array([rng.random() < (0.9 if i % 2 else 0.1) for i in range(600)]).astype(int)
    texts = [prose(["good", "fine", "well"] if i % 2 else ["bad", "poor", "ill"], 30) for i in range(600)]
    model = quality.train(texts, labels)
    score = model.score(model.pooled(*text_buffer(pa.array(["good fine well " * 9, "bad poor ill " * 9, ""]))))
    assert abs(score[0] - 0.9) < 0.12 and abs(score[1] - 0.1) < 0.12 and 0 <= score[2] <= 1


def test_labels_of_one_id_and_texts_of_one_id(spark):
    docs = spark.createDataFrame([("a", "one two"), ("a", "one"), ("b", "three"), ("c", None), (None, "x")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("c", 7), (None, 1), ("zz", 0)], "doc_id string, quality int")
    seen = {}
    old = quality.train
    quality.train = lambda texts, y: seen.update(zip(texts, y.tolist())) or old(texts, y)
    try:
        quality.fit(docs, labels, None)
    finally:
        quality.train = old
    assert seen == {"one": 0, "three": 1}


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, `a.b` int, `my-col` int")
    model = quality.train([], np.zeros(0, int))
    got = quality.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "a.b", "my-col", "score", "predicted"] and got.first()["score"] == 0.5


def test_monotone_sequences_are_read_and_searched_within_ranges():
    values = np.sort(np.array([rng.randrange(1 << 30) for _ in range(500)] + [7, 7, 7, 1 << 29] * 20, np.uint64))
    made = language_model.EliasFano(language_model.EliasFano.build(values, 30, "x"), "x")
    assert made.get(np.arange(len(values))).tolist() == values.tolist() == made.all().tolist()
    asked = np.concatenate([values, [np.uint64(3), np.uint64((1 << 30) - 1)]])
    for low, high in ((0, len(values)), (100, 300), (5, 5)):
        inside = set(values[low:high].tolist())
        found = made.find(asked, np.full(len(asked), low), np.full(len(asked), high))
        for q, i in zip(asked.tolist(), found.tolist()):
            assert (low <= i < high and int(values[i]) == q) if q in inside else i == -1
    h = np.array([rng.randrange(1 << 64) for _ in range(99)], np.uint64)
    assert unmix(mix(h)).tolist() == h.tolist()


def test_other_stores_are_copied_before_they_are_mapped(tmp_path, monkeypatch):
    from pyarrow.fs import LocalFileSystem

    arrays = {"a": np.arange(5), "b": np.zeros(0, np.uint64)}
    for store in (None, LocalFileSystem()):
        monkeypatch.setattr(language_model, "_store", lambda folder, store=store: (store, folder))
        folder = str(tmp_path / f"m-{store is None}")
        language_model.make_folder(folder)
        language_model.write_arrays(folder, "f", arrays)
        got = language_model.map_arrays(folder, "f")
        assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in arrays.items()}
    monkeypatch.undo()
    assert language_model._store("file:///x/y") == (None, "/x/y") and language_model._store("/x/y") == (None, "/x/y")
