"""What SQL can't say: random draws, alignments, simulations, files and errors."""

import json
import logging
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from variora.functions import labels
from variora.functions import text as T
from variora.operators import evaluation, linking, order, pools, sampling, screening, statistics, study
from variora.operators.alignment import EXTEND, MATCH, MISMATCH, OPEN, align, alignment_score, gotoh
from variora.sources import readers, sinks
from variora.streaming import screen

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def test_words_are_those_of_unicode(spark):
    texts = [f"{s}a{s}{s}b{s}" for s in SPACES] + ["", None, "a​b", SPACES]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words(F.col("t")).alias("w"), T.collapse(F.col("t")).alias("c"), T.alignment_key(F.col("t")).alias("k")).collect()
    for r in rows:
        assert r.w == (r.t or "").split()
        assert r.t is None or (r.c == " ".join(r.t.split()) and r.k == r.t.strip().lower())


def plain_score(pairs, a, b):
    score, last = 0.0, None
    for i, j in pairs:
        if i is not None and j is not None:
            score, last = score + (MATCH if a[i] == b[j] else MISMATCH), None
        else:
            side = 0 if i is None else 1
            score, last = score + (EXTEND if last == side else OPEN), side
    return score


def best_score(a, b):
    """By all three tables, without tracing back."""
    low = float("-inf")
    m, x, y = ({} for _ in range(3))
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                m[0, 0], x[0, 0], y[0, 0] = 0.0, low, low
                continue
            best = lambda p: max(m[p], x[p], y[p])
            m[i, j] = best((i - 1, j - 1)) + (MATCH if a[i - 1] == b[j - 1] else MISMATCH) if i and j else low
            x[i, j] = max(max(m[i - 1, j], y[i - 1, j]) + OPEN, x[i - 1, j] + EXTEND) if i else low
            y[i, j] = max(max(m[i, j - 1], x[i, j - 1]) + OPEN, y[i, j - 1] + EXTEND) if j else low
    return max(m[len(a), len(b)], x[len(a), len(b)], y[len(a), len(b)])


def test_alignments_are_complete_ordered_and_best():
    draw = random.Random(6)
    for _ in range(120):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(1, 9))] for _ in range(2))
        pairs = gotoh(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        paired = [k for k, (i, j) in enumerate(pairs) if i is not None and j is not None]
        for begin, end in zip([-1, *paired], [*paired, len(pairs)]):
            gaps = [i is None for i, _ in pairs[begin + 1 : end]]
            assert gaps == sorted(gaps, reverse=end < len(pairs))  # gaps in a first, after the last pair last
        assert plain_score(pairs, a, b) == pytest.approx(best_score(a, b))
        assert sum(i is not None and j is not None and a[i] == b[j] for i, j in pairs) == len(paired)
    with pytest.raises(ValueError):
        gotoh([], ["a"])


def test_alignment_rates(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "", "d"], ["a", "x", "", "d"], ["N", "", "", "V"], ["N", "", "", "N"])], "k int, a array<string>, b array<string>, p array<string>, q array<string>")
    whole = F.expr("transform(sequence(0, 3), i -> named_struct('idx_a', i, 'idx_b', i))")
    r = alignment_score(rows.withColumn("pairs", whole), ["k"], {"lemma": ("a", "b"), "pos": ("p", "q")}).first()
    assert (r.n_aligned, r.n_gaps_a, r.n_gaps_b, r.lemma_match_rate, r.pos_match_rate) == (4, 0, 0, 0.5, 0.25)
    made = align(rows.withColumn("e", F.array().cast("array<string>")), ["k"], "a", "e").first()
    assert made.pairs == []


def test_windows_cut_into_parts_are_those_of_one_pass(spark):
    draw = random.Random(9)
    rows = [(s, i, f"{s}{i}", " ".join("w" for _ in range(draw.choice([0, 3, 40, 70, 149, 160, 301])))) for s in ("a", "b", None) for i in range(90)]
    want = {}
    for s in ("a", "b", None):
        now, held, window = [], 0, 0
        for _, i, ref, text in [r for r in rows if r[0] == s]:
            n = len(text.split())
            if not n:
                continue
            if held and held + n > 300:
                want[s, window], now, held, window = (now, held), [], 0, window + 1
            now, held = [*now, ref], held + n
            if held >= 150:
                want[s, window], now, held, window = (now, held), [], 0, window + 1
        if now:
            want[s, window] = (now, held)
    table = spark.createDataFrame(rows, "source string, ord long, ref string, text string").repartition(4)
    for part_rows in (7, 64, 500_000):
        got = {(r.source, r.window): (r.ref, r.n_words) for r in order.passage_windows(table, part_rows=part_rows).collect()}
        assert got == {k: (refs[0] if len(refs) == 1 else f"{refs[0]}–{refs[-1]}", n) for k, (refs, n) in want.items()}


def test_vowels_change_within_the_budget_and_never_to_attested_forms(spark):
    words = "λέγει εἰπεῖν οἶκος ἔχω αιων καιρος ησαν μοι ειμι τοις".split()
    texts = [" ".join(random.Random(i).choice(words) for _ in range(1 + i % 12)) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    forms = spark.createDataFrame([("ιμι",), ("ισαν",), ("τυς",)], "form string")
    made = {r.id: r for r in pools.itacism_examples(rows, "text", "id", forms).collect()}
    assert made == {r.id: r for r in pools.itacism_examples(rows.repartition(5), "text", "id", forms).collect()}
    for i, t in enumerate(texts):
        if i not in made:
            continue
        assert made[i].target_text == t
        old, new = t.split(), made[i].input_text.removeprefix("normalize: ").split()
        changed = [(a, b) for a, b in zip(old, new, strict=True) if a != b]
        assert 1 <= len(changed) <= max(2, int(0.4 * len(old)))
        for a, b in changed:
            assert b not in ("ιμι", "ισαν", "τυς")
            assert any(a.replace(x, y, 1) == b for x, y in pools.ITACISMS)


def test_compositions_sum_up(spark):
    rows = spark.createDataFrame([(i, i % 9, i % 4 + 1) for i in range(80)], "id int, n int, k int")
    for r in pools.compositions(rows, "id", "n", "k").collect():
        assert sum(r.parts) == r.n and len(r.parts) == min(r.n, r.k) and all(p > 0 for p in r.parts)


def test_masked_tokens(spark):
    rows = spark.createDataFrame([(i, list(range(100, 100 + n))) for i, n in enumerate([0, 1, 6, 7, 40, 1000])], "id int, ids array<int>")
    for r in pools.mask_tokens(rows, "id", "ids", mask=-1).collect():
        n = len(r.ids)
        assert r.labels == r.ids and r.input_ids.count(-1) == (max(1, int(n * 0.15)) if n else 0)
        assert all(x in (-1, y) for x, y in zip(r.input_ids, r.ids, strict=True))


def test_packing_loses_no_token(spark):
    draw = random.Random(1)
    lists = [[i * 1000 + j for j in range(draw.choice([0, 1, 5, 30, 300]))] for i in range(60)]
    flat = [x for own in lists for x in own]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, t array<int>").repartition(3)
    got = {r.sequence: r.tokens for r in pools.pack(rows, "id", "t", 64).collect()}
    want = [flat[a : a + 64] for a in range(0, len(flat), 64)]
    assert got == {i: s for i, s in enumerate(want) if len(s) >= 8}


def test_simulated_power_is_that_of_a_plain_loop(spark):
    weights, tau, sims, draws = [30.0, 60.0, 90.0, 40.0], 0.2, 30, 60

    def plain(effect):
        hits = 0
        for sim in range(sims):
            rng = np.random.default_rng([42, sim, int(round(effect * 1e6))])
            x = rng.normal(effect, np.sqrt(tau**2 + 1 / np.asarray(weights)))
            picked = rng.integers(0, len(weights), (draws, len(weights)))
            hits += sorted_quantile([sum(x[j] for j in row) / len(row) for row in picked], 0.025) > 0
        return hits / sims

    def sorted_quantile(values, q):
        values = sorted(values)
        at = q * (len(values) - 1)
        low = int(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    effects = [0.0, 0.2, 0.5]
    got = {r.effect: r.power for r in statistics.lift_power(spark, effects, weights, tau, sims, draws).collect()}
    assert got == {e: plain(e) for e in effects}
    found = statistics.minimum_effect(spark.createDataFrame([(0.1, 0.2), (0.3, 0.9), (0.5, 1.0)], "effect double, power double")).first().effect
    assert found == 0.3 and statistics.minimum_effect(spark.createDataFrame([(0.1, 0.2)], "effect double, power double")).first().effect == float("inf")
    curve = {r.effect: r.power for r in study.difference_power(spark, [0.0, 0.5, 2.0], [50.0] * 4, [50.0] * 9, tau, 40, 80).collect()}
    assert curve[0.0] <= curve[0.5] <= curve[2.0] == 1.0


def test_null_sides_never_match_and_groups_without_tokens_are_errors(spark):
    rows = spark.createDataFrame([("a", "A"), (None, None), ("b", None), ("c", "d")], "p string, g string")
    from variora.operators.aggregates import exact_match_rate

    assert exact_match_rate(rows, F.col("p"), F.lower("g")).first().rate == 0.25
    scores = spark.createDataFrame([("x", 1.0, 0), ("y", 2.0, 3)], "g string, nll double, n int")
    assert evaluation.checked_perplexity(scores.where("n > 0"), ["g"], "nll", "n").first().mean_nll == 2.0
    with pytest.raises(PySparkException):
        evaluation.checked_perplexity(scores, ["g"], "nll", "n").collect()
    with pytest.raises(PySparkException):
        evaluation.correctness(rows, "g", "p").collect()


def test_bad_arguments(spark):
    rows = spark.createDataFrame([(i, "s") for i in range(4)], "id int, s string")
    with pytest.raises(ValueError):
        sampling.stratified_split(rows, "id", "s", 0.6, 0.3, 0.2)
    for k in (1, 5):
        with pytest.raises(ValueError):
            sampling.folds(rows, "id", ["s"], k)
    assert sorted(r.fold for r in sampling.folds(rows, "id", ["s"], 2).collect()) == [0, 0, 1, 1]


def test_strata_with_nulls_and_one_hot_stratum(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(2000)], "id int, s string")
    sizes = {}
    for r in sampling.stratified_split(rows, "id", "s").groupBy("s", "split").count().collect():
        sizes.setdefault(r.s, {})[r.split] = r["count"]
    for s, own in sizes.items():
        n = sum(own.values())
        assert own["train"] == round(n * 0.6) and own["val"] == round(n * 0.2), s
    held = sampling.hold_out(rows, "id", "s", 9, exempt=["hot"])
    assert held.count() == 2000 and {r.s: r["count"] for r in held.where("held").groupBy("s").count().collect()} == {None: 9, **{f"s{i}": 9 for i in range(7)}}


def test_screening_finds_what_a_plain_scan_finds(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([0, 3, 9, 30]))) for _ in range(80)]
    held = [" ".join(t.split()[2:11]) for t in texts[:6] if len(t.split()) > 12] + ["W1 w2", ""]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)} or ({tuple(w)} if w else set())

    index = set().union(*map(grams, held))
    rows = spark.createDataFrame(list(enumerate(texts + ["w1  W2"])), "id int, text string")
    asked = spark.createDataFrame([(t,) for t in held], "text string")
    got = {r.id for r in screening.contaminated(rows, asked, "id").collect()}
    assert got == {i for i, t in enumerate(texts + ["w1  W2"]) if grams(t) & index} and got
    assert {r.id for r in screen.clean_stream(rows, asked, "id").collect()} == got


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b.txt").write_text("x\n\ny")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    own = sorted((r.n, r.value) for r in rows if r.file.endswith("a.txt"))
    assert own == [(i, f"line {i}") for i in range(5000)] and len({r.n for r in rows if r.file.endswith("b.txt")}) == 3


def test_columns_of_other_lengths(spark):
    column = lambda values: spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "slot int, value string")
    made = readers.zip_columns({"word": column("ab"), "book": column("xyz")}).orderBy("slot").collect()
    assert [(r.word, r.book) for r in made] == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError):
        readers.zip_columns({"word": column("abc"), "book": column("xy")})


def test_documents_and_logs(spark, tmp_path):
    path = f"{tmp_path}/r.json"
    for value in ({"a": 1, "b": "é"}, {"c": [1]}):
        sinks.write_document(spark, value, path)
        assert json.loads((tmp_path / "r.json").read_text()) == value
    assert sinks.report(spark.range(1)) == {"id": 0}
    assert sinks.report_markdown("T", spark.range(1)) == "# T\n\n| id |\n|-|\n| 0 |"
    record = logging.LogRecord("x", logging.INFO, "", 0, "said %s", ("this",), None)
    record.count = 3
    said = json.loads(sinks.JsonLines().format(record))
    assert (said["message"], said["count"], said["level"]) == ("said this", 3, "INFO")
    assert labels.digest({"b": 1, "a": "é"}) == __import__("hashlib").sha256('{"a":"é","b":1}'.encode()).hexdigest() and len(labels.fingerprint({"a": 1})) == 12


def test_pools_and_the_corpus_build(spark):
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randint(0, 400)}" for _ in range(60)) for _ in range(80)]
    passages = spark.createDataFrame([("lxx" if i % 2 else "plato", i, str(i), t) for i, t in enumerate(texts)], "source string, ord long, ref string, text string")
    held = spark.createDataFrame([(" ".join(texts[7].split()[10:30]),)], "text string")
    made = pools.build_corpus(passages, held, 0.2)
    total = json.loads(made["manifest"].first().manifest)
    assert total["contaminated"] == total["dropped"] == 1
    assert total["raw_windows"] == total["clean_windows"] + total["dropped"] and total["clean_windows"] == total["train_windows"] + total["eval_windows"]
    assert made["eval_perplexity"].count() == total["eval_windows"] >= 1
    rows = made["corpus"].groupBy("task").count().collect()
    assert {r.task: r["count"] for r in rows} == {"denoise": total["train_windows"], "continuation": total["train_windows"]}
    clean = {r.raw_text for r in made["corpus"].where("task = 'denoise'").collect()} | {r.text for r in made["eval_perplexity"].collect()}
    assert len(clean) == total["clean_windows"] and {r.register for r in made["corpus"].collect()} <= {"koine", "classical"}
    empty = pools.register_draws(spark.createDataFrame([("a", None, 0), ("b", "koine", 4)], "task string, register string, n long"), {"a": 1.0, "b": 1.0}, {"koine": 1.0}, spark.range(20), "id")
    assert {r.task for r in empty.collect()} == {"b"}


def test_ranges_hold_their_ends(spark):
    ranges = spark.createDataFrame([("B", 1, 1, 30, 3, 2), ("B", 2, 2, 5, 2, 9), ("B", 3, 5, 9, 4, 1)], "k string, pid int, c1 int, v1 int, c2 int, v2 int")
    points = [("B", c, v) for c in range(0, 6) for v in (1, 2, 3, 5, 9, 29, 30, 99)]
    got = {(r.c, r.v): r.pid for r in linking.find_range(spark.createDataFrame(points, "k string, c int, v int"), ranges, ["k"], ("c", "v"), ("c1", "v1"), ("c2", "v2"), "pid", "pid").collect()}
    assert got == {(c, v): next((p for p, lo, hi in ((1, (1, 30), (3, 2)), (2, (2, 5), (2, 9))) if lo <= (c, v) <= hi), None) for _, c, v in points}


def test_a_probe_learns_what_is_linear(spark):
    from variora.operators.probe import linear_probe

    draw = random.Random(3)
    rows = [([draw.gauss(0, 1) for _ in range(4)],) for _ in range(300)]
    made = spark.createDataFrame([(v, "ab"[v[0] + v[1] > 0]) for (v,) in rows], "v array<double>, l string")
    r = linear_probe(made.limit(200), made.unionAll(spark.createDataFrame([([0.0] * 4, "new")] * 100, made.schema)), "v", "l").first()
    assert r.n == 400 and 0.65 < r.accuracy <= 0.75


def test_a_stream_indexes_the_held_out_texts_once(spark, monkeypatch, tmp_path):
    held = [" ".join(f"h{i}x{j}" for j in range(9)) for i in range(3)]
    texts = [f"a b {held[i % 3].upper()} c" if i % 4 == 0 else f"a b c d e f g h i j k {i}" for i in range(30)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    calls = []
    for module in (screen, screening):
        made = module.contamination_index
        monkeypatch.setattr(module, "contamination_index", lambda *a, made=made: calls.append(a) or made(*a))
    asked = spark.createDataFrame([(t,) for t in held], "text string")
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    screen.flag_batches(stream, asked, f"{tmp_path}/out", f"{tmp_path}/state", "id").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.id: r.contaminated for r in got} == {i: i < 30 and i % 4 == 0 for i in range(32)} and len(got) == 32
    assert len({r.batch for r in got}) == 3 and len(calls) == 1
