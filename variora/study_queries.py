"""Queries of training examples, study units, verdicts and tags, added to the core ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from variora.functions import tags
from variora.functions import text as T
from variora.operators import examples, sampling, study
from variora.operators.linking import numbered
from variora.plans import reader
from variora.queries import _SCORES, _TEXTS, _boot, _rounded, _scores, _sides, _SIDES, _SUMMARY, _texts, _U, query, table, words

_MEMBERS = ["user", "assistant", "system"]
_MAP = "m AS (SELECT conv_id, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a, max(text) FILTER (role = 'system') AS s FROM t WHERE text <> '' GROUP BY conv_id)"


@query("""WITH g AS (SELECT conv_id, string_agg(substr(md5(text), 1, 6), ' ' ORDER BY turn) AS w, string_agg(role, ' ' ORDER BY turn) AS p,
        count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, 'raw' AS task, w AS input_text, w AS target_text FROM g WHERE n >= 2 UNION ALL SELECT conv_id, 'pos', w, p FROM g
        WHERE n BETWEEN 2 AND 60""")
def annotated_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("form", F.substring(F.md5("text"), 1, 6))
    return examples.annotated_examples(rows, "conv_id", ["turn"], "form", {"pos": "role"})


@query(f"""WITH {_TEXTS}, {_MAP}, d AS (SELECT conv_id, 'user' AS source, 'assistant' AS target, u AS x, a AS y FROM m WHERE u IS NOT NULL AND a IS NOT NULL
    UNION ALL SELECT conv_id, 'system', 'user', s, u FROM m WHERE s IS NOT NULL AND u IS NOT NULL) SELECT conv_id, source, target, md5(x) AS x,
        md5(y) AS y FROM d""")
def directed_pairs(spark, sf_dir):
    rows = examples.directed_pairs(_texts(spark, sf_dir), "conv_id", "role", "text", [("user", "assistant"), ("system", "user")])
    return rows.select("conv_id", "source", "target", F.md5("source_text").alias("x"), F.md5("target_text").alias("y"))


_FUSED = f"WITH {_TEXTS}, {_MAP}, f AS (SELECT * FROM m WHERE u IS NOT NULL AND a IS NOT NULL AND s IS NOT NULL)"


def _fused(spark, sf_dir):
    return examples.fusion_examples(_texts(spark, sf_dir), "conv_id", "role", "text", ["user", "assistant"], "system")


def _witnesses(rows):
    entries = F.transform(F.array_sort(F.map_entries("witnesses")), lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"])))
    return rows.select("conv_id", F.array_join(entries, ",").alias("witnesses"), F.md5("target_text").alias("target"))


@query(f"{_FUSED} SELECT conv_id, 'assistant=' || md5(a) || ',user=' || md5(u) AS witnesses, md5(s) AS target FROM f")
def fusion_examples(spark, sf_dir):
    return _witnesses(_fused(spark, sf_dir))


@query(f"""{_FUSED} SELECT conv_id, 'assistant=' || md5(a) || ',user=' || md5(u) AS witnesses, md5(s) AS target FROM f UNION ALL SELECT conv_id,
        'assistant=' || md5(a), md5(s) FROM f
    UNION ALL SELECT conv_id, 'user=' || md5(u), md5(s) FROM f""")
def source_dropout(spark, sf_dir):
    return _witnesses(examples.source_dropout(_fused(spark, sf_dir)))


@query(
    "SELECT doc_id, md5('restore: ' || upper(replace(strip_accents(text), 'ß', 'ss'))) AS input, md5(text) AS target FROM documents WHERE strip_accents(text) <> text"
)
def restoration_examples(spark, sf_dir):
    rows = examples.restoration_examples(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.md5("input_text").alias("input"), F.md5("target_text").alias("target"))


@query(f"""SELECT doc_id, md5(array_to_string(w[1:len(w) // 2], ' ')) AS input, md5(array_to_string(w[len(w) // 2 + 1:], ' ')) AS target
        FROM (SELECT doc_id, {words('text')} AS w FROM documents)
    WHERE len(w) >= 6""")
def completion_probe(spark, sf_dir):
    rows = examples.completion_probe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.md5("input_text").alias("input"), F.md5("target_text").alias("target"))


@query(f"""SELECT doc_id, n - hidden AS kept, hidden FROM (SELECT doc_id, n, greatest(least(greatest(1, round_even(n * 0.15, 0)::INTEGER), n - 1), 0) AS hidden
    FROM (SELECT doc_id, len({words('text')})::INTEGER AS n FROM documents))""")
def span_corruption(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    made = examples.corrupt_spans(rows, "doc_id", "w")
    words_in = lambda c: F.size(F.filter(c, lambda x: ~x.startswith("<extra_id_")))
    return made.select("doc_id", words_in("corrupted").alias("kept"), (words_in("target") - 1).alias("hidden"))


@query("""SELECT *, least("user", assistant, system) AS smallest, conv_id IN (1, 2, 3) AS overlap FROM (
    SELECT conv_id, count(*) FILTER (role = 'user') AS "user", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id)
    WHERE least("user", assistant, system) > 0""")
def full_units(spark, sf_dir):
    return study.full_units(table(spark, sf_dir, "conversations"), "conv_id", "role", _MEMBERS, [1, 2, 3])


@query(
    """SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def unit_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return study.unit_table(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), {"orders": orders}, "c_custkey")


@query("""SELECT (SELECT count(*) = 0 FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(DISTINCT quality) > 1)) AS disjoint,
    (SELECT count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS covering, (SELECT count(*) = 0 FROM labels
        WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS closed""")
def split_check(spark, sf_dir):
    return study.split_check(table(spark, sf_dir, "labels"), "doc_id", "quality", table(spark, sf_dir, "documents"))


@query(f"""WITH {_SIDES}, w AS (SELECT {words('a')} AS g, {words('lower(a)')} AS p, {words("translate(a, 't', 'T')")} AS s FROM s),
    e AS (SELECT len(g) AS n, len(list_filter(range(1, len(g) + 1), lambda i: g[i] = p[i])) AS hit, len(list_filter(range(1, len(g) + 1),
        lambda i: g[i] = s[i])) AS copied,
        len(list_filter(range(1, len(g) + 1), lambda i: g[i] <> s[i] AND g[i] = p[i])) AS edited, (g = p)::INT AS em FROM w)
    SELECT round(sum(hit) / greatest(sum(n), 1), 9) AS tok, round(sum(em) / greatest(count(*), 1), 9) AS em, round(sum(copied) / greatest(sum(n), 1),
        9) AS copy,
        round(sum(hit) / greatest(sum(n), 1) - sum(copied) / greatest(sum(n), 1), 9) AS lift, round(sum(edited) / greatest(sum(n) - sum(copied), 1),
        9) AS edit, count(*) AS n FROM e""")
def word_aligned_scores(spark, sf_dir):
    a = F.col("a")
    return _rounded(study.word_aligned_scores(_sides(spark, sf_dir), T.words(a), T.words(F.lower(a)), T.words(F.translate(a, "t", "T"))))


@query("SELECT user_id, round(coalesce(avg(value) FILTER (event_type = 'view'), 0.0), 9) AS sequence_nll FROM events GROUP BY user_id")
def masked_nll(spark, sf_dir):
    return _rounded(study.masked_nll(table(spark, sf_dir, "events").withColumn("m", F.col("event_type") == "view"), ["user_id"], "value", "m"))


_MEANS = "(SELECT round(avg(a + 1 - b), 9) FROM s) AS raw_lift_mean, (SELECT round(avg(a + 1 - a), 9) FROM s) AS control_lift_mean"


@query(f"""WITH {_SCORES}, {_boot('s', 'a - b', '42', 'x')} SELECT (SELECT round(avg(a - b), 9) FROM s) AS estimate, (SELECT count(DISTINCT source)
        FROM s) AS n_units, (SELECT count(*) FROM s) AS n_samples,
    {_SUMMARY}, quantile_cont(m, 0.025) > 0 AS significant, {_MEANS} FROM x""")
def excess_lift(spark, sf_dir):
    rows = _scores(spark, sf_dir).select("source", (F.col("a") + 1).alias("base"), F.col("b").alias("added"), F.col("a").alias("control"))
    return _rounded(study.excess_lift(rows, "source", "base", "added", "control"))


@query(f"""WITH {_SCORES}, {_boot('s', 'b - a', '42', 'x')} SELECT (SELECT round(avg(b - a), 9) FROM s) AS estimate, (SELECT count(DISTINCT source)
        FROM s) AS n_units, (SELECT count(*) FROM s) AS n_samples,
    {_SUMMARY}, quantile_cont(m, 0.025) > 0 AS passed FROM x""")
def recovery_gate(spark, sf_dir):
    return _rounded(study.recovery_gate(_scores(spark, sf_dir), "source", "b", "a"))


_OVERLAP = f"""o AS (SELECT * FROM s WHERE lang = 'en'), e AS (SELECT * FROM s WHERE lang <> 'en'), {_boot('o', 'a - b', '42a', 'y')},
        {_boot('e', 'a - b', '42b', 'z')},
    d AS (SELECT y.m - z.m AS m FROM y JOIN z USING (r)), g AS (SELECT (SELECT count(*) FROM o) >= 2 AND (SELECT count(*) FROM e) >= 1 AS ok)"""


@query(f"""WITH {_SCORES}, {_boot('s', 'a - b', '42', 'x')}, {_OVERLAP}
    SELECT (SELECT round(avg(a - b), 9) FROM s) AS estimate, (SELECT count(DISTINCT source) FROM s) AS n_units, (SELECT count(*) FROM s) AS n_samples,
    {_SUMMARY}, quantile_cont(m, 0.025) > 0 AS significant, {_MEANS}, (SELECT round(quantile_cont(a - a / 2, 0.95), 9) FROM s) AS threshold,
        (SELECT count(*) FROM s) AS null_n,
    (SELECT CASE WHEN ok THEN round((SELECT avg(a - b) FROM o) - (SELECT avg(a - b) FROM e), 9) END FROM g) AS did_estimate,
    (SELECT CASE WHEN any_value(ok) THEN round(quantile_cont(m, 0.025), 9) END FROM d, g) AS did_ci_low, (SELECT CASE
        WHEN any_value(ok) THEN round(quantile_cont(m, 0.975), 9) END FROM d, g) AS did_ci_high,
    (SELECT avg(a - b) FROM s) > (SELECT quantile_cont(a - a / 2, 0.95) FROM s) AS clears_floor FROM x""")
def pooled_verdict(spark, sf_dir):
    rows = _scores(spark, sf_dir).select(
        "source", (F.col("a") + 1).alias("base"), F.col("b").alias("added"), F.col("a").alias("control"), (F.col("a") / 2).alias("null_added"),
        (F.col("lang") == "en").alias("overlap")
    )
    return _rounded(study.pooled_verdict(rows, "source", "overlap"))


@query()
def difference_power(spark, sf_dir):
    return study.difference_power(spark, [0.0, 0.3, 0.6, 1.2], [50.0] * 5, [50.0] * 60, 0.2)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey DESC LIMIT 1")
def best_record(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return study.best_record(rows, F.col("o_orderstatus") == "F", "o_totalprice")


@query("""WITH p AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM documents GROUP BY lang)
    SELECT lang, n, w, round(1000 * w / (SELECT sum(w) FROM p) / n, 9) AS epochs FROM p""")
def epoch_coverage(spark, sf_dir):
    pools = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("w", F.when(F.col("lang") == "en", 3.0).otherwise(1.0))
    return _rounded(study.epoch_coverage(pools, "n", "w", 1000))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 5")
def evaluation_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sampling.first_of_group(docs, "source", 5, sampling.hash_order("doc_id"), F.col("doc_id"))


@query(f"SELECT o_orderkey FROM orders WHERE {_U.format(x="'42:' || o_orderkey")} < 0.3")
def thinned_rows(spark, sf_dir):
    return sampling.thin(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.3)


@query("""SELECT 'c' AS stream, c_custkey AS id, ((row_number() OVER (ORDER BY c_custkey) - 1) // 7) * 10 + (row_number()
        OVER (ORDER BY c_custkey) - 1) % 7 AS slot FROM customer
    UNION ALL SELECT 's', s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 3) * 10 + 7 + (row_number() OVER (ORDER BY s_suppkey) - 1) % 3
        FROM supplier""")
def interleaved_streams(spark, sf_dir):
    side = lambda name, key, mark: numbered(table(spark, sf_dir, name).select(F.lit(mark).alias("stream"), F.col(key).alias("id")), ["id"], "n")
    return sampling.interleave(side("customer", "c_custkey", "c"), side("supplier", "s_suppkey", "s"), "n").select("stream", "id", "slot")


@query(
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS person, CASE WHEN p_size % 2 = 0 THEN 'aorist' END AS tense, 'active' AS voice, 'singular' AS number FROM part"""
)
def morphology_tags(spark, sf_dir):
    tag = F.concat((F.col("p_size") % 3 + 1).cast("string"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("-"), F.lit("A--S"))
    m = table(spark, sf_dir, "part").select("p_partkey", tags.morphology(tag).alias("m"))
    return m.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("person", "tense", "voice", "number")])


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'C-' WHEN 1 THEN 'RI' WHEN 2 THEN 'A-' WHEN 3 THEN 'RA' ELSE 'X-' END AS pos FROM part""")
def part_of_speech(spark, sf_dir):
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select(
        "p_partkey", tags.part_of_speech(pick("Df", "Px", "Px", "S-", "??"), pick("δέ", "τις", "πᾶς", "ὁ", "x")).alias("pos")
    )


@query("SELECT n_nationkey, 'Mark' AS book, n_regionkey * 1000 + n_nationkey AS first, n_regionkey * 1000 + n_nationkey + 2 AS last FROM nation")
def verse_spans(spark, sf_dir):
    ref = F.format_string("Mk %d:%d-%d", "n_regionkey", "n_nationkey", F.col("n_nationkey") + 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", tags.verse_span(ref).alias("s")).select("n_nationkey", "s.*")


def _token_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.lit("Mark").alias("book"), F.col("conv_id").alias("chapter"), F.col("turn").alias("verse"), F.lit(0).alias("position"),
        F.md5("text").alias("h")
    )


@query("SELECT conv_id AS chapter, turn AS verse, md5(text) AS h FROM conversations WHERE conv_id = 3 AND turn BETWEEN 1 AND 2")
def reference_read(spark, sf_dir):
    return reader.read(_token_rows(spark, sf_dir), "Mark 3:1-2").select("chapter", "verse", "h")


@query("SELECT DISTINCT conv_id AS chapter FROM conversations")
def chapter_picker(spark, sf_dir):
    return reader.chapters(_token_rows(spark, sf_dir), "Mark")
