"""Queries of passages, labels, evaluation and task pools, added to the core ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from variora.functions import labels as L
from variora.functions import scores as S
from variora.functions import text as T
from variora.operators import aggregates, corpus, evaluation, examples, linking, pools, probe, sampling, statistics, study
from variora.queries import _SCORES, _SIDES, _SUMMARY, _U, _boot, _rounded, _scores, _sides, key, ORACLE_SQL, query, shingled, table, words
from variora.sources import readers

_ALL = ["user", "assistant", "system"]
_KEY = "lower(strip_accents(trim({x})))"


def _pick(*values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


def _picked(*values):
    return f"[{', '.join(repr(v) for v in values)}][p_partkey % {len(values)} + 1]"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


# ---------------------------------------------------------------- labels


@query(
    f"SELECT conv_id, turn, array_to_string(list_filter({words('text')}, lambda w: regexp_matches(w, '[\\x{{0370}}-\\x{{03ff}}\\x{{1f00}}-\\x{{1fff}}]')), ' ') AS greek FROM (SELECT conv_id, turn, text || ' λόγος x' AS text FROM conversations)"
)
def greek_words(spark, sf_dir):
    text = F.concat("text", F.lit(" λόγος x"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(L.greek_words(text), " ").alias("greek"))


@query(f"SELECT p_partkey, {_picked('Mark', 'Matthew', 'Luke', 'Zoe', 'Mark', 'Rom')} AS book FROM part")
def book_names(spark, sf_dir):
    asked = _pick("Mk", " MATT ", "Lúke", "Zoe", "mark", "Rom")
    return table(spark, sf_dir, "part").select("p_partkey", L.canonical_book(asked, ["Matthew", "Mark", "Luke"]).alias("book"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_regionkey || ':' || n_nationkey
        WHEN 1 THEN n_regionkey || ':' || n_nationkey || '-' || (n_nationkey + 1)
    ELSE n_regionkey || ':' || n_nationkey || '-' || (n_regionkey + 1) || ':2' END AS label FROM nation""")
def range_formats(spark, sf_dir):
    c, v, kind = F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_nationkey") % 3
    c2, v2 = F.when(kind == 2, c + 1).otherwise(c), F.when(kind == 0, v).when(kind == 1, v + 1).otherwise(F.lit(2))
    return table(spark, sf_dir, "nation").select("n_nationkey", L.format_range(c, v, c2, v2).alias("label"))


@query(f"""SELECT p_partkey, {_picked('noun', 'verb', 'article', 'zz')} AS pos, {_picked('1st person', '3rd person', '2nd person', 'zz')} AS person,
        {_picked('p1', 'THIRD', '2', 'zz')} AS other,
    {_picked('noun', 'definite article', 'particle', 'zz')} AS code, {_picked('V-AAI', 'N-GSM', 'V-AAI', 'ZZ')} AS tag FROM part""")
def labels(spark, sf_dir):
    person = _pick("p1", "THIRD", "2", "zz")
    full = {"VAAI": "V-AAI", "NGSM": "N-GSM"}
    return table(spark, sf_dir, "part").select(
        "p_partkey", L.pos_label(
            _pick("subs", "VERB", "art", "zz")
        ).alias("pos"), L.feature_value("person", person).alias("person"), L.feature_value("case", person).alias("other"),
        L.code_label(_pick("n", "ra", "X-", "zz")).alias("code"), L.expand_tag(_pick("vaai", "NGSM", "VAAI", "zz"), full).alias("tag"),
    )


@query("""SELECT doc_id, concat_ws('_', source, lang) AS stratum, CASE WHEN regexp_matches(lower(source), 'src1|lxx')
        AND lower(source) LIKE '%lxx%' THEN 'koine' ELSE 'classical' END AS register,
    lang || ' of The NEW Testament, 1' LIKE 'en%' AS testament FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'My LXX'
        ELSE source END AS source FROM documents)""")
def registers(spark, sf_dir):
    source = F.when(F.col("doc_id") % 3 == 0, "My LXX").otherwise(F.col("source"))
    said = F.when(F.col("lang") == "en", "en of The NEW Testament, 1").otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        "doc_id", L.stratum(source, F.col("lang")).alias("stratum"), L.register_of(source).alias("register"), L.is_testament(said).alias("testament")
    )


@query(
    f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {_KEY.format(x='role')} ELSE {_KEY.format(x='text')} END AS lemma, coalesce(CASE WHEN turn % 3 = 0 THEN role END, '') AS pos, text AS normalized FROM conversations"
)
def token_keys(spark, sf_dir):
    lemma = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    key = L.token_key(lemma, F.col("text"), F.when(F.col("turn") % 3 == 0, F.col("role")))
    return _turns(spark, sf_dir).select("conv_id", "turn", key.alias("k")).select("conv_id", "turn", "k.*")


@query("""SELECT conv_id, sha256('["' || string_agg(role || turn, '","' ORDER BY role || turn) || '"]') AS ids,
    sha256('{"assignment":{' || string_agg('"' || role || turn || '":' || turn % 3, ','
        ORDER BY role || turn) || '},"n_folds":3,"seed":"7"}') AS plan FROM conversations GROUP BY conv_id""")
def digests(spark, sf_dir):
    name = F.concat("role", F.col("turn").cast("string"))
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(
        F.collect_list(name).alias("l"), F.map_from_entries(F.collect_list(F.struct(name, (F.col("turn") % 3).alias("f")))).alias("m")
    )
    return rows.select("conv_id", L.list_digest(F.col("l")).alias("ids"), L.plan_digest(F.col("m"), 3, "7").alias("plan"))


@query("SELECT conv_id, trim(string_agg(role || CASE WHEN turn % 2 = 0 THEN ' ' ELSE ', ' END, '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def read_texts(spark, sf_dir):
    word = F.struct("turn", F.col("role").alias("surface"), F.when(F.col("turn") % 2 == 0, " ").otherwise(", ").alias("after"))
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(word)).alias("w"))
    return rows.select("conv_id", L.read_text(F.col("w")).alias("text"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Mark' WHEN 1 THEN 'Luke' END AS book, CASE n_nationkey % 3
        WHEN 0 THEN n_regionkey + 1 WHEN 1 THEN n_regionkey END AS chapter,
    CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey + 10 END AS verse, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN n_regionkey END AS position FROM nation""")
def place_codes(spark, sf_dir):
    c, v = F.col("n_regionkey").cast("int"), F.col("n_nationkey").cast("int")
    code = F.when(v % 3 == 0, F.format_string("02%02d%02d", c + 1, v + 10)).when(
        v % 3 == 1, F.format_string("luk %d:%d/%d", c, v + 10, c + 1)
    ).otherwise("no place")
    made = table(spark, sf_dir, "nation").select("n_nationkey", readers.place_code(code).alias("p"))
    return made.select("n_nationkey", "p.book", "p.chapter", "p.verse", "p.position")


# ---------------------------------------------------------------- likelihoods


@query("""SELECT user_id, round(m + ln(avg(exp(value / 10.0 - m))), 9) AS mean, round(-(n + ln(avg(exp(-value / 10.0 - n)))), 9) AS nll
    FROM (SELECT *, max(value / 10.0) OVER (PARTITION BY user_id) AS m, max(-value / 10.0) OVER (PARTITION BY user_id) AS n FROM events)
        GROUP BY user_id, m, n""")
def mixed_likelihoods(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 10.0).alias("x"))
    return _rounded(aggregates.log_mean_exp(rows, ["user_id"], "x", "mean").join(aggregates.bottleneck_nll(rows, ["user_id"], "x"), "user_id"))


_LOGITS = "(SELECT *, len(v) AS d, list_max(v)::DOUBLE AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"


@query(
    f"SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE round(m + ln(list_sum(list_transform(v, lambda x: exp(x - m)))) - v[vec_id % d + 1], 9) END AS nll FROM {_LOGITS}"
)
def token_likelihoods(spark, sf_dir):
    rows, at = _vectors(spark, sf_dir)
    return _rounded(rows.select("vec_id", S.token_nll(F.col("v"), at, F.col("vec_id") % 4 == 0).alias("nll")))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows, (F.col("vec_id") % F.size("v")).cast("int")


@query("""SELECT vec_id, round(list_sum(list_filter(v, lambda x: x > 0)), 6) AS total, round(list_sum(list_filter(v, lambda x: x > 0)) / greatest(1,
        len(list_filter(v, lambda x: x > 0))), 6) AS mean
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def sequence_likelihoods(spark, sf_dir):
    rows, _ = _vectors(spark, sf_dir)
    kept = F.transform("v", lambda x: x > 0)
    return rows.select("vec_id", F.round(S.sequence_nll(F.col("v"), kept, "sum"), 6).alias("total"), F.round(S.sequence_nll(F.col("v"), kept), 6).alias("mean"))


# ---------------------------------------------------------------- passages

_CLASSES = "c AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS s FROM conversations GROUP BY conv_id)"


def _books(spark, sf_dir):
    book = F.when(F.col("role") == "user", "Matthew").when(F.col("role") == "assistant", "Mark").otherwise("Luke")
    return _turns(spark, sf_dir).withColumn("book", book)


@query("""SELECT pericope_id, CASE WHEN s IN (['Luke', 'Mark', 'Matthew'], ['Mark', 'Matthew'], ['Luke', 'Mark']) THEN 'triple' WHEN s = ['Luke',
        'Matthew'] THEN 'double'
    WHEN s = ['Matthew'] THEN 'matthean_unique' WHEN s = ['Mark'] THEN 'mark_unique' ELSE 'lukan_unique' END AS class FROM (
    SELECT conv_id AS pericope_id, list_sort(list_distinct(list(CASE role WHEN 'user' THEN 'Matthew' WHEN 'assistant' THEN 'Mark'
        ELSE 'Luke' END))) AS s FROM conversations WHERE turn % 3 <> 1 GROUP BY 1)""")
def traditions(spark, sf_dir):
    return corpus.tradition(_books(spark, sf_dir).where("turn % 3 <> 1").withColumnRenamed("conv_id", "pericope_id"))


@query(f"WITH {_CLASSES} SELECT conv_id, array_to_string(s, ',') AS members FROM c")
def passage_members(spark, sf_dir):
    return corpus.members_of(_turns(spark, sf_dir), "conv_id", "role").select("conv_id", F.array_join("members", ",").alias("members"))


@query(f"WITH {_CLASSES} SELECT conv_id FROM c WHERE list_contains(s, 'system')")
def keys_of_class(spark, sf_dir):
    return corpus.keys_of_class(_turns(spark, sf_dir), "conv_id", "role", [(["system"], "three")], "other", "three")


@query(
    "SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'other') AS p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey"
)
def genres(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size > 20").withColumnRenamed("p_partkey", "l_partkey")
    return corpus.with_default(table(spark, sf_dir, "lineitem"), part, "l_partkey", "p_brand", "other").select("l_orderkey", "l_linenumber", "p_brand")


def _marked(spark, sf_dir):
    return _turns(spark, sf_dir).withColumn(
        "is_punctuation", F.when(F.col("turn") % 5 == 4, True).when(F.col("turn") % 5 == 3, F.lit(None).cast("boolean")).otherwise(False)
    )


_COUNTS = """k AS (SELECT conv_id, count(*) FILTER (role = 'user') AS "user", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system
    FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id)"""


@query(f"WITH {_COUNTS} SELECT * FROM k")
def token_counts(spark, sf_dir):
    return corpus.token_counts(_marked(spark, sf_dir), "conv_id", "role", _ALL)


@query(
    f"""WITH {_COUNTS}, {_CLASSES} SELECT conv_id, "user", assistant FROM k JOIN c USING (conv_id) WHERE "user" > 0 AND assistant > 0
        AND NOT list_contains(s, 'system')"""
)
def two_witness_units(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    classes = aggregates.classify(turns, "conv_id", "role", [(["system"], "triple")], "double")
    return corpus.two_witness_units(_marked(spark, sf_dir), "conv_id", "role", "user", "assistant", classes)


@query("SELECT conv_id, role, md5(string_agg(text, ' ' ORDER BY turn, text)) AS text FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id, role")
def passage_texts(spark, sf_dir):
    made = corpus.passage_text(_marked(spark, sf_dir), ["conv_id", "role"], ["turn", "text"])
    return made.withColumn("text", F.md5("text"))


_MAP = "'{{' || string_agg('\"' || k || '\":' || v, ',' ORDER BY k) || '}}'"


@query(f"""WITH t AS (SELECT n_nationkey::VARCHAR AS pericope_id, 'g' || n_regionkey AS genre, n_nationkey + 1 AS a, n_regionkey + 5 AS b FROM nation
        WHERE n_regionkey < 3),
    d AS (SELECT 'g' || n_regionkey AS genre, n_nationkey + 1 AS a, n_regionkey + 5 AS b FROM nation WHERE n_regionkey > 1),
    m(n, j) AS (SELECT 'tg', {_MAP.format()} FROM (SELECT genre AS k, count(*) AS v FROM t GROUP BY 1) UNION ALL SELECT 'dg', {_MAP.format()}
        FROM (SELECT genre AS k, count(*) AS v FROM d GROUP BY 1)
        UNION ALL SELECT 'ts', {_MAP.format()} FROM (SELECT pericope_id AS k, least(a, b) AS v FROM t))
    SELECT (SELECT count(*) FROM t) AS n_triples, (SELECT '{{"a":' || sum(a) || ',"b":' || sum(b) || '}}' FROM t) AS triple_totals, (SELECT count(*)
        FROM t WHERE a % 2 = 0) AS n_core,
    (SELECT count(*) FROM t WHERE a % 3 = 0) AS n_extended, (SELECT j FROM m WHERE n = 'ts') AS triple_smallest, (SELECT count(*) FROM d) AS n_doubles,
    (SELECT '{{"a":' || sum(a) || ',"b":' || sum(b) || '}}' FROM d) AS double_totals, (SELECT j FROM m WHERE n = 'tg') AS triple_genres, (SELECT j
        FROM m WHERE n = 'dg') AS double_genres,
    (SELECT string_agg(DISTINCT genre, ',' ORDER BY genre) FROM d WHERE genre NOT IN (SELECT genre FROM t)) AS unlearnable_genres""")
def study_census(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    base = [F.concat(F.lit("g"), "n_regionkey").alias("genre"), (F.col("n_nationkey") + 1).alias("a"), (F.col("n_regionkey") + 5).alias("b")]
    rows = n.select(
        F.col("n_nationkey").cast("string").alias("pericope_id"), *base, ((F.col("n_nationkey") + 1) % 2 == 0).alias("core"),
        ((F.col("n_nationkey") + 1) % 3 == 0).alias("extended"), "n_regionkey"
    )
    made = corpus.census(rows.where("n_regionkey < 3"), rows.where("n_regionkey > 1"), ["a", "b"], ["a", "b"])
    maps = [c for c, t in made.dtypes if t.startswith("map")]
    return made.withColumns({c: F.to_json(c) for c in maps}).withColumn("unlearnable_genres", F.array_join("unlearnable_genres", ","))


@query(
    "SELECT split, stratum, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 'train' ELSE 'val' END AS split, concat_ws('_', source, lang) AS stratum FROM labels JOIN documents USING (doc_id)) GROUP BY ALL"
)
def split_counts(spark, sf_dir):
    splits = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    return corpus.split_counts(table(spark, sf_dir, "documents"), splits, "doc_id", L.stratum(F.col("source"), F.col("lang")))


@query(
    """SELECT form, string_agg(l, ',' ORDER BY o) AS lemmas FROM (SELECT o_orderstatus AS form, o_orderpriority AS l, min(o_orderkey) AS o FROM orders GROUP BY ALL) GROUP BY form"""
)
def lemma_index(spark, sf_dir):
    made = corpus.lemma_index(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), "o_orderpriority", ["o_orderkey"])
    return made.select("form", F.array_join("lemmas", ",").alias("lemmas"))


@query(f"SELECT conv_id, sum(len({words('text')}))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def target_words(spark, sf_dir):
    return corpus.target_words(_turns(spark, sf_dir), "conv_id", T.words(F.col("text")))


_RANGES = "r AS (SELECT n_nationkey AS pid, n_nationkey AS seq, 'B' || n_regionkey % 2 AS book, n_nationkey % 4 AS c1, 3 AS v1, n_nationkey % 4 + 1 AS c2, 5 AS v2 FROM nation)"


def _ranges(spark, sf_dir):
    c1 = (F.col("n_nationkey") % 4).cast("int")
    book = F.concat(F.lit("B"), F.col("n_regionkey") % 2)
    columns = F.col(
        "n_nationkey"
    ).alias("pid"), F.col("n_nationkey").alias("seq"), book.alias("book"), c1.alias("c1"), F.lit(3).alias("v1"), (c1 + 1).alias("c2"), F.lit(5).alias("v2")
    return table(spark, sf_dir, "nation").select(*columns)


@query(f"""WITH {_RANGES}, e AS (SELECT *, unnest(range(c1, c2 + 1)) AS chapter FROM r)
    SELECT pid, chapter::INTEGER AS chapter, CASE WHEN chapter = c1 THEN v1 ELSE 1 END AS v_low, CASE WHEN chapter = c2 THEN v2 ELSE 40 END AS v_high FROM e""")
def verse_ranges(spark, sf_dir):
    return linking.verse_ranges(_ranges(spark, sf_dir)).select("pid", "chapter", "v_low", "v_high")


@query(f"WITH {_RANGES} SELECT min(pid) AS pid FROM r WHERE book = 'B1' AND (c1 = 2 AND 17 BETWEEN 3 AND 40 OR c2 = 2 AND 17 BETWEEN 1 AND 5)")
def place_lookup(spark, sf_dir):
    return corpus.assign_place(_ranges(spark, sf_dir), "pid", "B1", 2, 17)


# one passage a region; its witnesses are B0 and B1, one range each, so that texts are told apart
_PLACES = """r AS (SELECT n_regionkey AS pid, n_regionkey * 2 + b AS seq, 'B' || b AS book, n_regionkey + 1 AS c1, 1 AS v1, n_regionkey + 1 + b AS c2, 3 AS v2
    FROM (SELECT DISTINCT n_regionkey FROM nation), (SELECT unnest([0, 1]) AS b))"""


@query(f"""WITH {_PLACES}, t AS (SELECT 'B' || conv_id % 2 AS book, (conv_id % 6)::INT AS c, turn::INT AS v, conv_id AS p, role AS text FROM conversations),
    x AS (SELECT 'B' || s_suppkey % 2 AS book, (s_suppkey % 7)::INT AS chapter, (s_suppkey % 5)::INT AS verse FROM supplier GROUP BY ALL),
    h AS (SELECT x.book, x.chapter, x.verse, min_by(pid, seq) AS pid FROM x JOIN r ON r.book = x.book AND (c1, v1) <= (chapter, verse) AND (chapter,
        verse) <= (c2, v2) GROUP BY ALL)
    SELECT h.book, h.chapter, h.verse, h.pid, o.book AS other_book, string_agg(t.text, ' ' ORDER BY t.c, t.v, t.p) AS text
    FROM h JOIN r o ON o.pid = h.pid AND o.book <> h.book JOIN t ON t.book = o.book AND (o.c1, o.v1) <= (t.c, t.v) AND (t.c, t.v) <= (o.c2, o.v2)
        GROUP BY ALL""")
def parallel_texts(spark, sf_dir):
    regions = table(spark, sf_dir, "nation").select("n_regionkey").distinct().withColumn("b", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("n_regionkey").cast("int")
    ranges = regions.select(
        F.col("n_regionkey").alias("pid"), (k * 2 + F.col("b")).alias("seq"), F.concat(F.lit("B"), "b").alias("book"), (k + 1).alias("c1"),
        F.lit(1).alias("v1"), (k + 1 + F.col("b")).alias("c2"), F.lit(3).alias("v2")
    )
    places = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("B"), F.col("s_suppkey") % 2).alias("book"), (F.col("s_suppkey") % 7).cast("int").alias("chapter"),
        (F.col("s_suppkey") % 5).cast("int").alias("verse")
    ).distinct()
    rows = _turns(spark, sf_dir).select(
        F.concat(F.lit("B"), F.col("conv_id") % 2).alias("book"), (F.col("conv_id") % 6).cast("int").alias("chapter"), F.col("turn").cast("int").alias("verse"),
        F.col("conv_id").alias("position"), F.col("role").alias("text"),
    )
    return corpus.parallel_texts(places, ranges, rows, "pid")


@query("""WITH t AS (SELECT conv_id, role, min(turn) AS n FROM conversations GROUP BY ALL) SELECT a.conv_id, a.role AS a, b.role AS b,
    CASE WHEN a.conv_id % 3 = 0 THEN '' WHEN a.conv_id % 3 = 1 THEN a.n || '>' || b.n ELSE b.n || '>' || a.n END AS pairs FROM t a
        JOIN t b ON a.conv_id = b.conv_id AND a.role < b.role""")
def aligned_pairs(spark, sf_dir):
    t = _turns(spark, sf_dir).groupBy("conv_id", "role").agg(F.min("turn").cast("int").alias("n")).withColumn("text", F.col("n").cast("string"))
    both = t.alias("x").join(t.alias("y"), (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.role") < F.col("y.role")))
    turned = F.col("x.conv_id") % 3 == 2
    pair = lambda a, b: F.array(F.struct(a.alias("idx_a"), b.alias("idx_b")))
    # filed as (b, a) in every third passage, and there with its sides exchanged
    made = both.where(F.col("x.conv_id") % 3 > 0).select(
        F.col("x.conv_id").alias("conv_id"), F.when(turned, F.col("y.role")).otherwise(F.col("x.role")).alias("book_a"),
        F.when(turned, F.col("x.role")).otherwise(F.col("y.role")).alias("book_b"), pair(F.col("x.n"), F.col("y.n")).alias("pairs"),
    )
    said = F.array_join(F.transform("pairs", lambda p: F.concat_ws(">", p["idx_a"].cast("string"), p["idx_b"].cast("string"))), ",")
    return corpus.parallel_pairs(t, made, "conv_id", "role", "text").select("conv_id", "a", "b", said.alias("pairs"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS gloss FROM lineitem JOIN part ON l_partkey = p_partkey""")
def glosses(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("ΛΌΓΟΣ"), "p_partkey").alias("lemma"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("gloss"),
        F.col("p_partkey").alias("o")
    )
    lexicon = corpus.lexicon(part, "lemma", "gloss", "o")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("λογοσ"), "l_partkey").alias("lemma"))
    fixed = lexicon.withColumn("key", F.translate("key", "ς", "σ"))
    return corpus.gloss_for(lines, fixed, "lemma", "gloss").select("l_orderkey", "l_linenumber", "gloss")


@query(
    "SELECT c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS a, coalesce(n::VARCHAR, '') AS b FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def zipped_features(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "node")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").cast("string").alias("value"))
    return corpus.zip_features(customer.select("node"), {"a": customer.where("node % 2 = 0").select("node", F.col("c_mktsegment").alias("value")), "b": orders})


@query("""WITH t AS (SELECT conv_id, role, string_agg(turn::VARCHAR, ' ' ORDER BY turn) AS l FROM conversations WHERE conv_id % 7 <> 0 GROUP BY ALL)
    SELECT conv_id::VARCHAR AS pericope_id, string_agg(role, ',' ORDER BY role) AS books, string_agg(role || '=' || l, ';' ORDER BY role) AS tokens,
        count(*) * (count(*) - 1) // 2 AS n_alignments,
    CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'other' END AS genre FROM t GROUP BY conv_id""")
def nested_passages(spark, sf_dir):
    key = F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.col("conv_id").cast("string")).alias("pericope_id")
    rows = _turns(spark, sf_dir).select(key, F.col("role").alias("book"), "turn", F.col("turn").cast("string").alias("t"), (F.col("conv_id") % 2).alias("m"))
    aligned = corpus.align_passages(rows, "pericope_id", "book", ["turn"], F.col("t"))
    classes = corpus.tradition(rows)
    genre = rows.where("m = 0").select("pericope_id", F.lit("even").alias("genre")).distinct()
    made = corpus.nested_passages(rows, aligned, classes, genre, ["turn"], "t")
    lists = F.array_join(F.transform(F.array_sort(F.map_entries("tokens")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], " "))), ";")
    n = F.coalesce(F.size(F.map_keys("alignment")), F.lit(0))
    return made.select(
        "pericope_id", F.array_join("books", ",").alias("books"), lists.alias("tokens"),
        F.when(n < 0, 0).otherwise(n).cast("long").alias("n_alignments"), "genre"
    )


# ---------------------------------------------------------------- evaluation

_TAGS = f"""w AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'nt' ELSE 'classical' END AS subset, {words('a')} AS g,
        {words("lower(a)")} AS p, {words("translate(a, 't', 'T')")} AS q FROM (
    SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS a FROM conversations GROUP BY conv_id))"""


def _tagged(spark, sf_dir):
    rows = aggregates.ordered_text(_turns(spark, sf_dir), ["conv_id"], ["turn"], "text")
    a = F.col("text")
    subset = F.when(F.col("conv_id") % 2 == 0, "nt").otherwise("classical")
    return rows.select("conv_id", subset.alias("subset"), T.words(a).alias("g"), T.words(F.lower(a)).alias("p"), T.words(F.translate(a, "t", "T")).alias("q"))


def _tag_sql(pred: str, mask: str = "true", exact: str = "hit = n") -> str:
    return f"""SELECT CASE WHEN grouping(subset) = 1 THEN 'overall' ELSE subset END AS subset, round(sum(hit) / greatest(sum(n), 1), 9) AS tok,
        round(count(*) FILTER ({exact}) / greatest(count(*), 1), 9) AS em,
        count(*) AS n FROM (SELECT subset, g, {pred} AS x, len(list_filter(range(1, len(g) + 1), lambda i: {mask})) AS n, len(list_filter(range(1,
        len(g) + 1), lambda i: {mask} AND g[i] = {pred}[i])) AS hit FROM w)
        GROUP BY ROLLUP (subset)"""


@query(f"WITH {_TAGS} {_tag_sql('p', exact='g = x')}")
def tagging_scores(spark, sf_dir):
    return _rounded(evaluation.tagging_scores(_tagged(spark, sf_dir), "subset", F.col("g"), F.col("p"), whole=True))


@query(f"WITH {_TAGS} {_tag_sql('p', 'g[i] = q[i]')}")
def neutral_scores(spark, sf_dir):
    mask = pools.neutral_mask(F.col("g"), F.col("q"))
    return _rounded(evaluation.tagging_scores(_tagged(spark, sf_dir), "subset", F.col("g"), F.col("p"), mask))


@query(f"""WITH {_TAGS}, m AS (SELECT 'full' AS mode, a.subset, a.tok AS tok_one, b.tok AS tok_two FROM ({_tag_sql('p')}) a
        JOIN ({_tag_sql('q')}) b USING (subset)
    UNION ALL SELECT 'neutral', a.subset, a.tok, b.tok FROM ({_tag_sql('p', 'length(g[i]) > 3')}) a JOIN ({_tag_sql('q', 'length(g[i]) > 3')}) b USING (subset))
    SELECT mode, subset, tok_one, tok_two, round(tok_two - tok_one, 6) AS delta FROM m""")
def compared_modes(spark, sf_dir):
    neutral = F.transform("g", lambda x: F.length(x) > 3)
    made = evaluation.compare_modes(_tagged(spark, sf_dir), "subset", F.col("g"), F.col("p"), F.col("q"), neutral)
    return _rounded(made).withColumn("delta", F.round("delta", 6))


_F1 = "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(a) + len(b)) END"
_COMMON = "list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x)))))"


@query(f"""WITH {_SIDES}, w AS (SELECT conv_id, {words("lower(strip_accents(a))")} AS a, {words("lower(strip_accents(b))")} AS b
        FROM s), f AS (SELECT *, coalesce({_COMMON}, 0) AS c FROM w)
    SELECT conv_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE {_F1} END::DOUBLE, 9) AS f1 FROM f""")
def loose_f1(spark, sf_dir):
    return _rounded(evaluation.loose_f1(_sides(spark, sf_dir), "conv_id", F.col("a"), F.col("b")))


_RECONSTRUCTED = f"w AS (SELECT conv_id, {words('a')} AS a, {words('lower(a)')} AS b FROM s), f AS (SELECT *, coalesce({_COMMON}, 0) AS c FROM w), x AS (SELECT conv_id, ({_F1})::DOUBLE AS f1, a = b AS em FROM f)"


@query(f"WITH {_SIDES}, {_RECONSTRUCTED} SELECT conv_id, round(f1, 9) AS f1, em FROM x")
def reconstruction_scores(spark, sf_dir):
    return _rounded(evaluation.reconstruction_scores(_sides(spark, sf_dir), "conv_id", F.col("a"), F.lower("a")))


@query(f"WITH {_SIDES}, {_RECONSTRUCTED} SELECT round(coalesce(avg(f1), 0), 9) AS f1, round(coalesce(avg(em::INT), 0), 9) AS em, count(*) AS n FROM x")
def reconstruction_summary(spark, sf_dir):
    return _rounded(evaluation.reconstruction_summary(evaluation.reconstruction_scores(_sides(spark, sf_dir), "conv_id", F.col("a"), F.lower("a"))))


_WITNESSED = f"""v AS (SELECT conv_id, 'x' AS name, b AS w, a AS g FROM s UNION ALL SELECT conv_id, 'y', lower(a), a FROM s),
    w AS (SELECT conv_id, name, {words('w')} AS a, {words('g')} AS b FROM v), f AS (SELECT *, coalesce({_COMMON}, 0) AS c FROM w),
        n AS (SELECT conv_id, max(({_F1})::DOUBLE) AS f1 FROM f GROUP BY conv_id)"""


def _witnessed(spark, sf_dir):
    return _sides(spark, sf_dir).withColumn("w", F.create_map(F.lit("x"), F.col("b"), F.lit("y"), F.lower("a")))


@query(f"WITH {_SIDES}, {_WITNESSED} SELECT conv_id, round(f1, 9) AS f1 FROM n")
def nearest_witness(spark, sf_dir):
    return _rounded(evaluation.nearest_witness(_witnessed(spark, sf_dir), "conv_id", "w", F.col("a")))


_EASE = """m AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS model, CASE WHEN event_type = 'view' THEN 'g' ELSE 'c' END AS grp,
        sum(value / 50.0 * (event_id % 5 + 1)) / sum(event_id % 5 + 1) AS x FROM events GROUP BY ALL),
    p AS (SELECT max(x) FILTER (model = 'old' AND grp = 'g') AS og, max(x) FILTER (model = 'old' AND grp = 'c') AS oc, max(x) FILTER (model = 'new'
        AND grp = 'g') AS ng, max(x) FILTER (model = 'new' AND grp = 'c') AS nc FROM m)"""


def _chunk_scores(spark, sf_dir):
    model, group = F.when(F.col("event_id") % 2 == 0, "old").otherwise("new"), F.when(F.col("event_type") == "view", "g").otherwise("c")
    return table(spark, sf_dir, "events").select(
        model.alias("model"), group.alias("group"), (F.col("value") / 50.0).alias("nll"), (F.col("event_id") % 5 + 1).alias("tokens")
    )


@query(
    f"WITH {_EASE} SELECT round(exp(nc - ng), 9) AS ease_ratio, round((og - oc) - (ng - nc), 9) AS gap, 0.2 ::DOUBLE AS match_rate, (og - oc) - (ng - nc) > 0.25 AS flagged FROM p"
)
def audit_report(spark, sf_dir):
    return _rounded(evaluation.audit_report(_chunk_scores(spark, sf_dir), "g", "old", "new", "c", 0.2))


@query(
    "SELECT user_id, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 9) AS mean_nll, count(*) AS n_chunks, sum(event_id % 5 + 1)::BIGINT AS n_tokens FROM events GROUP BY user_id"
)
def checked_perplexity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("event_id") % 5 + 1)
    return _rounded(evaluation.checked_perplexity(rows, ["user_id"], "value", "t").drop("perplexity"))


@query(
    f"""WITH {_TAGS}, a AS ({_tag_sql('p')}) SELECT (SELECT tok FROM a WHERE subset = 'nt') >= 0.5 AND (SELECT tok FROM a
        WHERE subset = 'classical') >= 0.5 AND (SELECT tok FROM a WHERE subset = 'overall') >= 0.99 AS passed"""
)
def gates(spark, sf_dir):
    scores = evaluation.tagging_scores(_tagged(spark, sf_dir), "subset", F.col("g"), F.col("p"))
    return evaluation.passes_gates(scores, scores, 0.5, 0.5, 0.99)


@query(f"""WITH {_SIDES}, t AS (SELECT conv_id, a, coalesce(b, '') AS b, length(coalesce(a, '')) / 1000.0 AS nll, conv_id % 4 + 1 AS n FROM s),
    w AS (SELECT conv_id, {words("lower(strip_accents(b))")} AS a, {words("lower(strip_accents(a))")} AS b, {words('b')} AS own
        FROM t), f AS (SELECT *, coalesce({_COMMON}, 0) AS c FROM w),
    q AS (SELECT avg(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE {_F1} END::DOUBLE) AS f1, count(*) AS n, avg(len(list_filter(own,
        lambda x: length(x) % 2 = 0)) / len(own)) FILTER (len(own) > 0) AS morph FROM f)
    SELECT (SELECT round(exp(sum(nll * n) / sum(n)), 9) FROM t) AS ppl, round(f1, 9) AS f1, n, round(coalesce(morph, 0), 9) AS morph FROM q""")
def generation_scores(spark, sf_dir):
    rows = _sides(spark, sf_dir).withColumns(
        {"b": F.coalesce("b", F.lit("")), "nll": F.length(F.coalesce("a", F.lit(""))) / 1000.0, "n": F.col("conv_id") % 4 + 1}
    )
    tags = F.transform(T.words(F.col("b")), lambda w: F.when(F.length(w) % 2 == 0, "N-").otherwise("?"))
    return _rounded(evaluation.generation_scores(rows, "conv_id", "nll", "n", F.col("b"), F.col("a"), tags, ["N-", "V-"]))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice < 30000 AND l_extendedprice < l_discount * 1000000 AS passed FROM lineitem WHERE l_orderkey < 400")
def operator_passes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey < 400")
    made = rows.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("nll"), F.lit(30000).alias("source_free"),
        (F.col("l_discount") * 1000000).alias("mismatched")
    )
    return evaluation.operator_passes(made).select("l_orderkey", "l_linenumber", "passed")


@query("SELECT doc_id, (quality = toxic)::INT::DOUBLE AS correct, CASE WHEN doc_id % 3 = 0 THEN 'own:' || doc_id ELSE quality::VARCHAR END AS grp FROM labels")
def correct_by_group(spark, sf_dir):
    rows = evaluation.correctness(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn(
        "grp", F.when(F.col("doc_id") % 3 != 0, F.col("quality").cast("string"))
    )
    return evaluation.group_names(rows, "grp", "doc_id").select("doc_id", "correct", "grp")


_DID = f"o AS (SELECT * FROM s WHERE lang = 'en'), e AS (SELECT * FROM s WHERE lang <> 'en'), {_boot('o', 'a - b', '42a', 'y')}, {_boot('e', 'a - b', '42b', 'z')}, d AS (SELECT y.m - z.m AS m FROM y JOIN z USING (r))"


def _verdict_rows(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    return rows.select(
        "source", F.col("b").alias("added"), F.col("a").alias("control"), (F.col("lang") == "en").alias("overlap"),
        (F.length("source") % 2).alias("fold")
    )


@query(f"WITH {_SCORES}, {_DID} SELECT round((SELECT avg(a - b) FROM o) - (SELECT avg(a - b) FROM e), 9) AS estimate, {_SUMMARY} FROM d")
def did_contrast(spark, sf_dir):
    return _rounded(evaluation.did_contrast(_verdict_rows(spark, sf_dir), "source", "overlap"))


@query(f"""WITH {_SCORES}, x AS (SELECT * FROM s WHERE length(source) % 2 = 0), y AS (SELECT * FROM s WHERE length(source) % 2 = 1),
        {_boot('x', 'a - b', '42', 'p')}, {_boot('y', 'a - b', '42', 'q')},
    v AS (SELECT 0 AS fold, m FROM p UNION ALL SELECT 1, m FROM q), c AS (SELECT fold, quantile_cont(m, 0.025) AS l, quantile_cont(m, 0.975) AS h
        FROM v GROUP BY fold),
    u AS (SELECT length(source) % 2 AS fold, avg(a - b) AS e, avg(a - b) FILTER (lang = 'en') - avg(a - b) FILTER (lang <> 'en') AS did FROM s GROUP BY 1)
    SELECT fold, round(e, 9) AS estimate, round(l, 9) AS ci_low, round(h, 9) AS ci_high, l > 0 AS significant, round(did, 9) AS did FROM c
        JOIN u USING (fold)""")
def fold_verdicts(spark, sf_dir):
    return _rounded(evaluation.fold_verdicts(_verdict_rows(spark, sf_dir), "fold", "source", "overlap"))


@query(
    f"WITH {_SCORES}, {_boot('s', 'a', '42', 'x')} SELECT 'G1' AS name, (SELECT round(avg(a), 9) FROM s) AS statistic, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high, quantile_cont(m, 0.025) > 0 AS passed, 'all rows' AS detail FROM x"
)
def gate_report(spark, sf_dir):
    return _rounded(evaluation.gate_report("G1", statistics.mean_ci(_scores(spark, sf_dir), "source", "a"), "all rows"))


@query()
def power_report(spark, sf_dir):
    return study.power_report(spark, [0.1, 0.3], [0.0, 0.2, 0.4, 0.8], [50.0] * 12, [50.0] * 4, [60.0] * 20, sims=60, draws=100)


# ---------------------------------------------------------------- pools and draws


@query(f"""SELECT o_orderkey, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS split FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def carved_split(spark, sf_dir):
    return sampling.carve(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.1)


_TASKS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'pos' WHEN '2-HIGH' THEN 'morphology' WHEN '3-MEDIUM' THEN 'denoise' ELSE 'lemma' END"


def _tasks(spark, sf_dir):
    p = F.col("o_orderpriority")
    task = F.when(p == "1-URGENT", "pos").when(p == "2-HIGH", "morphology").when(p == "3-MEDIUM", "denoise").otherwise("lemma")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", task.alias("task"), F.col("o_orderpriority").alias("target_text"), F.col("o_totalprice"), "o_custkey"
    )
    return rows.withColumn("input_text", F.concat("task", F.lit(": x"), "o_orderkey"))


@query(f"""WITH t AS (SELECT o_orderkey, {_TASKS} AS task, o_orderpriority AS p FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY task) AS n,
        row_number() OVER (PARTITION BY task ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r FROM t)
    SELECT o_orderkey, held, CASE WHEN held THEN 'x' || o_orderkey END AS text, CASE WHEN held THEN array_to_string(string_split(CASE
        WHEN task = 'morphology' THEN upper(p) ELSE lower(p) END, ' '), '|') END AS gold
    FROM (SELECT *, task NOT IN ('denoise', 'pos', 'synoptic') AND n >= 40 AND r <= 10 AS held FROM r)""")
def held_out_tasks(spark, sf_dir):
    return pools.held_out_tasks(_tasks(spark, sf_dir), "o_orderkey", 10).select("o_orderkey", "held", "text", F.array_join("gold", "|").alias("gold"))


@query(f"SELECT o_orderkey FROM (SELECT *, {_TASKS} AS task FROM orders) WHERE task = 'denoise' OR o_totalprice <= 200000 AND o_custkey <= 1000")
def kept_lengths(spark, sf_dir):
    return pools.drop_overlong(_tasks(spark, sf_dir), 1000, F.col("o_totalprice") / 200, F.col("o_custkey")).select("o_orderkey")


@query(f"""WITH p AS (SELECT CASE WHEN lang = 'en' THEN 'denoise' ELSE 'pos' END AS task, CASE WHEN lang = 'en' THEN CASE
        WHEN doc_id % 3 = 0 THEN 'koine' ELSE 'classical' END END AS register, count(*) AS n FROM documents GROUP BY ALL),
    t AS (SELECT task, sum(n) AS n, CASE task WHEN 'denoise' THEN 3.0 ELSE 1.0 END AS w FROM p GROUP BY task), b AS (SELECT task, sum(w)
        OVER (ORDER BY task) / sum(w) OVER () AS high FROM t),
    d AS (SELECT o_orderkey, {_U.format(x="'42:' || o_orderkey || ':pool'")} AS u, {_U.format(x="'42:' || o_orderkey || ':register'")} AS v, {_U.format(x="'42:' || o_orderkey || ':within'")} AS x FROM orders),
    m AS (SELECT o_orderkey, v, x, min_by(task, high) AS task FROM d JOIN b ON high > u GROUP BY ALL),
    g AS (SELECT *, CASE register WHEN 'koine' THEN 0.7 WHEN 'classical' THEN 0.3 ELSE 1.0 END AS w FROM p), h AS (SELECT task, register, n, sum(w)
        OVER (PARTITION BY task ORDER BY register NULLS FIRST) / sum(w) OVER (PARTITION BY task) AS high FROM g)
    SELECT o_orderkey, m.task, min_by(register, high) AS register, min_by(floor(x * n)::BIGINT, high) AS item FROM m JOIN h ON m.task = h.task
        AND high > v GROUP BY o_orderkey, m.task""")
def register_draws(spark, sf_dir):
    en = F.col("lang") == "en"
    rows = table(spark, sf_dir, "documents").select(
        F.when(en, "denoise").otherwise("pos").alias("task"),
        F.when(en, F.when(F.col("doc_id") % 3 == 0, "koine").otherwise("classical")).alias("register")
    )
    given = rows.groupBy("task", "register").agg(F.count("*").alias("n"))
    return pools.register_draws(given, {"denoise": 3.0, "pos": 1.0}, {"koine": 0.7, "classical": 0.3}, table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def first_chunks(spark, sf_dir):
    return readers.first_chunks(table(spark, sf_dir, "events").withColumn("n", F.col("event_id")), "user_id", 3).select("user_id", "event_id")


@query("SELECT n_nationkey, n_nationkey IN (1, 2, 9, 11) AS overlap, (row_number() OVER (ORDER BY n_nationkey) - 1) % 3 <> 1 AS train FROM nation")
def partitions(spark, sf_dir):
    units = corpus.overlap_partition(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", [1, 2], [9, 11], "extended")
    placed = linking.numbered(units, ["n_nationkey"], "fold").withColumn("fold", F.col("fold") % 3)
    parts = [sampling.fold_members(placed, 1, held).withColumn("train", F.lit(not held)) for held in (False, True)]
    return parts[0].unionAll(parts[1]).drop("fold")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1) AND n_nationkey % 5 = n_regionkey % 5")
def chosen_triples(spark, sf_dir):
    units = table(spark, sf_dir, "nation").where("n_regionkey > 1")
    return corpus.triple_ids(units, "n_nationkey", table(spark, sf_dir, "nation").where("n_nationkey % 5 = n_regionkey % 5"))


@query("""WITH t AS (SELECT conv_id, turn, 'word' || turn AS w, role FROM conversations), g AS (SELECT conv_id, string_agg(w, ' '
        ORDER BY turn) AS x, string_agg(role, ' ' ORDER BY turn) AS y, count(*) AS n FROM t GROUP BY conv_id HAVING count(*) >= 2)
    SELECT task, count(*) AS n, count(DISTINCT input_text) AS inputs, count(target_text) AS targets, count(register) AS registers FROM (
    SELECT 'pos' AS task, 'pos: ' || x AS input_text, y AS target_text, NULL AS register FROM g WHERE n <= 60 UNION ALL SELECT 'lemma',
        'lemma: ' || x, x, NULL FROM g WHERE n <= 60
    UNION ALL SELECT 'denoise', x, NULL, 'koine' FROM g UNION ALL SELECT 'synoptic', 's', 't', NULL FROM nation UNION ALL SELECT 'continuation',
        source, lang, 'classical' FROM documents) GROUP BY task""")
def pooled_tasks(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(
        F.col("conv_id").alias("key"), F.col("turn").alias("position"), F.concat(F.lit("word"), "turn").alias("form"), F.col("role").alias("pos")
    )
    rows = rows.withColumn("lemma", F.col("form"))
    pairs = table(spark, sf_dir, "nation").select(F.lit("s").alias("input_text"), F.lit("t").alias("target_text"))
    docs = table(spark, sf_dir, "documents").select(
        F.lit("continuation").alias("task"), F.col("source").alias("input_text"), F.col("lang").alias("target_text"), "source",
        F.lit(None).cast("string").alias("register")
    )
    made = pools.register_pools([rows], pairs, docs)
    return made.groupBy("task").agg(
        F.count("*").alias("n"), F.countDistinct("input_text").alias("inputs"), F.count("target_text").alias("targets"),
        F.count("register").alias("registers")
    )


@query(f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id, w, sum(len(w))
        OVER (ORDER BY doc_id) - len(w) AS a FROM d),
    e AS (SELECT (a + i) // 64 AS sequence, a + i AS p, w[i + 1] AS t FROM (SELECT a, w, unnest(range(0, len(w))) AS i FROM c))
    SELECT sequence::BIGINT AS sequence, count(*) AS n, md5(string_agg(t, ' ' ORDER BY p)) AS tokens FROM e GROUP BY sequence HAVING count(*) >= 8""")
def packed_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", T.words(F.col("text")).alias("w"))
    return pools.pack(rows, "doc_id", "w", 64).select("sequence", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query("""WITH t AS (SELECT *, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS pos FROM conversations), i AS (SELECT pos, row_number()
        OVER (ORDER BY min(conv_id * 1000 + turn)) - 1 AS n FROM t WHERE pos <> '' GROUP BY pos),
    g AS (SELECT conv_id, list(coalesce(n, -100) ORDER BY turn) AS l, string_agg(role, ' ' ORDER BY turn) AS text FROM t LEFT JOIN i USING (pos)
        GROUP BY conv_id)
    SELECT conv_id, text, array_to_string((l || list_transform(range(12), lambda x: -100))[1:12], ',') AS labels FROM g""")
def label_ids(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("pos", F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role")))
    made = pools.label_ids(rows, ["conv_id"], ["turn"], "role", "pos", 12)
    return made.select("conv_id", "text", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query(f"SELECT DISTINCT lower(strip_accents(rtrim(w, ',.:;·!?()'))) AS form FROM (SELECT unnest({words('text')}) AS w FROM conversations)")
def attested_forms(spark, sf_dir):
    return pools.attested_forms(_turns(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("w")), "w")


@query("""SELECT conv_id, turn, 'normalize: ' || t AS input_text, regexp_replace(t, 'κἀγὼ|κάν', CASE WHEN turn % 3 = 0 THEN 'καὶ ἐγὼ'
        ELSE 'καὶ ἐάν' END) AS target_text
    FROM (SELECT conv_id, turn, role || CASE turn % 3 WHEN 0 THEN ' κἀγὼ κάν' WHEN 1 THEN ' κάν, x' ELSE '' END AS t FROM conversations)
        WHERE turn % 3 = 0 UNION ALL
    SELECT conv_id, turn, 'normalize: ' || role || ' κάν, x', role || ' καὶ ἐάν x' FROM conversations WHERE turn % 3 = 1""")
def crasis_examples(spark, sf_dir):
    text = F.concat("role", F.when(F.col("turn") % 3 == 0, " κἀγὼ κάν").when(F.col("turn") % 3 == 1, " κάν, x").otherwise(""))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", text.alias("text"))
    return pools.crasis_examples(rows).select("conv_id", "turn", "input_text", "target_text")


@query(f"""WITH t AS (SELECT conv_id || ':' || turn AS id, translate(text, 'eaio', 'ηωαι') || ' οικει' AS text FROM conversations),
    w AS (SELECT id, unnest(range(len(l))) AS i, unnest(l) AS w, len(l) AS n FROM (SELECT id, {words('text')} AS l FROM t)),
    a AS (SELECT DISTINCT lower(strip_accents(rtrim(w, ',.:;·!?()'))) AS form FROM w JOIN t USING (id) WHERE length(text) % 2 = 0),
    r(j, old, new) AS (VALUES (0, 'ει', 'ι'), (1, 'η', 'ι'), (2, 'οι', 'υ'), (3, 'αι', 'ε'), (4, 'ω', 'ο')),
    x AS (SELECT id, i, n, j, substr(w, 1, instr(w, old) - 1) || new || substr(w, instr(w, old) + length(old)) AS made FROM w JOIN r ON contains(w, old)),
    e AS (SELECT id, i, n, min_by(made, md5('42:' || id || ':' || i || ':' || j)) AS made FROM x WHERE lower(strip_accents(made)) NOT IN (SELECT form
        FROM a) GROUP BY ALL),
    c AS (SELECT id, i, made FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5('42:' || id || ':' || i)) <= greatest(2, floor(n * 0.4)))
    SELECT id, 'normalize: ' || string_agg(coalesce(made, w), ' ' ORDER BY i) AS input_text, any_value(text) AS target_text FROM w LEFT
        JOIN c USING (id, i) JOIN t USING (id) GROUP BY id HAVING count(made) > 0""")
def itacism_examples(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(F.translate("text", "eaio", "ηωαι"), F.lit(" οικει")).alias("text")
    )
    forms = pools.attested_forms(rows.where("length(text) % 2 = 0").select(F.explode(T.words(F.col("text"))).alias("w")), "w")
    return pools.itacism_examples(rows, "text", "id", forms).select("id", "input_text", "target_text")


@query("SELECT conv_id AS pericope_id, role AS book, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE conv_id % 4 IN (1, 2) GROUP BY ALL")
def held_out_texts(spark, sf_dir):
    split = F.when(F.col("conv_id") % 4 == 1, "val").when(F.col("conv_id") % 4 == 2, "test").otherwise("train")
    rows = _turns(spark, sf_dir).select(
        F.col("conv_id").alias("pericope_id"), F.col("role").alias("book"), F.lit(1).alias("chapter"), F.col("turn").alias("verse"),
        F.lit(0).alias("position"), "text", split.alias("split")
    )
    return pools.held_out_texts(rows.drop("split"), rows.select("pericope_id", "split").distinct(), ["val", "test"])


_WINDOWS = ORACLE_SQL["passage_windows"].replace("md5(string_agg(text, ' ' ORDER BY doc_id)) AS text", "string_agg(text, ' ' ORDER BY doc_id) AS text")
_BUILT = _WINDOWS[: _WINDOWS.rindex("SELECT source, mine")], _WINDOWS[_WINDOWS.rindex("SELECT source, mine") :]


@query(f"""{_BUILT[0].rstrip()}, v AS ({_BUILT[1]}), u AS (SELECT source || ':' || v."window" AS id, text
        FROM v), i AS (SELECT DISTINCT unnest({shingled(key('text'), 8)}) AS s FROM benchmark),
    c AS (SELECT DISTINCT id FROM (SELECT id, unnest({shingled(key('text'), 8)}) AS s FROM u) WHERE s IN (SELECT s FROM i)),
        f AS (SELECT min(id) AS id FROM u GROUP BY md5({key('text')})),
    k AS (SELECT id, len({words('text')}) AS n, row_number() OVER (ORDER BY md5('42:' || id), id) AS r, count(*) OVER () AS total FROM u
        JOIN f USING (id) WHERE id NOT IN (SELECT id FROM c)),
    z AS (SELECT *, r <= greatest(1, floor(total * 0.02)) AS eval FROM k)
    SELECT (SELECT count(*) FROM u) AS raw_windows, (SELECT count(*) FROM c) AS contaminated, count(*) AS clean_windows, (SELECT count(*)
        FROM u) - count(*) AS dropped,
    count(*) FILTER (NOT eval) AS train_windows, count(*) FILTER (eval) AS eval_windows, sum(n) FILTER (NOT eval)::BIGINT AS corpus_words FROM z""")
def corpus_build(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("ref"), "text")
    totals = "raw_windows long, contaminated long, clean_windows long, dropped long, train_windows long, eval_windows long, corpus_words long"
    made = pools.build_corpus(docs, table(spark, sf_dir, "benchmark"))["manifest"]
    return made.select(F.from_json("manifest", totals).alias("m")).select("m.*")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 40")
def control_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", sampling.hash_order("o_orderkey").alias("file"), F.col("o_orderkey").alias("n"))
    return readers.control_chunks(rows, 40).select("o_orderkey")


@query(
    f"SELECT doc_id, len(w)::INTEGER AS n, greatest(1, floor(len(w) * 0.15))::INTEGER AS masked, true AS kept FROM (SELECT doc_id, {words('text')} AS w FROM documents) WHERE len(w) > 0"
)
def masked_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.words(F.col("text")), lambda w: F.length(w)).alias("ids")).where("size(ids) > 0")
    made = pools.mask_tokens(rows, "doc_id", "ids", mask=-1)
    masked = F.size(F.filter("input_ids", lambda x: x == -1))
    kept = F.forall(F.zip_with("input_ids", "labels", lambda x, y: (x == -1) | (x == y)), lambda x: x)
    return made.select("doc_id", F.size("labels").alias("n"), masked.alias("masked"), kept.alias("kept"))


@query(
    """SELECT p_partkey, p_size::INTEGER AS total, CASE WHEN p_size = 0 THEN 0 ELSE least(p_size, p_partkey % 7 + 1) END::INTEGER AS parts, true AS positive FROM part"""
)
def compositions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"), (F.col("p_partkey") % 7 + 1).cast("int").alias("k"))
    made = pools.compositions(rows, "p_partkey", "n", "k")
    total = F.aggregate("parts", F.lit(0), lambda x, y: x + y)
    return made.select("p_partkey", total.alias("total"), F.size("parts").alias("parts"), F.forall("parts", lambda x: x > 0).alias("positive"))


def _four(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(
        F.col("conv_id").alias("key"), F.col("turn").alias("position"), F.col("role").alias("form"), F.col("role").alias("pos"),
        F.col("role").alias("lemma"), F.col("role").alias("morph")
    )
    pairs = examples.directed_pairs(
        aggregates.ordered_text(_turns(spark, sf_dir), ["conv_id", "role"], ["turn"], "text"), "conv_id", "role", "text", [("user", "assistant")]
    )
    return rows, pairs.select(F.col("source_text").alias("input_text"), F.col("target_text"))


_FOUR = """g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 2), s AS (SELECT conv_id FROM conversations WHERE text <> '' GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(role = 'assistant'))"""


@query(
    f"WITH {_FOUR} SELECT 'pos' AS task, count(*) AS n FROM g WHERE n <= 60 UNION ALL SELECT 'lemma', count(*) FROM g WHERE n <= 60 UNION ALL SELECT 'denoise', count(*) FROM g UNION ALL SELECT 'synoptic', count(*) FROM s"
)
def four_pools(spark, sf_dir):
    rows, pairs = _four(spark, sf_dir)
    return pools.four_pools([rows], pairs).groupBy("task").agg(F.count("*").alias("n"))


@query(f"""WITH {_FOUR}, c AS (SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN 'κἀγὼ' ELSE 'λόγοι' END, ' ' ORDER BY turn) AS t, count(*) AS n
        FROM conversations GROUP BY conv_id HAVING count(*) >= 2)
    SELECT * FROM (SELECT unnest(['pos', 'lemma', 'morphology']) AS task, (SELECT count(*) FROM g WHERE n <= 60) AS n) UNION ALL SELECT 'denoise',
        count(*) FROM g UNION ALL SELECT 'synoptic', count(*) FROM s
    UNION ALL SELECT 'restore', count(*) FROM c UNION ALL SELECT 'normalize', count(DISTINCT t) FROM c""")
def task_pools(spark, sf_dir):
    rows, pairs = _four(spark, sf_dir)
    greek = rows.withColumn("form", F.when(F.col("position") == 0, "κἀγὼ").otherwise("λόγοι"))
    return pools.task_pools([greek], pairs, None).groupBy("task").agg(F.count("*").alias("n"))


@query()
def linear_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("embedding")[0] > F.col("embedding")[1], "a").otherwise("b").alias("label")
    )
    return probe.linear_probe(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), "embedding", "label")


@query(f"""WITH {_SIDES}, {_WITNESSED}, u AS (SELECT conv_id, {words('b')} AS a, {words('a')} AS b FROM s), h AS (SELECT *, coalesce({_COMMON}, 0) AS c FROM u),
    x AS (SELECT h.conv_id AS source, ({_F1})::DOUBLE - n.f1 AS gain FROM h JOIN n USING (conv_id)), {_boot('x', 'gain', '42', 'p', 2_000)}
    SELECT (SELECT round(avg(gain), 9) FROM x) AS estimate, (SELECT count(DISTINCT source) FROM x) AS n_units, (SELECT count(*) FROM x) AS n_samples,
        {_SUMMARY} FROM p""")
def gain_over_nearest(spark, sf_dir):
    return _rounded(evaluation.against_nearest(_witnessed(spark, sf_dir), "conv_id", F.col("b"), F.col("a"), "w"))


@query(f"SELECT doc_id, source, array_to_string({words('text')}[1:5], ' ') AS first FROM documents")
def capped_words(spark, sf_dir):
    rows = pools.truncate(table(spark, sf_dir, "documents").withColumn("w", T.words(F.col("text"))), 5, "w")
    return rows.select("doc_id", "source", F.array_join("w", " ").alias("first"))


@query("SELECT source FROM documents")
def group_ids(spark, sf_dir):
    return corpus.group_ids(table(spark, sf_dir, "documents"), "source")
