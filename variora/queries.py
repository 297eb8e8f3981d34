"""Queries over the driver's tables, one or more for each operator, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variora.functions import text as T
from variora.operators import aggregates, alignment, corpus, evaluation, linking, order, pools, sampling, screening, statistics
from variora.plans import reader

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "screened_passages"

#: SQL for the normalisers, on column {x}
_SPACES = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_KEY = "trim(regexp_replace(replace(replace(lower(strip_accents({x})), 'ß', 'ss'), 'ς', 'σ'), '@', ' ', 'g'))"
_WORDS = "list_filter(string_split_regex(coalesce({x}, ''), '@'), lambda w: w <> '')"
_U = "(('0x' || substr(md5({x}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(x: str) -> str:
    return _KEY.format(x=x).replace("@", _SPACES)


def words(x: str) -> str:
    return _WORDS.format(x=x).replace("@", _SPACES)


def loose(x: str) -> str:
    return f"replace(replace(lower(trim(regexp_replace({x}, '{_SPACES}', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"


def shingled(x: str, n: int) -> str:
    one = f"CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - {n} + 1), lambda i: array_to_string(list_slice(w, i + 1, i + {n}), ' '))) END"
    return f"list_transform([{words(x)}], lambda w: {one})[1]"


@query(f"""SELECT doc_id, md5({key('text')}) AS dedup, md5(lower(strip_accents(trim(text)))) AS alignment, md5(lower(strip_accents(text))) AS stripped,
    md5(upper(replace(strip_accents(text), 'ß', 'ss'))) AS uncial, md5({loose('text')}) AS loose FROM documents""")
def normalisers(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.dedup_key(x)).alias("dedup"), F.md5(T.alignment_key(x)).alias("alignment"), F.md5(T.strip_accents(x)).alias("stripped"),
        F.md5(T.uncial(x)).alias("uncial"), F.md5(T.loose(x)).alias("loose")
    )


@query("""SELECT DISTINCT w AS word, trim(w, '.,;:!?·()[]{}<>"''«»“”‘’—–-…⸀⸁⸂⸃⸄⸅') AS bare, regexp_matches(w, '[\\x{0370}-\\x{03ff}\\x{1f00}-\\x{1fff}]') AS greek
    FROM (SELECT unnest(""" + words("text") + """) AS w FROM conversations)""")
def bare_words(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", T.strip_punctuation(F.col("word")).alias("bare"), T.is_greek(F.col("word")).alias("greek"))


@query(f"SELECT doc_id, len(s)::INTEGER AS n FROM (SELECT doc_id, {shingled(key('text'), 8)} AS s FROM documents)")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.shingles(T.dedup_key(F.col("text")))).alias("n"))


_SHARE = f"""i AS (SELECT DISTINCT unnest({shingled(key('text'), 8)}) AS s FROM benchmark),
    c AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({shingled(key('text'), 8)}) AS s FROM documents) WHERE s IN (SELECT s FROM i))"""


@query(f"WITH {_SHARE} SELECT doc_id FROM c")
def contaminated_documents(spark, sf_dir):
    return screening.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


@query(f"""WITH {_SHARE}, f AS (SELECT min(doc_id) AS doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY md5({key('text')}))
    SELECT source, count(*) AS passages, sum(len({words('text')}))::BIGINT AS words FROM documents JOIN f USING (doc_id)
        WHERE doc_id NOT IN (SELECT doc_id FROM c) GROUP BY source""")
def screened_passages(spark, sf_dir):
    kept = screening.screen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return kept.groupBy("source").agg(F.count("*").alias("passages"), F.sum(F.size(T.words(F.col("text")))).alias("words"))


@query(f"""WITH RECURSIVE p AS (SELECT source, doc_id, array_to_string(w, ' ') AS text, len(w) AS n, row_number() OVER (PARTITION BY source
        ORDER BY doc_id) AS i
        FROM (SELECT source, doc_id, {words('text')} AS w FROM documents) WHERE len(w) > 0),
    r(source, i, mine, next, held) AS (SELECT source, i, 0, (n >= 150)::INT, CASE WHEN n >= 150 THEN 0 ELSE n END FROM p WHERE i = 1
        UNION ALL SELECT p.source, p.i, next + f, next + f + (t >= 150)::INT, CASE WHEN t >= 150 THEN 0 ELSE t END
        FROM (SELECT p.source, p.i, r.next, (r.held > 0 AND r.held + p.n > 300)::INT AS f, CASE WHEN r.held > 0 AND r.held + p.n > 300 THEN p.n
        ELSE r.held + p.n END AS t
              FROM r JOIN p ON p.source = r.source AND p.i = r.i + 1) p)
    SELECT source, mine::BIGINT AS window, CASE WHEN count(*) = 1 THEN min(doc_id)::VARCHAR ELSE min(doc_id) || '–' || max(doc_id) END AS ref,
        sum(n)::BIGINT AS n_words,
        md5(string_agg(text, ' ' ORDER BY doc_id)) AS text FROM r JOIN p USING (source, i) GROUP BY source, mine""")
def passage_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("ref"), "text")
    return order.passage_windows(docs).withColumn("text", F.md5("text"))


@query(f"""SELECT doc_id, md5('continue: ' || array_to_string(w[1:c], ' ')) AS input, md5(array_to_string(w[c + 1:], ' ')) AS target FROM (
    SELECT doc_id, w, greatest(1, least(len(w) - 1, round_even(len(w) * 0.5, 0)::INTEGER)) AS c FROM (SELECT doc_id, {words('text')} AS w
        FROM documents) WHERE len(w) >= 20)""")
def continuation_examples(spark, sf_dir):
    rows = order.continuations(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.md5("input_text").alias("input"), F.md5("target_text").alias("target"))


@query("""WITH r AS (SELECT n_nationkey AS pid, n_regionkey * 10 AS lo, n_regionkey * 10 + n_nationkey % 15 AS hi FROM nation),
    e AS (SELECT unnest(range(lo, hi + 1)) AS size, pid FROM r), f AS (SELECT size, min(pid) AS pid FROM e GROUP BY size)
    SELECT p_partkey, p_size, pid FROM part LEFT JOIN f ON p_size = size""")
def interval_assignment(spark, sf_dir):
    ranges = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("pid"), (F.col("n_regionkey") * 10).alias("lo"),
        (F.col("n_regionkey") * 10 + F.col("n_nationkey") % 15).alias("hi")
    )
    return linking.assign_intervals(
        table(spark, sf_dir, "part").select("p_partkey", "p_size"), ranges, "lo", "hi", "p_size", "pid"
    ).select("p_partkey", "p_size", "pid")


@query("""WITH r AS (SELECT n_regionkey AS k, n_nationkey AS pid, n_nationkey % 7 AS c1, 3 AS v1, n_nationkey % 7 + 2 AS c2, 5 AS v2 FROM nation)
    SELECT s_suppkey, min(pid) AS pid FROM (SELECT s_suppkey, s_nationkey % 5 AS k, s_suppkey % 9 AS c, s_suppkey % 11 AS v FROM supplier) s
    LEFT JOIN r ON s.k = r.k AND (c1, v1) <= (c, v) AND (c, v) <= (c2, v2) GROUP BY s_suppkey""")
def range_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    start = (F.col("n_nationkey") % 7).alias("c1"), F.lit(3).alias("v1")
    ranges = n.select(
        F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("pid"), *start, (F.col("n_nationkey") % 7 + 2).alias("c2"), F.lit(5).alias("v2")
    )
    points = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_nationkey") % 5).alias("k"), (F.col("s_suppkey") % 9).alias("c"), (F.col("s_suppkey") % 11).alias("v")
    )
    return linking.find_range(points, ranges, ["k"], ("c", "v"), ("c1", "v1"), ("c2", "v2"), "pid", "pid").select("s_suppkey", "pid")


@query("""WITH r AS (SELECT * FROM lineitem WHERE l_linenumber % 2 = 0), e AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS x FROM r GROUP BY ALL),
    f AS (SELECT l_orderkey, l_returnflag, min(l_partkey) AS y FROM r GROUP BY ALL)
    SELECT l.l_orderkey, l.l_linenumber, coalesce(x, y) AS part FROM lineitem l LEFT JOIN e USING (l_orderkey, l_linenumber) LEFT
        JOIN f USING (l_orderkey, l_returnflag)""")
def merge_with_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    right = rows.where("l_linenumber % 2 = 0").withColumnRenamed("l_partkey", "part")
    left = rows.drop("l_partkey")
    return linking.merge_with_fallback(
        left, right, ["l_orderkey", "l_linenumber"], "part", ["l_orderkey", "l_returnflag"], "part"
    ).select("l_orderkey", "l_linenumber", "part")


_TEXTS = "t AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY ALL)"


def _texts(spark, sf_dir):
    return aggregates.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"], "text")


@query(
    f"WITH {_TEXTS} SELECT a.conv_id, a.role AS a, b.role AS b, md5(a.text) AS x, md5(b.text) AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role < b.role"
)
def parallel_pairs(spark, sf_dir):
    return linking.unordered_pairs(_texts(spark, sf_dir), "conv_id", "role", "text").select(
        "conv_id", "a", "b", F.md5("value_a").alias("x"), F.md5("value_b").alias("y")
    )


@query(f"WITH {_TEXTS} SELECT a.conv_id, a.role, b.role AS other_role FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role <> b.role")
def parallel_members(spark, sf_dir):
    return linking.parallels(_texts(spark, sf_dir), "conv_id", "role").select("conv_id", "role", "other_role")


@query("""SELECT conv_id, CASE WHEN bool_or(role = 'user') AND bool_or(role = 'assistant') AND bool_or(role = 'system') THEN 'triple'
    WHEN bool_or(role = 'user') AND bool_or(role = 'assistant') THEN 'double' WHEN bool_or(role = 'system') THEN 'system_unique'
        ELSE 'other' END AS class FROM conversations GROUP BY conv_id""")
def tradition(spark, sf_dir):
    cases = [(["user", "assistant", "system"], "triple"), (["user", "assistant"], "double"), (["system"], "system_unique")]
    return aggregates.classify(table(spark, sf_dir, "conversations"), "conv_id", "role", cases, "other")


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(p_brand, '') AS p_brand, coalesce(p_size, 0) AS p_size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey"""
)
def enriched_facts(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size > 10").withColumnRenamed("p_partkey", "l_partkey")
    return linking.enrich(
        table(spark, sf_dir, "lineitem"), part, "l_partkey", {"p_brand": "", "p_size": 0}
    ).select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)
    SELECT a.c_custkey, b.c_custkey AS control, c.c_custkey AS null_control FROM r a JOIN r b ON b.i = (a.i + 1) % a.n JOIN r c ON c.i = (a.i + 2) % a.n""")
def rotated_controls(spark, sf_dir):
    return linking.rotate(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "c_custkey", {"control": 1, "null_control": 2})


@query("""SELECT conv_id::VARCHAR AS conv_id, string_agg(role || '=' || text, chr(10) ORDER BY role) AS members FROM (
    SELECT conv_id, role, string_agg(md5(text), ',' ORDER BY turn) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def nested_records(spark, sf_dir):
    rows = aggregates.nested(table(spark, sf_dir, "conversations").withColumn("h", F.md5("text")), "conv_id", "role", ["turn"], "h")
    items = F.transform(F.array_sort(F.map_entries("members")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return rows.select("conv_id", F.array_join(items, "\n").alias("members"))


@query(f"""SELECT source, round(sum(nll * n) / sum(n), 9) AS mean_nll, round(exp(sum(nll * n) / sum(n)), 6) AS perplexity, count(*) AS n_chunks,
        sum(n)::BIGINT AS n_tokens
    FROM (SELECT source, n_chars::DOUBLE / (n_chars + 500.0) AS nll, len({words('text')}) AS n FROM documents) GROUP BY source""")
def perplexity(spark, sf_dir):
    n = F.size(T.words(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("source", (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("nll"), n.alias("n"))
    made = aggregates.perplexity(rows, ["source"], "nll", "n")
    return made.withColumns({"mean_nll": F.round("mean_nll", 9), "perplexity": F.round("perplexity", 6)})


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS subset, sum((quality <> toxic)::INT)::BIGINT AS hits, count(*) AS n,
        round(sum((quality <> toxic)::INT) / count(*), 9) AS accuracy
    FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def pooled_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return aggregates.pooled_accuracy(rows, "lang", F.col("quality") != F.col("toxic")).withColumn("accuracy", F.round("accuracy", 9))


_SIDES = "s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS a, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)"


def _sides(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return t.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("a"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("b")
    )


@query(f"""WITH {_SIDES}, w AS (SELECT conv_id, w, sum(p) AS p, sum(g) AS g FROM (SELECT conv_id, unnest({words('a')}) AS w, 1 AS p, 0 AS g FROM s
        UNION ALL SELECT conv_id, unnest({words('b')}), 0, 1 FROM s) GROUP BY ALL),
    t AS (SELECT conv_id, sum(least(p, g)) AS c, sum(p) AS p, sum(g) AS g FROM w GROUP BY conv_id)
    SELECT conv_id, round(CASE WHEN p IS NULL THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (p + g) END::DOUBLE, 9) AS f1 FROM s LEFT JOIN t USING (conv_id)""")
def token_f1(spark, sf_dir):
    return aggregates.token_f1(_sides(spark, sf_dir), "conv_id", F.col("a"), F.col("b")).withColumn("f1", F.round("f1", 9))


@query(f"WITH {_SIDES} SELECT coalesce(avg(coalesce({loose('a')} = {loose('b')}, false)::INT::DOUBLE), 0.0) AS rate FROM s")
def exact_match_rate(spark, sf_dir):
    return aggregates.exact_match_rate(_sides(spark, sf_dir), F.col("a"), F.col("b"))


@query(
    """SELECT user_id, coalesce(min_by(g, event_id) FILTER (g <> ''), max_by(g, event_id)) AS gloss FROM (SELECT user_id, event_id, CASE WHEN value > 50 THEN event_type ELSE '' END AS g FROM events) GROUP BY user_id"""
)
def lexicon(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 50, F.col("event_type")).otherwise("").alias("gloss"))
    return aggregates.harvest(rows, "user_id", "gloss", "event_id")


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS index FROM orders GROUP BY o_orderpriority")
def label_index(spark, sf_dir):
    return aggregates.label_index(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query(f"SELECT source, count(*) AS windows, sum(len({words('text')}))::BIGINT AS words FROM documents GROUP BY source")
def census(spark, sf_dir):
    return aggregates.census(table(spark, sf_dir, "documents"), "source", "text")


@query("SELECT n_regionkey, count(DISTINCT n_name) AS codes FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1")
def code_conflicts(spark, sf_dir):
    return aggregates.code_conflicts(table(spark, sf_dir, "nation"), "n_regionkey", "n_name")


@query("""SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
    SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AND row_number()
        OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS n FROM events)""")
def islands(spark, sf_dir):
    return order.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id", "island")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, last_value(m IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS marker
    FROM (SELECT *, CASE WHEN value > 90 THEN event_type END AS m FROM events)""")
def carried_markers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") > 90, F.col("event_type")).alias("marker"))
    return order.positions(order.carry_forward(rows, ["user_id"], "event_id", "marker"), ["user_id"], "event_id").select("event_id", "position", "marker")


@query("""WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id),
        doc_id) AS r FROM documents),
    s AS (SELECT *, greatest(1, round_even(n * 0.6, 0)) AS t, greatest(1, round_even(n * 0.2, 0)) AS v FROM r), q AS (SELECT *, CASE
        WHEN n - t - v < 1 THEN greatest(1, n - t - 1) ELSE v END AS w FROM s)
    SELECT doc_id, CASE WHEN n < 3 OR r <= t THEN 'train' WHEN r <= t + w THEN 'val' ELSE 'test' END AS split FROM q""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "split")


@query("""WITH s AS (SELECT lang, source, row_number() OVER (ORDER BY lang, source) - 1 AS s FROM (SELECT DISTINCT lang, source FROM documents))
    SELECT doc_id, ((row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) - 1 + s) % 5)::INTEGER AS fold
        FROM documents JOIN s USING (lang, source)""")
def stratified_folds(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 5).select("doc_id", "fold")


@query(
    """SELECT doc_id, count(*) OVER (PARTITION BY source) >= 40 AND row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 10 AS held FROM documents"""
)
def held_out_pool(spark, sf_dir):
    return sampling.hold_out(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 10).select("doc_id", "held")


@query(f"""WITH p AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 3.0 ELSE 1.0 END AS w FROM documents GROUP BY lang),
    b AS (SELECT lang, n, sum(w) OVER (ORDER BY lang) / sum(w) OVER () AS high FROM p),
    d AS (SELECT o_orderkey, {_U.format(x="'42:' || o_orderkey || ':pool'")} AS u, {_U.format(x="'42:' || o_orderkey || ':item'")} AS v FROM orders),
    m AS (SELECT o_orderkey, u, v, min(high) AS high FROM d JOIN b ON high > u GROUP BY ALL)
    SELECT o_orderkey, lang AS pool, floor(v * n)::BIGINT AS item FROM m JOIN b USING (high)""")
def weighted_draws(spark, sf_dir):
    pools = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("w", F.when(F.col("lang") == "en", 3.0).otherwise(1.0))
    return sampling.draws(pools, "lang", "w", "n", table(spark, sf_dir, "orders"), "o_orderkey")


_SCORES = "s AS (SELECT source, l.quality::DOUBLE AS a, l.toxic::DOUBLE AS b, d.lang FROM labels l JOIN documents d USING (doc_id))"


def _scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "source", F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"), "lang"
    )


def _boot(rows: str, value: str, seed: str, name: str, n: int = 10_000) -> str:
    return f"""{name}g AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i, count(*) AS c, sum({value}) AS v FROM {rows} GROUP BY source),
        {name}n AS (SELECT count(*) AS k FROM {name}g),
    {name} AS (SELECT r, sum(v) / sum(c) AS m FROM (SELECT r, floor({_U.format(x=f"'{seed}:' || r || ':' || j")} * k)::BIGINT AS i
        FROM (SELECT unnest(range({n})) AS r), (SELECT unnest(range(k)) AS j, k FROM {name}n)) JOIN {name}g USING (i) GROUP BY r)"""


_SUMMARY = "round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high, round(avg(m), 9) AS boot_mean, round(stddev_pop(m), 9) AS boot_std, round(avg((m > 0)::INT::DOUBLE), 9) AS prob_positive"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    f"WITH {_SCORES}, {_boot('s', 'a', '42', 'x')} SELECT (SELECT round(avg(a), 9) FROM s) AS estimate, (SELECT count(DISTINCT source) FROM s) AS n_units, (SELECT count(*) FROM s) AS n_samples, {_SUMMARY} FROM x"
)
def bootstrap_ci(spark, sf_dir):
    return _rounded(statistics.mean_ci(_scores(spark, sf_dir), "source", "a"))


@query(f"""WITH {_SCORES}, e AS (SELECT * FROM s WHERE lang = 'en'), o AS (SELECT * FROM s WHERE lang <> 'en'), {_boot('e', 'a', '42a', 'x')},
        {_boot('o', 'a', '42b', 'y')}, z AS (SELECT x.m - y.m AS m FROM x JOIN y USING (r))
    SELECT (SELECT round((SELECT avg(a) FROM e) - (SELECT avg(a) FROM o), 9)) AS estimate, {_SUMMARY} FROM z""")
def difference_in_differences(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return _rounded(statistics.difference_ci(s.where("lang = 'en'"), s.where("lang <> 'en'"), "source", "a"))


@query(f"WITH {_SCORES}, {_boot('s', 'a - b', '42', 'z')} SELECT (SELECT round(avg(a) - avg(b), 9) FROM s) AS estimate, {_SUMMARY} FROM z")
def paired_delta(spark, sf_dir):
    return _rounded(statistics.paired_delta(_scores(spark, sf_dir), "source", "a", "b"))


@query(
    "SELECT round(quantile_cont(value, 0.95), 9) AS threshold, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(value) AS n FROM events"
)
def null_threshold(spark, sf_dir):
    return _rounded(statistics.null_threshold(table(spark, sf_dir, "events"), "value"))


@query(
    """SELECT user_id, round(gap, 9) AS gap, gap > 0.25 AS flagged FROM (SELECT user_id, (avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'view')) / 100.0 AS gap FROM events GROUP BY user_id) WHERE gap IS NOT NULL"""
)
def memorisation_gap(spark, sf_dir):
    of = lambda t: F.when(F.col("event_type") == t, F.col("value") / 100.0)
    rows = evaluation.memorisation_gap(table(spark, sf_dir, "events"), "user_id", of("purchase"), of("view"))
    return rows.where("gap is not null").withColumn("gap", F.round("gap", 9))


@query("""SELECT o_orderpriority AS task, count(*) AS n, count(*) FILTER (o_totalprice > 200000 OR o_custkey > 1000) AS dropped FROM orders GROUP BY 1""")
def length_filter_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "task")
    return pools.overlong_report(rows, 1000, F.col("o_totalprice") / 200, F.col("o_custkey"), ["none"])


@query("SELECT DISTINCT lang FROM documents EXCEPT SELECT DISTINCT lang FROM documents WHERE source = 'src1' AND doc_id < 100")
def set_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("lang").subtract(docs.where("source = 'src1' and doc_id < 100").select("lang"))


@query(
    """SELECT conv_id, turn, md5(text) AS text FROM conversations WHERE (conv_id > 3 OR conv_id = 3 AND turn >= 1) AND (conv_id < 9 OR conv_id = 9 AND turn <= 2)"""
)
def passage_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.lit("all").alias("book"), F.col("conv_id").alias("chapter"), F.col("turn").alias("verse"), F.lit(0).alias("position"), "text"
    )
    return reader.passage(rows, "all", (3, 1), (9, 2)).select(F.col("chapter").alias("conv_id"), F.col("verse").alias("turn"), F.md5("text").alias("text"))


@query(
    """SELECT n_name || ' ' || n_regionkey || ':' || n_nationkey AS ref, n_name AS book, n_regionkey AS chapter, n_nationkey AS first, n_nationkey AS last, n_name || ' ' || n_regionkey || ':' || n_nationkey || '-' || (n_nationkey + 1) AS label FROM (SELECT * REPLACE (translate(n_name, '0123456789', 'abcdefghij') AS n_name) FROM nation)"""
)
def references(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_name", F.translate("n_name", "0123456789", "abcdefghij")).select(
        "*", F.concat("n_name", F.lit(" "), "n_regionkey", F.lit(":"), "n_nationkey").alias("ref")
    )
    label = T.range_label(F.col("n_name"), F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_nationkey") + 1)
    return n.select("ref", T.parse_reference(F.col("ref")).alias("p"), label.alias("label")).select("ref", "p.*", "label")


@query(
    "SELECT conv_id, turn, a AS compact, c AS json FROM (SELECT conv_id, turn, replace(role || '--' || turn || '-', '-', '') AS a, '{\"a\":\"' || turn || '\",\"b\":\"' || role || '\"}' AS c FROM conversations)"
)
def tags_and_json(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    tag = T.compact_tag(F.concat("role", F.lit("--"), F.col("turn").cast("string"), F.lit("-")))
    return rows.select(
        "conv_id", "turn", tag.alias("compact"),
        T.canonical_json(F.create_map(F.lit("b"), F.col("role"), F.lit("a"), F.col("turn").cast("string"))).alias("json")
    )


@query()
def aligned_turns(spark, sf_dir):
    rows = _sides(spark, sf_dir).where("a is not null and b is not null").select(
        "conv_id", T.words(T.alignment_key(F.col("a"))).alias("a"), T.words(T.alignment_key(F.col("b"))).alias("b")
    )
    size = lambda x: F.transform(x, lambda w: F.length(w).cast("string"))
    pairs = alignment.align(rows, ["conv_id", "a", "b"], "a", "b").withColumns({"x": size("a"), "y": size("b")})
    return alignment.alignment_score(pairs, ["conv_id"], {"word": ("a", "b"), "size": ("x", "y")})


@query()
def lift_power(spark, sf_dir):
    return statistics.lift_power(spark, [0.0, 0.1, 0.2, 0.4], [50.0] * 65, 0.2)


@query("""WITH f AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels) ORDER BY md5('42:' || doc_id), doc_id LIMIT 10)
    SELECT (SELECT count(*) FROM documents) BETWEEN 100 AND 100000000 AS tokens_ok, (SELECT count(*) FROM documents) >= 100 AS pericopes_ok,
        (SELECT count(*) FROM documents WHERE lang = 'en') > 0 AS triples_ok,
    (SELECT count(*) FROM documents WHERE lang = 'fr') > 0 AS doubles_ok, (SELECT count(*) FROM labels JOIN documents USING (doc_id)
        WHERE lang = 'en') >= 50 AS pairs_ok,
    (SELECT avg(quality) FROM labels WHERE doc_id IN (SELECT doc_id FROM f)) >= 0.7 AS match_ok""")
def corpus_checks(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kinds = docs.select(
        F.col("doc_id").alias("pericope_id"),
        F.when(F.col("lang") == "en", "triple").when(F.col("lang") == "fr", "double").otherwise("other").alias("tradition")
    )
    pairs = labels.select(F.col("doc_id").alias("pericope_id"), F.col("quality").cast("double").alias("lemma_match_rate"))
    return corpus.corpus_report(docs, kinds, pairs, (100, 100_000_000))
