"""Queries of sources, sinks, readers and streams over files written from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from variora.functions import text as T
from variora.operators import aggregates, corpus
from variora.plans import editions, reader
from variora.queries import _SHARE, query, table, words
from variora.sources import readers, sinks
from variora.storage import materialise, new_path
from variora.streaming import screen


def _nations(spark, sf_dir):
    """(key, region, name) of the 25 nations, in order."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").collect()
    return sorted((int(r[0]), int(r[1]), r[2]) for r in rows)


def _files(spark, name, files: dict[str, str]) -> str:
    folder = new_path(spark, name)
    for file, content in files.items():
        sinks.write_bytes(spark, content.encode(), f"{folder}/{file}")
    return folder


def _column(values) -> str:
    return "\n".join(["@node", "@valueType=str", "", *map(str, values)]) + "\n"


# ---------------------------------------------------------------- column files


@query("SELECT (n_nationkey // 5 * 50 + 1 + n_nationkey % 5)::INTEGER AS node, n_name AS value FROM nation WHERE n_nationkey % 7 <> 3")
def sparse_column(spark, sf_dir):
    lines = [(f"{k * 10 + 1}\t" if k % 5 == 0 else "") + ("" if k % 7 == 3 else name) for k, _, name in _nations(spark, sf_dir)]
    return readers.sparse_column(spark, _files(spark, "sparse", {"name.tf": _column(lines)})).select("node", "value")


@query("SELECT n_nationkey::INTEGER + 1 AS slot, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS value FROM nation")
def dense_column(spark, sf_dir):
    values = ["" if k % 4 == 0 else name for k, _, name in _nations(spark, sf_dir)]
    return readers.dense_column(spark, _files(spark, "dense", {"word.tf": _column(values)})).select("slot", "value")


@query("SELECT count(*) AS n FROM nation")
def slot_count(spark, sf_dir):
    kinds = [(k + 1, "word") for k, _, _ in _nations(spark, sf_dir)]
    types = spark.createDataFrame(kinds + [(len(kinds) + 1, "verse"), (len(kinds) + 2, "word")], "node int, value string")
    return readers.slot_count(types).select(F.col("n").cast("long").alias("n"))


@query("""SELECT (n_nationkey // 3 + 1)::BIGINT AS ord, 'B' || n_nationkey // 12 AS book, (n_nationkey // 3 % 4)::VARCHAR AS chapter, 'v' AS verse,
        string_agg(n_name, ' ' ORDER BY n_nationkey) AS text
    FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY n_nationkey // 3, n_nationkey // 12""")
def verses_from_columns(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    parts = {
        "word": ["" if k % 4 == 0 else n for k, _, n in rows], "book": [f"B{k // 12}" for k, _, _ in rows] + ["more"],
        "chapter": [k // 3 % 4 for k, _, _ in rows], "verse": ["v" for _ in rows]
    }
    folder = _files(spark, "verses", {f"{name}.tf": _column(values) for name, values in parts.items()})
    columns = {name: readers.dense_column(spark, f"{folder}/{name}.tf") for name in parts}
    return readers.verses_from_columns(materialise(readers.zip_columns(columns), "slots"))


_EDITION = {
    "otype": lambda rows: ["word"] * len(rows), "book": lambda rows: [
        f"B{k // 10}" for k, _, _ in rows
    ], "chapter": lambda rows: [k // 4 + 1 for k, _, _ in rows],
    "verse": lambda rows: [
        "" if k == 7 else k % 4 // 2 + 1 for k, _, _ in rows
    ], "lex": lambda rows: [n.lower() for _, _, n in rows], "word": lambda rows: [n for _, _, n in rows],
    "sp": lambda rows: [
        "subs" if k % 2 else "verb" for k, _, _ in rows
    ], "gn": lambda rows: ["m" if k % 3 == 0 else "" for k, _, _ in rows], "after": lambda rows: ["," if k % 5 == 0 else "" for k, _, _ in rows],
}


def _edition(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    folder = _files(spark, "edition", {f"{name}.tf": _column(made(rows)) for name, made in _EDITION.items()})
    return editions.edition_words(readers.Features(spark, folder))


_WORDS = """w AS (SELECT 'B' || n_nationkey // 10 AS book, (n_nationkey // 10)::INTEGER AS book_number, (n_nationkey // 4 + 1)::INTEGER AS chapter,
        (n_nationkey % 4 // 2 + 1)::INTEGER AS verse, n_name AS surface, lower(n_name) AS lemma,
    CASE WHEN n_nationkey % 2 = 1 THEN 'noun' ELSE 'verb' END AS pos, CASE WHEN n_nationkey % 3 = 0 THEN '{"gender":"m"}'
        ELSE '{}' END AS features, '' AS gloss, '' AS strong,
    CASE WHEN n_nationkey % 5 = 0 THEN ',' ELSE ' ' END AS after, n_nationkey FROM nation WHERE n_nationkey <> 7),
    p AS (SELECT * EXCLUDE (n_nationkey), (row_number() OVER (PARTITION BY book, chapter, verse ORDER BY n_nationkey) - 1)::INTEGER AS position FROM w)"""


@query(f"WITH {_WORDS} SELECT *, book || ' ' || chapter || ':' || verse AS ref FROM p")
def edition_words(spark, sf_dir):
    return _edition(spark, sf_dir).withColumn("features", F.to_json("features"))


@query(f"WITH {_WORDS} SELECT * FROM p")
def reader_index(spark, sf_dir):
    path = new_path(spark, "index") + "/index.json.gz"
    sinks.save_index(_edition(spark, sf_dir), "test", path)
    return readers.reader_index(spark, path).withColumn("features", F.to_json(F.coalesce("features", F.expr("map()").cast("map<string,string>"))))


@query(f"WITH {_WORDS} SELECT * FROM p WHERE book = 'B1'")
def index_table(spark, sf_dir):
    path = new_path(spark, "index-table")
    sinks.save_index_table(_edition(spark, sf_dir).drop("ref"), path)
    return spark.read.parquet(path).where("book = 'B1'").withColumn("features", F.to_json("features"))


# ---------------------------------------------------------------- line formats


@query("""SELECT CASE WHEN n_regionkey = 0 THEN '05' WHEN n_regionkey < 4 THEN ['Matthew', 'Mark', 'Luke'][n_regionkey] ELSE 'John' END AS book,
        (n_nationkey // 5 + 1)::INTEGER AS chapter, 2 AS verse,
    CASE WHEN n_regionkey = 4 THEN n_nationkey::INTEGER ELSE (row_number() OVER (PARTITION BY n_regionkey, n_nationkey // 5
        ORDER BY n_nationkey) - 1)::INTEGER END AS position, 'N-' AS pos, '----NSF-' AS parsing, n_name || ',' AS text,
    n_name AS word, lower(n_name) AS normalized, 'l' || n_nationkey AS lemma FROM nation""")
def morphology_lines(spark, sf_dir):
    def place(k, r):
        return f"JHN {k // 5 + 1}:2/{k + 1}" if r == 4 else f"{r or 5:02}{k // 5 + 1:02}02"

    lines = ["# comment", "", "too few columns"] + [
        f"{place(k, r)} N- ----NSF- {n}, {n} {n.lower()} l{k}" for k, r, n in _nations(spark, sf_dir)
    ] + ["9x0101 N- ----NSF- a b c d"]
    return readers.morphology_lines(spark, _files(spark, "morph", {"a.txt": "\n".join(lines)})).drop("file")


@query(
    """SELECT 'a.txt.Mark.' || (n_nationkey // 5 + 1) || '.2' AS key, (row_number() OVER (PARTITION BY n_nationkey // 5 ORDER BY n_nationkey) - 1)::INTEGER AS position, lower(n_name) AS form, 'N-' AS pos, 'l' AS lemma, 'NNSF' AS morph FROM nation"""
)
def verse_keyed_lines(spark, sf_dir):
    lines = [f"02{k // 5 + 1:02}02 N- ----NSF- {n} {n} {n.lower()}, l" for k, _, n in _nations(spark, sf_dir)]
    return readers.verse_keyed_lines(spark, _files(spark, "keyed", {"a.txt": "\n".join(lines)}))


@query(
    """SELECT n_regionkey::INTEGER AS sentence, 'The Greek New Testament, ' || n_regionkey AS source, string_agg(n_name || '/' || lower(n_name) || '/Nb', ' ' ORDER BY n_nationkey) AS tokens FROM nation GROUP BY n_regionkey"""
)
def conllu_sentences(spark, sf_dir):
    blocks = []
    for region in range(5):
        rows = [n for _, r, n in _nations(spark, sf_dir) if r == region]
        said = [f"{i + 1}\t{n}\t{n.lower()}\tNOUN\tNb\tCase=Nom\t_\troot\t_\t_" for i, n in enumerate(rows)]
        blocks.append("\n".join([f"# source = The Greek New Testament, {region}", *said, "9-10\tx\t_\t_\t_\t_\t_\t_\t_\t_"]))
    made = readers.conllu_rows(spark, _files(spark, "conllu", {"a.conllu": "\n\n".join(blocks)}))
    token = F.transform("tokens", lambda t: F.concat_ws("/", t["form"], t["lemma"], t["xpos"]))
    return made.select("sentence", "source", F.array_join(token, " ").alias("tokens"))


# ---------------------------------------------------------------- marked-up and plain text


@query(
    """SELECT 'B' || n_regionkey AS book, (n_nationkey // 10 + 1)::INTEGER AS chapter, 1 AS verse, (row_number() OVER (PARTITION BY n_regionkey, n_nationkey // 10 ORDER BY n_nationkey) - 1)::INTEGER AS position, n_name AS text FROM nation"""
)
def edition_xml(spark, sf_dir):
    files = {}
    for region in range(5):
        body, seen = "", None
        for k, r, n in _nations(spark, sf_dir):
            if r == region:
                body += ("" if seen == k // 10 else f'<verse-number id="B {k // 10 + 1}:1">x</verse-number>') + f"<w>{n}</w><suffix>, </suffix>"
                seen = k // 10
        files[f"b{region}.xml"] = f'<book id="B{region}"><p>{body}</p></book>'
    return readers.edition_xml(spark, _files(spark, "xml", {**files, "bad.xml": "<book>"})).drop("file")


@query(
    "SELECT n_regionkey::INTEGER AS f, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS position, n_name AS word FROM nation QUALIFY row_number() OVER (ORDER BY n_regionkey, n_nationkey) <= 12"
)
def tei_words(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    text = lambda region: "".join(f"<s>{n} </s>" for _, r, n in rows if r == region)
    files = {f"t{region}.xml": f'<TEI xmlns="urn:x"><head>no</head><text><body><p>{text(region)}</p></body></text></TEI>' for region in range(5)}
    made = readers.tei_words(spark, _files(spark, "tei", files), 12)
    return made.select(F.regexp_extract("file", r"t(\d)\.xml$", 1).cast("int").alias("f"), "position", "word")


@query(
    "SELECT n_nationkey::INTEGER AS f, 0 AS position, 'é' || n_name AS word FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey::INTEGER, 1, 'x' FROM nation WHERE n_regionkey = 2"
)
def plain_words(spark, sf_dir):
    folder = new_path(spark, "plain")
    for k, r, n in _nations(spark, sf_dir):
        name = f"README{k}.txt" if r == 0 else f"{'gen' if r == 2 else 'other'}-{k}.txt"
        sinks.write_bytes(spark, f"é{n}\nx".encode("utf-8" if k % 2 else "latin-1"), f"{folder}/{name}")
    made = readers.plain_words(spark, folder, None, ["GEN"])
    return made.select(F.regexp_extract("file", r"-(\d+)\.txt$", 1).cast("int").alias("f"), "position", "word")


@query("""SELECT CASE n_nationkey % 3 WHEN 0 THEN 'xml' WHEN 1 THEN 'tf' ELSE 'txt' END AS kind, CASE
        WHEN n_nationkey % 3 = 0 THEN 'λόγος ' || n_name WHEN n_nationkey % 3 = 1 THEN 'λόγος ' || repeat(n_name || ' ', 4) || 'τέλος'
    ELSE 'λόγος ' || repeat(n_name || ' ', 4) || 'τέλος.' END AS chunk FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'txt',
        left(repeat('αβγδε', 200), 500)""")
def text_chunks(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    long = lambda n: "λόγος " + f"{n} " * 4 + "τέλος"
    files = {f"a{k}.xml": f"<a><b> λόγος {n} </b><c>abc defg</c><d>λό</d></a>" for k, _, n in rows if k % 3 == 0}
    files |= {f"c{k}.tf": f"@meta\n@text=\"{long(n)}\"\nx=λόγος\n" for k, _, n in rows if k % 3 == 1}
    files["t.txt"] = " ".join(f"{long(n)}. λόγος. {n}." for k, _, n in rows if k % 3 == 2) + " " + "αβγδε" * 200
    made = readers.text_chunks(spark, _files(spark, "chunks", {**files, "README.txt": files["t.txt"]}), ["a3"])
    return made.select(F.regexp_extract("file", r"\.([^.]*)$", 1).alias("kind"), "chunk")


@query("""SELECT (row_number() OVER (ORDER BY s, n) - 1)::BIGINT AS ord, text, source, CASE source WHEN 'lxx' THEN 'koine'
        ELSE 'classical' END AS register, ref FROM (
    SELECT 0 AS s, n_nationkey AS n, n_name AS text, 'lxx' AS source, 'N' || n_nationkey AS ref FROM nation UNION ALL SELECT 1, r_regionkey, r_name,
        'first1k', 'R' || r_regionkey FROM region)""")
def raw_passages(spark, sf_dir):
    part = lambda name, k, t, mark: table(spark, sf_dir, name).select(
        F.col(k).alias("n"), F.concat(F.lit(mark), k).alias("ref"), F.col(t).alias("text")
    )
    return readers.raw_passages(
        {"lxx": part("nation", "n_nationkey", "n_name", "N"), "first1k": part("region", "r_regionkey", "r_name", "R")}, {"lxx": "koine"}
    )


# ---------------------------------------------------------------- corpora and exports


def _passages(spark, sf_dir):
    """tokens, pericopes, alignments and splits made of conversations."""
    key = F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.col("conv_id").cast("string"))
    turns = table(spark, sf_dir, "conversations")
    tokens = turns.select(
        F.concat_ws(
            ".", "role", "conv_id", "turn"
        ).alias("token_id"), F.col("role").alias("book"), F.col("conv_id").cast("int").alias("chapter"), F.col("turn").cast("int").alias("verse"), F.lit(0).alias("position"),
        F.md5("text").alias("text"), F.lit("n").alias("normalized"), F.lit("l").alias("lemma"), F.lit("N-").alias("pos"), F.lit("--").alias("morph"), key.alias("pericope_id"), F.lit(False).alias(
            "is_punctuation"
        ),
    )
    some = tokens.where("pericope_id <> ''")
    books = corpus.members_of(some, "pericope_id", "book").withColumnRenamed("members", "books")
    pericopes = books.withColumns({"tradition": F.when(F.size("books") == 3, "triple").otherwise("double"), "genre": F.lit("other")})
    pairs = pericopes.where("size(books) > 1").select("pericope_id", F.col("books")[0].alias("book_a"), F.col("books")[1].alias("book_b"))
    pairs = pairs.withColumn("pairs", F.expr("array(named_struct('idx_a', 0, 'idx_b', 0), named_struct('idx_a', cast(null as int), 'idx_b', 1))"))
    splits = pericopes.select(
        "pericope_id", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("pericope_id").cast("int") % 3 + 1)).alias("split")
    )
    return tokens, pericopes, pairs, splits


_PASSAGES = """t AS (SELECT conv_id, role, turn, CASE WHEN conv_id % 9 = 0 THEN '' ELSE conv_id::VARCHAR END AS pid FROM conversations),
    b AS (SELECT pid, list_sort(list_distinct(list(role))) AS books, count(*) AS n, ['train', 'val', 'test'][any_value(conv_id) % 3 + 1] AS split
        FROM t WHERE pid <> '' GROUP BY pid)"""


def _exported(spark, sf_dir):
    parts = _passages(spark, sf_dir)
    path = new_path(spark, "export")
    sinks.export_dataset(*parts, path)
    return path, parts


@query(f"""WITH {_PASSAGES} SELECT pid AS pericope_id, CASE WHEN len(books) = 3 THEN 'triple' ELSE 'double' END AS tradition, 'other' AS genre,
        '["' || array_to_string(books, '","') || '"]' AS books, n AS n_tokens,
    CASE WHEN len(books) > 1 THEN 2 ELSE 0 END::BIGINT AS n_alignment_pairs, split FROM b""")
def exported_passages(spark, sf_dir):
    return spark.read.parquet(f"{_exported(spark, sf_dir)[0]}/pericopes.parquet")


@query(
    f"WITH {_PASSAGES} SELECT CASE split WHEN 'val' THEN 'validation' ELSE split END AS folder, role || '.' || t.conv_id || '.' || turn AS token_id, '[\"' || array_to_string(books, '\",\"') || '\"]' AS books FROM t JOIN b USING (pid)"
)
def exported_tokens(spark, sf_dir):
    path, _ = _exported(spark, sf_dir)
    parts = [
        spark.read.parquet(f"{path}/data/{name}.parquet").select(
            F.lit(name).alias("folder"), "token_id", F.col("books_in_pericope").alias("books")
        ) for name in sinks.SPLITS.values()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT true AS counts_kept, true AS splits_filled, true AS ids_kept, true AS pericopes_kept, true AS alignments_readable")
def export_checks(spark, sf_dir):
    path, (tokens, pericopes, _, splits) = _exported(spark, sf_dir)
    return sinks.export_checks(spark, path, tokens, pericopes, splits)


@query(f"""WITH {_PASSAGES} SELECT pid AS pericope_id, array_to_string(books, ',') AS books, CASE
        WHEN len(books) > 1 THEN books[1] || '|' || books[2] || ' 0,0;,1' END AS aligned, split,
    n AS n_tokens FROM b""")
def corpus_round_trip(spark, sf_dir):
    tokens, pericopes, pairs, splits = _passages(spark, sf_dir)
    path = new_path(spark, "corpus")
    sinks.write_corpus(tokens, pericopes, path)
    lists = sinks.alignment_lines(pairs).collect()  # small: a test corpus
    import json

    sinks.write_document(spark, {r["key"]: json.loads(r["pairs"]) for r in lists}, f"{path}/alignments.json", zipped=True)
    ids: dict[str, list[str]] = {}
    for r in splits.collect():
        ids.setdefault(f"{r['split']}_ids", []).append(r["pericope_id"])
    sinks.write_document(spark, ids, f"{path}/splits.json")
    made = readers.corpus_with_side_files(spark, f"{path}/tokens.parquet", f"{path}/pericopes.parquet", f"{path}/alignments.json", f"{path}/splits.json")
    pair = lambda p: F.concat(F.coalesce(p["idx_a"].cast("string"), F.lit("")), F.lit(","), F.coalesce(p["idx_b"].cast("string"), F.lit("")))
    said = F.concat("book_a", F.lit("|"), "book_b", F.lit(" "), F.array_join(F.transform("pairs", pair), ";"))
    counts = made["tokens"].groupBy("pericope_id").agg(F.count("*").alias("n_tokens"))
    rows = made["pericopes"].join(
        made["alignments"].select("pericope_id", said.alias("aligned")), "pericope_id", "left"
    ).join(made["splits"], "pericope_id").join(counts, "pericope_id")
    return rows.select("pericope_id", F.array_join("books", ",").alias("books"), "aligned", "split", "n_tokens")


@query(
    "SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'koine' WHEN doc_id % 3 = 1 THEN 'classical' ELSE 'given' END AS register FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'LXX' ELSE source END AS source FROM documents)"
)
def training_rows(spark, sf_dir):
    path = new_path(spark, "jsonl")
    source = F.when(F.col("doc_id") % 3 == 0, "LXX").otherwise(F.col("source"))
    sinks.write_jsonl(
        table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), F.when(F.col("doc_id") % 3 == 2, "given").alias("register")), path
    )
    return readers.training_rows(spark, path)


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY split")
def split_folders(spark, sf_dir):
    path = new_path(spark, "splits")
    sinks.write_splits(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train").alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query(
    "SELECT count(*) AS n_tokens, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 9 <> 0) AS n_pericopes, 'Luke,Mark' AS stems FROM conversations"
)
def corpus_sizes(spark, sf_dir):
    tokens, pericopes, _, _ = _passages(spark, sf_dir)
    stems = ",".join(readers.excluded_stems(["Mark", "Luke"]))
    return corpus.corpus_sizes(
        readers.require_columns(tokens, readers.TOKEN_COLUMNS), readers.require_columns(pericopes, readers.PERICOPE_COLUMNS)
    ).withColumn("stems", F.lit(stems))


# ---------------------------------------------------------------- the reader


def _held(spark, sf_dir):
    tokens, pericopes, _, splits = _passages(spark, sf_dir)
    return tokens.withColumn(
        "is_punctuation", F.when(F.col("verse") % 3 == 2, True).when(F.col("verse") % 3 == 1, F.lit(None).cast("boolean")).otherwise(False)
    ), pericopes, splits


@query(
    "SELECT conv_id::INTEGER AS chapter, turn::INTEGER AS verse FROM conversations WHERE role = 'user' AND conv_id % 9 <> 0 AND conv_id % 3 = 0 AND turn % 3 <> 2"
)
def token_filter(spark, sf_dir):
    tokens, _, splits = _held(spark, sf_dir)
    return reader.tokens(tokens, book="user", splits=splits, split="train").select("chapter", "verse")


@query("SELECT md5(text) AS text FROM conversations WHERE role = 'user' AND conv_id = 4 AND turn = 0")
def verse_lookup(spark, sf_dir):
    return reader.verse(_held(spark, sf_dir)[0], "user", 4, 0).select("text")


@query(f"WITH {_PASSAGES} SELECT pid AS pericope_id, len(books)::INTEGER AS books FROM b WHERE len(books) = 2 AND list_contains(books, 'assistant')")
def passage_filter(spark, sf_dir):
    return reader.pericopes(
        _held(spark, sf_dir)[1], tradition="double", genre="other", books=["assistant", "user"]
    ).select("pericope_id", F.size("books").alias("books"))


@query("SELECT role AS book FROM conversations GROUP BY role")
def book_picker(spark, sf_dir):
    return reader.books(_held(spark, sf_dir)[0].withColumn("o", F.struct("chapter", "verse")), "o")


@query("SELECT DISTINCT turn::INTEGER AS verse FROM conversations WHERE role = 'user' AND conv_id = 3")
def verse_picker(spark, sf_dir):
    return reader.verses(_held(spark, sf_dir)[0], "user", 3)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'first · ' ELSE '' END || 'active' AS features, p_size % 3 = 0 AS punctuation FROM part""")
def described_features(spark, sf_dir):
    features = F.create_map(F.lit("voice"), F.lit("active"), F.lit("person"), F.when(F.col("p_size") % 2 == 0, "first").otherwise(""))
    sign = F.when(F.col("p_size") % 3 == 0, " ·, ").when(F.col("p_size") % 3 == 1, "a,").otherwise("  ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.describe_features(features, ["person", "voice", "mood"]).alias("features"), T.is_punctuation(sign).alias("punctuation")
    )


@query("""WITH g AS (SELECT conv_id, [w || 'α' FOR w IN list(role ORDER BY turn)][1:5] AS l FROM conversations GROUP BY conv_id),
        e AS (SELECT conv_id, l, unnest(range(1, len(l) + 1)) AS i FROM g)
    SELECT conv_id::VARCHAR AS id, (i - 1)::INTEGER AS position, l[i] AS surface, upper(l[i]) AS lemma, CASE WHEN length(l[i]) % 2 = 0 THEN 'noun'
        ELSE 'verb' END AS pos, true AS predicted,
    CASE WHEN l[i] = 'userα' THEN 'asks' ELSE '' END AS gloss FROM e""")
def analysed_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit("α x")).alias("t")))).alias("l")
    )
    texts = rows.select(F.col("conv_id").cast("string").alias("id"), F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))

    def predict(task, lists):
        if task == "lemma":
            return [[w.upper() for w in own] for own in lists]
        made = [["n-" if len(w) % 2 == 0 else "v-" for w in own] for own in lists]
        return [own[:1] if len(own) > 3 else own for own in made]  # loses words of longer lists

    lexicon = spark.createDataFrame([("userα", "asks")], "key string, gloss string")
    return editions.analyse(texts, "id", predict, lexicon, most=5)


# ---------------------------------------------------------------- streams


@query(f"WITH {_SHARE} SELECT doc_id, doc_id IN (SELECT doc_id FROM c) AS contaminated FROM documents")
def flagged_stream(spark, sf_dir):
    path, held = f"{sf_dir}/documents.parquet", table(spark, sf_dir, "benchmark")
    rows = spark.read.parquet(path)
    folder = new_path(spark, "stream-in")
    rows.select("doc_id", "text").write.parquet(folder)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    screen.flag_batches(stream, held, out, state, "doc_id").awaitTermination()
    return spark.read.parquet(out).select("doc_id", "contaminated")


@query(f"SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text, sum(len({words('text')}))::BIGINT AS n FROM conversations GROUP BY conv_id")
def ordered_texts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    made = aggregates.ordered_text(turns, ["conv_id"], ["turn"], "text")
    return made.select("conv_id", F.md5("text").alias("text"), F.size(T.words(F.col("text"))).cast("long").alias("n"))
