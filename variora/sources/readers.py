"""Readers of text editions, treebanks and column files.

Line formats are read with ``read.text``, split as Spark splits files, and their lines numbered
within the file; documents that must be walked as trees (mixed-content XML) are read whole and
parsed by a Python UDF, one file a row.
"""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variora.functions.labels import BOOK_ABBREVIATIONS, BOOK_NUMBERS, register_of
from variora.functions.tags import lookup
from variora.functions.text import compact_tag, feats, is_greek, strip, words
from variora.operators.linking import numbered
from variora.storage import materialise

# Fixed values.
BOOK_STEMS = {"Matthew": "Matt", "Mark": "Mark", "Luke": "Luke", "John": "John"}
TOKEN_COLUMNS = ["token_id", "book", "chapter", "verse", "position", "text", "normalized", "lemma", "pos", "morph", "pericope_id", "is_punctuation"]
PERICOPE_COLUMNS = ["pericope_id", "tradition", "genre", "books"]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of each file as UTF-8, else as Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    utf8 = F.expr("try_validate_utf8(cast(content as string))")
    return raw.select(F.col("path").alias("file"), F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("content"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n, value): UTF-8 lines with their number from 0. A line's place in its split of the
    file is counted there; the splits of a file are added up."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), "value")
    own = F.row_number().over(Window.partitionBy("file", "_b").orderBy("_i")) - 1
    rows = raw.withColumn("_i", F.monotonically_increasing_id()).withColumn("n", own)
    sizes = raw.groupBy("file", "_b").count()
    before = F.sum("count").over(Window.partitionBy("file").orderBy("_b")) - F.col("count")  # one row a split
    return rows.join(sizes.withColumn("_before", before), ["file", "_b"]).select("file", (F.col("n") + F.col("_before")).cast("int").alias("n"), "value")


def dense_column(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, slot, value) of a column file: ``@`` header lines, one blank, one value a line; the
    last line end makes no value."""
    rows = lines(spark, path)
    head = rows.where("value = ''").groupBy("file").agg(F.min("n").alias("_head"))  # one row a file
    return rows.join(head, "file").where(F.col("n") > F.col("_head")).select("file", (F.col("n") - F.col("_head")).cast("int").alias("slot"), "value")


def sparse_column(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, node, value) of a sparse column file: ``value`` (the next node), ``n<tab>value`` or
    ``n1-n2<tab>value``. An empty value takes its node but stores nothing."""
    rows = dense_column(spark, path)
    tab = F.instr("value", "\t") > 0
    spec = F.when(tab, F.substring_index("value", "\t", 1))
    low, high = F.expr("cast(substring_index(_s, '-', 1) as int)"), F.expr("cast(substring_index(_s, '-', -1) as int)")
    rows = rows.withColumn("_s", spec).withColumn("_lo", low).withColumn("_hi", high).withColumn(
        "v", F.when(tab, F.expr("substr(value, instr(value, '\t') + 1)")).otherwise(F.col("value"))
    )
    w = Window.partitionBy("file").orderBy("slot")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.coalesce(F.last("_hi", ignorenulls=True).over(run), F.lit(0)))
    rows = rows.withColumn("_at", F.coalesce(F.last(F.when(F.col("_hi").isNotNull(), F.col("slot")), ignorenulls=True).over(run), F.lit(0)))
    own = F.col("_end") + F.col("slot") - F.col("_at")
    return rows.where("v <> ''").select(
        "file", F.explode(F.when(F.col("_lo").isNotNull(), F.sequence("_lo", "_hi")).otherwise(F.array(own))).alias("node"), F.col("v").alias("value")
    )


def slot_count(node_types: DataFrame) -> DataFrame:
    """One row (n): the nodes 1, 2, ... in a row that have node 1's type."""
    first = node_types.where("node = 1").select(F.col("value").alias("_t"))
    own = node_types.join(F.broadcast(first), F.col("value") == F.col("_t")).select("node")
    gap = own.join(own.select((F.col("node") - 1).alias("node")), "node", "left_anti")
    return gap.agg(F.coalesce(F.min("node"), F.lit(0)).alias("n"))


def zip_columns(columns: dict[str, DataFrame], words_column: str = "word") -> DataFrame:
    """slot and one column a name from dense columns (slot, value). Columns longer than the words'
    are cut to them; a shorter one is an error."""
    last = {name: c.agg(F.max("slot")).first()[0] or 0 for name, c in columns.items()}
    short = sorted(name for name, n in last.items() if n < last[words_column])
    if short:
        raise ValueError(f"columns shorter than {words_column}: {', '.join(short)}")
    sides = [c.select("slot", F.col("value").alias(name)) for name, c in columns.items() if name != words_column]
    return reduce(lambda left, right: left.join(right, "slot"), sides, columns[words_column].select("slot", F.col("value").alias(words_column)))


def verses_from_columns(slots: DataFrame, section: list[str] = ("book", "chapter", "verse")) -> DataFrame:
    """(ord, <section>, text): words of consecutive equal sections, in order; empty words go.
    slots: slot (1, 2, ... without gaps), word and the section columns.

    A section begins where the slot before has another one; the beginnings are numbered, and
    each section's slots are written out again, so that no task sees the whole text."""
    before = slots.select((F.col("slot") + 1).alias("slot"), F.struct(*section).alias("_before"))
    starts = slots.join(before, "slot", "left").where(~F.struct(*section).eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    starts = materialise(numbered(starts.select("slot"), ["slot"], "ord"), "sections").withColumn("ord", F.col("ord") + 1)
    following = starts.select((F.col("ord") - 1).alias("ord"), F.col("slot").alias("_next"))
    end = slots.agg((F.max("slot") + 1).alias("_end"))  # one row
    spans = starts.join(following, "ord", "left").join(F.broadcast(end)).withColumn("_stop", F.coalesce("_next", "_end"))
    of = spans.select("ord", F.explode(F.sequence("slot", F.col("_stop") - 1)).alias("slot"))
    items = F.array_sort(F.collect_list(F.when(F.col("word") != "", F.struct("slot", "word"))))
    made = slots.join(of, "slot").groupBy("ord", *section).agg(F.array_join(F.transform(items, lambda x: x["word"]), " ").alias("text"))
    return made.where("text <> ''")


def place_code(x: Column) -> Column:
    """struct(book, chapter, verse, position) of ``BBCCVV`` (position 0) or ``ABBR c:v/p`` (p from
    1); null where it is neither."""
    bare = strip(x)
    legacy = r"^(\S+)\s+(\d+):(\d+)(?:/(\d+))?$"
    of = lambda i: F.regexp_extract(bare, legacy, i)
    digits = F.struct(
        lookup(F.substring(bare, 1, 2), BOOK_NUMBERS, F.substring(bare, 1, 2)).alias("book"), F.substring(bare, 3, 2).cast("int").alias("chapter"),
        F.substring(bare, 5, 2).cast("int").alias("verse"), F.lit(0).alias("position"),
    )
    named = F.struct(
        lookup(F.upper(of(1)), BOOK_ABBREVIATIONS, of(1)).alias("book"), of(2).try_cast("int").alias("chapter"), of(3).try_cast("int").alias("verse"),
        F.coalesce(of(4).try_cast("int") - 1, F.lit(0)).alias("position"),
    )
    return F.when(bare.rlike("^[0-9]{6}$"), digits).when(bare.rlike(legacy), named)


def morphology_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, book, chapter, verse, position, pos, parsing, text, word, normalized, lemma) of lines
    of seven columns parted by white space; comments and bad places are left out. A place is
    ``BBCCVV``, or ``ABBR c:v/p`` with the place's two parts as columns of their own. A verse's
    words are counted in file order unless the place says where a word stands."""
    rows = lines(spark, path).withColumn("c", words(F.col("value"))).where("size(c) >= 7 and not value like '#%'")
    one, other = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    two = other.rlike(r"^\d+:\d+(/\d+)?$")
    code = place_code(F.when(two, F.concat_ws(" ", one, other)).otherwise(one))
    rest = F.when(two, F.slice("c", F.lit(3), F.size("c"))).otherwise(F.slice("c", F.lit(2), F.size("c")))
    rows = rows.withColumns({"_at": code, "_c": rest}).where("_at is not null and size(_c) >= 6")
    names = ("pos", "parsing", "text", "word", "normalized", "lemma")
    rows = rows.select("file", "n", "_at.*", *[F.get("_c", F.lit(i)).alias(x) for i, x in enumerate(names)], two.alias("_own"))
    count = F.row_number().over(Window.partitionBy("file", "book", "chapter", "verse").orderBy("n")) - 1
    return rows.withColumn("position", F.when(F.col("_own"), F.col("position")).otherwise(count)).select("file", "book", "chapter", "verse", "position", *names)


def verse_keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``morphology_lines`` as training rows: key (file, book, chapter, verse), position, form
    without signs at its end, pos and the compact tag of pos and parsing."""
    rows = morphology_lines(spark, path)
    key = F.concat_ws(".", F.element_at(F.split("file", "/"), -1), "book", F.col("chapter").cast("string"), F.col("verse").cast("string"))
    form = F.rtrim(F.col("normalized"), F.lit(",.:;·!?()"))
    return rows.select(
        key.alias("key"), "position", form.alias("form"), "pos", "lemma", compact_tag(F.concat("pos", "parsing")).alias("morph")
    ).where("form <> ''")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, metadata MAP, tokens ARRAY) of CoNLL-U files; a blank line or the end of
    the file ends a sentence; multiword and empty nodes are left out; head ``_`` is 0."""
    blocks = whole_files(spark, path).select("file", F.posexplode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), r"\n\s*\n")).alias("sentence", "block"))
    rows = blocks.withColumn("l", F.filter(F.split("block", "\n"), lambda x: F.trim(x) != ""))
    meta = F.filter("l", lambda x: x.rlike(r"^#.*="))
    pairs = F.transform(
        meta,
        lambda x: F.struct(F.trim(F.regexp_extract(x, r"^#\s*([^=]*)=", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^#[^=]*=(.*)$", 1)).alias("v"))
    )
    cells = F.filter(F.transform(F.filter("l", lambda x: ~x.startswith("#")), lambda x: F.split(x, "\t")), lambda c: (F.size(c) == 10) & ~c[0].rlike("[-.]"))
    token = F.transform(cells, lambda c: F.struct(
        c[0].cast("int").alias("id"), c[1].alias("form"), c[2].alias("lemma"), c[3].alias("upos"), c[4].alias("xpos"), feats(c[5]).alias("feats"),
        F.coalesce(F.expr("null").cast("int"), F.when(c[6] == "_", 0).otherwise(c[6].cast("int"))).alias("head"), c[7].alias("deprel")))
    return rows.select("file", "sentence", F.map_from_entries(pairs).alias("metadata"), token.alias("tokens")).where("size(tokens) > 0")


def conllu_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, source, tokens ARRAY<struct(form, lemma, xpos)>): what training reads."""
    rows = conllu(spark, path)
    short = F.transform("tokens", lambda t: F.struct(t["form"].alias("form"), t["lemma"].alias("lemma"), t["xpos"].alias("xpos")))
    return rows.select("file", "sentence", F.coalesce(F.col("metadata")["source"], F.lit("")).alias("source"), short.alias("tokens"))


def _walk_edition(content: str) -> list[tuple]:
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    out, chapter, verse, position, ref = [], 0, 0, 0, None
    for node in root.iter():
        if node.tag == "verse-number":
            ref = (node.get("id") or "").rpartition(" ")[2]
            a, _, b = ref.partition(":")
            if a.isdigit() and b.isdigit():
                chapter, verse, position = int(a), int(b), 0
        elif node.tag == "w":
            out.append((root.get("id") or "", chapter, verse, position, (node.text or "").strip()))
            position += 1
    return out


def edition_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, book, chapter, verse, position, text) of editions marked up word by word, one
    book a file. A bad verse reference keeps the one before; a file that can't be parsed is
    left out."""
    walk = F.udf(_walk_edition, "array<struct<book:string,chapter:int,verse:int,position:int,text:string>>")
    return whole_files(spark, path).select("file", F.explode(walk("content")).alias("t")).select("file", "t.*")


def _body_text(content: str) -> str:
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return ""
    body = next((x for x in root.iter() if x.tag.rpartition("}")[2] == "body"), root)
    return " ".join("".join(body.itertext()).split())


def _first_words(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first ``most`` rows of all in order: numbered by parts, not in one task."""
    return rows if most is None else numbered(rows, order, "_at").where(F.col("_at") < most).drop("_at")


def tei_words(spark: SparkSession, path: str, most: int | None = 350_000) -> DataFrame:
    """(file, position, word) of the text under ``body``; ``most``: words of the corpus that stay,
    files in the order of their names."""
    text = F.udf(_body_text, "string")
    rows = whole_files(spark, path).select("file", F.posexplode(words(text("content"))).alias("position", "word"))
    return _first_words(rows, ["file", "position"], most)


def plain_words(spark: SparkSession, path: str, most: int | None = None, only: list[str] = (), skip: list[str] = ("readme", "license", "notes")) -> DataFrame:
    """(file, position, word) of plain texts, UTF-8 or else Latin-1. ``only``: files whose stem holds
    one of these; ``skip``: files whose name holds one are left out; ``most``: words that stay."""
    rows = whole_files(spark, path)
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    rows = rows.where(name.endswith(".txt") & ~name.rlike("|".join(skip) or "$^"))
    if only:
        rows = rows.where(F.regexp_replace(name, r"\.[^.]*$", "").rlike("|".join(x.lower() for x in only)))
    return _first_words(rows.select("file", F.posexplode(words(F.col("content"))).alias("position", "word")), ["file", "position"], most)


def _element_texts(content: str) -> list[str]:
    try:
        return [t for x in ET.fromstring(content).iter() if len(t := (x.text or "").strip()) > 3]
    except ET.ParseError:
        return []


def text_chunks(
    spark: SparkSession, path: str, exclude: list[str] = (), skip: list[str] = ("README", "LICENSE", "NOTES", "Makefile", "makefile", "Pipfile")
) -> DataFrame:
    """(file, n, chunk): Greek text of a folder of editions. XML and TEI: every element's text of
    more than 3 characters; column files: values after ``=`` of more than 20 characters in lines
    of more than 10; plain text: sentences of more than 20 characters. The latter two are cut at
    500. Files whose name holds a word of ``skip``, or whose stem is in ``exclude``, are left out."""
    rows = whole_files(spark, path)
    name = F.element_at(F.split("file", "/"), -1)
    kind, stem = F.regexp_extract(name, r"\.([^.]*)$", 1), F.regexp_replace(name, r"\.[^.]*$", "")
    rows = rows.where(~name.rlike("|".join(skip)) & ~stem.isin(*exclude) if exclude else ~name.rlike("|".join(skip)))
    xml = F.udf(_element_texts, "array<string>")
    cut = lambda parts: F.transform(F.filter(parts, lambda x: F.length(x) > 20), lambda x: F.substring(x, 1, 500))
    fields = F.filter(F.split("content", r"\r\n|\r|\n"), lambda x: x.contains("=") & (F.length(x) > 10))
    values = F.transform(fields, lambda x: F.btrim(F.btrim(strip(F.regexp_replace(x, r"^[^=]*=", "")), F.lit('"')), F.lit("'")))
    sentences = F.transform(F.split("content", r"(?<=[.;·])\s+"), strip)
    chunks = F.when(kind.isin("xml", "tei"), xml("content")).when(kind == "tf", cut(values)).when(kind == "txt", cut(sentences))
    return rows.select("file", F.posexplode(chunks).alias("n", "chunk")).where(is_greek(F.col("chunk")))


def sentence_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``text_chunks`` of plain texts alone."""
    return text_chunks(spark, path).where(F.col("file").endswith(".txt"))


def control_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """The first ``most`` chunks, files in the order of their names."""
    return chunks.orderBy("file", "n").limit(most)


def first_chunks(chunks: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` chunks of each book."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy("n"))
    return chunks.withColumn("_r", nth).where(F.col("_r") <= most).drop("_r")


def raw_passages(sources: dict[str, DataFrame], register: dict[str, str]) -> DataFrame:
    """(ord, text, source, register, ref): the passages (n, ref, text) of all sources in reading
    order, sources in the order given."""
    out = None
    for i, (name, rows) in enumerate(sources.items()):
        part = rows.select(F.lit(i).alias("_s"), "n", "ref", "text", F.lit(name).alias("source"), F.lit(register.get(name, "classical")).alias("register"))
        out = part if out is None else out.unionAll(part)
    return numbered(out, ["_s", "n"], "ord").select("ord", "text", "source", "register", "ref")


def excluded_stems(books: list[str], stems: dict[str, str] = BOOK_STEMS) -> list[str]:
    """The stems of the files that hold some books; an unknown book is its own stem."""
    return sorted({stems.get(b, b) for b in books})


class Features:
    """A folder of sparse column files, each read when it is asked for and no other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.tf").load(path).select("path")
        self.names = sorted(r[0].rsplit("/", 1)[-1].removesuffix(".tf") for r in listing.collect())  # one row a file

    def has(self, name: str) -> bool:
        return name in self.names

    def column(self, name: str) -> DataFrame:
        """(node, value); empty for a feature that the folder lacks."""
        if not self.has(name):
            return self.spark.createDataFrame([], "node int, value string")
        return sparse_column(self.spark, f"{self.path}/{name}.tf").select("node", "value")

    def columns(self, names: list[str]) -> DataFrame:
        """node and one column a name, null where a node has no value: one scan of these files."""
        paths = [f"{self.path}/{n}.tf" for n in names if self.has(n)]
        rows = sparse_column(self.spark, paths).withColumn("_f", F.regexp_extract("file", r"([^/]*)\.tf$", 1))
        return rows.groupBy("node").agg(*[F.max(F.when(F.col("_f") == n, F.col("value"))).alias(n) for n in names])

    def first_present(self, names: tuple[str, ...]) -> str:
        """The first of the names that is there, else the first."""
        return next((n for n in names if self.has(n)), names[0] if names else "")


def corpus_from_parquet(spark: SparkSession, tokens: str, pericopes: str) -> tuple[DataFrame, DataFrame]:
    books = "array<string>"
    table = require_columns(spark.read.parquet(pericopes), PERICOPE_COLUMNS)
    if table.schema["books"].dataType.simpleString() == "string":
        table = table.withColumn("books", F.from_json("books", books))
    return require_columns(spark.read.parquet(tokens), TOKEN_COLUMNS), table


def corpus_with_side_files(spark: SparkSession, tokens: str, pericopes: str, alignments: str | None = None, splits: str | None = None) -> dict[str, DataFrame]:
    """tokens, pericopes and, where given, alignments (pericope_id, book_a, book_b, pairs) from a
    JSON object with keys ``id|a|b`` and splits (pericope_id, split) from one of lists by split."""
    made = dict(zip(("tokens", "pericopes"), corpus_from_parquet(spark, tokens, pericopes)))
    if alignments:
        entries = json_object(spark, alignments, "map<string,array<array<int>>>")
        part = lambda i: F.split("key", r"\|")[i]
        pairs = F.transform("value", lambda p: F.struct(p[0].alias("idx_a"), p[1].alias("idx_b")))
        made["alignments"] = entries.select(part(0).alias("pericope_id"), part(1).alias("book_a"), part(2).alias("book_b"), pairs.alias("pairs"))
    if splits:
        lists = json_object(spark, splits, "map<string,array<string>>")
        made["splits"] = lists.select(F.explode("value").alias("pericope_id"), F.regexp_replace("key", "_ids$", "").alias("split"))
    return made


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, value) of one JSON object, plain or gzipped."""
    return inflated(spark, path).select(F.explode(F.from_json("content", schema)).alias("key", "value"))


def inflated(spark: SparkSession, path: str) -> DataFrame:
    """(content): whole files as text, those that begin as gzip does unpacked."""
    unpack = F.udf(lambda raw: (gzip.decompress(bytes(raw)) if bytes(raw[:2]) == b"\x1f\x8b" else bytes(raw)).decode(), "string")
    return spark.read.format("binaryFile").load(path).select(unpack("content").alias("content"))


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (task, ..., source, register), the register taken from the source if missing."""
    rows = spark.read.json(path)
    if "register" not in rows.columns:
        rows = rows.withColumn("register", F.lit(None).cast("string"))
    return rows.withColumn("register", F.coalesce("register", register_of(F.col("source"))))


def reader_index(spark: SparkSession, path: str) -> DataFrame:
    """(book, book_number, chapter, verse, position, surface, lemma, pos, features, gloss, strong,
    after) of an index document (``sinks.index_document``), plain or gzipped."""
    word = "array<string>"
    schema = f"schema int, name string, book_order array<string>, books map<string,map<string,map<string,array<{word}>>>>"
    doc = inflated(spark, path).select(F.from_json("content", schema).alias("d")).select("d.*")
    rows = doc.select("book_order", F.explode("books").alias("book", "c")).select("book_order", "book", F.explode("c").alias("chapter", "v"))
    rows = rows.select("book_order", "book", F.col("chapter").cast("int").alias("chapter"), F.explode("v").alias("verse", "w"))
    rows = rows.select(
        "book", (F.array_position("book_order", F.col("book")) - 1).cast("int").alias("book_number"), "chapter", F.col("verse").cast("int").alias("verse"),
        F.posexplode("w").alias("position", "w"),
    )
    names = ("surface", "lemma", "pos", "features", "gloss", "strong", "after")
    rows = rows.select("book", "book_number", "chapter", "verse", "position", *[F.col("w")[i].alias(n) for i, n in enumerate(names)])
    return rows.withColumn("features", F.from_json("features", "map<string,string>"))
