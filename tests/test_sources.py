from pyspark.sql import functions as F

from variora.functions import text as T
from variora.operators.alignment import gotoh
from variora.operators.order import passage_windows
from variora.sources import readers


def test_sparse_column(spark, tmp_path):
    (tmp_path / "lemma.tf").write_text("@node\n@valueType=str\n@x=y\n\na\nb\n\n7\tc\nd\n10-12\te\nf\n")
    rows = readers.sparse_column(spark, str(tmp_path)).orderBy("node").collect()
    assert [(r.node, r.value) for r in rows] == [(1, "a"), (2, "b"), (7, "c"), (8, "d"), (10, "e"), (11, "e"), (12, "e"), (13, "f")]


def test_conllu(spark, tmp_path):
    row = "1\tλόγος\tλόγος\tNOUN\tNb\tCase=Nom|Number=Sing\t_\troot\t_\t_"
    (tmp_path / "a.conllu").write_text(f"# sent_id = s1\n{row}\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n\n# sent_id = s2\n{row}")
    rows = readers.conllu(spark, str(tmp_path)).orderBy("sentence").collect()
    assert [r.metadata["sent_id"] for r in rows] == ["s1", "s2"]
    assert [len(r.tokens) for r in rows] == [1, 1]
    assert rows[0].tokens[0].feats == {"Case": "Nom", "Number": "Sing"} and rows[0].tokens[0].head == 0


def test_edition(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<book id="Mark"><p><verse-number id="Mark 1:1"/><w>Ἀρχὴ</w><suffix> </suffix><w>τοῦ</w><verse-number id="bad"/><w>x</w><verse-number id="Mark 1:2"/><w>y</w></p></book>')
    rows = readers.edition_xml(spark, str(tmp_path)).collect()
    assert [(r.chapter, r.verse, r.position, r.text) for r in rows] == [(1, 1, 0, "Ἀρχὴ"), (1, 1, 1, "τοῦ"), (1, 1, 2, "x"), (1, 2, 0, "y")]


def test_greek(spark):
    row = spark.range(1).select(T.alignment_key(F.lit(" Λόγος ")).alias("a"), T.dedup_key(F.lit("ΛΌΓΟΣ  ß")).alias("b"), T.uncial(F.lit("ἐν ἀρχῇ")).alias("c"), T.shingles(F.lit("a b"), 3).alias("d")).first()
    assert tuple(row) == ("λογοσ", "λογοσ ss", "ΕΝ ΑΡΧΗ", ["a b"])


def test_alignment():
    assert gotoh(list("abc"), list("ac")) == [(0, 0), (1, None), (2, 1)]


def test_windows(spark):
    rows = [("s", i, str(i), " ".join(["w"] * n)) for i, n in enumerate([100, 60, 250, 100, 10, 400])]
    made = passage_windows(spark.createDataFrame(rows, "source string, ord long, ref string, text string")).orderBy("window").collect()
    assert [(r.ref, r.n_words) for r in made] == [("0–1", 160), ("2", 250), ("3–4", 110), ("5", 400)]
