"""The stored library, model plug points, blocks, division lines and tables on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers, blocks, library, models, shelf
from tessera.sources import store


def test_library(spark, tmp_path):
    lib = shelf.Library(spark, str(tmp_path / "lib"))
    rows = spark.createDataFrame([("1", "a/x.txt", "the cat and the dog", 1), ("2", "a/x.txt", "of the house", 2), ("3", "b/y.md", "pisica și casa", None)], shelf.CHUNKS)
    assert lib.create_folder(" new ") == "new" and lib.add(rows) == {"chunks": 3, "replaced": 0}
    for bad in (lambda: lib.add(rows), lambda: lib.create_folder("NEW")):
        with pytest.raises(FileExistsError):
            bad()
    with pytest.raises(ValueError):
        lib.create_folder("abc.")
    with pytest.raises(ValueError):
        lib.delete_folder("a")
    with pytest.raises(KeyError):
        lib.scope("none")
    assert {r.source: (r.language, r.chunks, r.pages) for r in lib.documents().collect()} == {"a/x.txt": ("en", 2, 2), "b/y.md": ("ro", 1, 0)}
    asked = spark.createDataFrame([(1, "cat casa")], "qid long, text string")
    assert {r.chunk_id for r in lib.search(asked).collect()} == {"1", "3"} and lib.search(asked, folder="new").count() == 0
    assert lib.add(rows.where("source = 'b/y.md'"), replace=True)["replaced"] == 1 and lib.remove(["b/y.md", "b/y.md"]) == 1 and lib.remove([]) == 0
    assert lib.delete_folder("a", with_documents=True) == 1 and lib.delete_folder("new") == 0 and lib.folders().count() == 0
    with pytest.raises(ValueError):
        store.load(spark, lib.path, "another model")


def test_models(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    make = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = {r.id: r.embedding for r in models.embed_queries(rows, make, "lengths").collect()}
    assert np.allclose(got[1], np.array([10, 1]) / np.hypot(10, 1)) and np.allclose(np.linalg.norm(got[2]), 1)
    assert models.embed_passages(rows, make, "lengths").where("id = 1").first().embedding[0] > got[1][0]
    with pytest.raises(ValueError):
        models.check_mode("fast")


def test_blocks(spark):
    text = "intro\ngoes on\n# H one\n|---|\n| a | b |\n|---|---|\n| c | |\nafter\n\n- item\n2) two"
    got = blocks.parse_blocks(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).orderBy("block").collect()
    assert [(r.kind, r.level, r.text, text[r.start:r.end].split("\n")[0]) for r in got] == [
        ("p", None, "intro goes on", "intro"), ("h", 1, "H one", "# H one"), ("table", None, "", "| a | b |"), ("p", None, "after", "after"), ("li", None, "item", "- item"), ("li", None, "two", "2) two")]
    assert [list(r) for r in got[2].rows] == [["a", "b"], ["c", ""]]


def test_keyword_levels(spark):
    lines = ["Chapter I", "Section 1", "Section 3", "see Section 9", "Section 2", "section 4", "Chapter II", "Section 1", "Annex 1", "Section 2", "Chapter II"]
    got = spark.range(1).select(blocks.keyword_levels(F.array(*map(F.lit, lines)))).first()[0]
    assert [(r.i, r.level) for r in got] == [(0, 1), (1, 2), (2, 2), (6, 1), (7, 2), (8, 1), (9, 2)]


def test_table_lines():
    assert blocks.table_lines([["Name", "Money", "", "Year"], ["", "own", "lent", ""], ["A", "x", "-", "1"], ["B", "", "y", "2"]]) == [
        "| Name | Money – own | Money – lent | Year |", "| Name: A | Money – own: x | Money – lent: - | Year: 1 |", "| Name: B | Money – lent: y | Year: 2 |"]
    assert blocks.table_lines([["Cup", ""], ["first", "60"], ["", ""], ["second", "40 %"], ["Notes:", ""], ["third", "5"]]) == [
        "| Cup |", "| Cup | first | 60 |", "| Cup | second | 40 % |", "| Notes: |", "| third | 5 |"]


def test_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.roman_number(F.lit(x))) for x in ("VIX", "12", "MCMXCIV")] == [14, 12, 1994]
    assert one(T.fold(F.lit("Việt ĂȘ ß Ё"))) == "viet as ß е" and one(T.norm(F.lit("\u00a0A\u2003b "))) == "a b"
    assert one(answers.refusal(F.lit(" \n\t"), F.array(F.lit(1)))) == "model"
    assert [one(library.folder_name_ok(F.lit(x))) for x in ("abc", "abc.", "con", " é-1 ")] == [True, False, False, True]
    assert [one(library.file_name_ok(F.lit(x), shelf.KINDS)) for x in (r"C:\a\b.PDF", "../x/.txt", "nul.txt", "a.exe", "a.txt")] == [True, False, False, False, True]
