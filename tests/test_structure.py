"""Rules of structure, prompts, loading and streaming on small inputs."""

import io
import zipfile

import numpy as np
import pytest
from compare import differs, duck
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers, chunkers, library, metrics
from tessera.plans import more_queries
from tessera.sources import files, tables
from tessera.sources.html import load_html
from tessera.streaming import ingest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_sections_paths_and_fences():
    assert chunkers.sections("intro\n# A\nx\n## B\ny\n# C") == [(0, 6, ""), (6, 12, "A"), (12, 19, "A > B"), (19, 22, "C")]
    assert [s[2] for s in chunkers.sections("```\n# no\n```\n# yes\nx")] == ["", "yes"]
    assert chunkers.sections("") == []


@pytest.mark.parametrize("sizes,groups", [((200, 150, 100, 50), [(0, 350), (350, 500)]), ((200, 150, 40, 100), [(0, 390), (350, 490)])])
def test_pack(sizes, groups):
    units, at = [], 0
    for n in sizes:
        units.append((at * 2, (at + n) * 2))
        at += n
    size = chunkers.Ruler("w " * at)
    assert [(a // 2, b // 2) for a, b in chunkers.pack(units, size, 400, 60)] == groups


def test_windows():
    text = " ".join(["w"] * 760)
    assert [(a // 2, (b + 1) // 2) for a, b in chunkers.windows(text, 0, len(text), chunkers.words, 400, 60, 100)] == [(0, 400), (340, 760)]
    assert chunkers.windows("", 0, 0, chunkers.words, 400, 60, 100) == []


def test_sentences():
    text = "See art. 5 of it. J. Smith came. and left.\n\n- one\n- two"
    assert [text[a:b] for a, b in chunkers.sentences(text, 0, len(text))] == ["See art. 5 of it.", "J. Smith came. and left.", "- one", "- two"]


def test_structure_merges_and_splits():
    text = "# A\n\n## B\n" + "w " * 150 + "\n## C\n" + "v " * 900
    got = chunkers.by_structure(text)
    assert got[0][2] == "A > B" and all(g[2] == "A > C" for g in got[1:]) and len(got) >= 3
    size = chunkers.Ruler(text)
    assert all(size(a, b) <= 500 for a, b, _ in got)
    assert "".join(text[a:b] for a, b, _ in got).count("w ") >= 149


def test_semantic_cuts_between_topics(spark):
    text = " ".join("Apples grow on old trees in autumn gardens here. " for _ in range(20)) + " ".join("Ships cross wide seas under grey winter skies today. " for _ in range(20))
    d = chunkers.boundary_distances(text, chunkers.sentences(text, 0, len(text)), chunkers.hashed_bag)
    assert int(np.argmax(d)) == 19
    got = chunkers.chunk(spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "One. Two.")], "doc_id long, text string"), "semantic", embed=chunkers.hashed_bag).collect()
    assert {r.doc_id for r in got} == {1, 4}
    assert all(text[r.start_char:r.end_char].strip() == r.text for r in got if r.doc_id == 1)


def test_headings(spark):
    assert one(spark, T.mark_headings(F.lit("1. Only one\nplain text"))) == "1. Only one\nplain text"
    assert one(spark, T.mark_headings(F.lit("CAPITOLUL II\nArticolul 5\nends here."))) == "# CAPITOLUL II\n## Articolul 5\nends here."
    assert one(spark, T.clean_heading(F.lit("**2.1. Rules of entry**"))) == "Rules of entry"
    assert one(spark, T.usable_heading(F.lit("Rules for new students")))
    assert not one(spark, T.usable_heading(F.lit("Rules for 2024 students")))


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.lit("a­\r\nb  ﬁ\r\r\n\n\ncafé  \nş "))) == "ab  fi\n\ncafé\nș"
    assert one(spark, T.clean_text(F.lit("inter-\nnet  x"), from_pdf=True)) == "internet x"


def test_topics_drops_shared_headings(spark):
    rows = [(1, "Terms of student transport"), (2, "Top > Terms of student transport"), (2, "Top > Housing for visiting families"), (1, "**3. Meals during long courses**")]
    got = library.topics(spark.createDataFrame(rows, "doc_id long, heading_path string")).collect()
    assert {(r.doc_id, r.heading) for r in got} == {(2, "Housing for visiting families"), (1, "Meals during long courses")}


def test_answer_asks_again_once(spark):
    chat = lambda turns: ("Now cited [1, 7]." if len(turns) > 2 else {"a": "Bare.", "b": "NOT_FOUND", "c": "Fine [1]."}[turns[1]["content"][-1]])
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "qid long, text string")
    hits = spark.createDataFrame([(i, 1, "s", "", 0, "t") for i in (1, 2, 3)], "qid long, n int, source string, heading string, page int, text string")
    got = {r.qid: r for r in answers.answer(q, hits, chat).collect()}
    assert got[1].found and got[1].cited == [1] and got[1].invalid == [7] and got[1].first_raw == "Bare."
    assert got[2].refusal == "model" and got[3].found and got[3].first_raw is None
    assert got[4].refusal == "no_sources" and got[4].text == " / ".join(answers.MESSAGES.values())


def test_bootstrap(spark):
    v = spark.createDataFrame([("c", i, float(i % 2)) for i in range(200)], "config string, qid long, value double")
    r = metrics.bootstrap(v, "config", "value", "qid").first()
    assert r["mean"] == 0.5 and 0.41 < r["low"] < 0.45 and 0.55 < r["high"] < 0.59


def test_load_html():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Menu item {i}</a></li>" for i in range(6)) + "</ul>"
    page = f"<html><head><title>T &amp; U</title></head><body><nav>x</nav>{menu}<main><h2>Head</h2><p>Body  text<br>next</p><ul><li>one</li></ul>{menu}</main><footer>f</footer></body></html>"
    assert load_html(page) == ("T & U", "## Head\n\nBody text\n\nnext\n\n- one")
    assert load_html("") == (None, "") and load_html("<p>a") == (None, "a")


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_load_directory(spark, tmp_path):
    (tmp_path / "law").mkdir()
    (tmp_path / "law" / "a.txt").write_text("CHAPTER I\nplain words.\nCHAPTER II\nmore.")
    (tmp_path / "b.csv").write_text("a;b\n1;2\n")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "empty.md").write_text(" ")
    (tmp_path / "x.bin").write_bytes(b"?")
    (tmp_path / "c.docx").write_bytes(_zip(**{"word/document.xml": "<w:document xmlns:w='w'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>"}))
    (tmp_path / "d.xlsx").write_bytes(_zip(**{"xl/workbook.xml": "<w><sheets><sheet name='S'/></sheets></w>", "xl/sharedStrings.xml": "<s><si><t>k</t></si></s>", "xl/worksheets/sheet1.xml": "<w><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>5</v></c></row></w>"}))
    got = {r.source: r for r in files.load_directory(spark, str(tmp_path)).collect()}
    assert got["law/a.txt"].text.startswith("# CHAPTER I\nplain") and got["law/a.txt"].error is None
    assert got["b.csv"].text == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert got["bad.docx"].error.startswith("BadZipFile") and got["empty.md"].error == "no text" and "x.bin" not in got
    assert got["c.docx"].text == "# Head\n\nBody" and got["d.xlsx"].text == "# S\n\n| k | 5 |\n| --- | --- |"


def test_slides_and_delimiters():
    def slide(*shapes):
        return "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<p:sp><p:nvPr><p:ph type='{kind}'/></p:nvPr>{body}</p:sp>" for kind, body in shapes) + "</p:sld>"

    line = lambda t, lvl="0": f"<a:p><a:pPr lvl='{lvl}'/><a:r><a:t>{t}</a:t></a:r></a:p>"
    raw = _zip(**{"ppt/slides/slide2.xml": slide(("body", line("last"))), "ppt/slides/slide10.xml": slide(("body", line("ten"))),
                  "ppt/slides/slide1.xml": slide(("title", line("Head")), ("body", line("one") + line("in", "1"))), "ppt/notesSlides/notesSlide1.xml": slide(("body", line("say")))})
    assert files.PARSERS["pptx"][1](raw) == (None, "# Head\n\n- one\n  - in\n\nSpeaker notes: say\n\n# Slide 2\n\n- last\n\n# Slide 10\n\n- ten")
    assert files.decode("ș".encode("utf-16")) == "ș" and files.decode(b"\xba") == "ş"


def test_table_drops_empty_columns():
    assert files.table([["a", "", "b"], ["", "", "c"], ["d", None, ""]]) == "| a | b |\n| --- | --- |\n|  | c |\n| d |"


def test_qrels_and_jsonl(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1\n1\tb\t0\n")
    assert [tuple(r) for r in tables.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("1", "a", 1)]
    x = spark.createDataFrame([("1", "ș")], "doc_id string, text string")
    tables.write_jsonl(x, str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "doc_id string, text string").collect() == x.collect()


def test_stream_keeps_the_last_version(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for version in ("First text here.", "Second text, longer."):
        spark.createDataFrame([(1, version), (2, "Same.")] if version[0] == "F" else [(1, version)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(ingest.arrivals(spark, src, "doc_id long, text string"), out, ck, strategy="fixed").awaitTermination()
    got = {r.doc_id: r.text for r in ingest.current(spark, out).collect()}
    assert got == {1: "Second text, longer.", 2: "Same."}


def test_structure_query_chunks_every_character(spark, tmp_path):
    texts = {1: "one line " * 30, 2: "\n".join(f"line {i} " + "w" * 60 for i in range(40)), 3: "", 4: "\n\nafter blanks"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = {r.doc_id: r.text for r in more_queries._documents_with_sections(spark, str(tmp_path)).collect()}
    for k, text in texts.items():
        lines, got = text.split("\n"), iter(made[k].split("\n"))
        for i, line in enumerate(lines):
            if i % 4 == 0 or i % 16 == 1:
                assert next(got).lstrip("# ") == line[:40].lstrip("# ")
            assert next(got) == line
        assert next(got, None) is None
    covered = {k: bytearray(len(t)) for k, t in made.items()}
    for r in more_queries.chunk_structure(spark, str(tmp_path)).collect():
        covered[r.doc_id][r.start_char:r.end_char] = b"\1" * (r.end_char - r.start_char)
    assert all(c.isspace() or x for k, t in made.items() for c, x in zip(t, covered[k]))


def test_repeated_lines_query_reads_whole_texts(spark, tmp_path):
    rows = [(i, "s", f"own start {'abcdef'[i]}\n\nInner  line {i} of all\nown middle {'abcdef'[i]}\nLast line\n") for i in range(6)] + [(9, "few", "Last line")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.key): r.pages for r in more_queries.repeated_lines(spark, str(tmp_path)).collect()}
    assert got == {("s", "inner line # of all"): 6, ("s", "last line"): 6}
