"""What grows with the input: rows shuffled, memory, results over many equal rows."""

import hashlib
import re
import tracemalloc
from collections import Counter
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, bm25, chunkers, layout, shelf
from tessera.plans import retrieval


def shuffled(spark, frame) -> int:
    """Rows that running a frame writes into shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = total()
    frame.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in total().items() if k not in before)


def plain_bm25(docs, asked):
    words = {d: t.split() for d, t in docs.items()}
    counts = {d: Counter(w) for d, w in words.items()}
    df = Counter(t for c in counts.values() for t in c)
    raw = {t: log(len(docs) - n + 0.5) - log(n + 0.5) for t, n in df.items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for t, x in raw.items()}
    mean = sum(map(len, words.values())) / len(docs)
    return {(q, d): round(sum(n * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(words[d]) / mean)) for t, n in Counter(text.split()).items() if t in c), 6)
            for q, text in asked.items() for d, c in counts.items()}


@pytest.mark.parametrize("cells", [bm25.CELLS, 4])
def test_bm25_shuffles_the_best_only(spark, monkeypatch, cells):
    monkeypatch.setattr(bm25, "CELLS", cells)
    docs = {i: " ".join(["same"] * (i % 3) + ["same common" if i % 5 else "other", f"w{i % 50}"] + ["pad"] * (i % 2)) for i in range(3000)}
    asked = {1: "same same w7", 2: "other common", 3: "nowhere", 4: "w7 w8 w9 other"}
    frame = spark.createDataFrame([(d, t, "ab"[d % 2]) for d, t in docs.items()], "doc_id long, text string, lang string").repartition(4)
    indexed = bm25.index(frame, keep=("lang",)).localCheckpoint()
    stats = bm25.term_stats(indexed).localCheckpoint()
    questions = spark.createDataFrame(list(asked.items()), "qid long, text string")
    scores = plain_bm25(docs, asked)

    def want(parts, allowed):
        groups = {}
        for (q, d), s in scores.items():
            if s > 0 and allowed(d):
                groups.setdefault((q, "ab"[d % 2] if parts else ""), []).append((-s, d))
        return {(q, d, -s, r + 1) for (q, _), x in groups.items() for r, (s, d) in enumerate(sorted(x)[:5])}

    near = lambda rows: {(r.qid, r.doc_id, round(r.score, 5), r["rank"]) for r in rows}
    coarse = lambda rows: {(q, d, round(s, 5), r) for q, d, s, r in rows}
    whole = bm25.top_k(indexed, questions, 5, stats=stats)
    assert shuffled(spark, whole) <= 4 * 5 * len(asked)
    assert near(whole.collect()) == coarse(want(False, lambda d: True))
    assert near(bm25.top_k(indexed, questions, 5, stats=stats, partition=["lang"], allowed=F.col("doc_id") % 7 > 1).collect()) == coarse(want(True, lambda d: d % 7 > 1))
    some = frame.where("doc_id % 7 > 1").select("doc_id", "lang")
    assert near(bm25.top_k(bm25.index(frame), questions, 5, partition=["lang"], allowed=some).collect()) == coarse(want(True, lambda d: d % 7 > 1))


def test_index_counts_in_order(spark):
    x = spark.createDataFrame([(1, "b a b"), (2, None), (3, " "), (4, "é e")], "doc_id long, text string")
    got = {r.doc_id: (r.dl, [tuple(t) for t in r.terms]) for r in bm25.index(x).collect()}
    assert got == {1: (3, [("a", 1), ("b", 2)]), 2: (None, []), 3: (0, []), 4: (2, [("e", 2)])}
    assert bm25.top_k(bm25.index(x.limit(0)), spark.createDataFrame([(1, "a")], "qid long, text string"), 3).collect() == []


def test_string_keys(spark):
    x = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z"), ("d", "u"), ("e", "v"), ("f", "r")], "chunk_id string, text string")
    got = bm25.top_k(bm25.index(x, key="chunk_id"), spark.createDataFrame([("q", "x")], "qid string, text string"), 1, key="chunk_id").collect()
    assert [(r.qid, r.chunk_id, r["rank"]) for r in got] == [("q", "a", 1)]


def test_answers_retrieve_once(spark):
    """Hits are made once, however often prompts are read."""
    made = spark.sparkContext.accumulator(0)

    def hit(batches):
        for b in batches:
            made.add(len(b))
            yield b

    hits = spark.createDataFrame([(1, 1, "s", "", 0, "text"), (2, 1, "s", "", 0, "text")], "qid long, n long, source string, heading string, page int, text string")
    questions = spark.createDataFrame([(1, "Is it?"), (2, "Was it?"), (3, "Who?")], "qid long, text string")
    got = answers.answer(questions, hits.mapInPandas(hit, hits.schema), lambda turns: "So [1]." if len(turns) > 2 else "So.").collect()
    assert {(r.qid, r.found, r.raw, r.first_raw) for r in got} == {(1, True, "So [1].", "So."), (2, True, "So [1].", "So."), (3, False, None, None)}
    assert made.value == 2


def test_texts_of_hits_are_not_shuffled(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(50)).alias("text")).repartition(4).localCheckpoint()
    hits = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 5, 1)], "qid long, id long, pos long").repartition(4).localCheckpoint()
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.with_documents(hits, docs)
        assert shuffled(spark, found) == 0 and sorted((r.qid, r.id, r.pos) for r in found.collect()) == [(1, 5, 1), (1, 7, 2), (2, 5, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)


def test_chunkers_read_a_text_once(spark):
    """The whole text goes to the tokenizer once, and the chunks of many documents make one batch."""
    calls, frames = [], []

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            frames.extend(run(iter([pd.DataFrame({"doc_id": range(300), "text": ["# A b\nOne two. Three four.\n## C\nfive"] * 299 + [None]})])))

    for strategy in ("structure", "fixed", "semantic"):
        calls.clear(), frames.clear()
        chunkers.chunk(Docs(), strategy, tokenizer=lambda t: calls.append(t) or chunkers.words(t), embed=chunkers.hashed_bag)
        assert len(calls) == 299 and len(frames) == 1 and set(frames[0]["doc_id"]) == set(range(299))


@pytest.mark.parametrize("line", ["", " ", "a", " a b c\x1cd\x85e　f \U0001f600​g\n", "\ud800 x"])
def test_words_are_runs_without_white_space(line):
    assert chunkers.words(line) == [m.span() for m in re.finditer(r"\S+", line)]
    assert chunkers.words("".join(map(chr, range(0xD000)))) == [m.span() for m in re.finditer(r"\S+", "".join(map(chr, range(0xD000))))]


def test_sections_of_odd_lines():
    text = "x\n  ~~~ \n# no\n~~~\n#no\n#  Yes ## \n\t```py\n## no\n~~~\n```\n####### no\n## Sub\r\n"
    assert [p for _, _, p in chunkers.sections(text)] == ["", "Yes", "Yes > Sub"]


def test_hashed_bag_remembers_a_bounded_number(monkeypatch):
    monkeypatch.setattr(chunkers, "REMEMBERED", 2)
    monkeypatch.setattr(chunkers, "_places", {})
    got = chunkers.hashed_bag(["A b c a", "", "d e f"], 16)
    want = np.zeros((3, 16))
    for i, t in enumerate(["a b c a", "", "d e f"]):
        for w in t.split():
            want[i, int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % 16] += 1
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)) and len(chunkers._places) <= 2


def test_library_tokenises_what_is_added_only(spark, tmp_path, monkeypatch):
    """Chunks that stay keep their BM25 rows; what a search finds is what a library made at once finds."""
    seen, whole = [], bm25.index
    monkeypatch.setattr(bm25, "index", lambda x, **more: seen.append(x.count()) or whole(x, **more))
    make = lambda rows: spark.createDataFrame(rows, shelf.CHUNKS)
    lib = shelf.Library(spark, str(tmp_path / "a"))
    lib.add(make([(f"c{i}", f"f{i % 2}/{i}.txt", f"word{i} shared" + " more" * (i % 3), 1) for i in range(20)]))
    lib.add(make([("n3", "f1/3.txt", "word3 new shared", 2)]), replace=True)
    lib.remove(["f0/4.txt"])
    lib.delete_folder("f0", with_documents=True)
    assert sum(seen) == 21
    other = shelf.Library(spark, str(tmp_path / "b"))
    other.add(lib.chunks())
    asked = spark.createDataFrame([(1, "word3 shared more"), (2, "word5 new"), (3, "word4 word0")], "qid long, text string")
    hits = [sorted(map(tuple, x.search(asked).collect())) for x in (lib, other)]
    assert hits[0] == hits[1] and hits[0] and lib.chunks().count() == 10
    with pytest.raises(ValueError, match="twice"):
        lib.add(make([("c1", "f1/99.txt", "again", 1)]))
    assert lib.chunks().count() == 10


def test_tables_are_counted_by_blocks(spark):
    """A row for each block of cells is shuffled, and the counts are those of distinct rows and columns."""
    cells = [(1, r, c, "x" * (r % 3)) for r in range(130) for c in range(70)] + [(2, 0, c, "a") for c in range(5)] + [(3, r, 0, "a") for r in range(5)]
    cells += [(4, r, c, "" if r + c else "a") for r in range(4) for c in range(4)] + [(5, r, c, "long " * 20) for r in range(2) for c in range(2)]
    cells += [(6, 0, 0, None), (6, 500, 900, "a"), (6, 500, 900, "a"), (6, None, 3, "a"), (7, -1, -70, "a"), (7, -65, 2, "b")]
    x = spark.createDataFrame(cells, "table_id long, row long, col int, text string").repartition(4, "table_id").localCheckpoint()
    found = layout.real_tables(x)
    assert {tuple(r) for r in found.collect()} == {(1, 130, 70), (6, 2, 3), (7, 2, 2)}
    assert shuffled(spark, layout.real_tables(x)) < 150


def test_composition_holds_few_texts(spark):
    """Python holds a few texts of a batch at a time, and composes as unicodedata does."""
    column = pa.array(["ș e\u0301 " * 500, None, ""] * 1500)
    tracemalloc.start()
    got = text._nfc.func(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000 and got.slice(4497).to_pylist() == ["ș é " * 500, None, ""] and len(got) == 4500
    rows = spark.createDataFrame([("q\u0307\u0323",), ("각",), (None,)], "text string")
    assert {r.c for r in rows.select(text._nfc("text").alias("c")).collect()} == {"q\u0323\u0307", "각", None}
    assert len(text._nfc.func(column.slice(0, 0))) == 0


ODD = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800)]))


def words_of_index(spark, words):
    """The plan of an index over odd letters and signs; its rows and the words counted one by one, by doc_id."""
    texts = ["", " ", None, "Țară țara\u0300 e\u0301É é-É \u0344 \u0385x", *(f"a{ODD[i : i + 97]}b {' x'.join(ODD[i : i + 97])}" for i in range(0, len(ODD), 97))]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    indexed = bm25.index(x, words=words)
    got = {r.doc_id: (r.dl, [tuple(t) for t in r.terms]) for r in indexed.collect()}
    want = {r.doc_id: (None, []) if r.w is None else (len(r.w), sorted(Counter(r.w).items(), key=lambda t: t[0].encode())) for r in x.select("doc_id", words(F.col("text")).alias("w")).collect()}
    return indexed._jdf.queryExecution().toString(), got, want


def test_index_folds_distinct_words(spark):
    """Spark splits texts in one pass; each distinct word is folded by the step that counts, and counts as `tokens` has it."""
    plan, got, want = words_of_index(spark, text.tokens)
    assert "translate(" not in plan and got == want


def test_words_are_prepared_once_for_chunks_counted_together():
    calls = []
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "_words": [["b", "a", "B"], None] * 1000})
    rows = [r for b in bm25._counted(lambda w: calls.extend(w) or pc.utf8_lower(w))(iter([batch])) for r in b.to_pylist()]
    assert len(calls) == 3 * 2 and rows[0] == {"doc_id": 0, "dl": 3, "terms": [{"term": "a", "tf": 1}, {"term": "b", "tf": 2}]} and rows[1]["dl"] is None and len(rows) == 2000
