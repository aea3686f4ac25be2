"""Stems: known words, whole tables against a plain reading, BM25 over stems against a plain BM25."""

import math
import unicodedata
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import stem
from tessera.functions.text import tokens
from test_queries import SF
from test_sizes import words_of_index

ENGLISH = """consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist
consistent:consist consistently:consist consolation:consol consolatory:consolatori console:consol consolidate:consolid consolingly:consol
conspicuously:conspicu conspiracy:conspiraci conspirators:conspir constables:constabl constancy:constanc knackeries:knackeri knavish:knavish
knees:knee knightly:knight knives:knive knocked:knock knotted:knot knuckles:knuckl generate:generat generically:generic generously:generous
communism:communism skies:sky dying:die news:news inning:inning exceeding:exceed ties:tie cries:cri gas:gas this:this gaps:gap kiwis:kiwi hopping:hop hoping:hope
luxuriated:luxuri sayings:say cry:cri by:by say:say enjoyment:enjoy relational:relat vietnamization:vietnam hopefulness:hope
apology:apolog rate:rate probate:probat controll:control fall:fall beautiful:beauti youth:youth agreed:agre feed:feed"""


@pytest.mark.parametrize("pair", ENGLISH.split())
def test_english(pair):
    word, want = pair.split(":")
    assert stem.english(word) == want


def test_romanian():
    for words in ("credit credite creditul creditului creditele", "student studenti studentul studentului", "ocol ocolea ocoleau ocoli ocolit", "casa case"):
        assert len({stem.romanian(w) for w in words.split()}) == 1, words
    assert [stem.romanian(w) for w in ("abilitate", "comunicabilitate", "activitate", "realist", "capitalisme", "frumoasa", "bani", "in", "a", "")] == \
        ["abil", "comunic", "activ", "realist", "capitalist", "frumoas", "ban", "in", "a", ""]
    assert [stem.romanian(w) for w in ("ploaie", "casei", "mobile", "portabile")] == ["ploai", "case", "mob", "portabil"]


def plain(text):
    folded = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    words = ("".join(c for c in w if c.isalnum()) for w in folded.split())
    return [stem.stem(w) for w in words if w]


def test_arrays(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Studenții, studentul: Running runs!")], "doc_id long, text string")
    got = {r[0]: r[1] for r in rows.select("doc_id", stem.stemmed_tokens(F.col("text"))).collect()}
    assert got == {1: None, 2: [], 3: plain("Studenții, studentul: Running runs!")}
    assert rows.limit(0).select(stem.stemmed_tokens(F.col("text"))).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(stem, "WORDS", 3)
    assert [stem._remembered(w) for w in "running runs cats dogs running".split()] == ["run", "run", "cat", "dog", "run"]
    assert len(stem._stems) <= 3


def test_bm25_over_stems(spark):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    df = Counter(t for ws in docs.values() for t in set(ws))
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    counts = {d: Counter(ws) for d, ws in docs.items()}
    want = {}
    for q, terms in asked.items():
        scores = {d: sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in terms if t in c) for d, c in counts.items()}
        want[q] = sorted((-round(s, 6) for s in scores.values() if round(s, 6) > 0))[:10]
    got: dict = {}
    for r in entry.queries()["bm25_topk_stemmed"](spark, SF).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(-r.score)
    assert got.keys() == {q for q, s in want.items() if s}
    assert all(a == pytest.approx(b, abs=2e-6) for q in got for a, b in zip(got[q], want[q], strict=True))


def test_stemmed_tokens_of_whole_table(spark):
    x = spark.read.parquet(f"{SF}/documents.parquet")
    for r in x.select("text", stem.stemmed_tokens(F.col("text")).alias("s"), tokens(F.col("text")).alias("t")).collect():
        assert r.s == plain(r.text) and len(r.s) == len(r.t)


def test_point_ids(spark):
    space = uuid.UUID("6f9b1d9e-2f4a-4c7e-9f1b-3a7c5d8e0f21")
    rows = entry.queries()["point_ids"](spark, SF).collect()
    assert rows and all(r.point_id == str(uuid.uuid5(space, r.chunk_id)) for r in rows)


def test_index_stems_distinct_words(spark):
    """Stems are made by the step that counts words, with no Python step before it, and count as `stemmed_tokens` has them."""
    plan, got, want = words_of_index(spark, stem.stemmed_tokens)
    assert "EvalPython" not in plan and got == want
