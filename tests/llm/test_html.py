"""HTML extraction beside a plain reading of the tables' pages, and on pages written for one rule each."""

import html
import re

import duckdb
import numpy as np

from tessera.llm import html_extract as H

WORDS = "running text of an article that goes on for quite a while"


def reading(page: str) -> str:
    """The article's blocks by patterns: the tables' pages have no mark-up in articles but p, b, br and h1."""
    body = re.search(r"(?s)<article>(.*?)(</article>|$)", page or "")
    blocks = re.split(r"</?(?:p|h1|article|footer)\b[^>]*>", body.group(1)) if body else []
    texts = [" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", b) if "<" not in re.sub(r"</?(?:br|b)\s*/?>", "", b) else b).split()) for b in blocks]
    return "\n\n".join(t for t in (re.sub(r"</?b>", "", t) for t in texts) if t)


def test_pages_of_the_table():
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    same = sum(H.extract(p) == reading(p) for p in pages)
    assert same >= 0.98 * len(pages), (same, len(pages))
    hits = got = want = 0
    for p in pages:
        a, b = H.extract(p).split(), reading(p).split()
        hits += len(set(enumerate(a)) & set(enumerate(b)))
        got, want = got + len(a), want + len(b)
    assert hits >= 0.99 * max(got, want)


def test_ratios_decide(monkeypatch):
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    before = [H.extract(p) for p in pages]
    monkeypatch.setattr(H, "ratios", lambda rows: [1.0] * len(rows))
    assert sum(H.extract(p) != b for p, b in zip(pages, before)) > 0.9 * len(pages)


def test_all_regions_stay():
    a, b = f"First: {WORDS}.", f"Second: {WORDS}."
    assert H.extract(f"<article><p>{a}</p></article><article><p>{b}</p></article>") == f"{a}\n\n{b}"
    assert H.extract(f"<main><p>Short.</p></main><div><p>{WORDS * 4}</p><p>End.</p></div><footer>x</footer>") == f"Short.\n\n{WORDS * 4}\n\nEnd."
    assert H.extract(f"<div id=content><h1>T</h1><p>{WORDS}<p>b</div><div class='side-bar ad-slot'>{WORDS}</div>") == f"T\n\n{WORDS}\n\nb"


def test_names_of_parts():
    page = f"<article><h1>T</h1><p>{WORDS}</p>" + "".join(f"<div class='{c}'>{c} {WORDS}</div>" for c in ("notice-of-sale", "social-policy", "cookie-notice", "comment-list", "adSlot", "note"))
    assert re.findall(r"notice-of-sale|social-policy|cookie-notice|comment-list|adSlot|note", H.extract(page)) == ["notice-of-sale", "social-policy", "note"]


def test_links_alone():
    item = "<li><a href=x>{}</a></li>"
    few, many = "".join(map(item.format, "ab")), "".join(map(item.format, "abc"))
    for k, want in ((few, "a\n\nb\n\n"), (many, "")):
        assert H.extract(f"<article><p>{WORDS}</p><p><a href=y>One link</a></p><p>{WORDS}</p><ul>{k}</ul><p>End.</p></article>") == f"{WORDS}\n\nOne link\n\n{WORDS}\n\n{want}End."


def test_hostile_pages(spark):
    assert H.extract("<div>x" * 20_000).count("x") == 20_000
    assert H.extract("<p>" * 3 + "</b>" * 20_000 + f"{WORDS}&nbsp;&lt;b&gt;") == f"{WORDS} <b>"
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "<nav>x</nav>"), (3, "u", f"<p>{WORDS}")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = H.extracted(docs).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, None, 0), (1, None, 0), (2, "u", 0), (None, "u", 0), (3, "u", len(WORDS))]
    assert H.extracted(docs.limit(0)).count() == 0
    assert np.isclose(H.smooth([1.0, 1.0, 1.0]), 1).all()
