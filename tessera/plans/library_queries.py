"""Layout, sheets, the stored library, retrieval put together, review: driver queries and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stemmed_tokens
from ..operators import blocks, fusion, gold, layout, models, review, shelf
from ..sources import store
from . import retrieval
from .queries import BM, DENSE, _in, _lists, _read, _run_and_qrels, query

# Spans made of the documents' lines: a document is a page of its source; size, weight and place follow from the line.
SPAN_SQL = """sp AS (SELECT source, doc_id AS page, i, line AS text, 8 + length(line) % 6 AS size, i % 7 = 0 AS bold, (i % 10) / 10.0 AS x, (i + 0.5) / n AS y
FROM (SELECT source, doc_id, len(ls) AS n, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def _spans(spark, d):
    lines = F.split("text", "\n")
    x = _read(spark, d, "documents").select("source", F.col("doc_id").alias("page"), F.size(lines).alias("n"), F.posexplode(lines).alias("i", "text"))
    return x.select("source", "page", "i", F.lit(0).alias("block"), F.col("i").alias("line"), F.lit(0).alias("span"), "text", (8 + F.length("text") % 6).cast("double").alias("size"),
                    (F.col("i") % 7 == 0).alias("bold"), ((F.col("i") % 10) / 10.0).alias("x"), ((F.col("i") + 0.5) / F.col("n")).alias("y"))


@query(f"WITH {SPAN_SQL}, s AS (SELECT source, size, sum(length(trim(text, ' '))) AS chars FROM sp GROUP BY ALL) SELECT source, size::DOUBLE AS body FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chars DESC, size) AS r FROM s) WHERE r = 1")
def body_size(spark, d):
    return layout.body_size(_spans(spark, d))


@query(f"""WITH {SPAN_SQL}, s AS (SELECT source, size, sum(length(trim(text, ' '))) AS chars FROM sp GROUP BY ALL), b AS (SELECT source, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chars DESC, size) AS r FROM s) WHERE r = 1)
SELECT page, i::BIGINT AS i, size::DOUBLE AS size FROM (SELECT *, trim(text, ' ') AS t FROM sp JOIN b USING (source)) WHERE length(t) BETWEEN 2 AND 120 AND NOT regexp_matches(t, '^[0-9]+$') AND right(t, 1) NOT IN ('.', ',', ';', ':') AND (size >= body * 1.15 OR (bold AND size >= body))""")
def heading_lines(spark, d):
    x = _spans(spark, d)
    x = x.join(layout.body_size(x), "source")
    return x.where(layout.looks_like_heading(F.col("text"), F.col("size"), F.col("body"), F.col("bold"))).select("page", F.col("i").cast("long").alias("i"), "size")


TABLE_SQL = "tb AS (SELECT source, doc_id AS page, 0.15 AS x0, 0.25 + (doc_id % 3) / 10.0 AS y0, 0.55 AS x1, 0.75 AS y1 FROM documents WHERE doc_id % 2 = 0)"


@query(f"WITH {SPAN_SQL}, {TABLE_SQL} SELECT page, i::BIGINT AS line, md5(text) AS text_md5, y < 0.12 OR y > 0.88 AS margin FROM sp WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.page = sp.page AND tb.source = sp.source AND sp.x BETWEEN x0 AND x1 AND sp.y BETWEEN y0 AND y1)")
def page_lines_outside_tables(spark, d):
    """Lines of pages but those in a table's rectangle: a point-in-rectangle anti join."""
    tables = _read(spark, d, "documents").where("doc_id % 2 = 0").select("source", F.col("doc_id").alias("page"), F.lit(0.15).alias("x0"), (0.25 + (F.col("doc_id") % 3) / 10.0).alias("y0"), F.lit(0.55).alias("x1"), F.lit(0.75).alias("y1"))
    x = layout.page_lines(_spans(spark, d), tables)
    return x.select("page", F.col("line").cast("long").alias("line"), F.md5("text").alias("text_md5"), layout.in_margin(F.col("y")).alias("margin"))


@query(rf"""WITH {SPAN_SQL}, k AS (SELECT *, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS key, y < 0.12 OR y > 0.88 AS m FROM sp),
p AS (SELECT source, count(DISTINCT page) AS pages FROM k WHERE m GROUP BY source), r AS (SELECT source, key FROM (SELECT source, key, count(DISTINCT page) AS c FROM k WHERE m GROUP BY ALL) JOIN p USING (source) WHERE pages >= 3 AND c >= greatest(2, round_even(0.02 * pages, 0)))
SELECT page, count(*) AS lines FROM k WHERE NOT (m AND EXISTS (SELECT 1 FROM r WHERE r.source = k.source AND r.key = k.key)) GROUP BY page""")
def without_furniture(spark, d):
    return layout.without_furniture(_spans(spark, d), 0.02).groupBy("page").agg(F.count("*").alias("lines"))


CELLS = "ce AS (SELECT doc_id AS table_id, i // 4 AS row, i % 4 AS col, CASE WHEN length(w) % 5 < doc_id % 6 THEN '' ELSE w END AS text FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))"


@query(f"WITH {CELLS} SELECT table_id, count(DISTINCT row) AS rows, count(DISTINCT col) AS cols FROM ce GROUP BY table_id HAVING count(DISTINCT row) >= 2 AND count(DISTINCT col) >= 2 AND avg(CASE WHEN trim(text, ' ') = '' THEN 1.0 ELSE 0 END) <= 0.7 AND coalesce(avg(length(trim(text, ' '))) FILTER (trim(text, ' ') <> ''), 0) <= 40")
def real_tables(spark, d):
    x = _read(spark, d, "documents").select(F.col("doc_id").alias("table_id"), F.posexplode(F.split("text", " ")).alias("i", "w"))
    return layout.real_tables(x.select("table_id", F.floor(F.col("i") / 4).alias("row"), (F.col("i") % 4).alias("col"), F.when(F.length("w") % 5 < F.col("table_id") % 6, "").otherwise(F.col("w")).alias("text")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS quantity, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT::VARCHAR ELSE rtrim(rtrim(round(l_extendedprice, 4)::DECIMAL(18,4)::VARCHAR, '0'), '.') END AS price FROM lineitem")
def cell_texts(spark, d):
    x = _read(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", layout.cell_text(F.col("l_quantity")).alias("quantity"), layout.cell_text(F.round("l_extendedprice", 4)).alias("price"))


@query("SELECT source AS sheet, col::BIGINT AS col, least(greatest(max(CASE WHEN r < 200 THEN length(v) ELSE 0 END) + 2, 6), 40)::BIGINT AS width FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, unnest([0, 1, 2]) AS col, unnest([doc_id::VARCHAR, lang, substring(text, 1, doc_id % 60)]) AS v FROM documents) GROUP BY ALL")
def sheet_widths(spark, d):
    x = _read(spark, d, "documents").withColumn("row", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    cells = F.array(F.col("doc_id").cast("string"), "lang", F.expr("substring(text, 1, cast(doc_id % 60 as int))"))
    x = x.select(F.col("source").alias("sheet"), "row", F.posexplode(cells).alias("col", "text"))
    return layout.column_widths(x).select("sheet", F.col("col").cast("long").alias("col"), "width")


@query("SELECT n_nationkey AS sheet, n_nationkey + r AS row, 2 + c AS col, CASE WHEN n_nationkey * 40 + 2 + c < 26 THEN chr((65 + n_nationkey * 40 + 2 + c)::INT) WHEN n_nationkey * 40 + 2 + c < 702 THEN chr((64 + (n_nationkey * 40 + 2 + c) // 26)::INT) || chr((65 + (n_nationkey * 40 + 2 + c) % 26)::INT) ELSE chr((64 + ((n_nationkey * 40 + 2 + c) // 26 - 1) // 26)::INT) || chr((65 + ((n_nationkey * 40 + 2 + c) // 26 - 1) % 26)::INT) || chr((65 + (n_nationkey * 40 + 2 + c) % 26)::INT) END AS letters FROM nation, range(0, 10) x(r), range(0, 10) y(c) WHERE r < n_nationkey % 3 + 1 AND c < n_nationkey % 4 + 1 AND (r > 0 OR c > 0)")
def merged_cells(spark, d):
    m = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("sheet"), F.col("n_nationkey").cast("long").alias("row"), F.lit(2).alias("col"), (F.col("n_nationkey") % 3 + 1).alias("rows"), (F.col("n_nationkey") % 4 + 1).alias("cols"))
    return layout.hidden_cells(m).select("sheet", "row", F.col("col").cast("long").alias("col"), layout.column_letters((F.col("sheet") * 40 + F.col("col")).cast("int")).alias("letters"))


@query(rf"""SELECT source, CASE WHEN en > ro THEN 'en' ELSE 'ro' END AS language FROM (SELECT source, sum(len(list_filter(w, lambda x: x IN ({_in(T.STOPWORDS['ro'])})))) AS ro, sum(len(list_filter(w, lambda x: x IN ({_in(T.STOPWORDS['en'])})))) AS en
FROM (SELECT source, string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS w FROM documents) GROUP BY source)""")
def language_per_source(spark, d):
    return shelf.source_language(_read(spark, d, "documents").select("source", "text"))


def _library(spark, d):
    """A stored library of the documents: a folder made, a third of the files replaced, some removed, one folder deleted with its documents."""
    lib = shelf.Library(spark, f"{store.shared_folder(spark)}/library-{uuid.uuid4().hex}")
    x = _read(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), "doc_id", "text")
    chunks = lambda t: t.select(F.md5(F.concat("source", "text")).alias("chunk_id"), "source", "text", (F.col("doc_id") % 4).alias("page"))
    lib.create_folder("empty one")
    lib.add(chunks(x))
    lib.add(chunks(x.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))), replace=True)
    lib.remove([f"src1/{i}.txt" for i in range(0, 200)])
    lib.delete_folder("src2", with_documents=True)
    return lib


LIBRARY = "lb AS (SELECT source AS folder, source || '/' || doc_id::VARCHAR || '.txt' AS source, CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END AS text, doc_id % 4 AS page FROM documents WHERE source <> 'src2' AND NOT (source = 'src1' AND doc_id < 200))"


@query(rf"""WITH {LIBRARY}, g AS (SELECT source, CASE WHEN en > ro THEN 'en' ELSE 'ro' END AS language FROM (SELECT source, len(list_filter(w, lambda x: x IN ({_in(T.STOPWORDS['ro'])}))) AS ro, len(list_filter(w, lambda x: x IN ({_in(T.STOPWORDS['en'])}))) AS en
FROM (SELECT source, string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS w FROM lb))) SELECT source, folder, language, 1::BIGINT AS chunks, length(text)::BIGINT AS num_chars, page AS pages FROM lb JOIN g USING (source)""")
def library_documents(spark, d):
    return _library(spark, d).documents()


@query(f"WITH {LIBRARY} SELECT folder, count(*) AS documents, count(*) AS chunks FROM lb GROUP BY folder UNION ALL SELECT 'empty one', 0, 0")
def library_folders(spark, d):
    return _library(spark, d).folders()


SHARED = "len(list_intersect(list_distinct(string_split(lower(b.text), ' ')), list_distinct(string_split(lower(d.text), ' '))))"


@query(f"""WITH {BM}, {DENSE}, r AS (WITH {_lists(', lang', names=("'sparse:' || lang", "'dense:' || lang"), k=5).replace('pos <= 5', 'pos <= 20')}),
s AS (SELECT qid, id, pos AS fused, {SHARED}::DOUBLE AS rerank FROM r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.id)
SELECT qid, id, fused, rerank, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, fused) AS pos FROM s) WHERE pos <= 5""")
def retrieve_reranked(spark, d):
    """Retrieval put together: lists per language, fusion to 20 candidates, a reranker (shared words stand in for a model), the best five."""

    def make():
        return lambda pairs: [len(set(a.lower().split(" ")) & set(b.lower().split(" "))) for a, b in pairs]

    docs, _, questions, _ = retrieval.inputs(spark, d)
    fused = fusion.fuse(retrieval.rankings(spark, d, k=5, per_language=True), 20)
    hits = retrieval.with_documents(fused, docs.select("doc_id", "text")).join(questions.select("qid", F.col("text").alias("question")), "qid")
    return models.rerank(hits.select("qid", "id", "pos", "question", "text"), make, 5, "shared words").select("qid", "id", "fused", "rerank", "pos")


def _ranks(spark, d):
    run, qrels = _run_and_qrels(spark, d)
    ranks = run.join(qrels, ["qid", "did"], "left").groupBy("qid").agg(F.min(F.when(F.col("rel") == 1, F.col("pos"))).alias("rank"))
    return ranks.join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label"), "qid")


WILSON = "round(greatest(0, (f{k} / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(f{k} / n * (1 - f{k} / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low_{k}, round(least(1, (f{k} / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(f{k} / n * (1 - f{k} / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high_{k}"


@query(f"""WITH {DENSE}, top AS (SELECT * FROM (SELECT qid, vec_id AS did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS pos FROM dn WHERE vec_id <> qid) WHERE pos <= 10),
r AS (SELECT t.qid, a.label, min(CASE WHEN a.label = b.label THEN pos END) AS rank FROM top t JOIN embeddings a ON a.vec_id = t.qid JOIN embeddings b ON b.vec_id = t.did GROUP BY ALL),
g AS (SELECT label, grouping(label)::BIGINT AS overall, count(*) AS n, {', '.join(f'count(*) FILTER (rank <= {k}) AS f{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY GROUPING SETS ((label), ()))
SELECT label, overall, n, mrr, {', '.join(f'f{k} AS found_{k}' for k in (1, 3, 5, 10))}, {', '.join(WILSON.format(k=k) for k in (1, 3, 5, 10))} FROM g""")
def recall_summary(spark, d):
    return review.summary(_ranks(spark, d), "label")


REVIEW = "rv AS (SELECT conv_id % 3 <> 0 AS answerable, CASE WHEN turn % 5 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN (['refused', 'wrong'])[length(text) % 2 + 1] ELSE (['correct', 'partial', 'wrong', 'missed'])[length(text) % 4 + 1] END AS verdict, CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'refused' ELSE 'correct' END END AS proposed, length(text) % 3 AS gold FROM conversations WHERE text IS NOT NULL)"


def _reviews(spark, d):
    x = _read(spark, d, "conversations").where("text IS NOT NULL")
    return x.select("conv_id", "turn", *[F.expr(e).alias(n) for n, e in (("answerable", "conv_id % 3 <> 0"), ("gold", "length(text) % 3"),
        ("verdict", "CASE WHEN turn % 5 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN get(array('refused', 'wrong'), length(text) % 2) ELSE get(array('correct', 'partial', 'wrong', 'missed'), length(text) % 4) END"),
        ("proposed", "CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'refused' ELSE 'correct' END END"))])


@query(f"""WITH {REVIEW}, g AS (SELECT count(verdict) AS judged, count(*) - count(verdict) AS open, count(*) FILTER (answerable AND verdict IS NOT NULL) AS n, count(*) FILTER (answerable AND verdict = 'correct') AS correct, count(*) FILTER (answerable AND verdict IN ('correct', 'partial')) AS correct_or_partial,
count(*) FILTER (NOT answerable AND verdict = 'refused') AS refused, count(*) FILTER (NOT answerable AND verdict IS NOT NULL) AS unanswerable, count(*) FILTER (verdict IS NOT NULL AND proposed IS NOT NULL) AS proposed, count(*) FILTER (verdict = proposed) AS agreed FROM rv)
SELECT g.*, {WILSON.format(k='x').replace('fx', 'correct').replace('low_x', 'low').replace('high_x', 'high')} FROM g""")
def review_statistics(spark, d):
    return review.review_statistics(_reviews(spark, d))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 0 AND length(text) % 3 = 0 THEN 'an answerable question needs a quote' WHEN conv_id % 3 = 0 AND length(text) % 3 > 0 THEN 'an unanswerable question has no quote' WHEN conv_id % 3 = 0 AND v IN ('correct', 'partial', 'missed') OR conv_id % 3 <> 0 AND v = 'refused' THEN 'not a verdict of this kind' END AS problem
FROM (SELECT *, (['correct', 'refused', 'wrong'])[turn % 3 + 1] AS v FROM conversations WHERE text IS NOT NULL)""")
def review_problems(spark, d):
    x = _reviews(spark, d).withColumn("v", F.expr("get(array('correct', 'refused', 'wrong'), cast(turn % 3 as int))"))
    return x.select("conv_id", "turn", review.verdict_problem(F.col("answerable"), F.col("v"), F.col("gold")).alias("problem"))


@query("SELECT doc_id, md5(substring(text, greatest(0, s - 500) + 1, least(length(text), e + 500) - greatest(0, s - 500))) AS context_md5, (s - greatest(0, s - 500))::BIGINT AS mark_start, (e - greatest(0, s - 500))::BIGINT AS mark_end FROM (SELECT doc_id, text, length(text) // 2 AS s, least(length(text), length(text) // 2 + 40) AS e FROM documents)")
def gold_context(spark, d):
    x = _read(spark, d, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).alias("s")).withColumn("e", F.least(F.length("text"), F.col("s") + 40))
    context, a, b = review.gold_view(F.col("text"), F.col("s"), F.col("e"))
    return x.select("doc_id", F.md5(context).alias("context_md5"), a.cast("long").alias("mark_start"), b.cast("long").alias("mark_end"))


@query("""SELECT l.doc_id AS doc_id, item_id, CASE WHEN d.doc_id IS NULL THEN 'unknown source' ELSE 'quote not found' END AS problem FROM (SELECT item_id, text, item_id * 7 AS doc_id FROM benchmark) l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR NOT contains(d.text, l.text)""")
def gold_problems(spark, d):
    rows = _read(spark, d, "benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id"), F.col("text").alias("quote"))
    return gold.attach_spans(rows, _read(spark, d, "documents").select("doc_id", "text"))[1]


BLOCKS = "bl AS (SELECT doc_id, i, line AS text, CASE WHEN i % 5 = 1 THEN 1 ELSE 0 END AS level, 1 + length(line) % 3 AS page FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


def _blocks(spark, d):
    x = _read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return x.select("doc_id", "i", "text", F.when(F.col("i") % 5 == 1, 1).otherwise(0).alias("level"), (1 + F.length("text") % 3).alias("page"))


@query(f"WITH {BLOCKS}, s AS (SELECT *, sum(level) OVER (PARTITION BY doc_id ORDER BY i) AS slide FROM bl) SELECT doc_id, slide::BIGINT AS slide, count(*) AS blocks, md5(first(text ORDER BY i)) AS title_md5 FROM s WHERE slide > 0 GROUP BY doc_id, slide")
def slide_groups(spark, d):
    return review.slides(_blocks(spark, d)).groupBy("doc_id", F.col("slide").cast("long").alias("slide")).agg(F.count("*").alias("blocks"), F.md5(F.min_by("text", "i")).alias("title_md5"))


@query(f"WITH {BLOCKS}, s AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM bl) SELECT doc_id, count(*) FILTER (before IS NOT NULL AND before <> page) AS turns FROM s GROUP BY doc_id")
def page_turns(spark, d):
    return review.page_changes(_blocks(spark, d)).groupBy("doc_id").agg(F.count_if("turns").alias("turns"))


@query("SELECT source, median(n_chars)::DOUBLE AS median, quantile_cont(n_chars, 0.9) AS p90, (list_sort(list(n_chars)))[count(*) // 2 + 1] AS upper FROM documents GROUP BY source")
def length_percentiles(spark, d):
    x = _read(spark, d, "documents").groupBy("source")
    return x.agg(F.percentile("n_chars", 0.5).alias("median"), F.percentile("n_chars", 0.9).alias("p90"), review.upper_median(F.col("n_chars")).alias("upper"))


@query("""WITH RECURSIVE sp AS (SELECT doc_id, k, (doc_id * k * 37) % 200 AS a FROM documents, range(1, 8) t(k)), o AS (SELECT doc_id, a, a + 20 + a % 30 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY a, a + 20 + a % 30) AS r FROM sp),
f AS (SELECT doc_id, r, a, b, true AS shown, b AS last FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.r, o.a, o.b, o.a >= f.last, CASE WHEN o.a >= f.last THEN o.b ELSE f.last END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT doc_id, a::BIGINT AS start, b::BIGINT AS "end" FROM f WHERE shown""")
def highlight_marks(spark, d):
    x = _read(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"))
    start = (F.col("doc_id") * F.col("k") * 37) % 200
    return review.marks(x.select("doc_id", start.alias("start"), (start + 20 + start % 30).alias("end")))


MARKED = "CASE i % 9 WHEN 0 THEN '## ' || line WHEN 2 THEN '- ' || line WHEN 3 THEN '' WHEN 4 THEN '| a | ' || substring(line, 1, 9) || ' |' WHEN 5 THEN '|---|---|' ELSE line END"


@query(rf"""WITH l0 AS (SELECT doc_id, i, {MARKED} AS line FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
l AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS s, trim(line, ' ') AS t FROM l0),
k AS (SELECT *, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^#{{1,6}}\s') THEN 'h' WHEN t[1] = '|' THEN 'table' WHEN regexp_matches(t, '^([-*+]|[0-9]+[.)])\s') THEN 'li' ELSE 'p' END AS kind FROM l),
g AS (SELECT *, sum(CASE WHEN kind IN ('h', 'li') OR kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)),
b AS (SELECT doc_id, g, kind, min(s) AS s, max(s + length(line)) AS e, string_agg(t, ' ' ORDER BY i) AS t FROM g WHERE kind <> '' GROUP BY ALL HAVING kind <> 'table' OR bool_or(NOT contains(t, '---')))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS block, kind, s::BIGINT AS start, e::BIGINT AS "end", md5(CASE kind WHEN 'h' THEN regexp_replace(t, '^#+\s+', '') WHEN 'li' THEN regexp_replace(t, '^([-*+]|[0-9]+[.)])\s+', '') WHEN 'p' THEN t ELSE '' END) AS text_md5 FROM b""")
def text_blocks(spark, d):
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 9 == 0, F.concat(F.lit("## "), x)).when(i % 9 == 2, F.concat(F.lit("- "), x)).when(i % 9 == 3, "")
                         .when(i % 9 == 4, F.concat(F.lit("| a | "), F.substring(x, 1, 9), F.lit(" |"))).when(i % 9 == 5, "|---|---|").otherwise(x))
    x = blocks.parse_blocks(_read(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("text")))
    return x.select("doc_id", F.col("block").cast("long").alias("block"), "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("text_md5"))


@query()
def bm25_topk_stemmed(spark, d):
    """BM25 over stems: documents and questions folded and stemmed alike."""
    return retrieval.best(spark, d, 10, stemmed_tokens).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT chunk_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || CASE WHEN substring(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8'
WHEN substring(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substring(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id
FROM (SELECT *, sha1(unhex('{T.POINT_SPACE}') || encode(chunk_id)) AS h FROM (SELECT source || '#' || doc_id AS chunk_id FROM documents))""")
def point_ids(spark, d):
    return _read(spark, d, "documents").select(F.concat("source", F.lit("#"), F.col("doc_id").cast("string")).alias("chunk_id")).withColumn("point_id", T.point_id(F.col("chunk_id")))
