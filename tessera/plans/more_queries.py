"""Structure, prompts, evaluation and loading: driver queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, chunkers, chunking, gold, library, metrics
from ..sources.html import load_html
from . import retrieval
from .queries import BM, CH, DENSE, _lists, _read, _run_and_qrels, query

RELEVANCE = """WITH qv AS (SELECT item_id AS qid, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id),
dn AS (SELECT qid, vec_id, round(list_dot_product(embedding::DOUBLE[], qvec::DOUBLE[]), 6) AS score FROM embeddings JOIN documents ON vec_id = doc_id CROSS JOIN qv),
top AS (SELECT * FROM (SELECT qid, vec_id AS did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS pos FROM dn WHERE vec_id <> qid) WHERE pos <= 10),
rel AS (SELECT q.vec_id AS qid, e.vec_id AS did FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id JOIN documents ON e.vec_id = doc_id WHERE q.vec_id IN (SELECT qid FROM qv)),
sc AS (SELECT r.qid, count(*) AS n, count(CASE WHEN pos <= 5 THEN 1 END) AS f5, count(CASE WHEN pos <= 10 THEN 1 END) AS f10, min(pos) AS first FROM rel r LEFT JOIN top t ON r.qid = t.qid AND r.did = t.did GROUP BY r.qid)"""


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), chr(160), ' '), 'ﬁ', 'fi'), 'œ', 'oe'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS text_md5 FROM documents""")
def clean_text_core(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("text_md5"))


HEADED = "'## Part ' || (doc_id % 3)::VARCHAR || chr(10) || text"


@query(f"SELECT doc_id, md5('Top' || CASE WHEN doc_id % 2 = 1 THEN ' > Part 1' ELSE '' END || chr(10) || chr(10) || {HEADED}) AS text_md5 FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0 UNION ALL SELECT doc_id, md5('Top' || chr(10) || chr(10) || {HEADED}) FROM documents WHERE doc_id % 3 = 1 AND doc_id % 2 = 1")
def embedding_text(spark, d):
    """A heading path whose second part, "Part 1" of odd documents, is in the text of some."""
    x = _read(spark, d, "documents").withColumn("body", F.concat(F.lit("## Part "), (F.col("doc_id") % 3).cast("string"), F.lit("\n"), "text"))
    path = F.when(F.col("doc_id") % 2 == 1, "Top > Part 1").otherwise("Top")
    return x.select("doc_id", F.md5(T.embedding_text(F.col("body"), path)).alias("text_md5"))


@query("SELECT source, n_chars % 17 AS size, least(dense_rank() OVER (PARTITION BY source ORDER BY n_chars % 17 DESC), 6) AS level FROM (SELECT DISTINCT source, n_chars % 17 AS n_chars FROM documents)")
def level_map_sizes(spark, d):
    """Font sizes of a document to heading levels: distinct sizes first, so a window holds few rows."""
    sizes = _read(spark, d, "documents").select("source", (F.col("n_chars") % 17).alias("size")).distinct()
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy(F.desc("size")))
    return sizes.select("source", "size", F.least(rank, F.lit(6)).cast("long").alias("level"))


DIVIDED = "'Chapter ' || (doc_id % 9 + 1)::VARCHAR || chr(10) || '1.' || (doc_id % 4)::VARCHAR || ' Scope' || chr(10) || '2. Terms' || chr(10) || 'GENERAL RULES' || chr(10) || 'It ends here.'"


@query(f"SELECT doc_id, '# Chapter ' || (doc_id % 9 + 1)::VARCHAR || chr(10) || '### 1.' || (doc_id % 4)::VARCHAR || ' Scope' || chr(10) || '## 2. Terms' || chr(10) || '#### GENERAL RULES' || chr(10) || 'It ends here.' AS marked FROM documents")
def pattern_headings(spark, d):
    x = _read(spark, d, "documents").select("doc_id", F.expr("concat('Chapter ', doc_id % 9 + 1, '\n1.', doc_id % 4, ' Scope\n2. Terms\nGENERAL RULES\nIt ends here.')").alias("text"))
    return x.select("doc_id", T.mark_headings(F.col("text")).alias("marked"))


@query(r"""WITH l AS (SELECT source, page, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS key FROM (SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents)),
p AS (SELECT source, count(DISTINCT page) AS pages FROM l GROUP BY source) SELECT source, key, count(DISTINCT page) AS pages FROM l WHERE key <> '' GROUP BY source, key
HAVING count(DISTINCT page) >= (SELECT greatest(2, round_even(0.06 * p.pages, 0)) FROM p WHERE p.source = l.source AND p.pages >= 3)""")
def repeated_lines(spark, d):
    """Lines of whole texts that recur over a source's documents (its pages); the share is lower here, as these pages repeat little."""
    x = _read(spark, d, "documents").select("source", F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    x = x.select("source", "page", T.repeat_key(F.col("line")).alias("key"))
    return library.repeated_lines(x, 0.06).where("key <> ''")


@query(f"WITH {BM}, {DENSE}, f AS ({{}}), s AS (SELECT qid, pos AS n, id, source, lang, text FROM f JOIN documents ON id = doc_id), b AS (SELECT qid, string_agg('[' || n::VARCHAR || '] ' || source || ' — ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS t, count(*) AS n FROM s GROUP BY qid) SELECT item_id AS qid, md5('Sources:' || chr(10) || chr(10) || coalesce(t, '') || chr(10) || chr(10) || 'Question: ' || text) AS user_md5, coalesce(n, 0) AS n_sources FROM benchmark LEFT JOIN b ON qid = item_id".replace("{}", "WITH " + _lists("")))
def build_messages(spark, d):
    docs, _, questions, _ = retrieval.inputs(spark, d)
    hits = retrieval.with_documents(retrieval.hybrid(spark, d).select("qid", F.col("pos").alias("n"), "id"), docs)
    made = answers.build_messages(questions, hits.select("qid", "n", "source", F.col("lang").alias("heading"), F.lit(0).alias("page"), "text"))
    return made.select("qid", F.md5("user").alias("user_md5"), F.col("n_sources").cast("long").alias("n_sources"))


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'prose' WHEN 3 THEN 'no_citations' END AS refusal FROM conversations""")
def prose_refusals(spark, d):
    reply = F.expr("element_at(array('The sources do not contain this. See [1].', 'There is no tax [2]. The documents do not mention more.', 'It is 5 [1], but the document does not specify when.', 'It is five.'), cast(conv_id % 4 as int) + 1)")
    x = _read(spark, d, "conversations").withColumn("reply", reply)
    return x.select("conv_id", "turn", answers.status(F.col("reply"), answers.valid(answers.citations(F.col("reply")), F.lit(3))).alias("refusal"))


@query(RELEVANCE + " SELECT qid, round(f5 / n, 6) AS recall_5, round(f10 / n, 6) AS recall_10, round(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END, 6) AS mrr_10 FROM sc")
def recall_mrr_documents(spark, d):
    return metrics.scores(*_run_and_qrels(spark, d))


def _by_config(spark, d):
    run, qrels = _run_and_qrels(spark, d)
    s = metrics.scores(run, qrels)
    return s.select("qid", F.expr("stack(3, 'recall_5', recall_5, 'recall_10', recall_10, 'mrr_10', mrr_10) AS (config, value)"))


@query(RELEVANCE + """, v AS (SELECT qid, round(f5 / n, 6) AS r5, round(f10 / n, 6) AS r10, round(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END, 6) AS m FROM sc)
SELECT 'recall_10 - recall_5' AS pair, qid, round(r10 - r5, 6) AS diff FROM v UNION ALL SELECT 'mrr_10 - recall_10', qid, round(m - r10, 6) FROM v""")
def paired_differences(spark, d):
    out = metrics.paired_differences(_by_config(spark, d), [("recall_10", "recall_5"), ("mrr_10", "recall_10")])
    return out.withColumn("diff", F.round("diff", 6))


@query()
def bootstrap_ci(spark, d):
    return metrics.bootstrap(_by_config(spark, d), "config", "value", "qid")


SPANS = f"""WITH {CH}, g AS (SELECT doc_id, 300 + doc_id % 50 AS s, 420 + doc_id % 50 AS e FROM labels)"""


@query(SPANS + " SELECT doc_id, chunk_index, least(end_token, e) - greatest(start_token, s) AS shared FROM ch JOIN g USING (doc_id) WHERE start_token < e AND s < end_token")
def relevance_overlap_join(spark, d):
    ch = chunking.chunk_fixed(_read(spark, d, "documents")).withColumnsRenamed({"start_token": "start", "end_token": "end"})
    gold = _read(spark, d, "labels").select("doc_id", (300 + F.col("doc_id") % 50).alias("start"), (420 + F.col("doc_id") % 50).alias("end"))
    shared = F.least("c.end", "g.end") - F.greatest("c.start", "g.start")
    return metrics.overlapping(ch, gold).select("c.doc_id", "chunk_index", shared.alias("shared"))


@query(SPANS + " SELECT doc_id, count(chunk_index) AS chunks, CASE WHEN count(chunk_index) = 0 THEN 'no chunk overlaps' END AS issue FROM g LEFT JOIN ch USING (doc_id) WHERE chunk_index IS NULL OR (start_token < e AND s < end_token) GROUP BY doc_id UNION ALL SELECT doc_id, 0, 'no chunk overlaps' FROM g WHERE EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = g.doc_id) AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = g.doc_id AND start_token < e AND s < end_token)")
def gold_coverage_check(spark, d):
    gold = _read(spark, d, "labels").select("doc_id")
    n = relevance_overlap_join(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    x = gold.join(n, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return x.withColumn("issue", F.when(F.col("chunks") == 0, "no chunk overlaps"))


@query("""WITH a AS (SELECT conv_id, turn, conv_id % 3 <> 0 AS able, turn % 4 <> 3 AS found, turn % 5 = 4 AS odd, conv_id % 2 = 0 AS has FROM conversations)
SELECT count(*) FILTER (able) AS answerable, count(*) FILTER (able AND has) AS gold_in_sources, count(*) FILTER (able AND found) AS answered, count(*) FILTER (able AND found AND has) AS cites_gold,
count(*) FILTER (NOT able) AS unanswerable, count(*) FILTER (NOT able AND NOT found) AS refused, count(*) FILTER (odd) AS invented, round(avg(turn * 0.5), 6) AS mean_seconds FROM a""")
def answers_report(spark, d):
    x = _read(spark, d, "conversations").withColumn("qid", F.concat_ws("/", "conv_id", "turn"))
    a = x.select("qid", (F.col("conv_id") % 3 != 0).alias("answerable"), (F.col("turn") % 4 != 3).alias("found"), F.expr("array(1L)").alias("cited"), F.expr("if(turn % 5 = 4, array(9L), cast(array() as array<bigint>))").alias("invalid"), (F.col("turn") * 0.5).cast("double").alias("seconds"))
    return metrics.answers_report(a, x.where("conv_id % 2 = 0").select("qid", F.lit(1).cast("long").alias("n")))


def _documents_with_sections(spark, d):
    """Documents with a short heading line inserted before every fourth line, so that they have sections; every line stays whole."""
    lines = F.split("text", "\n")
    headed = lambda sign, x: F.concat(F.lit(sign), F.substring(x, 1, 40), F.lit("\n"), x)
    marked = F.transform(lines, lambda x, i: F.when(i % 4 == 0, headed("## ", x)).when(i % 16 == 1, headed("# ", x)).otherwise(x))
    return _read(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))


@query()
def chunk_structure(spark, d):
    return chunkers.chunk(_documents_with_sections(spark, d), "structure")


@query()
def chunk_semantic(spark, d):
    return chunkers.chunk(_read(spark, d, "documents"), "semantic", embed=chunkers.hashed_bag)


@query()
def topics_candidates(spark, d):
    chunks = chunkers.chunk(_documents_with_sections(spark, d), "structure")
    return library.topics(chunks.select("doc_id", "heading_path"), 8)


@query()
def html_load(spark, d):
    def run(batches):
        for b in batches:
            got = [load_html(x or "") for x in b["html"]]
            yield b[["page_id"]].assign(title=[g[0] for g in got], text=[g[1] for g in got])

    pages = _read(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, title string, text string")
    return pages.withColumn("text", T.clean_text(F.col("text")))


@query()
def answer_questions(spark, d):
    """The answer loop with an echoing stand-in for the model: it cites the first source on the second turn only."""

    def chat(turns):
        return "It is so [1]." if len(turns) > 2 else "It is so."

    docs, _, questions, _ = retrieval.inputs(spark, d)
    hits = retrieval.with_documents(retrieval.hybrid(spark, d).select("qid", F.col("pos").alias("n"), "id"), docs)
    return answers.answer(questions, hits.select("qid", "n", "source", F.lit("").alias("heading"), F.lit(0).alias("page"), "text"), chat)


MODES = """m AS (SELECT qid, 'bm25' AS mode, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS pos FROM sc JOIN documents USING (doc_id) WHERE score > 0
UNION ALL SELECT qid, 'dense', vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) FROM dn)"""


@query(f"WITH {BM}, {DENSE}, {MODES} SELECT * FROM m WHERE pos <= 5")
def single_modes(spark, d):
    """A single list's own order, by mode."""
    x = retrieval.rankings(spark, d)
    mode = F.when(F.col("list_name") == "sparse", "bm25").otherwise("dense")
    return x.where("rank <= 5").select("qid", mode.alias("mode"), "id", F.col("rank").cast("long").alias("pos"))


@query("""WITH l AS (SELECT doc_id, i, length(line) AS n, substring(line, 1, 30) AS heading FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
h AS (SELECT doc_id, heading, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i) - n - 1 AS start FROM l),
p AS (SELECT doc_id, n, (length(text) * n) // 4 AS pos FROM documents, (VALUES (1), (2), (3)) v(n) WHERE text <> '')
SELECT p.doc_id, n::BIGINT AS n, heading FROM p ASOF JOIN h ON p.doc_id = h.doc_id AND p.pos >= h.start""")
def heading_asof(spark, d):
    """The line at or before each of three positions of a text, by the starts of its lines: an as-of join."""
    docs = _read(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    heads = lines.select("doc_id", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("start"), F.substring("line", 1, 30).alias("heading"))
    at = docs.select("doc_id", F.length("text").alias("len"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")).withColumn("pos", F.floor(F.col("len") * F.col("n") / 4))
    found = gold.as_of(at, heads, "doc_id", "pos", "start", "heading")
    return found.select("doc_id", F.col("n").cast("long").alias("n"), "heading")
