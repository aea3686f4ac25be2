"""Driver queries and their DuckDB twins, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, chunking, fusion, gold, library, metrics, vectors
from . import retrieval

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, substring(sha256(source || '/' || doc_id::VARCHAR), 1, 16) AS source_key, substring(sha256(text), 1, 16) AS content_hash, length(text) AS num_chars FROM documents")
def doc_ids_sha(spark, d):
    x = _read(spark, d, "documents")
    return x.select("doc_id", T.short_hash(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("source_key"), T.short_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("num_chars"))


@query(r"SELECT doc_id, md5(n) AS norm_md5, md5(regexp_replace(n, '[0-9]+', '#', 'g')) AS key_md5 FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents)")
def norm_repeat_key(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(T.norm(F.col("text"))).alias("norm_md5"), F.md5(T.repeat_key(F.col("text"))).alias("key_md5"))


TOKENS = r"list_filter(string_split(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def fold_tokens(spark, d):
    x = _read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(rf"""SELECT doc_id, CASE WHEN en > ro THEN 'en' ELSE 'ro' END AS language FROM (
SELECT doc_id, len(list_filter(w, lambda x: x IN ({_in(T.STOPWORDS['ro'])}))) AS ro, len(list_filter(w, lambda x: x IN ({_in(T.STOPWORDS['en'])}))) AS en
FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS w FROM documents))""")
def lang_detect_docs(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.document_language(F.col("text")).alias("language"))


@query(rf"""SELECT item_id, CASE WHEN regexp_matches(text, '[ăâîșțşţĂÂÎȘȚŞŢ]') THEN 'ro' WHEN ro > en THEN 'ro' WHEN en > ro THEN 'en' END AS language FROM (
SELECT item_id, text, len(list_filter(w, lambda x: x IN ({_in(T.RO_QUESTION)}))) + 0.5 * len(list_filter(w, lambda x: length(x) > 4 AND regexp_matches(x, '{T.RO_ENDINGS}'))) AS ro,
len(list_filter(w, lambda x: x IN ({_in(T.EN_QUESTION)}))) + 0.5 * len(list_filter(w, lambda x: length(x) > 4 AND regexp_matches(x, '{T.EN_ENDINGS}'))) AS en
FROM (SELECT item_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark))""")
def lang_detect_questions(spark, d):
    return _read(spark, d, "benchmark").select("item_id", T.question_language(F.col("text")).alias("language"))


ROMAN = "list_reduce(list_prepend('', list_transform([1000, 100, 10, 1], lambda p: CASE WHEN p = 1000 THEN repeat('M', (n // 1000)::INT) ELSE replace(replace(replace([ '', 'x', 'xx', 'xxx', 'xy', 'y', 'yx', 'yxx', 'yxxx', 'xz' ][((n // p) % 10 + 1)::INT], 'x', CASE p WHEN 100 THEN 'C' WHEN 10 THEN 'X' ELSE 'I' END), 'y', CASE p WHEN 100 THEN 'D' WHEN 10 THEN 'L' ELSE 'V' END), 'z', CASE p WHEN 100 THEN 'M' WHEN 10 THEN 'C' ELSE 'X' END) END)), lambda a, b: a || b)"


@query(f"SELECT doc_id, n, {ROMAN} AS roman FROM (SELECT doc_id, doc_id % 3999 + 1 AS n FROM documents)")
def roman_numbers(spark, d):
    """Every document's number written as a Roman numeral by digits, and read back."""
    x = _read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3999 + 1).alias("v"))
    parts = []
    for p, (one, five, ten) in ((1000, "M  "), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        parts.append(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.floor(F.col("v") / p) % 10 + 1).cast("int")))
    return x.select("doc_id", F.concat(*parts).alias("roman")).select("doc_id", T.roman_number(F.col("roman")).cast("long").alias("n"), "roman")


BM = f"""
toks AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
size AS (SELECT doc_id, len(t) AS dl FROM toks),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term), (SELECT count(*) AS n FROM toks)),
mean AS MATERIALIZED (SELECT avg(r) AS mean FROM raw),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, mean),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM size)))), 6) AS score
  FROM post JOIN qt USING (term) JOIN stats USING (term) JOIN size USING (doc_id) GROUP BY ALL)"""
DENSE = """
qv AS (SELECT item_id AS qid, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id),
dn AS (SELECT qid, vec_id, round(list_dot_product(embedding::DOUBLE[], qvec::DOUBLE[]), 6) AS score, lang, source FROM embeddings JOIN documents ON vec_id = doc_id CROSS JOIN qv)"""


def _lists(part: str, where: str = "true", names: tuple[str, str] = ("'sparse'", "'dense'"), k: int = 10) -> str:
    return f"""lists AS (
SELECT qid, list_name, id, rank FROM (SELECT qid, {names[0]} AS list_name, doc_id AS id, score, row_number() OVER (PARTITION BY qid{part} ORDER BY score DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE {where}) WHERE rank <= {k} AND score > 0
UNION ALL SELECT qid, list_name, id, rank FROM (SELECT qid, {names[1]} AS list_name, vec_id AS id, row_number() OVER (PARTITION BY qid{part} ORDER BY score DESC, vec_id) AS rank FROM dn WHERE {where}) WHERE rank <= {k}),
fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score, coalesce(min(CASE WHEN list_name LIKE 'dense%' THEN rank END), 1000000) AS dense_rank FROM lists GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank, id) AS pos FROM fused) WHERE pos <= 5"""


@query(f"WITH {BM} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark, d):
    return retrieval.stats(spark, d).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM} SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10 AND score > 0")
def bm25_topk(spark, d):
    return retrieval.best(spark, d, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {BM} SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE source = 'src3') WHERE rank <= 10 AND score > 0")
def bm25_filtered_global_stats(spark, d):
    return retrieval.best(spark, d, 10, allowed=F.col("source") == "src3").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {DENSE} SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM dn) WHERE rank <= 10")
def dense_topk(spark, d):
    docs, v, _, qv = retrieval.inputs(spark, d)
    return vectors.top_k(v.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi"), qv, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {DENSE} SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM dn WHERE source = 'src3') WHERE rank <= 10")
def dense_topk_filtered(spark, d):
    docs, v, _, qv = retrieval.inputs(spark, d)
    return vectors.top_k(v.join(docs.where("source = 'src3'").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi"), qv, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {BM}, {DENSE}, {_lists('')}")
def rrf_hybrid_topk(spark, d):
    return retrieval.hybrid(spark, d)


LANG_NAMES = ("'sparse:' || lang", "'dense:' || lang")


@query(f"WITH {BM}, {DENSE}, {_lists(', lang', names=LANG_NAMES)}")
def rrf_per_language(spark, d):
    return retrieval.hybrid(spark, d, per_language=True)


IN_FOLDER = "source = 'src3'"


@query(f"WITH {BM}, {DENSE}, {_lists('', IN_FOLDER)}")
def rrf_folder_scope(spark, d):
    return retrieval.hybrid(spark, d, source="src3")


@query("""SELECT * FROM (SELECT qid, id, round(score * 10 - id % 7, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score * 10 - id % 7, 6) DESC, pos) AS pos FROM (WITH """ + f"{BM}, {DENSE}, {_lists('')}" + ")) WHERE pos <= 3")
def rerank_given_scores(spark, d):
    """Rerank with a stand-in scorer that SQL has too; ties keep the fused order."""
    from pyspark.sql import Window

    x = retrieval.hybrid(spark, d).withColumn("s", F.round(F.col("score") * 10 - F.col("id") % 7, 6))
    by = Window.partitionBy("qid").orderBy(F.desc("s"), "pos")
    return x.select("qid", "id", F.col("s").alias("score"), F.row_number().over(by).cast("long").alias("pos")).where("pos <= 3")


CH = r"""
w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents),
l0 AS (SELECT doc_id, n, greatest(0, ceil((n - 400) / 340))::BIGINT AS l FROM w WHERE n > 0),
l1 AS (SELECT doc_id, n, CASE WHEN l > 0 AND n - l * 340 < 100 THEN l - 1 ELSE l END AS last FROM l0),
ch AS (SELECT doc_id, i AS chunk_index, i * 340 AS start_token, CASE WHEN i = last THEN n ELSE i * 340 + 400 END AS end_token FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM l1))"""


@query(f"WITH {CH} SELECT *, substring(sha256(doc_id::VARCHAR || '|fixed|' || start_token::VARCHAR || '|' || end_token::VARCHAR), 1, 16) AS chunk_id FROM ch")
def chunk_fixed(spark, d):
    return chunking.chunk_fixed(_read(spark, d, "documents"))


@query(f"WITH {CH} SELECT doc_id, count(*) AS chunks, min(end_token - start_token) AS min_tokens, floor(avg(end_token - start_token))::BIGINT AS avg_tokens, max(end_token - start_token) AS max_tokens FROM ch GROUP BY doc_id")
def chunk_stats(spark, d):
    return chunking.chunk_stats(chunking.chunk_fixed(_read(spark, d, "documents")))


@query("SELECT doc_id, len(list_filter([0, 500, 1500, 4000], lambda s: s <= length(text) // 2))::BIGINT AS page FROM documents")
def page_at(spark, d):
    starts = F.array(*[F.lit(x) for x in (0, 500, 1500, 4000)])
    return _read(spark, d, "documents").select("doc_id", T.page_at(starts, F.floor(F.length("text") / 2)).cast("long").alias("page"))


REPLY = "text || ' [' || (turn % 4)::VARCHAR || ', 2] and [9]' || CASE WHEN conv_id % 5 = 0 THEN ' NOT_FOUND' ELSE '' END"


def _replies(spark, d):
    x = _read(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    end = F.when(F.col("conv_id") % 5 == 0, " NOT_FOUND").otherwise("")
    x = x.withColumn("reply", F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit(", 2] and [9]"), end))
    cited = answers.citations(F.col("reply"))
    return x.select("conv_id", "turn", "reply", answers.valid(cited, F.lit(3)).alias("cited"), cited.alias("every"))


CITED = f"""x AS (SELECT conv_id, turn, {REPLY} AS reply FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
c AS (SELECT *, CASE WHEN turn % 4 = 2 THEN [2, 9] ELSE [turn % 4, 2, 9] END AS every FROM x WHERE NOT regexp_matches(reply[:-25], '\\[[0-9]')),
v AS (SELECT *, list_filter(every, lambda n: n >= 1 AND n <= 3) AS cited FROM c)"""


@query(f"WITH {CITED} SELECT conv_id, turn, array_to_string(every, ',') AS every_n, array_to_string(cited, ',') AS cited_n FROM v")
def citations_parse(spark, d):
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    return _replies(spark, d).select("conv_id", "turn", joined("every").alias("every_n"), joined("cited").alias("cited_n"))


@query(f"WITH {CITED} SELECT conv_id, turn, CASE WHEN contains(reply, 'NOT_FOUND') THEN 'model' WHEN len(cited) = 0 THEN 'no_citations' END AS refusal FROM v")
def answer_status(spark, d):
    return _replies(spark, d).select("conv_id", "turn", answers.refusal(F.col("reply"), F.col("cited")).alias("refusal"))


@query("SELECT doc_id, md5('[' || (doc_id % 5 + 1)::VARCHAR || '] ' || source || CASE WHEN lang <> '' THEN ' — ' || lang ELSE '' END || CASE WHEN doc_id % 3 > 0 THEN ' (p. ' || (doc_id % 3)::VARCHAR || ')' ELSE '' END || chr(10) || text) AS block_md5 FROM documents")
def format_sources(spark, d):
    x = _read(spark, d, "documents")
    return x.select("doc_id", F.md5(answers.source_block(F.col("doc_id") % 5 + 1, F.col("source"), F.col("lang"), F.col("doc_id") % 3, F.col("text"))).alias("block_md5"))


@query("""SELECT source, k, n, round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high
FROM (SELECT source, count(*) AS n, sum(quality)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def wilson_rates(spark, d):
    x = _read(spark, d, "labels").join(_read(spark, d, "documents"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return x.select("source", "k", "n", low.alias("low"), high.alias("high"))


RELEVANT = f"""WITH {DENSE}, top AS (SELECT * FROM (SELECT qid, vec_id AS did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS pos FROM dn WHERE vec_id <> qid) WHERE pos <= 10),
rel AS (SELECT q.vec_id AS qid, e.vec_id AS did, 1 AS rel FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id JOIN documents ON e.vec_id = doc_id WHERE q.vec_id IN (SELECT qid FROM qv))"""


def _run_and_qrels(spark, d):
    docs, v, _, qv = retrieval.inputs(spark, d)
    v = v.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    run = vectors.top_k(v, qv, 11).where("vec_id <> qid")
    from pyspark.sql import Window

    run = run.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("pos <= 10").select("qid", F.col("vec_id").alias("did"), "pos")
    e = _read(spark, d, "embeddings").select("vec_id", "label")
    judged = e.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    q = e.join(qv.select("qid"), F.col("vec_id") == F.col("qid")).select("qid", F.col("label").alias("l"))
    # A question's judged documents: as many as share its label, a bounded set of questions.
    qrels = judged.join(q, F.col("label") == F.col("l")).where("vec_id <> qid").select("qid", F.col("vec_id").alias("did"), F.lit(1).alias("rel"))
    return run, qrels


@query(RELEVANT + """, got AS (SELECT qid, sum(1 / log2(pos + 1)) AS dcg FROM top JOIN rel USING (qid, did) GROUP BY qid),
ideal AS (SELECT qid, sum(1 / log2(p + 1)) AS best FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY did) AS p FROM rel) WHERE p <= 10 GROUP BY qid)
SELECT qid, round(coalesce(dcg, 0) / best, 6) AS ndcg FROM ideal LEFT JOIN got USING (qid)""")
def ndcg_at_10(spark, d):
    return metrics.ndcg(*_run_and_qrels(spark, d))


@query(RELEVANT + """, r AS (SELECT qid, min(CASE WHEN rel = 1 THEN pos END) AS rank FROM top LEFT JOIN rel USING (qid, did) GROUP BY qid)
SELECT label, count(*) AS n, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3, count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
FROM r JOIN embeddings ON vec_id = qid GROUP BY label""")
def recall_mrr_by_type(spark, d):
    run, qrels = _run_and_qrels(spark, d)
    ranks = run.join(qrels, ["qid", "did"], "left").groupBy("qid").agg(F.min(F.when(F.col("rel") == 1, F.col("pos"))).alias("rank"))
    labels = _read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    return metrics.summarize(ranks.join(labels, "qid"), ["label"])


@query(f"WITH {CH}, c AS (SELECT doc_id, count(*) AS c FROM ch GROUP BY doc_id), f AS (SELECT source AS folder, count(*) AS documents, sum(coalesce(c, 0))::BIGINT AS chunks FROM documents LEFT JOIN c USING (doc_id) GROUP BY source) SELECT * FROM f UNION ALL SELECT 'empty', 0, 0")
def folders_summary(spark, d):
    x = _read(spark, d, "documents")
    return library.folders(x, chunking.chunk_fixed(x), spark.createDataFrame([("empty",)], "folder string"))


@query("SELECT source, lang, count(*) AS documents, sum(length(text))::BIGINT AS num_chars, max(length(text))::BIGINT AS longest FROM documents GROUP BY source, lang")
def documents_summary(spark, d):
    return _read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("num_chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT 'only in documents' AS problem, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'only in embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'twice in documents', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)")
def sync_check(spark, d):
    return library.sync_problems(_read(spark, d, "documents").select("doc_id"), _read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", ("documents", "embeddings"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS source FROM documents")
def upsert_replace(spark, d):
    x = _read(spark, d, "documents").select("doc_id", "source")
    return library.upsert(x, x.where("doc_id % 10 = 0").withColumn("source", F.lit("new")), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_by_source(spark, d):
    x = _read(spark, d, "documents").select("doc_id", "source")
    return library.delete(x, spark.createDataFrame([("src1",), ("src2",)], "source string"), "source")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def resume_todo(spark, d):
    done = _read(spark, d, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("item_id"))
    return library.delete(_read(spark, d, "benchmark").select("item_id"), done, "item_id")


@query(r"""WITH q AS (SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '\S+'), lambda w: regexp_escape(w)), '(?:\s+#{1,6})?\s+') AS pat FROM benchmark WHERE regexp_matches(text, '\S')),
p AS (SELECT item_id, doc_id, string_split_regex(d.text, pat) AS parts, regexp_extract_all(d.text, pat) AS found FROM q JOIN documents d ON regexp_matches(d.text, pat)),
n AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM p),
s AS (SELECT item_id, doc_id, (coalesce(list_sum(list_transform(parts[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0))::BIGINT AS start_char, length(found[i]) AS len FROM n)
SELECT item_id, doc_id, start_char, start_char + len AS end_char FROM s""")
def gold_quotes(spark, d):
    """Every place where a quote of the question set stands in a document, its white space as it may be there."""
    quotes = _read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return gold.find_spans(_read(spark, d, "documents").select("doc_id", "text"), quotes)
