"""Prompt assembly and the reading of replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_language
from ..sources.store import written

# Fixed value: how a reply cites.
CITATION = r"\[\s*(\d+(?:\s*[,;]\s*\d+)*)\s*\]"


def citations(reply: Column) -> Column:
    """Cited numbers, distinct, in order of first use."""
    groups = F.regexp_extract_all(reply, F.lit(CITATION), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*"))), lambda x: x.cast("long")))


def valid(cited: Column, sources: Column) -> Column:
    return F.filter(cited, lambda n: (n >= 1) & (n <= sources))


def refusal(reply: Column, cited: Column) -> Column:
    """model, no_citations or null, from the reply and its valid citations."""
    return F.when(F.regexp_like(reply, F.lit(r"(?U)^\s*$")) | F.regexp_like(reply, F.lit(r"(?i)\bNOT_FOUND\b")), "model").when(F.size(cited) == 0, "no_citations")


def source_block(n: Column, source: Column, heading: Column, page: Column, text: Column) -> Column:
    where = F.concat(source, F.when(heading != "", F.concat(F.lit(" — "), heading)).otherwise(""), F.when(page > 0, F.concat(F.lit(" (p. "), page.cast("string"), F.lit(")"))).otherwise(""))
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), where, F.lit("\n"), text)


# The wording of prompts, messages and refusals.
NOT_FOUND = "NOT_FOUND"
LANGUAGES = {"ro": "Romanian", "en": "English"}
SAME_LANGUAGE = "the same language as the question"
MESSAGES = {"ro": "Nu am găsit această informație în documente.", "en": "I could not find this information in the documents."}
SYSTEM = """You answer questions about a collection of documents, using only the numbered sources you are given.

Rules:
1. Use only facts that the sources state. Never add outside knowledge.
2. After each claim, cite the source it comes from, like [2]. Cite only the sources that state that claim directly, not every source you read.
3. If the sources do not contain the answer, reply with exactly NOT_FOUND and nothing else.
4. Never write in your own words that the sources lack some information. Either answer from the sources, or reply NOT_FOUND.
5. If the sources answer only part of the question, answer that part and leave the rest out.
6. Answer in {language}.
7. Be concise: a few sentences at most."""
CITE_REQUEST = """Your reply has no citations. If your reply says that the sources do not contain the answer, reply with exactly NOT_FOUND and nothing else. Otherwise rewrite it so that every claim is followed by the number of the source that states it, like [2], keeping only the claims that a source states."""
NEGATION = r"\b(nu (exist[ăa]|se (poate|afl[ăa]|g[ăa]se[șş]te|men[țţ]ioneaz[ăa]|specific[ăa]|preciz[eă]az[ăa])|con[țţ]in|specific[ăa]|men[țţ]ioneaz[ăa]|preciz[eă]az[ăa]|ofer[ăa]|furnizeaz[ăa]|indic[ăa])|not (contain|specify|mention|provide|state|include)|no information|does not|do not)"
SOURCE_WORDS = r"\b(surs|document|informa[țţ]i|furnizat|sources?\b|documents?\b|information\b|context\b)"


# Fixed value: where a reply's first sentence ends.
FIRST_SENTENCE = r"^.*?(?:[.!?](?=\s)|$)"


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "(?s)" + FIRST_SENTENCE, 0)


def prose_refusal(reply: Column) -> Column:
    """The first sentence says that sources lack something, and cites nothing."""
    first = first_sentence(reply)
    return F.regexp_like(first, F.lit("(?iu)" + NEGATION)) & F.regexp_like(first, F.lit("(?iu)" + SOURCE_WORDS)) & ~F.regexp_like(first, F.lit(CITATION))


def status(reply: Column, cited: Column) -> Column:
    """model, no_citations, prose, or null for an answer."""
    return F.coalesce(refusal(reply, cited), F.when(prose_refusal(reply), "prose"))


def not_found(language: Column) -> Column:
    return F.when(language == "ro", MESSAGES["ro"]).when(language == "en", MESSAGES["en"]).otherwise(" / ".join(MESSAGES.values()))


def system_prompt(language: Column) -> Column:
    name = F.when(language == "ro", LANGUAGES["ro"]).when(language == "en", LANGUAGES["en"]).otherwise(SAME_LANGUAGE)
    return F.replace(F.lit(SYSTEM), F.lit("{language}"), name)


def build_messages(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, language, system, user, n_sources): questions (qid, text) with numbered hits (qid, n, source, heading, page, text).

    A question's hits are the few it retrieved, gathered in their order.
    """
    block = source_block(F.col("n"), F.col("source"), F.col("heading"), F.col("page"), F.col("h_text"))
    blocks = hits.withColumnRenamed("text", "h_text").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("blocks"))
    joined = questions.join(blocks, "qid", "left").withColumn("language", question_language(F.col("text")))
    shown = F.array_join(F.transform(F.coalesce("blocks", F.array()), lambda b: b["block"]), "\n\n")
    return joined.select("qid", "language", system_prompt(F.col("language")).alias("system"),
                         F.concat(F.lit("Sources:\n\n"), shown, F.lit("\n\nQuestion: "), F.col("text")).alias("user"), F.coalesce(F.size("blocks"), F.lit(0)).alias("n_sources"))


def _ask(messages: DataFrame, chat: Callable[[list[dict]], str]) -> DataFrame:
    """`raw` for every row: the replies of `chat` to its messages, a task at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turns = [[{"role": r, "content": c} for r, c in zip(("system", "user", "assistant", "user"), row)] for row in batch["turns"]]
            yield batch[["qid"]].assign(raw=[chat(t) for t in turns])

    return messages.select("qid", "turns").mapInPandas(run, f"qid {messages.schema['qid'].dataType.simpleString()}, raw string")


def answer(questions: DataFrame, hits: DataFrame, chat: Callable[[list[dict]], str]) -> DataFrame:
    """(qid, language, text, found, refusal, cited, invalid, raw, first_raw) of every question.

    Without sources the model isn't asked. Replies without citations are asked for once more; only those rows are.
    Prompts and replies are written into the shared folder before they are read again, so retrieval runs once.
    """
    prompts = written(build_messages(questions, hits), "prompts")
    asked = prompts.where("n_sources > 0").withColumn("turns", F.array("system", "user"))
    first = written(_ask(asked, chat).withColumnRenamed("raw", "first"), "replies")
    read = asked.join(first, "qid").withColumn("cited", valid(citations(F.col("first")), F.col("n_sources")))
    again = read.where(status(F.col("first"), F.col("cited")) == "no_citations").select("qid", F.array("system", "user", "first", F.lit(CITE_REQUEST)).alias("turns"))
    second = written(_ask(again, chat), "replies").withColumnRenamed("raw", "second")
    out = prompts.join(first, "qid", "left").join(second, "qid", "left").withColumn("raw", F.coalesce("second", "first"))
    every = citations(F.coalesce("raw", F.lit("")))
    out = out.withColumn("every", every).withColumn("cited", valid(F.col("every"), F.col("n_sources")))
    out = out.withColumn("refusal", F.when(F.col("n_sources") == 0, "no_sources").otherwise(status(F.col("raw"), F.col("cited"))))
    found = F.col("refusal").isNull()
    return out.select("qid", "language", F.when(found, F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).otherwise(not_found(F.col("language"))).alias("text"), found.alias("found"), "refusal",
                      F.when(found, F.col("cited")).otherwise(F.array().cast("array<bigint>")).alias("cited"), F.array_except("every", "cited").alias("invalid"),
                      "raw", F.when(F.col("second").isNotNull(), F.col("first")).alias("first_raw"))

