"""Answers from hits, routing of questions, and presentation."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as tx

SOURCES_HEADER = "Источники:"
NO_HITS = "Не нашёл релевантных фрагментов в базе."
NOTE_MARKER = "заметка"
SYSTEM_PROMPT = (
    "You answer questions about a collection of notes. Rely on the context given and on nothing else; where it falls short, "
    "say what it does contain. Answer in the language of the question, in plain markdown, and leave out a list of sources."
)


def _joined(hits: DataFrame, line: Column, name: str, sep: str = "\n") -> DataFrame:
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line")))).alias("rows"))
    return rows.select("qid", F.array_join(F.transform("rows", lambda r: r["line"]), sep).alias(name))


def source_line() -> Column:
    note, chunk, title, section = (tx.escape_html(F.col(c)) for c in ("note_id", "chunk_id", "title", "section"))
    return F.concat(F.col("rank").cast("string"), F.lit(") "), note, F.lit(" ("), chunk, F.lit(") — "), title, F.lit(" → "), section)


def sources_block(hits: DataFrame) -> DataFrame:
    """(qid, sources): a header and a line for each hit; starts with a newline."""
    return _joined(hits, source_line(), "body").select("qid", F.concat(F.lit(f"\n{SOURCES_HEADER}\n"), F.col("body")).alias("sources"))


def context_blocks(hits: DataFrame, budget: int) -> DataFrame:
    """The hits of each query whose blocks fit the budget of characters, up to the first that doesn't, with their block."""
    named = [F.lit("[Source "), F.col("rank").cast("string"), F.lit("]\n")]
    for c in ("note_id", "chunk_id", "title", "section", "text"):
        named += [F.lit(f"{c}: "), F.col(c), F.lit("\n")]
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    blocks = hits.withColumn("block", F.concat(*named))
    return blocks.withColumn("upto", F.sum(F.length("block")).over(upto)).where(F.col("upto") <= budget)


def llm_context(hits: DataFrame, budget: int = 12_000) -> DataFrame:
    """(qid, context)."""
    return _joined(context_blocks(hits, budget), F.col("block"), "context").withColumn("context", tx.strip(F.col("context")))


def _three_decimals(scores: pd.Series) -> pd.Series:
    return scores.map("{:.3f}".format)


def three_decimals(score: Column) -> Column:
    """By the exact value of the double, as Python and C print it; the JVM rounds half up what the double's shortest decimal form says (1.0005, 0.0625)."""
    return F.when(score.isNull(), "null").otherwise(F.pandas_udf(_three_decimals, "string", F.PandasUDFType.SCALAR)(score.cast("double")))


def extractive(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, answer): the hits themselves and their sources; a fixed message without hits."""
    entry = F.concat(
        F.col("rank").cast("string"), F.lit(") ["), F.col("title"), F.lit(" -> "), F.col("section"), F.lit("] (score="), three_decimals(F.col("score")), F.lit(")\n"),
        F.col("text"), F.lit("\n   source: "), F.col("note_id"), F.lit(" ("), F.col("chunk_id"), F.lit(")\n"),
    )
    body = _joined(hits, entry, "body")
    rows = queries.select("qid", "text").join(body, "qid", "left").join(sources_block(hits), "qid", "left")
    shown = F.concat(F.lit("Question: "), F.coalesce("text", F.lit("")), F.lit("\n\nAnswer (baseline, retrieval-only):\n\n"), F.col("body"))
    return rows.select("qid", F.when(F.col("body").isNull(), NO_HITS).otherwise(F.concat(tx.strip(shown), F.col("sources"))).alias("answer"))


def with_llm(queries: DataFrame, hits: DataFrame, chat: Callable[[str, str], str] | None, budget: int = 12_000) -> DataFrame:
    """(qid, answer) from chat(system, user); questions without hits get the fixed message, failed calls the extractive answer."""
    plain = extractive(queries, hits)
    if chat is None:
        return plain
    prompt = F.concat(F.lit("Question: "), F.coalesce("text", F.lit("")), F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")))
    asked = queries.select("qid", "text").join(llm_context(hits, budget), "qid", "left").join(sources_block(hits), "qid").select("qid", prompt.alias("user"), "sources")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = []
            for user in pdf["user"]:
                try:
                    said.append(chat(SYSTEM_PROMPT, user).strip())
                except Exception:
                    said.append(None)
            yield pd.DataFrame({"qid": pdf["qid"], "said": said, "sources": pdf["sources"]})

    told = asked.mapInPandas(call, "qid long, said string, sources string")
    return plain.join(told, "qid", "left").select("qid", F.when(F.col("said").isNull(), F.col("answer")).otherwise(tx.strip(F.concat("said", "sources"))).alias("answer"))


def answer(queries: DataFrame, hits: DataFrame, mode: str = "extractive", chat: Callable[[str, str], str] | None = None, budget: int = 12_000) -> DataFrame:
    return extractive(queries, hits) if mode.strip().lower() in ("extractive", "baseline") else with_llm(queries, hits, chat, budget)


def md_token(question: Column) -> Column:
    """First word that ends in .md, quotes and punctuation around it removed."""
    words = F.split(tx.squeeze(F.replace(question, F.lit("\\"), F.lit("/"))), " ")
    first = F.get(F.filter(words, lambda w: F.lower(w).endswith(".md")), 0)
    return F.regexp_replace(first, r"""^["'(),. ]+|["'(),. ]+$""", "")


def route(queries: DataFrame, k: int = 5) -> DataFrame:
    """Adds tool, note_id (for get_note) and k (for search)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    asks = (low.contains("покажи") | low.contains("открой") | low.contains("open")) & low.contains(".md")
    token = md_token(F.col("text"))
    fetch = asks & (F.coalesce(token, F.lit("")) != "")
    tool = F.when(fetch, "get_note").otherwise("search")
    return queries.withColumn("tool", tool).withColumn("note_id", F.when(fetch, token)).withColumn("k", F.when(~fetch, F.lit(k)))


def expand_query(question: Column) -> Column:
    """Without punctuation; a question of fewer than three words gets a marker word; nothing left: unchanged."""
    bare = tx.squeeze(F.regexp_replace(question, rf"[^\p{{L}}\p{{N}}{tx.WS[1:-1]}]", " "))
    return F.when(bare == "", question).when(F.size(F.split(bare, " ")) < 3, F.concat(bare, F.lit(f" {NOTE_MARKER}"))).otherwise(bare)


def split_message(df: DataFrame, text: str = "text", most: int = 4_000) -> DataFrame:
    """One row (part, piece) for each message of at most ``most`` characters; lines stay whole, a longer line is a message of its own."""
    st = lambda out, cur: F.struct(out.alias("out"), cur.alias("cur"))
    kept = lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(tx.strip(a["cur"]))))

    def add(a: Column, line: Column) -> Column:
        over = F.length(a["cur"]) + F.length(line) + 1 > most
        return F.when(over, st(kept(a), line)).otherwise(st(a["out"], F.when(a["cur"] == "", line).otherwise(F.concat(a["cur"], F.lit("\n"), line))))

    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.aggregate(F.split(whole, "\n"), st(F.array().cast("array<string>"), F.lit("")), add, kept)
    return df.select("*", F.posexplode(F.when(F.length(whole) <= most, F.array(whole)).otherwise(parts)).alias("part", "piece"))


def compact_sources(hits: DataFrame, most: int = 5) -> DataFrame:
    """(qid, sources): at most ``most`` short lines."""

    def short(c: str, n: int) -> Column:
        return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.col(c))

    line = F.concat(F.col("rank").cast("string"), F.lit(") "), short("title", 50), F.lit(" → "), short("section", 30))
    return _joined(hits.where(F.col("rank") <= most), line, "body").select("qid", F.concat(F.lit("\n<b>📚 Источники:</b>\n"), F.col("body")).alias("sources"))


def chat_html(answer: str | None) -> str | None:
    """Code fences and spans to tags, attributes off, runs of blank lines to one."""
    if answer is None:
        return None
    quoted = lambda s: html.escape(s, quote=False)
    out = re.sub(r"```(?:\w+)?\n(.*?)```", lambda m: f"<pre><code>{quoted(m[1].strip())}</code></pre>", answer, flags=re.S)
    out = re.sub(r"`([^`]+)`", lambda m: f"<code>{quoted(m[1])}</code>", out)
    out = re.sub(r"<(\w+)\s+[^>]*>", r"<\1>", out)
    kept: list[str] = []
    for line in out.split("\n"):
        blank = not line.strip()
        if not (blank and kept and kept[-1] == ""):
            kept.append("" if blank else line)
    return "\n".join(kept).strip()


def fix_mojibake(text: str | None) -> str | None:
    """UTF-8 that was read as cp1251, if at least two Cyrillic letters come out."""
    if not text or not ("Р" in text or "С" in text):
        return text
    try:
        fixed = text.encode("cp1251").decode("utf-8")
    except UnicodeError:
        return text
    return fixed if sum("а" <= c <= "я" or c == "ё" for c in fixed.lower()) >= 2 else text


def escape_markdown(text: Column) -> Column:
    """Messages are sent as HTML, so markdown needs no escapes."""
    return text


def _by_text(f: Callable[[str | None], str | None]) -> Callable[[pd.Series], pd.Series]:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return run


def chat_html_of(text: Column) -> Column:
    return F.pandas_udf(_by_text(chat_html), "string", F.PandasUDFType.SCALAR)(text)


def mojibake_fixed(text: Column) -> Column:
    return F.pandas_udf(_by_text(fix_mojibake), "string", F.PandasUDFType.SCALAR)(text)


def corpus_counts(chunks: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One row (chunks, notes); the number of notes falls back to the notes table's rows where chunks name none."""
    row = chunks.agg(F.count("*").alias("chunks"), F.countDistinct(F.nullif("note_id", F.lit(""))).alias("named"))
    if notes is None:
        return row.select("chunks", F.col("named").alias("notes"))
    return row.crossJoin(F.broadcast(notes.agg(F.count("*").alias("rows")))).select("chunks", F.when(F.col("named") > 0, F.col("named")).otherwise(F.col("rows")).alias("notes"))
