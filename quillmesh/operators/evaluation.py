"""Retrieval and answer metrics over whole validation sets, as joins and aggregates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.config import JUDGEMENT
from quillmesh.functions import text as tx
from quillmesh.operators.answers import SOURCES_HEADER

KS = (1, 3, 5, 10)
_EMPTY = "array<string>"


def as_list(c: Column, is_array: bool) -> Column:
    """Null is nothing, a scalar one member; blanks are dropped."""
    values = c if is_array else F.array(c.cast("string"))
    return F.filter(F.coalesce(values, F.array().cast(_EMPTY)), lambda x: x.isNotNull() & (x != ""))


def relevants(validation: DataFrame, lenient: bool = False) -> DataFrame:
    """(qid, text, chunk_ids, note_ids).  Notes default to those of the chunk ids: only from ids with # or ending in .md, or (lenient) from all."""
    types = dict(validation.dtypes)

    def field(*names: str) -> Column:
        lists = [as_list(F.col(n), types[n].startswith("array")) for n in names if n in types]
        out = F.array().cast(_EMPTY)
        for values in reversed(lists):
            out = F.when(F.size(values) > 0, values).otherwise(out)
        return out

    chunks, notes = field("relevant_chunk_ids", "expected_chunk_id"), field("relevant_note_ids", "expected_note_id")
    fit = chunks if lenient else F.filter(chunks, lambda c: c.contains("#") | c.endswith(".md"))
    derived = F.array_distinct(F.transform(fit, lambda c: F.substring_index(c, "#", 1)))
    rows = validation.select("qid", F.coalesce("query", F.lit("")).alias("text"), chunks.alias("chunk_ids"), notes.alias("given"), derived.alias("derived"))
    return rows.select("qid", "text", "chunk_ids", F.when(F.size("given") > 0, F.col("given")).otherwise(F.col("derived")).alias("note_ids"))


def first_ranks(relevant: DataFrame, hits: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, chunk_rank, note_rank): the first hit that is relevant, null without one."""
    found = hits if most is None else hits.where(F.col("rank") <= most)
    rows = relevant.join(found.select("qid", "rank", "chunk_id", "note_id"), "qid", "left")
    return rows.groupBy("qid").agg(
        F.min(F.when(F.array_contains("chunk_ids", F.col("chunk_id")), F.col("rank"))).alias("chunk_rank"),
        F.min(F.when(F.array_contains("note_ids", F.col("note_id")), F.col("rank"))).alias("note_rank"),
    )


def k_list(ks: list[int] | tuple[int, ...]) -> list[int]:
    return sorted({int(k) for k in ks if int(k) > 0})


def rag_k_list(k: int) -> list[int]:
    """Of 1, 3, 5 and 10 those that k hits can show."""
    return [x for x in KS if x <= k]


def retrieval_metrics(firsts: DataFrame, ks: list[int] | tuple[int, ...] = KS) -> DataFrame:
    """(k, recall_chunk, mrr_chunk, recall_note, mrr_note): over all queries, those without relevant ids included."""
    rows = firsts.select("chunk_rank", "note_rank", F.explode(F.array(*[F.lit(k) for k in k_list(ks)])).alias("k"))
    within = lambda c: F.col(c).isNotNull() & (F.col(c) <= F.col("k"))
    hit = lambda c: F.round(F.avg(F.when(within(c), 1.0).otherwise(0.0)), 6)
    mrr = lambda c: F.round(F.avg(F.when(within(c), 1.0 / F.col(c)).otherwise(0.0)), 6)
    return rows.groupBy("k").agg(hit("chunk_rank").alias("recall_chunk"), mrr("chunk_rank").alias("mrr_chunk"), hit("note_rank").alias("recall_note"), mrr("note_rank").alias("mrr_note"))


def misses(relevant: DataFrame, hits: DataFrame, most: int, show: int = 5) -> DataFrame:
    """(qid, text, top_score): nothing relevant in the first ``most`` hits, the most confident first."""
    found = hits.where(F.col("rank") <= most).select("qid", "chunk_id", "note_id")
    by_chunk = F.size("chunk_ids") > 0
    labelled = relevant.where(by_chunk | (F.size("note_ids") > 0))
    good = labelled.join(found, "qid").where(F.when(by_chunk, F.array_contains("chunk_ids", F.col("chunk_id"))).otherwise(F.array_contains("note_ids", F.col("note_id"))))
    top = hits.where("rank = 1").select("qid", "score")
    lost = labelled.join(good.select("qid").distinct(), "qid", "left_anti").join(top, "qid", "left")
    return lost.select("qid", "text", F.coalesce("score", F.lit(-999.0)).alias("top_score")).orderBy(F.desc("top_score"), "qid").limit(show)


def _shares(said: pd.Series, known: pd.Series) -> pd.Series:
    out = []
    for tokens, context in zip(said, known):
        there = set(context)
        out.append(sum(t in there for t in tokens) / len(tokens) if len(tokens) else 0.0)
    # As SQL rounds, on the product: rounding the decimal form, 999/1920 would be 0.520313, not 0.520312.
    return np.floor(pd.Series(out, dtype=float) * 1e6 + 0.5) / 1e6


def coverage(answer: Column, context: Column) -> Column:
    """Share of the answer's tokens, with repeats, that the context has, to six decimals.

    Tokens are made by built-ins; counting them needs a set for each row, which a lambda over
    arrays would build again for every token, so that is an Arrow UDF.
    """
    return F.pandas_udf(_shares, "double", F.PandasUDFType.SCALAR)(tx.lex_tokens(answer), tx.lex_tokens(context))


def citations(answer: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[([^\]]++)\]"), F.lit(1))
    return F.filter(F.transform(found, tx.strip), lambda c: c != "")


def has_valid_citation(cited: Column, ids: Column) -> Column:
    """Whether some retrieved id is part of some citation."""
    return F.exists(cited, lambda c: F.exists(ids, lambda i: c.contains(i)))


def strip_sources(answer: Column) -> Column:
    return tx.strip(F.substring_index(F.coalesce(answer, F.lit("")), SOURCES_HEADER, 1))


def parse_judgement(text: Column) -> Column:
    """The struct of the first { to the last }; null if that isn't an object or has none of the fields."""
    raw = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.from_json(raw, JUDGEMENT)
    some = F.coalesce(*[parsed[c.split()[0]].cast("string") for c in JUDGEMENT.split(", ")])
    return F.when(some.isNotNull(), parsed)


_JUDGE = f"struct<{', '.join(f.replace(' ', ':', 1) for f in JUDGEMENT.split(', '))}>"


def judge_request(asked: str, context: str, said: str) -> tuple[str, str]:
    wanted = {"correctness": "1-5", "groundedness": "1-5", "uses_context": "true/false", "hallucination": "true/false", "short_reason": "at most 20 words"}
    system = "You grade answers of a retrieval system strictly, by the context given and nothing else; an answer that the context lacks costs both grades."
    return system, f"Question:\n{asked}\n\nContext:\n{context}\n\nAnswer:\n{said}\n\nReturn one JSON object and nothing else: {json.dumps(wanted)}"


def judge(rows: DataFrame, chat: Callable[[str, str], str]) -> DataFrame:
    """Adds ``judge``; rows: text, context, answer_body."""
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(raw=[chat(*judge_request(q or "", c or "", a or "")) for q, c, a in zip(pdf["text"], pdf["context"], pdf["answer_body"])])

    return rows.mapInPandas(ask, f"{types}, raw string").withColumn("judge", parse_judgement(F.col("raw"))).drop("raw")


def judge_first(rows: DataFrame, chat: Callable[[str, str], str], n: int) -> DataFrame:
    """Adds ``judge`` in the order of qid until n verdicts could be parsed; the rest isn't sent to the model and gets null."""
    at = rows.select("qid", F.row_number().over(Window.orderBy("qid")).alias("_at"))
    placed = rows.join(at, "qid").persist()
    upto, wanted, total, parts = 0, n, placed.count(), []
    while wanted > 0 and upto < total:
        some = judge(placed.where(F.col("_at").between(upto + 1, upto + wanted)), chat).persist()
        parts.append(some)
        upto, wanted = upto + wanted, wanted - some.where("judge is not null").count()
    parts.append(placed.where(F.col("_at") > upto).withColumn("judge", F.lit(None).cast(_JUDGE)))
    return reduce(DataFrame.unionByName, parts).drop("_at")


def rag_report(relevant: DataFrame, hits: DataFrame, answers: DataFrame, chat: Callable[[str, str], str] | None = None, judge_n: int = 0) -> DataFrame:
    """One row for each query: ids, answer, coverage, citations and the judge's verdict (on the first judge_n only; 0: on all)."""
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "note_id", "text"))).alias("h"))
    joined = listed.select("qid", F.col("h.chunk_id").alias("retrieved_chunk_ids"), F.col("h.note_id").alias("retrieved_note_ids"), F.array_join("h.text", "\n").alias("context"))
    none = F.array().cast(_EMPTY)
    rows = relevant.join(joined, "qid", "left").join(answers.select("qid", "answer"), "qid", "left")
    rows = rows.withColumns({
        "context": F.coalesce("context", F.lit("")),
        "retrieved_chunk_ids": F.coalesce("retrieved_chunk_ids", none),
        "retrieved_note_ids": F.coalesce("retrieved_note_ids", none),
        "answer_body": strip_sources(F.col("answer")),
    })
    if chat is None:
        rows = rows.withColumn("judge", F.lit(None).cast(_JUDGE))
    else:
        rows = judge_first(rows, chat, judge_n) if judge_n > 0 else judge(rows, chat)
    cited = citations(F.col("answer_body"))
    ids = F.array_distinct(F.concat("retrieved_chunk_ids", "retrieved_note_ids"))
    return rows.select(
        F.col("text").alias("query"),
        F.col("chunk_ids").alias("relevant_chunk_ids"),
        F.col("note_ids").alias("relevant_note_ids"),
        "retrieved_chunk_ids",
        "retrieved_note_ids",
        "answer",
        "answer_body",
        coverage(F.col("answer_body"), F.col("context")).alias("coverage"),
        (F.size(cited) > 0).alias("has_bracket_citations"),
        has_valid_citation(cited, ids).alias("has_valid_bracket_citation"),
        "judge",
    )


def rag_summary(report: DataFrame) -> DataFrame:
    """One row: rates and means of a report; means of the judge over parsed verdicts."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return report.agg(
        F.count("*").alias("n"),
        rate(F.size("retrieved_chunk_ids") > 0).alias("hit_rate"),
        rate(F.col("has_bracket_citations")).alias("citation_rate"),
        rate(F.col("has_valid_bracket_citation")).alias("valid_citation_rate"),
        F.round(F.avg("coverage"), 6).alias("coverage"),
        F.count("judge").alias("judged"),
        F.round(F.avg(F.when(F.col("judge").isNotNull(), F.coalesce("judge.correctness", F.lit(0.0)))), 6).alias("correctness"),
        F.round(F.avg(F.when(F.col("judge").isNotNull(), F.coalesce("judge.groundedness", F.lit(0.0)))), 6).alias("groundedness"),
        F.round(F.avg(F.when(F.col("judge").isNotNull(), F.when(F.col("judge.hallucination"), 1.0).otherwise(0.0))), 6).alias("hallucination_rate"),
    )
