"""Questions to answers: route, retrieve, retry the weak ones once, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.operators import answers as an
from quillmesh.plans.hybrid import IndexTables, retrieve


def search_with_retry(index: IndexTables, queries: DataFrame, cfg: RetrievalConfig) -> tuple[DataFrame, DataFrame]:
    """Hits, and (qid, text) of the retries.  A query without hits or with a weak first one is expanded and asked again; what that finds replaces its hits."""
    hits = retrieve(index, queries, cfg).persist()
    strong = hits.where((F.col("rank") == 1) & (F.col("score") >= cfg.low_score)).select("qid")
    weak = queries.join(strong, "qid", "left_anti").withColumn("again", an.expand_query(F.col("text")))
    retried = weak.where("again <> text").select("qid", F.col("again").alias("text")).persist()
    second = retrieve(index, retried, cfg).persist()
    kept = hits.join(second.select("qid").distinct(), "qid", "left_anti")
    return kept.unionByName(second), retried


def ask(index: IndexTables, notes: DataFrame, questions: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), chat: Callable[[str, str], str] | None = None) -> DataFrame:
    """(qid, answer, tool_calls) for questions (qid, text); a missing or zero k means 5."""
    cfg = replace(cfg, k=cfg.k or 5)
    routed = an.route(questions, cfg.k).persist()
    opened = routed.where("tool = 'get_note'").select("qid", F.col("note_id").alias("wanted"))
    from quillmesh.functions.text import strip

    first = notes.dropDuplicates(["id"]).select("id", "title", "content")
    shown = F.when(F.col("id").isNull(), F.concat(F.lit("Заметка не найдена: "), F.col("wanted"))).otherwise(
        strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit(""))))
    )
    fetched = opened.join(first, F.col("wanted") == F.col("id"), "left").select("qid", shown.alias("answer"))
    asked = routed.where("tool = 'search'").select("qid", "text")
    hits, retried = search_with_retry(index, asked, cfg)
    found = an.answer(asked, hits, cfg.answer_mode, chat, cfg.context_chars)
    call = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("args"))
    note_call = call("get_note", F.create_map(F.lit("note_id"), F.col("note_id")))
    search = lambda text: call("search", F.create_map(F.lit("query"), text, F.lit("k"), F.lit(str(cfg.k))))
    again = retried.select("qid", F.col("text").alias("again"))
    calls = routed.join(again, "qid", "left").select(
        "qid",
        F.when(F.col("tool") == "get_note", F.array(note_call))
        .when(F.col("again").isNull(), F.array(search(F.col("text"))))
        .otherwise(F.array(search(F.col("text")), search(F.col("again"))))
        .alias("tool_calls"),
    )
    return calls.join(fetched.unionByName(found), "qid").select("qid", "answer", "tool_calls")
