"""What larger and odder tables showed."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import answers as an
from quillmesh.operators import evaluation as ev

HIT = "qid long, rank int, score double, chunk_id string, note_id string, title string, section string, text string"


@pytest.mark.parametrize("report", [False, True])
def test_scores_are_printed_by_their_exact_value(spark, report):
    """As the SQL prints them: 1.0005 is a little less than that, 0.0625 a tie that goes to the even digit."""
    scores = [1.0005, 0.0625, 0.1875, 12.3455, 9.0015, 7.2, 0.0, -1.0005]
    hits = spark.createDataFrame([(q, 1, s, f"n{q}.md#1", f"n{q}.md", "t", "s", "x") for q, s in enumerate(scores)], HIT)
    asked = spark.createDataFrame([(q, f"what {q}", []) for q in range(len(scores))], "qid long, text string, ids array<string>")
    answers = an.extractive(asked, hits)
    if report:
        answers = ev.rag_report(asked.select("qid", "text", F.col("ids").alias("chunk_ids"), F.col("ids").alias("note_ids")), hits, answers)
    shown = sorted(r.answer.split("score=")[1].split(")")[0] for r in answers.collect())
    assert shown == sorted(duckdb.sql(f"SELECT printf('%.3f', x::DOUBLE) AS s FROM (SELECT unnest({scores}::DOUBLE[]) AS x)").df()["s"])


def test_shares_are_rounded_as_sql_rounds(spark):
    """Shares with a 5 at the seventh decimal: 1 to 1919 of 1920 tokens."""
    said = [(k, " ".join(["known"] * k + ["other"] * (1920 - k))) for k in (3, 9, 33, 999, 1001, 1917)]
    rows = spark.createDataFrame(said, "k long, said string")
    got = {r.k: r.c for r in rows.select("k", ev.coverage(F.col("said"), F.lit("known")).alias("c")).collect()}
    assert got == {k: float(v) for k, v in duckdb.sql(f"SELECT k, round(k::DOUBLE / 1920, 6) AS v FROM (SELECT unnest({[k for k, _ in said]}) AS k)").df().itertuples(index=False)}
