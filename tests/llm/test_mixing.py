from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import mixing


def brute(rows, weights, default, share=None, budget=None, seed=mixing.SEED):
    docs = {}
    for i, s, t in rows:
        if i is None:
            continue
        n = len(re.findall(r"[^ \t\r\n]+", t or ""))
        old = docs.get(i)
        docs[i] = (min(s or "", old[0]), max(n, old[1])) if old else (s or "", n)
    queues, line = {}, []
    for i, (s, n) in docs.items():
        queues.setdefault(s, []).append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, n))
    for s, q in queues.items():
        upto = 0
        for key, i, n in sorted(q):
            upto += n
            line.append((upto / weights.get(s, default), s, key, i, n))
    budget = int(share * sum(n for _, n in docs.values())) if budget is None else budget
    out, served = [], 0
    for finish, s, _, i, n in sorted(line):
        served += n
        if served <= budget:
            out.append((i, s, n, finish, served))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert rows_of(mixing.mix(docs)) == brute(rows, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.BUDGET)
    assert rows_of(mixing.mix(docs, {}, 1.0, 1.0)) == brute(rows, {}, 1.0, 1.0)


def test_shares_follow_weights(spark):
    rows = [(i, "ab"[i % 2], "w " * 10) for i in range(4000)]
    got = rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"a": 3.0, "b": 1.0}, budget_tokens=20_000))
    assert sum(r[2] for r in got) == 20_000 and abs(sum(r[2] for r in got if r[1] == "a") - 15_000) <= 10


def test_defined_cases(spark):
    rows = [(1, None, "a b"), (2, "", "c"), (3, "s", None), (4, "s", ""), (None, "s", "x"), (5, "s", "d e f"), (5, "s", "d e f"), (6, "t", "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("x")).withColumn("place", F.lit(1)).withColumn("key", F.lit(2))
    assert rows_of(mixing.mix(df, {"s": 2.0}, 1.0, 1.0)) == brute(rows, {"s": 2.0}, 1.0, 1.0)
    assert mixing.mix(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(df, {"s": 0.0})
