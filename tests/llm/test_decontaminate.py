from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import decontaminate as dc


def scores(index, tokens):
    """Every item's score against a passage, term by term."""
    total = [0.0] * len(index.items)
    for t in {index.vocabulary[w] for w in tokens if w in index.vocabulary}:
        for item, share in zip(*index.lists[t][:2]):
            total[item] += share
    return total


def brute(index, texts, threshold, overlap):
    best = {}
    for row, text in enumerate(texts):
        tokens = dc.words(text)
        for w in range(-(-len(tokens) // index.stride)):
            passage = tokens[w * index.stride : (w + 2) * index.stride]
            for item, s in enumerate(scores(index, passage)):
                if s >= threshold - dc.EPS:
                    q, a = (sum(g in dc._grams_of(passage, side) for g in side) / len(side) for side in index.questions[item])
                    if q >= overlap and a >= overlap:
                        e = (round(s, 9), round(q, 9), round(a, 9), -w * index.stride)
                        best[row, item] = max(best.get((row, item), e), e)
    return [(row, index.items[i], e[0], e[1], e[2], -e[3]) for (row, i), e in sorted(best.items())]


@pytest.mark.parametrize("seed", range(12))
def test_wand_and_screen_equal_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for i in range(rng.choice([1, 5, 90]))]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    texts += [t[:100] + " " + rng.choice(items)[1] + " " + t[100:] for t in texts[:20]]
    for threshold in (0.3, 0.6, 0.9):
        index = dc.build(items, threshold)[0]
        hits = 0
        for text in texts:
            tokens = dc.words(text)
            want = {i: s for i, s in enumerate(scores(index, tokens)) if s >= threshold - dc.EPS}
            got = dict(dc.wand(index, {index.vocabulary[w] for w in tokens if w in index.vocabulary}, threshold))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
            hits += len(got)
        assert dc.retrieve(index, texts, threshold, dc.RESIDUE, 0.3) == brute(index, texts, threshold, 0.3) and hits


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    rows = docs.select("doc_id", "text").collect()
    index = dc.build([(r.item_id, r.text) for r in bench.collect()])[0]
    want = sorted((rows[h[0]].doc_id, *h[1:]) for h in brute(index, [r.text for r in rows], dc.THRESHOLD, dc.OVERLAP))
    got = sorted(tuple(r) for r in dc.contaminated(docs, bench).collect())
    assert got == want and want
    in_parts = sorted(tuple(r)[:2] for r in dc.contaminated(docs, bench, items_per_part=7).collect())
    assert in_parts == [w[:2] for w in want]
    items = [r.text for r in bench.collect()]
    planted = {r.doc_id for r in rows if any(t in r.text for t in items)}
    assert planted <= {w[0] for w in want}
    clean = dc.without_test_items(docs, bench)
    assert clean.schema == docs.schema and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - {w[0] for w in want}


def test_question_and_answer():
    assert dc.question_and_answer("What is it? A thing.") == ("What is it?", " A thing.")
    assert dc.question_and_answer("One. Two. Three.") == ("One. Two.", "Three.")
    assert dc.question_and_answer("Only one") == ("Only one", "Only one")


def test_defined_cases(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta. Epsilon zeta."), (2, "alpha beta gamma delta. Epsilon zeta."), (3, None), (4, "..."), (None, "alpha beta")], "item_id long, text string")
    hit = "noise " * 9 + "Alpha beta gamma delta. epsilon ZETA"
    rows = [(1, None), (2, ""), (3, hit), (3, hit), (None, hit), (4, "alpha beta"), (5, "pad " * 60_000 + hit + " pad" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("position", F.lit(None).cast("date"))
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect())
    assert got == [(3, 1), (3, 2), (5, 1), (5, 2)]
    assert dc.contaminated(df.limit(0), bench).collect() == [] and dc.contaminated(df, bench.limit(0)).collect() == []
    assert sorted(r.doc_id for r in dc.without_test_items(df, bench).collect()) == [1, 2, 4]
    assert dc.without_test_items(df, bench.limit(0)).count() == len(rows)
