from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import toxicity as tx


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    asked = labels.where(F.col("doc_id") % 4 == 0)
    chain = tx.fit(docs, labels.where(F.col("doc_id") % 4 != 0))
    rows = tx.score(docs.join(asked.select("doc_id"), "doc_id", "left_semi"), chain).join(asked.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    caught = sum(r.toxic for r in rows if r.truth) / sum(r.truth for r in rows)
    false = sum(r.toxic for r in rows if not r.truth) / sum(1 - r.truth for r in rows)
    assert caught > 0.75 and false < 0.01
    assert all(not r.severe or r.toxic for r in rows) and any(r.severe for r in rows)


def test_features_and_scores_equal_a_plain_version():
    texts = ["Fine words, fine day", "", "éclair idiots idiot"]
    rows = tx.features(texts)
    for text, row in zip(texts, rows):
        import re

        words = set(re.findall(r"\w+", text.lower()))
        parts = {p for w in words for p in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*")}
        assert set(row) == {tx.xxhash.xxh3_64_intdigest(p.encode()) % tx.BUCKETS for p in parts}
    rng = np.random.default_rng(0)
    chain = [tx.Link(rng.normal(size=tx.BUCKETS).astype(np.float32), rng.normal(size=k), 0.1 * k) for k in range(3)]
    got = tx.predict_chain(chain, rows)
    for i, row in enumerate(rows):
        before = []
        for c, link in enumerate(chain):
            s = sum(float(link.weights[b]) for b in row) + sum(a * b for a, b in zip(link.earlier, before)) + link.bias
            p = 1 / (1 + np.exp(-s))
            assert abs(got[i, c] - p) < 1e-6
            q = min(max(p, 1e-4), 1 - 1e-4)
            before.append(np.log(q / (1 - q)) / 4)


def test_later_links_use_out_of_fold_probabilities(monkeypatch):
    """No row is in the training set of the model that gave the probability it carries on."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 400, 12)) for _ in range(200)]
    y = np.array([int(3 in r or 5 in r or k % 9 == 0) for k, r in enumerate(rows)])
    seen = []
    real = tx.Link.predict

    def spy(self, asked, before):
        seen.append({id(r) for r in asked})
        return real(self, asked, before)

    trained = []
    fit = tx.fit_link
    monkeypatch.setattr(tx.Link, "predict", spy)
    monkeypatch.setattr(tx, "fit_link", lambda r, b, t, **k: (trained.append({id(x) for x in r}), fit(r, b, t, **k))[1])
    tx.fit_chain(rows, np.column_stack([y, y]))
    assert len(seen) == tx.FOLDS and set.union(*seen) == {id(r) for r in rows}
    assert all(not (t & s) for t, s in zip(trained[1:-1], seen))


def test_a_later_category_learns_from_an_earlier_one():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(10, 3000, 6)) for _ in range(600)]
    first = np.array([k % 3 == 0 for k in range(600)])
    rows = [np.unique(np.r_[r, 7]) if f else r for r, f in zip(rows, first)]
    chain = tx.fit_chain(rows, np.column_stack([first, first]).astype(int))
    p = tx.predict_chain(chain, rows)
    assert chain[1].earlier[0] > 0.5 and ((p > 0.5) == first[:, None]).all()


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "some idiot"), (3, "some idiot"), (None, "x"), (4, "calm words " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (4, 1, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = tx.score(df, tx.fit(df, labels)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4]
    assert len({r.toxic_probability for r in got if r.doc_id in (1, 2)}) == 1
    none = tx.score(df, tx.fit(df, labels.limit(0))).collect()
    assert {(r.toxic_probability, r.toxic) for r in none} == {(0.5, False)}
    assert tx.score(df.limit(0), tx.fit(df.limit(0), labels)).collect() == []
