from __future__ import annotations

import corpus_pipeline as cp
from pyspark.sql import functions as F

from quillmesh.llm import decontaminate, mixing, near_dedup, quality, sharding

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (kept, out))
        if name == "quality_rules":
            want = {r.doc_id for r in quality.judge(kept, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
        elif name == "near_dedup":
            want = {r.doc_id for r in near_dedup.near_duplicates(kept).where("keep").collect()}
        elif name == "decontaminate":
            want = before - {r.doc_id for r in decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        else:
            want = {r.doc_id for r in mixing.mix(kept).collect()}
        assert after == want and out.count() == len(after)
        kept = out
    final = cp.STAGES[-1][1](spark, kept, SF)
    assert final.columns == [*docs.columns, "shard"]
    assert {(r.doc_id, r.shard) for r in final.collect()} == {(r.doc_id, r.shard) for r in sharding.assign(kept).collect()}
    run = {(r.doc_id, r.text, r.shard) for r in cp.run(spark, SF).collect()}
    assert run == {(r.doc_id, r.text, r.shard) for r in final.collect()}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "one two three", "en", "s", 1), (1, "one two three", "en", "s", 1), (2, None, None, None, None), (None, "four five six", "en", None, 2), (3, "seven eight nine ten", None, "t", 3), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit("mine")).withColumn("keep", F.lit(0)).withColumn("tokens", F.lit(1))
    seen = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        seen.append(sorted((r.doc_id or 0) for r in docs.collect()))
    assert seen[0] == [0, 1, 1, 3] and seen[1] == [0, 1, 3] and seen[2] == [0, 1, 3] and set(seen[3]) <= {1, 3}
    final = cp.STAGES[-1][1](spark, docs, SF)
    assert final.columns.count("shard") == 1
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_column_names_of_the_stages_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 100")
    plain = {name: {r.doc_id for r in stage(spark, docs, SF).collect()} for name, stage in cp.STAGES}
    extra = ["gone", "nth", "served", "placed", "shard", "last", "queue", "Gone_", "_gone", "_nth", "_served", "_placed", "_shard", "draw", "quality", "key", "part"]
    for name in extra:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.col("doc_id")))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        rows = out.collect()
        assert {r.doc_id for r in rows} == plain[name]
        assert all(r[x] == f"{x}:{r.doc_id}" for r in rows for x in extra if x != "shard" or name != "shard")


def test_mixing_filter_looks_up_what_cutoffs_cannot_tell(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in mixing.mix(docs).collect()}
    assert {r.doc_id for r in mixing.keep_served(docs, most_sources=1).collect()} == want
    torn = docs.unionByName(docs.where("doc_id % 5 = 0").withColumn("source", F.lit("zz")))
    want = {r.doc_id for r in mixing.mix(torn).collect()}
    got = [r.doc_id for r in mixing.keep_served(torn).collect()]
    assert set(got) == want and len(got) == len(want) + sum(i % 5 == 0 for i in want)


def plain_run(docs, labels, items):
    """Stages 1 and 3 to 5 by brute force in plain Python; groups of near duplicates come from fingerprints compared pair by pair."""
    from collections import Counter
    from itertools import combinations
    from math import floor
    from hashlib import md5

    import numpy as np

    kept = {r.doc_id: r for r in docs if r.text and r.text.strip(" \t\r\n")}  # no language has labels enough for a cutoff here
    ids = sorted(kept)
    prints = near_dedup.simhash([kept[i].text for i in ids])
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(zip(ids, prints.view(np.uint64)), 2):
        if int(np.bitwise_count(a ^ b).sum()) <= near_dedup.RADIUS:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    kept = {i: r for i, r in kept.items() if root(i) == i}

    def leaks(text):
        tokens = decontaminate.words(text)
        for _, item in items:
            own = decontaminate.words(item)
            sides = [decontaminate.grams(decontaminate.words(x)) for x in decontaminate.question_and_answer(item)]
            if own and any(all(len(g & decontaminate.grams(tokens[k : k + 2 * stride])) >= 0.5 * len(g) for g in sides) for k in range(0, max(1, len(tokens) - stride), stride)):
                return True
        return False

    stride = max(len(decontaminate.words(t)) for _, t in items)
    kept = {i: r for i, r in kept.items() if not leaks(r.text)}
    tokens = {i: len([w for w in r.text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]) for i, r in kept.items()}
    key = {i: md5(f"{mixing.SEED}:{i}".encode()).hexdigest() for i in kept}
    upto, order = Counter(), []
    for i in sorted(kept, key=lambda i: (key[i], i)):
        source = kept[i].source or ""
        upto[source] += tokens[i]
        order.append((upto[source] / mixing.WEIGHTS.get(source, mixing.DEFAULT_WEIGHT), source, key[i], i))
    budget, total, served = floor(sum(tokens.values()) * mixing.BUDGET), 0, []
    for *_, i in sorted(order):
        total += tokens[i]
        if total > budget:
            break
        served.append(i)
    left, shard_of = [], {}
    for i in sorted(served, key=lambda i: (-len(kept[i].text.encode()), i)):
        size = len(kept[i].text.encode())
        fits = [b for b, r in enumerate(left) if r >= size]
        best = min(fits, key=lambda b: left[b]) if fits else len(left)
        if not fits:
            left.append(sharding.CAPACITY)
        left[best] -= size
        shard_of[i] = best
    return shard_of, left


def test_run_equals_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "labels", "benchmark"))
    assert all(v is None for _, c in quality.cutoffs(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")) for v in c.values())
    shard_of, left = plain_run(docs, labels, [(r.item_id, r.text) for r in items])
    got = {r.doc_id: (r.text, r.shard) for r in cp.run(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs}
    assert set(got) == set(shard_of) and all(got[i][0] == texts[i] for i in got)
    loads = {}
    for i, (t, s) in got.items():
        loads[s] = loads.get(s, 0) + len(t.encode())
    assert sorted(loads.values()) == sorted(sharding.CAPACITY - r for r in left)


def test_stages_leave_parquet(spark):
    files = cp.run(spark, SF).inputFiles()
    last = len(cp.STAGES) - 1
    assert files and all(f"/{last}_shard/" in f and f.endswith(".parquet") for f in files)
    folder = files[0].split(f"/{last}_shard/")[0]
    kept = [spark.read.parquet(f"{folder}/{k}_{name}").count() for k, (name, _) in enumerate(cp.STAGES)]
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0


def test_near_dedup_makes_no_table_of_pairs(spark, monkeypatch):
    """Pairs of a group grow with the square of its texts: a group of 300 texts gives no 44,850 rows."""

    def refuse(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(near_dedup, "near_pairs", refuse)
    words = " ".join(f"word{i}" for i in range(400))
    rows = [(i, f"{words} own{i}", "en", "s", 1) for i in range(300)] + [(1000, "something else altogether", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, SF).collect()) == [0, 1000]
