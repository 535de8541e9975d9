"""Scoring in one scan, labels by a word, statistics of the asked terms alone, chunks without Python."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.config import CHUNK, RetrievalConfig
from quillmesh.functions.parts import containing
from quillmesh.operators import chunking, lexical, scan, vectors
from quillmesh.plans import catalog, hybrid
from quillmesh.sources import store

SF = "/root/testdata/sf0.001"
CHUNKS = [(f"n{k}.md#1", f"n{k}.md", f"t{k}", "s", f"red word{k % 7} green {'blue ' * (k % 4)}", ["a"], [f"n{k + 1}"], 1) for k in range(50)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "sparse_topk", "note_cap_topk"])
def test_top_k_joins_no_postings(spark, name):
    """No row for a query and an item but for the best of a partition."""
    top = vectors.sparse_topk if name != "bm25_topk" else lexical.bm25_topk
    assert "Join" not in plan(top(catalog.asked(spark, SF), catalog.items(spark, SF), 10))


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_ties_go_by_the_item_in_any_partition_and_slice(spark, monkeypatch, cells):
    monkeypatch.setattr(scan, "_CELLS", cells)
    items = spark.createDataFrame([(k, "same text" if k % 3 else "other words, same") for k in range(60)], "item long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "same"), (2, "text same"), (3, ""), (4, None), (5, "nowhere")], "qid long, text string")
    for at_once in (2, 2_000):
        sparse = {(r.qid, r["rank"]): r["item"] for r in vectors.sparse_topk(asked, items, 4, at_once=at_once).collect()}
        assert [sparse[q, n] for q in (1, 2, 3) for n in (1, 2, 3, 4)] == [1, 2, 4, 5, 1, 2, 4, 5, 0, 1, 2, 3] and len(sparse) == 20
        bm = {(r.qid, r["rank"]): r["item"] for r in lexical.bm25_topk(asked, items, 4, at_once=at_once).collect()}
        assert [bm[q, n] for q in (1, 2) for n in (1, 2, 3, 4)] == [1, 2, 4, 5, 1, 2, 4, 5] and len(bm) == 8


def test_a_partition_holds_few_rows_however_many_go_by():
    block = scan.make_block([7, 8], 3, [[1], [2]], 4)
    kept = scan._Kept(block, ["item"])
    zeros = lambda r, q: np.zeros(len(r), int)
    most = 0
    for n in range(3_000):
        kept.offer(pa.table({"item": np.arange(10) + 10 * n}), 0, np.full((10, 2), 0.5), None, zeros, zeros)
        most = max(most, kept.rows)
    kept.trim()
    assert most <= 10_010 and kept.parts[0]["item"].to_pylist() == [0, 1, 2] * 2


def test_statistics_are_those_of_the_asked_terms(spark):
    """The vocabulary is counted where an index is saved, and nowhere else."""
    index = hybrid.build_index(spark.createDataFrame(CHUNKS, CHUNK), RetrievalConfig())
    asked = spark.createDataFrame([(1, "red word3 nothing"), (2, "the")], "qid long, text string")
    terms, n, avgdl = hybrid.query_stats(replace(index, term_stats=None, corpus=None), asked)
    want = {r.term: r.idf for r in index.term_stats.collect()}
    size = index.corpus.first()
    assert (n, avgdl) == (size.n, pytest.approx(size.avgdl))
    assert {r.term: r.idf for r in terms.collect()} == {t: want.get(t) and pytest.approx(want[t]) for t in ("red", "word3", "nothing")}


def test_a_saved_index_counts_over_what_it_wrote(spark, tmp_path):
    index = hybrid.build_index(spark.createDataFrame(CHUNKS, CHUNK), RetrievalConfig())
    store.save_index(replace(index, term_stats=None, corpus=None), str(tmp_path))
    back = store.load_index(spark, str(tmp_path))
    assert sorted(map(tuple, back.term_stats.collect())) == [(t, df, pytest.approx(w)) for t, df, w in sorted(map(tuple, index.term_stats.collect()))]
    assert tuple(back.corpus.first()) == tuple(index.corpus.first())


def test_texts_that_contain_a_part(spark):
    r = random.Random(3)
    letters = ["ab", "Ab", "b", " ", " ", ".", "-", "ж", "Σ", "σας", "\n", "😀"]
    text = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    texts = [(k, text(40)) for k in range(300)] + [(300, None), (301, "")]
    parts = [(k, text(7)) for k in range(60)] + [(60, None), (61, ""), (62, texts[5][1]), (63, texts[9][1][3:-2])]
    t, p = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(parts, "id long, part string")
    got = containing(t, p, "id")
    assert sorted(map(tuple, got.collect())) == sorted((d, k) for d, x in texts for k, y in parts if x is not None and y is not None and y in x)


def test_long_parts_are_not_compared_with_every_text(spark):
    t = spark.createDataFrame([(1, "one two three four"), (2, "five")], "doc long, text string")
    p = spark.createDataFrame([(1, "one two three")], "id long, part string")
    assert "word" in plan(containing(t, p, "id")) and [tuple(r) for r in containing(t, p, "id").collect()] == [(1, 1)]


def test_sentences_and_chunks_stay_in_the_jvm(spark):
    r = random.Random(1)
    pieces = ["a", "b.", ". ", ".", " ", "! ", "?", "…", "… ", "ж", "\n", "x y", "😀", " "]
    rows = [(k, "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))) for k in range(3_000)] + [(3_000, "word " * 100_000), (3_001, "a. " * 50_000), (3_002, None)]
    df = spark.createDataFrame(rows, "k long, text string")
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "x", "x")
    sent = df.select("k", chunking.clean_markdown(flat).alias("flat"), chunking.sentences(F.col("text")).alias("s"))
    sizes = [(300, 60), (3, 1), (4, 0), (2, 5)]
    packed = df.select("k", chunking.clean_markdown(flat).alias("flat"), *[F.when((F.col("k") < 3_000) | (F.lit(s) == 300), chunking.pack(F.col("text"), s, o)).alias(f"p{s}") for s, o in sizes])
    assert "Python" not in plan(sent.select("s")) + plan(packed)
    from quillmesh.functions.text import squeeze

    bare = {x.k: x.f for x in df.select("k", squeeze(flat).alias("f")).collect()}
    assert all(x.s == chunking.split_sentences(bare[x.k]) for x in sent.collect())
    for x in packed.collect():
        found = chunking.split_sentences(x.flat)
        assert all(x[f"p{s}"] is None and x.k >= 3_000 or x[f"p{s}"] == chunking.pack_sentences(found, s, o) for s, o in sizes)
