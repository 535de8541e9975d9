from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import line_dedup as ld


def test_filter_knows_all_keys_and_few_others():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    f = ld.CuckooFilter.sized(20_000)
    for part in np.array_split(keys, 7):
        assert f.has(part).mean() < 0.01
        f.add(part)
        assert f.has(part).all()
    assert f.has(keys).all() and len(f.stash) < 50 and f.n == 20_000
    others = rng.integers(-(2**63), 2**63 - 1, (50_000, 2))
    assert f.has(others).mean() < 0.001
    f.remove(keys[:12_000])
    assert f.has(keys[12_000:]).all() and f.has(keys[:12_000]).mean() < 0.002 and f.n == 8_000
    f.remove(keys[12_000:])
    assert not f.cells.any() and not len(f.stash)


def test_overfull_filter_uses_its_stash():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (40, 2))
    f = ld.CuckooFilter.sized(1)
    f.add(keys)
    assert f.has(keys).all() and len(f.stash) >= 36
    again = ld.CuckooFilter.of(f.row(3))
    assert again.has(keys).all()
    again.remove(keys)
    assert not again.cells.any() and not len(again.stash)


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            bare = line.strip(" \t\r")
            if not bare or bare not in seen:
                kept.append(line)
            if bare:
                seen.add(bare)
        out.append((i, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    return out


def table_of(df):
    return sorted(tuple(r) for r in df.collect())


def keys_of(index):
    refs = {(r.h0, r.h1): (r.refs, tuple(r.owner)) for r in ld._latest(index.refs).where("refs > 0").collect()}
    filters = {r.shard: ld.CuckooFilter(np.frombuffer(r.cells, np.uint16).reshape(-1, 4), np.frombuffer(r.stash, np.int64).reshape(-1, 2), r.n) for r in index.filters.collect()}
    for h0, h1 in refs:
        assert filters[h0 % index.shards].has(np.array([[h0, h1]])).all()
    assert sum(f.n for f in filters.values()) == len(refs)
    return refs


def test_increments_and_deletions_are_reversible(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    a, b, c = (docs.where(F.pmod("doc_id", F.lit(3)) == k) for k in range(3))
    empty = ld.LineIndex.empty(spark)
    ab = empty.insert(b).insert(a)
    abc = ab.insert(c)
    assert abc.shards > 1 and abc.shards >= ab.shards
    assert table_of(abc.deduplicate(docs)) == brute(rows) and any(r[3] for r in brute(rows))
    assert keys_of(abc) == keys_of(empty.insert(docs))
    back = abc.delete(c.select("doc_id"))
    assert keys_of(back) == keys_of(ab)
    kept = [r for r in rows if r[0] % 3 != 2]
    assert table_of(back.deduplicate(docs.where("doc_id % 3 != 2"))) == brute(kept)
    forth = back.insert(c)
    assert keys_of(forth) == keys_of(abc) and table_of(forth.deduplicate(docs)) == brute(rows)
    assert keys_of(abc.insert(a)) == keys_of(abc)
    gone = forth.delete(docs.select("doc_id"))
    assert keys_of(gone) == {} and gone._alive(gone.occurrences).count() == 0
    small = forth.compact()
    assert keys_of(small) == keys_of(abc) and small.occurrences.count() == abc.occurrences.count() < forth.occurrences.count()
    assert keys_of(small.delete(c.select("doc_id"))) == keys_of(ab)
    back.save(str(tmp_path / "state"))
    again = ld.LineIndex.load(spark, str(tmp_path / "state"))
    assert keys_of(again) == keys_of(ab) and keys_of(again.insert(c)) == keys_of(abc)


def test_logs_are_merged_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(ld, "COMPACT_EVERY", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = docs.where("doc_id % 2 = 1")
    index = ld.LineIndex.empty(spark).insert(docs).delete(odd.select("doc_id")).insert(odd)
    assert index.layers < 3 and keys_of(index) == keys_of(ld.LineIndex.empty(spark).insert(docs))
    assert table_of(index.deduplicate(docs)) == brute(rows)


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert table_of(ld.op3_line_dedup(spark, d).select("doc_id", "text", "n_lines", "n_removed")) == sorted(con.sql(ld.ORACLE).fetchall())


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a\nb\n\na"), (3, "a\nb\n\na"), (None, "a"), (4, " b \n\nc"), (5, "z\n" * 60_000), (3, "other\na")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("x")).withColumn("ver", F.lit(1)).withColumn("refs", F.lit(1))
    index = ld.LineIndex.empty(spark).insert(df)
    got = sorted((r.doc_id, r.text, r.n_removed) for r in index.deduplicate(df).collect() if r.text is not None)
    assert [g[0] for g in got] == [2, 3, 3, 3, 4, 5]
    assert got[0][1:] == ("", 0) and ("a\nb\n", 1) in [g[1:] for g in got] or ("b\n", 2) in [g[1:] for g in got]
    assert (4, "\nc", 1) in got and [g[2] for g in got if g[0] == 5] == [59_999]
    null = [r for r in index.deduplicate(df).collect() if r.doc_id == 1]
    assert len(null) == 1 and null[0].text is None and null[0].n_lines == 0
    same = [g for g in got if g[0] == 3 and g[1] != "other"]
    assert len(same) >= 2
    nothing = ld.LineIndex.empty(spark).insert(df.limit(0))
    assert nothing.deduplicate(df.limit(0)).collect() == [] and nothing.delete(df.select("doc_id")).refs.count() == 0
    assert keys_of(index.delete(spark.createDataFrame([(999,)], "doc_id long"))) == keys_of(index)
