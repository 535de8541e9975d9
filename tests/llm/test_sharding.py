from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import sharding


def naive(sizes, capacity):
    """Best fit decreasing, one group at a time: loads of the bins."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b, r in enumerate(left) if r >= s]
        if s > capacity:
            left.append(capacity - s)
        elif fits:
            left[min(fits, key=lambda b: left[b])] -= s
        else:
            left.append(capacity - s)
    return Counter(capacity - r for r in left)


def loads(runs, sizes):
    counts, got = Counter(sizes), Counter()
    for size, lo, hi, base, per in runs:
        for rank in range(lo, hi):
            got[base + (rank - lo) // per] += size
        counts[size] -= hi - lo
    assert not any(counts.values())
    return got


@pytest.mark.parametrize("seed", range(40))
def test_packing_equals_group_by_group(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 64, 1000, 4096])
    top = rng.choice([3, capacity, 2 * capacity, capacity // 3 + 1])
    sizes = [rng.randint(0, top) for _ in range(rng.randint(0, 300))]
    runs, opened = sharding.pack(list(Counter(sizes).items()), capacity)
    got = loads(runs, sizes)
    assert Counter(got.values()) == naive(sizes, capacity) and opened == len(got)


def test_tree_finds_successors():
    rng = random.Random(3)
    tree, keys = sharding.CapacityTree(1 << 20), set()
    for _ in range(4000):
        k = rng.randint(0, 1 << 20)
        if k in keys:
            tree.remove(k)
            keys.remove(k)
        else:
            tree.add(k)
            keys.add(k)
        q = rng.randint(0, 1 << 20)
        assert tree.at_least(q) == min((x for x in keys if x >= q), default=None)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.assign(docs, 20_000).collect()
    groups, first = Counter(), {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
        groups[first[texts[i]]] += len(texts[i].encode())
    assert {r.doc_id: (r.group_id, r.n_bytes) for r in got} == {i: (first[t], len(t.encode())) for i, t in texts.items()}
    where = {}
    for r in got:
        assert where.setdefault(r.group_id, r.shard) == r.shard
    full = Counter()
    for r in got:
        full[r.shard] += r.n_bytes
    assert Counter(full.values()) == naive(groups.values(), 20_000)


def test_defined_cases(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "abc"), (5, "abc"), (6, "abc"), (None, "abc"), (7, "x" * 5000), (8, "y" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("q")).withColumn("size", F.lit(1)).withColumn("h0", F.lit(0))
    got = {r.doc_id: (r.group_id, r.n_bytes, r.shard) for r in sharding.assign(df, 100).collect()}
    assert len(got) == 8 and got[3][0] == got[4][0] == 3 and got[1][0] == 1 and got[2][0] == 2 and got[5][0] == got[6][0] == 5
    assert got[7][2] not in {v[2] for k, v in got.items() if k != 7} and got[5][2] == got[6][2] == got[8][2]
    assert sharding.assign(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(df, 0)
