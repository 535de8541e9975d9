"""Best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Documents with identical text are one indivisible group; its size is the bytes of all its
copies.  Groups in order of falling size go into the shard with the least remaining
capacity that still takes them, or into a new one.

The rule only looks at sizes, and shards with equal remaining capacity are alike, so the
packing is computed over the histogram of sizes, which is what the driver gets: a balanced
64-ary tree holds the remaining capacities, each with the shards that have it, and all
groups of a size that fall into shards of one kind are placed in one step.  The result is
the one that placing group by group gives.  Groups of one size are ranked in parts of about
``PART_ROWS``, so no task holds all of them.  The steps ("runs": size, ranks, first shard,
groups a shard) are joined back to the groups by their rank among those of equal size.

Defined cases: null doc_id: left out.  Null text: a group of its own with size 0, as is
each document of it; empty text: a group with size 0.  Groups of size 0 go into the
fullest shard.  A group beyond the capacity gets a shard of its own.  Ties: smaller
group_id (the least doc_id of the group) first.  Repeated rows count once; of several
texts with one doc_id the longest counts (then the one with the greater hash).  Very long
texts: by their bytes like any other.  Extra columns: ignored.  Empty table: no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, project, table

CAPACITY = 4 << 20
PART_ROWS = 1_000_000
_RUNS = "size long, lo long, hi long, base long, per long"


class CapacityTree:
    """The set of remaining capacities as a 64-ary tree of bitmaps: all leaves are equally deep."""

    def __init__(self, largest: int):
        self.levels: list[dict[int, int]] = [{}]
        while largest >> 6 * len(self.levels):
            self.levels.append({})

    def add(self, key: int) -> None:
        for level in self.levels:
            level[key >> 6] = level.get(key >> 6, 0) | 1 << (key & 63)
            key >>= 6

    def remove(self, key: int) -> None:
        for level in self.levels:
            left = level[key >> 6] & ~(1 << (key & 63))
            if left:
                level[key >> 6] = left
                return
            del level[key >> 6]
            key >>= 6

    def at_least(self, key: int) -> int | None:
        for depth, level in enumerate(self.levels):
            above = level.get(key >> 6, 0) >> (key & 63)
            if above:
                key += (above & -above).bit_length() - 1
                for lower in reversed(self.levels[:depth]):
                    word = lower[key]
                    key = key << 6 | (word & -word).bit_length() - 1
                return key
            key = (key >> 6) + 1
        return None


def pack(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs and the number of shards for (size, groups of that size)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    tree, shards_with = CapacityTree(capacity), {}
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(remaining: int, first: int, n: int) -> None:
        if n:
            if remaining not in shards_with:
                shards_with[remaining] = []
                tree.add(remaining)
            shards_with[remaining].append((first, n))

    for size, count in sorted(histogram, reverse=True):
        at = 0
        if size > capacity:
            runs.append((size, 0, count, opened, 1))
            opened += count
            continue
        while at < count:
            remaining = tree.at_least(size)
            if remaining is None:
                per = capacity // size if size else count
                first, n = opened, -(-(count - at) // per)
                opened += n
                remaining = capacity
            else:
                first, n = shards_with[remaining].pop()
                if not shards_with[remaining]:
                    del shards_with[remaining]
                    tree.remove(remaining)
                per = remaining // size if size else count
            full = min(n, (count - at) // per)
            if full:
                runs.append((size, at, at + full * per, first, per))
                give(remaining - per * size, first, full)
                at += full * per
            if full < n and at < count:
                left = count - at
                runs.append((size, at, count, first + full, left))
                give(remaining - left * size, first + full, 1)
                at, full = count, full + 1
            give(remaining, first + full, n - full)
    return runs, opened


def assign(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, group_id, n_bytes, shard) for every document."""
    spark = docs.sparkSession
    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string")).where("doc_id is not null")
    rows = rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").isNull().alias("missing"),
        F.when(F.col("text").isNull(), F.col("doc_id")).otherwise(F.xxhash64("text")).alias("h0"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(1), "text")).alias("h1"),
    )
    text = ["missing", "h0", "h1"]
    rows = cut(rows.groupBy("doc_id").agg(F.max(F.struct("n_bytes", *text)).alias("one")).select("doc_id", "one.*"))
    groups = cut(rows.groupBy(*text).agg(F.min("doc_id").alias("group_id"), F.sum("n_bytes").alias("size")))
    histogram = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]
    parts = max(1, -(-max([n for _, n in histogram], default=0) // PART_ROWS))
    groups = groups.withColumn("part", F.pmod(F.xxhash64("group_id"), F.lit(parts)))
    counts = groups.groupBy("size", "part").agg(F.count("*").alias("n"))
    runs, _ = pack(histogram, capacity)
    plan = spark.createDataFrame(pd.DataFrame(runs, columns=["size", "lo", "hi", "base", "per"]), _RUNS) if runs else spark.createDataFrame([], _RUNS)
    ahead = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    line = Window.partitionBy("size", "part").orderBy("group_id")
    ranked = groups.join(counts, ["size", "part"]).select("group_id", *text, "size", (F.col("ahead") + F.row_number().over(line) - 1).alias("rank"))
    placed = ranked.join(plan, (ranked["size"] == plan["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select("group_id", *text, (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("long").alias("shard"))
    return rows.join(placed, text).select("doc_id", "group_id", "n_bytes", "shard")


def op6_shard_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
