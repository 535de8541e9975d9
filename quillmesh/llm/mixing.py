"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in the order of a seeded hash.  A document's virtual finish
time is the number of the source's tokens up to and including it, divided by the source's
target weight; documents are served in the order of finish times (then source, hash,
doc_id) while the tokens served stay within the budget, so at every moment the sources
have been served in proportion to their weights for as long as they last.

Both running sums are distributed: a source's queue is split by hash prefix and the
global order by range partition; sums of the parts before are added to running sums
within a part, so no task holds a whole source, however hot.

Defined cases: null doc_id: left out, as nothing could refer to it.  Null source: the
source "".  Null or empty text: no tokens; such a document takes the finish time of the
one before it.  Repeated doc_ids: one document with the most tokens and the least source
of its rows.  Very long texts: by their tokens like any other.  Ties: as said, by source,
hash and doc_id.  A source without a weight: ``default_weight``; weights must be positive.
Extra columns: ignored, or kept by ``keep_served``.  Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, n_tokens, project, table, unused

WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06}
DEFAULT_WEIGHT = 0.04
BUDGET = 0.7
SEED = "mix-1"


def place_in_queue(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = DEFAULT_WEIGHT,
    budget_share: float = BUDGET,
    budget_tokens: int | None = None,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, source, tokens, finish, served) of the documents served; served counts tokens up to and including each."""
    weights = WEIGHTS if weights is None else weights
    if not all(math.isfinite(w) and w > 0 for w in [default_weight, *weights.values()]):
        raise ValueError("weights must be positive")
    rows = project(docs, doc_id=("doc_id", "long"), source=("source", "string"), text=("text", "string"))
    rows = (
        rows.where("doc_id is not null")
        .select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("tokens"))
        .groupBy("doc_id")
        .agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))
        .withColumn("key", place_in_queue(F.col("doc_id"), seed))
        .withColumn("part", F.substring("key", 1, 2))
    )
    rows = cut(rows)
    sums = rows.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    queue = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.lit(float(default_weight))
    if weights:
        pairs = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.try_element_at(pairs, F.col("source")), weight)
    queued = rows.join(sums, ["source", "part"]).withColumn("upto", F.col("ahead") + F.sum("tokens").over(queue))
    queued = queued.select("doc_id", "source", "tokens", "key", (F.col("upto").cast("double") / weight).alias("finish"))
    order = ["finish", "source", "key", "doc_id"]
    ranged = cut(queued.repartitionByRange(*order).withColumn("place", F.spark_partition_id()))
    places = ranged.groupBy("place").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    line = Window.partitionBy("place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    served = ranged.join(places, "place").withColumn("served", F.col("before") + F.sum("tokens").over(line))
    budget = F.lit(budget_tokens) if budget_tokens is not None else F.floor(F.col("total") * F.lit(float(budget_share)))
    return served.where(F.col("served") <= budget).select("doc_id", "source", "tokens", "finish", "served")


def keep_served(docs: DataFrame, seed: str = SEED, most_sources: int = 50_000, **settings) -> DataFrame:
    """The rows of docs that ``mix`` serves, with all their columns.

    What is served of a source is the front of its queue, so the last one served tells for each row whether it is, and
    text isn't shuffled: the last ones, one row a source, are broadcast if there are at most ``most_sources``.  Beyond
    that, or where rows of one doc_id name several sources, rows are looked up by doc_id.
    """
    served = cut(mix(docs, seed=seed, **settings).select("doc_id", "source"))
    rows = project(docs, doc_id=("doc_id", "long"), source=("source", "string")).where("doc_id is not null")
    source = F.coalesce("source", F.lit(""))
    torn = rows.groupBy("doc_id").agg(F.min(source).alias("a"), F.max(source).alias("b")).where("a <> b")
    last_name, source_name, id_name = (unused(docs, n) for n in ("last", "queue", "served"))
    last = served.groupBy(F.col("source").alias(source_name)).agg(F.max(F.struct(place_in_queue(F.col("doc_id"), seed).alias("key"), F.col("doc_id"))).alias(last_name))
    doc_id = docs["doc_id"].cast("long")
    if not torn.isEmpty() or last.limit(most_sources + 1).count() > most_sources:
        return docs.join(served.select(F.col("doc_id").alias(id_name)), doc_id == F.col(id_name), "left_semi")
    here = F.struct(place_in_queue(doc_id, seed).alias("key"), doc_id.alias("doc_id"))
    found = docs.join(F.broadcast(last), (F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col(source_name)) & (here <= F.col(last_name)), "left_semi")
    return found


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_WHEN = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in WEIGHTS.items())
ORACLE = rf"""
WITH d AS (
    SELECT doc_id, min(coalesce(source, '')) AS source,
           max(coalesce(length(regexp_extract_all(text, '[^ \t\r\n]+')), 0)) AS tokens
    FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT *, md5('{SEED}:' || doc_id) AS key, CASE source {_WHEN} ELSE {DEFAULT_WEIGHT}::DOUBLE END AS w FROM d),
f AS (SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING))::DOUBLE / w AS finish FROM k),
g AS (SELECT *, sum(tokens) OVER (ORDER BY finish, source, key, doc_id ROWS UNBOUNDED PRECEDING) AS served FROM f)
SELECT doc_id, source, tokens::BIGINT AS tokens, finish, served::BIGINT AS served FROM g
WHERE served <= floor((SELECT sum(tokens) FROM d)::DOUBLE * {BUDGET}::DOUBLE)
"""
