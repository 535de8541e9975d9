"""The corpus pipeline: documents to sharded training data in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where docs is what
the stage before kept, and returns a DataFrame.  All but the last return the columns of
documents.  ``run`` applies them to the documents table, each stage's result written as
Parquet to a folder of its own under the shared checkpoint folder and read again by the
next one.

Rows with a null doc_id go through the first three stages like any other row, as a text can
be judged without an id; mixing, which has to name what it serves, leaves them out.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import ensure_checkpoint_dir, table, unused
from quillmesh.llm.decontaminate import without_test_items
from quillmesh.llm.mixing import keep_served
from quillmesh.llm.near_dedup import near_duplicates
from quillmesh.llm.quality import keep_good
from quillmesh.llm.sharding import assign


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a risk-controlled rule rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays, one row for each doc_id; text is shuffled once, by doc_id."""
    gone_name, nth_name = unused(docs, "gone"), unused(docs, "nth")
    gone = near_duplicates(docs).where(~F.col("keep")).select(F.col("doc_id").alias(gone_name))
    named = docs.where(docs["doc_id"].isNotNull())
    left = named.join(gone, named["doc_id"] == F.col(gone_name), "left_anti")
    nth = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    first = left.withColumn(nth_name, F.row_number().over(nth)).where(F.col(nth_name) == 1).drop(nth_name)
    return first.unionByName(docs.where(docs["doc_id"].isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified test item go."""
    return without_test_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that weighted fair queueing serves within the budget stay."""
    return keep_served(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of its shard, in the column ``shard``, which replaces one of that name."""
    id_name, shard_name = unused(docs, "placed"), unused(docs, "shard")
    placed = assign(docs).select(F.col("doc_id").alias(id_name), F.col("shard").alias(shard_name))
    joined = docs.join(placed, docs["doc_id"] == F.col(id_name)).drop(id_name)
    return joined if shard_name == "shard" else joined.drop("shard").withColumnRenamed(shard_name, "shard")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Hash fingerprints, binomial tails and bin packing are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
