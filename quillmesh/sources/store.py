"""A saved index: one Parquet folder for each table, written as a new version and switched to at the end."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.plans.hybrid import IndexTables, build_index, corpus_of, hashed_passages, term_stats_of

PARTS = ("chunks", "passages", "term_stats", "corpus", "meta")
_CURRENT = "version string, saved_at long"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the cluster's shared folder, or in a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base or tempfile.mkdtemp(prefix='quillmesh-')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_index(index: IndexTables, path: str) -> None:
    """Fails without chunks.  Readers see the old version until the new one is complete."""
    if index.chunks.isEmpty():
        raise ValueError("nothing to save: no chunks")
    now = time.time_ns()
    version = f"v{now}"
    spark = index.chunks.sparkSession

    def write(part: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{version}/{part}")
        return spark.read.schema(df.schema).parquet(f"{path}/{version}/{part}")

    write("chunks", index.chunks)
    write("meta", index.meta)
    # The statistics are counted over what is written, so that texts are cut into tokens once.
    passages = write("passages", hashed_passages(index.passages))
    corpus = write("corpus", corpus_of(passages))
    write("term_stats", term_stats_of(passages, corpus))
    spark.createDataFrame([(version, now)], _CURRENT).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_index(spark: SparkSession, path: str) -> IndexTables:
    where, fs = _path(spark, f"{path}/versions")
    if not fs.exists(where):
        raise FileNotFoundError(f"no index at {path}")
    version = spark.read.schema(_CURRENT).parquet(f"{path}/versions").orderBy(F.desc("saved_at")).first()["version"]
    return IndexTables(*(spark.read.parquet(f"{path}/{version}/{part}") for part in PARTS), saved=True)


def append_chunks(index: IndexTables, chunks: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> IndexTables:
    """The index with further chunks: their passages are computed, those there are reused; statistics cover all."""
    have = index.meta.first()
    if have["dim"] != cfg.dim or have["backend"] != "hashing":
        raise ValueError(f"the index has {have['backend']} vectors of {have['dim']} dimensions, not hashing vectors of {cfg.dim}")
    missing = set(index.chunks.columns) - set(chunks.columns)
    if missing:
        raise ValueError(f"chunks lack {sorted(missing)}")
    more = build_index(chunks.select(*index.chunks.columns), cfg)
    kept = (lambda p: p) if "tokens" in index.passages.columns else hashed_passages
    passages = kept(index.passages).unionByName(kept(more.passages))
    corpus = corpus_of(passages)
    df = index.term_stats.select("term", "df").unionByName(more.term_stats.select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    from quillmesh.operators.lexical import idf

    stats = df.crossJoin(F.broadcast(corpus)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    return IndexTables(index.chunks.unionByName(chunks.select(*index.chunks.columns)), passages, stats, corpus, index.meta)
