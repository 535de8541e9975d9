"""JSON lines with explicit schemas: malformed rows fail, missing keys are null, null keys are kept on writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import CHUNK, NOTE, VALIDATION


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, NOTE)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CHUNK)


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    """With a key ``qid``."""
    return read_jsonl(spark, path, VALIDATION).withColumn("qid", F.monotonically_increasing_id())


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df
