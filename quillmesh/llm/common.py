"""What the operators share: input projection, shared folders, materialised intermediates.

Every operator first projects the columns that it needs to names of its own, so extra
columns of the input, clashing names included, neither break it nor reach its result.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[^ \t\r\n]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """``project(df, own_name=("column", "type"))``; a missing column is an error."""
    missing = sorted({c for c, _ in columns.values()} - set(df.columns))
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[df[c].cast(t).alias(own) for own, (c, t) in columns.items()])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder where spark.checkpoint.dir names one; a folder of our own only where unset, on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmesh-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def n_tokens(text: Column) -> Column:
    """Whitespace-separated tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, rows: int, n: int, *keys: str) -> DataFrame:
    """The n rows (of about ``rows``) with the least hash of the keys among a hash class of about 2 n.

    The class is taken first, so what the tasks send to order and cut doesn't grow with the table.  Rows with equal keys
    are in one class, so where keys repeat the sample may fall short of n.
    """
    classes = rows // (2 * n)
    if classes > 1:
        df = df.where(F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(classes)) == 0)
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)
