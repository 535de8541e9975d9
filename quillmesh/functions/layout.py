"""How rows lie: spreading inputs that come in too few pieces, and broadcasts behind a check."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side with at most so many rows (counted, not guessed) is broadcast; beyond that the planner decides.
SMALL_ROWS = 200_000


def spread(df: DataFrame) -> DataFrame:
    """Over all cores where the input has fewer partitions than there are cores; any larger input is left as it is.

    A Parquet file of one row group is one task, whatever its size; text work on it would keep one core busy.  For scans:
    the number of partitions of anything that was shuffled is only known once it has run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checked_broadcast(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_blocks(rows: Iterable, most: int) -> Iterator[list]:
    block: list = []
    for row in rows:
        block.append(row)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block
