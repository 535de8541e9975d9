"""Scoring of all rows against a block of queries: each partition keeps its best few for each query and leg.

Rows come with hashed tokens (``buckets``, leg 0) or lexical tokens (``terms``, leg 1) or both, or with all their
``tokens`` and the number of lexical ones (``dl``), which are then hashed in the same Python, and go by in slices; a slice is two products of matrices, and only rows that reach a query's last place so far are looked
at again.  What leaves a partition is queries x legs x keep rows at most, and nothing is shuffled before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

#: Numbers in a matrix of a slice; rows that a partition holds for each query, leg and place before it sorts them out.
_CELLS, _SLACK = 1 << 20, 4
#: Rows whose tokens are hashed together, each token once.  Asked terms up to which others are left out before rows go to Python.
HASHED_AT_ONCE, _MOST_TERMS = 1_024, 4_000


@dataclass
class Block:
    """Queries as the tasks need them.  matrix: buckets x queries, unit columns; terms: distinct, with their idf; each query's terms and keywords are numbers of terms, -1 where there are fewer."""

    qids: list
    keep: int
    matrix: np.ndarray | None = None
    terms: list[str] | None = None
    idf: np.ndarray | None = None
    asked: np.ndarray | None = None
    keywords: np.ndarray | None = None
    avgdl: float = 1.0
    k1: float = 1.2
    b: float = 0.75
    flags: np.ndarray | None = field(default=None, repr=False)


def bucket_lists(tokens: pa.ListArray, dim: int) -> pa.ListArray:
    """The bucket of each token: the first four bytes of its MD5 digest, little-endian, modulo dim."""
    coded = tokens.flatten().dictionary_encode()
    of = [int.from_bytes(md5(t.encode()).digest()[:4], "little") % dim for t in coded.dictionary.to_pylist()]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(of, pa.int32()).take(coded.indices))


def _padded(lists: list[list[int]]) -> np.ndarray:
    out = np.full((len(lists), max([1, *map(len, lists)])), -1)
    for row, found in zip(out, lists):
        row[: len(found)] = found
    return out


def unit_columns(buckets: list[list[int]], dim: int) -> np.ndarray:
    matrix = np.zeros((dim, len(buckets)))
    for q, found in enumerate(buckets):
        np.add.at(matrix[:, q], np.asarray(found, int), 1)
    return matrix / (np.sqrt((matrix**2).sum(axis=0)) + 1e-12)


def make_block(qids: list, keep: int, buckets: list[list[int]] | None = None, dim: int = 0, terms: list[list[tuple[str, float | None]]] | None = None, keywords: list[list[str]] | None = None, avgdl: float | None = None, k1: float = 1.2, b: float = 0.75) -> Block:
    """terms: of each query in its order, distinct, with the idf, null where no row has it."""
    block = Block(qids, keep, avgdl=avgdl or 1.0, k1=k1, b=b)
    if buckets is not None:
        block.matrix = unit_columns(buckets, dim)
    if terms is not None:
        idf = {t: w or 0.0 for found in terms for t, w in found}
        number = {t: n for n, t in enumerate(idf)}
        block.terms, block.idf = list(idf), np.array(list(idf.values()), float)
        block.asked = _padded([[number[t] for t, _ in found] for found in terms])
        block.keywords = _padded([[number[t] for t in found or ()] for found in keywords or [[]] * len(qids)])
        block.flags = np.zeros((len(idf), len(qids)))
        for q, found in enumerate(terms):
            block.flags[[number[t] for t, _ in found], q] = 1
    return block


def _counts(lists: pa.Array, numbers: np.ndarray, width: int) -> np.ndarray:
    """rows x width: how often each number is in each list; numbers below 0 don't count."""
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    known = numbers >= 0
    return np.bincount(row[known] * width + numbers[known], minlength=len(lists) * width).reshape(len(lists), width)


class _Kept:
    """What a partition holds: for each leg and query the rows that may be among its best."""

    def __init__(self, block: Block, order: list[str]):
        self.block, self.order = block, order
        self.top = {leg: np.full((len(block.qids), block.keep), -np.inf) for leg in (0, 1)}
        self.parts: list[pa.Table] = []
        self.rows = 0

    def offer(self, rows: pa.Table, leg: int, score: np.ndarray, matched: np.ndarray | None, first, overlap) -> None:
        """score: rows x queries, rounded; first(rows, queries) and overlap(rows, queries) are asked for what is kept."""
        keep, top = self.block.keep, self.top[leg]
        good = score >= top[:, -1]
        if matched is not None:
            good &= matched
        if not good.any():
            return
        q, row = np.nonzero(good.T)
        value, place = score[row, q], first(row, q)
        # Rows are in the order of their keys.
        order = np.lexsort((row, place, -value, q))
        q, row, value, place = q[order], row[order], value[order], place[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < keep
        q, row, value, place = q[kept], row[kept], value[kept], place[kept]
        found = rows.take(pa.array(row))
        for name, column in (("_q", q), ("leg", np.full(len(q), leg, np.int32)), ("score", value), ("first", place.astype(np.int32)), ("overlap", overlap(row, q).astype(np.int32))):
            found = found.append_column(name, pa.array(column))
        self.parts.append(found)
        self.rows += len(q)
        asked = np.unique(q)
        every = np.concatenate([np.repeat(asked, keep), q])
        value = np.concatenate([top[asked].ravel(), value])
        order = np.lexsort((-value, every))
        kept = np.arange(len(every)) - np.searchsorted(every[order], every[order]) < keep
        top[asked] = value[order][kept].reshape(-1, keep)
        if self.rows > max(10_000, 2 * _SLACK * keep * len(self.block.qids)):
            self.trim()

    def trim(self) -> None:
        if not self.parts:
            return
        every = pa.concat_tables(self.parts)
        keys = [("_q", "ascending"), ("leg", "ascending"), ("score", "descending"), ("first", "ascending"), *((c, "ascending") for c in self.order)]
        every = every.take(pc.sort_indices(every.select([k for k, _ in keys]), sort_keys=keys, null_placement="at_start"))
        group = every["_q"].to_numpy() * 2 + every["leg"].to_numpy()
        every = every.filter(pa.array(np.arange(len(group)) - np.searchsorted(group, group) < self.block.keep)).combine_chunks()
        self.parts, self.rows = [every], len(every)


def _slice(block: Block, kept: _Kept, rows: pa.Table, buckets: pa.Array | None, terms: pa.Array | None, length: np.ndarray | None, known: pa.Array | None) -> None:
    tf = None
    if terms is not None:
        numbers = pc.fill_null(pc.index_in(terms.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        tf = _counts(terms, numbers, len(block.terms))
    # One more column for the number -1.
    has = None if tf is None else np.hstack([tf > 0, np.zeros((len(tf), 1), bool)])
    overlap = lambda r, q: has[r[:, None], block.keywords[q]].sum(axis=1) if has is not None else np.zeros(len(r))
    if buckets is not None:
        count = _counts(buckets, buckets.flatten().to_numpy(zero_copy_only=False), len(block.matrix)).astype(float)
        norm = np.sqrt((count**2).sum(axis=1)) + 1e-12
        kept.offer(rows, 0, np.round((count @ block.matrix) / norm[:, None], 6), None, lambda r, q: np.zeros(len(r), int), overlap)
    if tf is not None and len(block.terms):
        norm = block.k1 * (1 - block.b + block.b * np.maximum(length, 1) / block.avgdl)
        gain = np.zeros(tf.shape)
        row, term = np.nonzero(tf)
        n = tf[row, term]
        gain[row, term] = block.idf[term] * (n * (block.k1 + 1) / (n + norm[row]))
        score = gain @ block.flags

        def first(r: np.ndarray, q: np.ndarray) -> np.ndarray:
            return has[r[:, None], block.asked[q]].argmax(axis=1)

        kept.offer(rows, 1, np.round(score, 6), score > 0, first, overlap)


def _only(terms: Column, words: list[str]) -> Column:
    return F.filter(terms, lambda t: t.isin(words)) if 0 < len(words) <= _MOST_TERMS else terms


def scan(rows: DataFrame, payload: list[str], order: list[str], qid: str, blocks: list[Block]) -> DataFrame | None:
    """(qid, leg, score, first, *payload, overlap): of every partition its best for each query and leg; ties go by ``first``, the place of the first matching term, then ``order``."""
    schema = StructType().add("qid", qid).add("leg", IntegerType()).add("score", DoubleType()).add("first", IntegerType())
    for c in payload:
        schema = schema.add(rows.schema[c])
    schema = schema.add("overlap", IntegerType())
    arrow, found = to_arrow_schema(schema), None
    for block in blocks:
        whole = "tokens" in rows.columns
        legs = ["tokens"] if whole else ["buckets"] if block.matrix is not None else []
        if block.terms is not None:
            terms = F.col("terms")
            legs.append((F.col("dl") if whole else F.greatest(F.size(terms), F.lit(0))).cast("int").alias("_length"))
            if not whole:
                legs.append(_only(terms, block.terms).alias("terms"))
        source = rows.select(*payload, *legs)
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, whole=whole) -> Iterator[pa.RecordBatch]:
            block = shared.value
            kept = _Kept(block, order)
            known = None if block.terms is None else pa.array(block.terms, pa.string())
            width = max(1 if block.matrix is None else len(block.matrix), 1 if known is None else len(known), len(block.qids))
            step = max(1, _CELLS // width)
            for batch in batches:
                if not len(batch):
                    continue
                keys = pa.table({c: batch[c] for c in order})
                sorted_ = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
                for first in range(0, len(batch), HASHED_AT_ONCE):
                    some = batch.take(sorted_[first : first + HASHED_AT_ONCE])
                    terms = None if known is None else some["tokens" if whole else "terms"]
                    buckets = None if block.matrix is None else bucket_lists(some["tokens"], len(block.matrix)) if whole else some["buckets"]
                    length = None if known is None else some["_length"].to_numpy(zero_copy_only=False)
                    for at in range(0, len(some), step):
                        part = slice(at, at + step)
                        cut = lambda x: None if x is None else x[part]
                        _slice(block, kept, pa.Table.from_batches([some[part].select(payload)]), cut(buckets), cut(terms), cut(length), known)
            kept.trim()
            for every in kept.parts:
                ids = pa.array(block.qids, arrow.field("qid").type).take(every["_q"].combine_chunks())
                yield from pa.table([ids, *(every[c] for c in arrow.names[1:])], schema=arrow).to_batches(max_chunksize=10_000)

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def count_terms(rows: DataFrame, words: list[str]) -> tuple[int, float | None, dict[str, int]]:
    """Number of rows, mean length, and how many rows have each of the words, in one pass over ``terms``."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        having, n, length = np.zeros(len(known) + 1, np.int64), 0, 0
        for batch in batches:
            for at in range(0, len(batch), 1_024):
                terms = batch["terms"][at : at + 1_024]
                sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                n, length = n + len(terms), length + int(batch["_length"][at : at + 1_024].to_numpy().sum())
                number = pc.fill_null(pc.index_in(terms.flatten(), value_set=known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = np.repeat(np.arange(len(terms)), sizes) * len(having) + number
                having += np.bincount(np.unique(pairs) % len(having), minlength=len(having))
        term = np.nonzero(having[:-1])[0]
        yield pa.record_batch([pa.array([*term, -1], pa.int64()), pa.array([*having[term], n], pa.int64()), pa.array([*([0] * len(term)), length], pa.int64())], names=["term", "n", "length"])

    source = rows.select(F.greatest(F.size("terms"), F.lit(0)).cast("long").alias("_length"), _only(F.col("terms"), words).alias("terms"))
    schema = StructType().add("term", LongType()).add("n", LongType()).add("length", LongType())
    found = {r.term: r for r in source.mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()}
    whole = found.pop(-1, None)
    n = whole.n if whole else 0
    return n, whole.length / n if n else None, {words[k]: r.n for k, r in found.items()}
