"""Reversible incremental line dedup: sharded cuckoo filters over exact reference counts.

A line's key is a 128-bit hash of the line without surrounding blanks; keys are spread over
shards, as many as ``SHARD_KEYS`` asks for.  For each shard there is a cuckoo filter (16-bit
fingerprints, four to a bucket).  Beside them are exact tables: the occurrences of each
document's lines, so that it can be taken out again, and for each key the number of its
occurrences and its owner, the first occurrence in the order of doc_id and position.

The tables are logs: each step appends rows of its generation and rewrites none.  Insertion
asks the filters first: a key that a filter doesn't know is new and is appended unread;
only the others are looked up, and appended with their new count.  Deletion appends the
document ids and the new counts and owners of the keys touched; keys that reach zero leave
the filter.  A key's latest row counts.  After ``COMPACT_EVERY`` steps the logs are merged.
So the state only depends on the documents in it, not on the order in which they came or on
others that have gone again, and a step writes in proportion to its batch (it scans the
older tables where keys must be looked up).

Deduplication removes a line where it isn't its key's owner.  Blank lines are always kept.

Defined cases: null doc_id: left out.  Null text: no lines, null text.  Empty text: one
blank line.  Very long texts: all their lines.  Repeated rows: one document, returned once
for each row; other rows with the same doc_id are further versions of it, ordered by the
hash of their text.  Ties between owners: none, as (doc_id, position, version) is unique.
A document that is inserted twice counts once; deleting an unknown one does nothing.  Extra
columns: ignored.  Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, project, table

SHARD_KEYS = 1 << 18
SLOTS, KICKS, LOAD = 4, 400, 0.8
COMPACT_EVERY = 16
CHURN = 8
_KEY = ["h0", "h1"]
_OWNER = "struct<doc_id: bigint, pos: int, ver: bigint>"
_FILTER = "shard int, cells binary, stash binary, n long"
_REFS = f"h0 long, h1 long, refs long, owner {_OWNER}, again boolean, gen int"
_ASKED = "shard int, h0 long, h1 long, refs long, doc_id long, pos int, ver long, maybe boolean"
_OCCURRENCES = "doc_id long, ver long, pos int, h0 long, h1 long, gen int"
_MEMBERS = "doc_id long, ver long, gen int"
_GONE = "doc_id long, gen int"


class CuckooFilter:
    """Of distinct 128-bit keys; what finds no place after KICKS moves is kept in a stash."""

    def __init__(self, cells: np.ndarray, stash: np.ndarray, n: int):
        self.cells, self.stash, self.n = cells, stash, n
        self.mask = np.uint64(len(cells) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros((0, 2), np.int64), 0)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = keys.view(np.uint64)
        mark = (u[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = u[:, 0] >> np.uint64(24) & self.mask  # not the lowest bits, which a shard's keys share
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & self.mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        found = (self.cells[first] == mark[:, None]).any(axis=1) | (self.cells[second] == mark[:, None]).any(axis=1)
        if len(self.stash):
            known = set(map(tuple, self.stash.tolist()))
            found |= np.array([tuple(k) in known for k in keys.tolist()], bool)
        return found

    def add(self, keys: np.ndarray) -> None:
        """keys that aren't in it."""
        mark, first, second = self._places(keys)
        rest = np.arange(len(keys))
        for place in (first, second):
            order = rest[np.argsort(place[rest], kind="stable")]
            at = place[order]
            start = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0)) if len(at) else at.astype(np.int64)
            free = self.cells[at] == 0
            fits = nth < free.sum(axis=1)
            slot = (np.cumsum(free, axis=1) == (nth + 1)[:, None]).argmax(axis=1)
            self.cells[at[fits], slot[fits]] = mark[order[fits]]
            rest = order[~fits]
        rng = np.random.default_rng(len(keys))
        homeless = []
        for k in rest.tolist():
            m, at, trail = mark[k], int(second[k]), []
            for _ in range(KICKS):
                empty = np.nonzero(self.cells[at] == 0)[0]
                if len(empty):
                    self.cells[at, empty[0]] = m
                    break
                slot = int(rng.integers(SLOTS))
                trail.append((at, slot, m))
                m, self.cells[at, slot] = self.cells[at, slot], m
                at = at ^ int(self._jump(np.array([m], np.uint16))[0])
            else:
                for at, slot, put in reversed(trail):  # take the moves back, so that no other key loses its place
                    self.cells[at, slot], m = m, put
                homeless.append(k)
        if homeless:
            self.stash = np.concatenate([self.stash, keys[homeless]])
        self.n += len(keys)

    def remove(self, keys: np.ndarray) -> None:
        """keys that are in it."""
        stashed = {tuple(k) for k in self.stash.tolist()}
        gone = set()
        mark, first, second = self._places(keys)
        for k, m, a, b in zip(map(tuple, keys.tolist()), mark, first, second):
            if k in stashed:
                gone.add(k)
                continue
            for at in (a, b):
                hit = np.nonzero(self.cells[at] == m)[0]
                if len(hit):
                    self.cells[at, hit[0]] = 0
                    break
        if gone:
            self.stash = np.array([k for k in self.stash.tolist() if tuple(k) not in gone], np.int64).reshape(-1, 2)
        self.n -= len(keys)

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "cells": [self.cells.tobytes()], "stash": [self.stash.tobytes()], "n": [self.n]})

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> CuckooFilter | None:
        if not len(pdf):
            return None
        r = pdf.iloc[0]
        return cls(np.frombuffer(r["cells"], np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(r["stash"], np.int64).reshape(-1, 2), int(r["n"]))


def _pairs(pdf: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(pdf[["h0", "h1"]].to_numpy(np.int64))


def _probe(key: tuple, new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    known = CuckooFilter.of(filters)
    new["maybe"] = known.has(_pairs(new)) if known and len(new) else np.zeros(len(new), bool)
    return new


def _extend(key: tuple, new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    known = CuckooFilter.of(filters)
    if known is None:
        known = CuckooFilter.sized(len(new))
    if known.n + len(new) > known.cells.size * LOAD:  # too small: to be rebuilt from the exact table
        return pd.DataFrame({"shard": [key[0]], "cells": [None], "stash": [None], "n": [-1]})
    if len(new):
        known.add(_pairs(new))
    return known.row(key[0])


def _build(key: tuple, every: pd.DataFrame) -> pd.DataFrame:
    known = CuckooFilter.sized(2 * len(every))
    known.add(_pairs(every))
    return known.row(key[0])


def _shrink(key: tuple, gone: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    known = CuckooFilter.of(filters)
    if known is None:
        return pd.DataFrame({"shard": [], "cells": [], "stash": [], "n": []})
    if len(gone):
        known.remove(_pairs(gone))
    return known.row(key[0])


def versions(docs: DataFrame) -> DataFrame:
    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string")).where("doc_id is not null")
    return rows.withColumn("ver", F.xxhash64("text"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ver, pos, h0, h1) of every line of every row; a blank line has no key."""
    each = versions(docs).where("text is not null").select("doc_id", "ver", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = F.btrim("line", F.lit(" \t\r"))
    return each.select("doc_id", "ver", "pos", F.when(bare != "", F.xxhash64(bare)).alias("h0"), F.when(bare != "", F.xxhash64(F.lit(1), bare)).alias("h1"))


def _counted(occurrences: DataFrame) -> DataFrame:
    owner = F.min(F.struct("doc_id", "pos", "ver")).alias("owner")
    return occurrences.where("h0 is not null").groupBy(*_KEY).agg(F.count("*").alias("refs"), owner)


def _latest(refs: DataFrame) -> DataFrame:
    """(h0, h1, refs, owner): the row of the last generation for each key."""
    last = F.max_by(F.struct("refs", "owner"), "gen").alias("last")
    return refs.groupBy(*_KEY).agg(last).select(*_KEY, "last.refs", "last.owner")


def _shards_for(keys: int) -> int:
    return 1 << max(0, (max(keys, 1) - 1) // SHARD_KEYS).bit_length()


@dataclass(frozen=True)
class LineIndex:
    """The state; each step returns a new one.  ``gen`` counts the steps, ``deleted`` tells whether any was a deletion."""

    occurrences: DataFrame
    members: DataFrame
    gone: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int = 1
    gen: int = 0
    layers: int = 0
    deleted: bool = False

    @classmethod
    def empty(cls, spark: SparkSession) -> LineIndex:
        return cls(*(spark.createDataFrame([], schema) for schema in (_OCCURRENCES, _MEMBERS, _GONE, _REFS, _FILTER)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        rest = spark.read.parquet(f"{path}/steps").first()
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in cls.parts()), rest["shards"], rest["gen"], rest["layers"], rest["deleted"])

    @staticmethod
    def parts() -> tuple[str, ...]:
        return "occurrences", "members", "gone", "refs", "filters"

    def save(self, path: str) -> None:
        for part in self.parts():
            getattr(self, part).write.mode("overwrite").parquet(f"{path}/{part}")
        steps = self.refs.sparkSession.createDataFrame([(self.shards, self.gen, self.layers, self.deleted)], "shards int, gen int, layers int, deleted boolean")
        steps.write.mode("overwrite").parquet(f"{path}/steps")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Of rows with doc_id and gen: those that no later deletion took."""
        if not self.deleted:
            return rows
        last = self.gone.groupBy("doc_id").agg(F.max("gen").alias("end"))
        return rows.join(last, "doc_id", "left").where("end is null or gen > end").drop("end")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod("h0", F.lit(self.shards)).cast("int"))

    def insert(self, docs: DataFrame) -> LineIndex:
        gen = self.gen + 1
        here = self._alive(self.members).select("doc_id", "ver").distinct()
        new = lines(docs).join(here, ["doc_id", "ver"], "left_anti").dropDuplicates(["doc_id", "ver", "pos"])  # of repeated rows; keys only, no text
        new = cut(new.withColumn("gen", F.lit(gen)))
        counted = _counted(new)
        if self.gen:
            flat = self._sharded(counted.select(*_KEY, "refs", "owner.doc_id", "owner.pos", "owner.ver"))
            asked = cut(flat.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, _ASKED))
            asked = asked.select(*_KEY, "refs", F.struct("doc_id", "pos", "ver").alias("owner"), "maybe")
            fresh = asked.where("not maybe").select(*_KEY, "refs", "owner", F.lit(False).alias("again"), F.lit(True).alias("unknown"))
            check = asked.where("maybe").select(*_KEY, F.col("refs").alias("more"), F.col("owner").alias("claim"))
            known = _latest(self.refs.join(check.select(*_KEY), _KEY, "left_semi"))
            looked = check.join(known, _KEY, "left").select(
                *_KEY,
                (F.coalesce("refs", F.lit(0)) + F.col("more")).alias("refs"),
                F.least("owner", "claim").alias("owner"),
                F.col("refs").isNotNull().alias("again"),
                (F.coalesce("refs", F.lit(0)) == 0).alias("unknown"),
            )
            layer = cut(fresh.unionByName(looked))
        else:
            layer = cut(counted.select("*", F.lit(False).alias("again"), F.lit(True).alias("unknown")))
        state = replace(
            self,
            occurrences=self.occurrences.unionByName(new),
            members=cut(self.members.unionByName(new.select("doc_id", "ver", "gen").distinct())),
            refs=self.refs.unionByName(layer.drop("unknown").withColumn("gen", F.lit(gen))),
            gen=gen,
            layers=self.layers + 1,
        )
        return state._learn(layer.where("unknown").select(*_KEY))._compacted()

    def _learn(self, added: DataFrame) -> LineIndex:
        """Keys that were in no filter go into theirs; all filters are built anew where there are too many keys for the shards."""
        held = self.filters.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + added.count()
        shards = max(self.shards, _shards_for(held))
        if shards > self.shards or self.layers == 1:
            state = replace(self, shards=shards)
            return replace(state, filters=cut(state._rebuilt(state._alive_keys())))
        filters = cut(self._sharded(added).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_extend, _FILTER))
        small = filters.where("cells is null").select("shard")
        if not small.isEmpty():
            keys = self._sharded(self._alive_keys()).join(F.broadcast(small), "shard", "left_semi").select(*_KEY)
            filters = cut(filters.where("cells is not null").unionByName(self._rebuilt(keys)))
        return replace(self, filters=filters)

    def _alive_keys(self) -> DataFrame:
        return _latest(self.refs).where("refs > 0").select(*_KEY) if self.layers > 1 else self.refs.where("refs > 0").select(*_KEY)

    def _rebuilt(self, keys: DataFrame) -> DataFrame:
        return self._sharded(keys).groupBy("shard").applyInPandas(_build, _FILTER)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """doc_ids: a column doc_id."""
        gen = self.gen + 1
        ids = cut(project(doc_ids, doc_id=("doc_id", "long")).where("doc_id is not null").distinct())
        alive = self._alive(self.occurrences).where("h0 is not null")
        touched = cut(alive.join(ids, "doc_id", "left_semi").select(*_KEY).distinct())
        left = _counted(alive.join(touched, _KEY, "left_semi").join(ids, "doc_id", "left_anti"))
        layer = cut(touched.join(left, _KEY, "left").select(*_KEY, F.coalesce("refs", F.lit(0)).alias("refs"), "owner", F.lit(True).alias("again")))
        dead = self._sharded(layer.where("refs = 0").select(*_KEY))
        filters = dead.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_shrink, _FILTER)
        return replace(
            self,
            gone=self.gone.unionByName(ids.withColumn("gen", F.lit(gen))),
            refs=self.refs.unionByName(layer.withColumn("gen", F.lit(gen))),
            filters=cut(filters),
            gen=gen,
            layers=self.layers + 1,
            deleted=True,
        )._compacted()

    def _compacted(self) -> LineIndex:
        return self.compact() if self.layers >= COMPACT_EVERY else self

    def compact(self) -> LineIndex:
        """The same state with one row for each occurrence, document and key."""
        gone = self.refs.sparkSession.createDataFrame([], _GONE)
        refs = _latest(self.refs).where("refs > 0").select(*_KEY, "refs", "owner", F.lit(False).alias("again"), F.lit(self.gen).alias("gen"))
        return replace(self, occurrences=cut(self._alive(self.occurrences)), members=cut(self._alive(self.members)), gone=gone, refs=cut(refs), layers=1, deleted=False)

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, n_lines, n_removed) for each row of docs, which must have been inserted."""
        shared = _latest(self.refs.where("refs > 1 or again")).where("refs > 1").select(*_KEY, "owner")
        extra = self._alive(self.occurrences).join(shared, _KEY).where(F.col("owner") != F.struct("doc_id", "pos", "ver"))
        masks = extra.groupBy("doc_id", "ver").agg(F.sort_array(F.collect_list("pos")).alias("removed"))
        rows = versions(docs).join(masks, ["doc_id", "ver"], "left")
        split = F.split("text", "\n")
        # the stretches between removed lines: after each of -1 and the removed ones, up to the next of these or the end
        stops = F.concat(F.array(F.lit(-1)), F.col("removed"))
        stretch = lambda a, i: F.slice(split, a + 2, F.coalesce(F.get("removed", i), F.size(split)) - a - 1)
        text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.transform(stops, stretch)), "\n"))
        count = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
        n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
        return rows.select("doc_id", text.alias("text"), count.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus inserted in two batches by hash of doc_id, the second deleted and inserted again; then deduplicated."""
    docs = table(spark, sf_dir, "documents")
    last = F.pmod(F.xxhash64("doc_id"), F.lit(CHURN)) == 0
    index = LineIndex.empty(spark).insert(docs.where(~last)).insert(docs.where(last))
    return index.delete(docs.where(last).select("doc_id")).insert(docs.where(last)).deduplicate(docs)


ORACLE = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
r AS (SELECT *, bare = '' OR row_number() OVER (PARTITION BY bare ORDER BY doc_id, pos) = 1 AS kept FROM k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS text,
       count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT kept)::BIGINT AS n_removed
FROM r GROUP BY doc_id
"""
