"""SimHash near-duplicate detection with vantage-point trees over exact block search.

A document's fingerprint has 128 bits: each lower-cased word votes with its hash bits,
weighted by a damped count (integers, so sums don't depend on the order).  Two documents
are near duplicates when their fingerprints differ in at most ``radius`` bits; groups are
the connected components of that relation and the smallest doc_id of a group stays.

The search is exact.  A fingerprint's bits fall into blocks with a small reach each, such
that reaches + 1 add up to ``radius + 1``; a pair that differs by more than its reach in
every block is beyond the radius (pigeonhole), so searching each block with its reach finds
every pair.  Blocks are somewhat wider than the binary logarithm of the number of
fingerprints (16 to 32 bits): what a block's ball holds then grows far more slowly than the
corpus.

The top levels of a vantage-point tree for each block, fitted on a sample, are shards: a
fingerprint is stored in the shard that it falls into and visits each shard that its ball
overlaps by the triangle bound; a shard with many visitors is searched in slices, each with
all that is stored.  Within a slice the keys of a ball (a block's first ``KEY_BITS`` bits)
are looked up one mask at a time for all visitors at once; a pair is met from its greater
value, so half a ball does.  Where a ball has more keys than a slice has fingerprints, a tree over
the distinct values is searched instead, level by level; branches go by the least and
greatest distance to their vantage point.  What is met is compared on all 128 bits.  The
sample decides how even shards are, never what is found.

Pairs grow with the square of a group's texts, so a slice gives none of them: it gives each
fingerprint that is in one with a representative of its component and its least distance.
``near_pairs`` gives the pairs themselves, each by the first block that can find it.

Defined cases: null doc_id: no row.  Null, empty or blank text: no fingerprint; its own
group, kept.  Text without word characters: its stripped form is the only feature.  Very
long texts: read whole.  Repeated doc_ids: one row; with several texts it belongs to the
group with the smallest id.  Copies share one fingerprint and cost one entry however many.
Ties: none, as the smallest doc_id decides.  Extra columns: ignored.  Empty table: no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_sample, cut, project, table

RADIUS = 19
SHARD_ROWS, SLICE_ROWS = 1_048_576, 524_288
SAMPLE_PER_SHARD = 64
LEAF = 16
KEY_BITS = 25
_WORD = re.compile(r"\w+")
_WEIGHTS = np.array([0] + [round(16 * (1 + math.log(c))) for c in range(1, 4096)], np.float32)


def damped(counts: np.ndarray) -> np.ndarray:
    """The weight of a word that occurs so often in a text."""
    weights = _WEIGHTS.take(counts, mode="clip")
    for i in np.flatnonzero(counts >= len(_WEIGHTS)):
        weights[i] = round(16 * (1 + math.log(counts[i])))
    return weights


class Digests(dict):
    """word -> the row of its 128-bit hash in ``rows()``."""

    def __init__(self):
        super().__init__()
        self.raw = bytearray()

    def __missing__(self, word: str) -> int:
        self.raw += xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))
        at = self[word] = len(self)
        return at

    def rows(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8).reshape(-1, 16)


def simhash(texts: list[str], tokens_at_once: int = 16_384, known: Digests | None = None) -> np.ndarray:
    """(n, 2) int64 fingerprints; texts must have at least one feature."""
    known = Digests() if known is None else known
    out = np.zeros((len(texts), 2), np.int64)

    def flush(first: int, words: list[int], ends: list[int]) -> None:
        n = len(ends)
        key = np.array(words, np.int64)
        key += np.repeat(np.arange(n) << 32, np.diff(ends, prepend=0))
        key.sort()
        at = np.flatnonzero(np.diff(key, prepend=-1))
        weights = damped(np.diff(at, append=len(key)))
        key = key[at]
        edges = np.searchsorted(key, np.arange(n + 1) << 32)
        total = np.add.reduceat(weights.astype(np.float64), edges[:-1])
        bits = np.unpackbits(known.rows()[key & 0xFFFFFFFF], axis=1).astype(np.float32)
        votes = np.empty((n, 128))
        for i, (lo, hi) in enumerate(itertools.pairwise(edges.tolist())):
            exact = weights[lo:hi] if total[i] < 1 << 24 else weights[lo:hi].astype(np.float64)  # integers that float32 can add in any order
            votes[i] = exact @ bits[lo:hi]
        out[first : first + n] = np.packbits(2 * votes > total[:, None], axis=1).view(">i8").astype(np.int64)

    first, words, ends = 0, [], []
    for i, text in enumerate(texts):
        words.extend(map(known.__getitem__, _WORD.findall(text.lower()) or [text.strip()]))
        ends.append(len(words))
        if len(words) >= tokens_at_once:
            flush(first, words, ends)
            first, words, ends = i + 1, [], []
    if ends:
        flush(first, words, ends)
    return out


def _fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Digests()
    for pdf in batches:
        if len(known) > 200_000:
            known = Digests()
        fp = simhash(pdf["text"].tolist(), known=known)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "f0": fp[:, 0], "f1": fp[:, 1]})


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    return rows.mapInPandas(_fingerprint_batches, "doc_id long, f0 long, f1 long")


class Block(NamedTuple):
    """Bits lo to hi of a fingerprint, searched with so many differing bits."""

    lo: int
    hi: int
    reach: int

    def of(self, f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
        high, low = f0.view(np.uint64), f1.view(np.uint64)
        mask = np.uint64((1 << self.hi - self.lo) - 1)
        if self.hi <= 64:
            return (high >> np.uint64(64 - self.hi) & mask).astype(np.uint32)
        if self.lo >= 64:
            return (low >> np.uint64(128 - self.hi) & mask).astype(np.uint32)
        return ((high << np.uint64(self.hi - 64) | low >> np.uint64(128 - self.hi)) & mask).astype(np.uint32)


def blocks_for(n: int, radius: int) -> list[Block]:
    """Blocks for n fingerprints; reaches + 1 add up to radius + 1, and a block that isn't needed is left out."""
    k = 128 // min(32, max(16, (max(n, 2) - 1).bit_length() + 1))
    edges = [128 * i // k for i in range(k + 1)]
    reaches = [(radius + 1) // k + (i < (radius + 1) % k) - 1 for i in range(k)]
    return [Block(lo, hi, reach) for lo, hi, reach in zip(edges, edges[1:], reaches) if reach >= 0]


def _pick(values: np.ndarray) -> tuple[int, int] | None:
    """A vantage point among evenly spaced candidates and the median distance to it: the most even split."""
    best = None
    for v in values[:: max(1, len(values) // 8)][:8]:
        d = np.bitwise_count(values ^ v)
        mu = int(np.median(d))
        for m in (mu, mu - 1):
            inside = int((d <= m).sum())
            gap = abs(2 * inside - len(values))
            if 0 < inside < len(values) and (best is None or gap < best[0]):
                best = (gap, int(v), m)
    return best and best[1:]


def grow(values: np.ndarray, depth: int) -> list[list[int]]:
    """Top of a tree: nodes [vantage, bound, inner, outer], or [-1, leaf, 0, 0]; node 0 is the root."""
    nodes: list[list[int]] = []
    leaves = 0

    def build(v: np.ndarray, left: int) -> int:
        nonlocal leaves
        at = len(nodes)
        split = _pick(v) if left and len(v) > 1 else None
        if split is None:
            nodes.append([-1, leaves, 0, 0])
            leaves += 1
            return at
        nodes.append([split[0], split[1], 0, 0])
        d = np.bitwise_count(v ^ np.uint32(split[0]))
        nodes[at][2] = build(v[d <= split[1]], left - 1)
        nodes[at][3] = build(v[d > split[1]], left - 1)
        return at

    build(values, depth)
    return nodes


def route(values: np.ndarray, nodes: list[list[int]], reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf: the rows whose ball overlaps it, and whether it is their own."""
    stack = [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while stack:
        at, rows, home = stack.pop()
        vantage, bound, inner, outer = nodes[at]
        if vantage < 0:
            yield bound, rows, home
            continue
        d = np.bitwise_count(values[rows] ^ np.uint32(vantage)).astype(np.int16)
        for child, near, own in ((inner, d - reach <= bound, d <= bound), (outer, d + reach > bound, d > bound)):
            if near.any():
                stack.append((child, rows[near], home[near] & own[near]))


class Tree:
    """A vantage-point tree over distinct values, held as arrays and built level by level."""

    def __init__(self, values: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(values))
        start, size = np.zeros(1, np.int64), np.full(1, len(values), np.int64)
        self.levels: list[dict[str, np.ndarray]] = []
        while len(start):
            inner = size > leaf
            level = {"start": start, "size": size, "child": np.where(inner, 2 * (np.cumsum(inner) - 1), -1)}
            s, n = start[inner], size[inner]
            segment = np.repeat(np.arange(len(s)), n)
            at = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
            vantage = values[order[s]]
            d = np.bitwise_count(values[order[at]] ^ vantage[segment]).astype(np.int64)
            key = segment * 64 + d
            turn = np.argsort(key, kind="stable")
            order[at], key = order[at[turn]], key[turn]
            first = np.cumsum(n) - n
            middle = key[first + (n - 1) // 2]
            cut = np.stack([np.searchsorted(key, middle, "left"), np.searchsorted(key, middle, "right")]) - first
            cut = np.where((cut > 0) & (cut < n), cut, -n)
            cut = np.where(np.abs(2 * cut[0] - n) <= np.abs(2 * cut[1] - n), cut[0], cut[1])
            near = lambda i: (key[i] & 63).astype(np.int16)
            full = lambda x: np.zeros(len(start), x.dtype)
            for name, x in (("vantage", vantage), ("in_lo", near(first)), ("in_hi", near(first + cut - 1)), ("out_lo", near(first + cut)), ("out_hi", near(first + n - 1))):
                level[name] = full(x)
                level[name][inner] = x
            self.levels.append(level)
            start, size = np.stack([s, s + cut], axis=1).ravel(), np.stack([cut, n - cut], axis=1).ravel()
        self.order, self.values = order, values[order]

    def within(self, asked: np.ndarray, reach: int, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in the values, positions in asked) of all pairs within reach."""
        for k in range(0, len(asked), at_once):
            some = asked[k : k + at_once]
            q, node = np.arange(len(some)), np.zeros(len(some), np.int64)
            for level in self.levels:
                child = level["child"][node]
                leaf = child < 0
                if leaf.any():
                    at, who = node[leaf], q[leaf]
                    n = level["size"][at]
                    who, offset = np.repeat(who, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    spot = np.repeat(level["start"][at], n) + offset
                    hit = np.bitwise_count(self.values[spot] ^ some[who]) <= reach
                    if hit.any():
                        yield self.order[spot[hit]], who[hit] + k
                    node, q, child = node[~leaf], q[~leaf], child[~leaf]
                d = np.bitwise_count(level["vantage"][node] ^ some[q]).astype(np.int16)
                low, high = d - reach, d + reach
                inner = (low <= level["in_hi"][node]) & (high >= level["in_lo"][node])
                outer = (low <= level["out_hi"][node]) & (high >= level["out_lo"][node])
                node, q = np.concatenate([child[inner], child[outer] + 1]), np.concatenate([q[inner], q[outer]])
                if not len(q):
                    break


def _members(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, and for each: where its rows start in the last array, and how many they are."""
    order = np.argsort(values, kind="stable")
    distinct, start, count = np.unique(values[order], return_index=True, return_counts=True)
    return distinct, start, count, order


def _products(a: tuple, b: tuple, v: np.ndarray, q: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a with value v against rows of b with value q, for all pairs (v, q), in pieces of about ``most``."""
    na, nb = a[2][v], b[2][q]
    total = np.cumsum(na * nb)
    at = 0
    while at < len(v):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n, w = na[at:upto] * nb[at:upto], nb[at:upto]
        for lo in range(0, int(n.sum()), most) if upto == at + 1 else (0,):
            pair = np.repeat(np.arange(len(n)), n)[lo : lo + most] if upto == at + 1 else np.repeat(np.arange(len(n)), n)
            offset = np.arange(lo, lo + len(pair)) - np.repeat(np.cumsum(n) - n, n)[lo : lo + len(pair)]
            yield a[3][a[1][v[at:upto]][pair] + offset // w[pair]], b[3][b[1][q[at:upto]][pair] + offset % w[pair]]
        at = upto


def ball(width: int, reach: int) -> int:
    """How many values differ from one in at most so many of its bits."""
    return sum(math.comb(width, i) for i in range(min(width, reach) + 1))


def masks_below(top: int, reach: int) -> np.ndarray:
    """All values with bit ``top`` set, none above and at most ``reach`` in all; for top -1 the value 0 alone."""
    lower = [[1 << i for i in c] for r in range(reach) for c in itertools.combinations(range(top), r)] if top >= 0 else [[]]
    return np.array([sum(c) + (1 << top if top >= 0 else 0) for c in lower], np.int64)


class Keys:
    """Sorted keys, repeats included: a flag for each possible key, and bits counted by words, which lead from a key to its rows."""

    def __init__(self, keys: np.ndarray, width: int):
        distinct, self.start, self.count = np.unique(keys, return_index=True, return_counts=True)
        self.there = np.zeros(max(64, 1 << width), bool)
        self.there[distinct] = True
        self.bits = np.packbits(self.there, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int32)

    def rows(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the asked keys that there are: their positions in asked, where their rows start and how many they are."""
        at = np.flatnonzero(self.there.take(asked))
        keys = asked[at]
        word = keys >> 6
        rank = self.before[word] - np.bitwise_count(self.bits[word] >> (keys & 63).astype(np.uint64))
        return at, self.start[rank], self.count[rank]


def near_in_balls(stored: np.ndarray, asked: np.ndarray, width: int, reach: int, sides: tuple[np.ndarray, np.ndarray], most: int, at_once: int = 32_768, pairs_at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in stored, in asked) where the sorted keys are within reach, the stored one is not the greater, and the
    sides (a word of each fingerprint) differ in at most ``most`` bits.  Looks up every key of the lower half of a ball."""
    table = Keys(stored, width)
    for top in range(-1, width if reach else 0):
        some = np.flatnonzero(asked >> top & 1) if top >= 0 else np.arange(len(asked))
        masks = masks_below(top, reach)
        for k in range(0, len(some), at_once):
            rows = some[k : k + at_once]
            keys, side = asked[rows], sides[1][rows]
            for mask in masks:
                at, start, n = table.rows(keys ^ mask)
                end = np.cumsum(n)
                lo = 0
                while lo < len(at):
                    done = int(end[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(end, done + pairs_at_once, "right")))
                    m, upto = n[lo:hi], end[lo:hi] - done
                    x = np.repeat(start[lo:hi] - upto + m, m)
                    x += np.arange(len(x))
                    near = np.nonzero(np.bitwise_count(sides[0][x] ^ np.repeat(side[at[lo:hi]], m)) <= most)[0]
                    if len(near):
                        yield x[near], rows[at[lo + np.searchsorted(upto, near, "right")]]
                    lo = hi


def _near(block: Block, pdf: pd.DataFrame, radius: int, at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a slice within the radius and the block's reach, each once, with their distance: of a pair, the one with the greater value asks."""
    f0, f1, rep, kind = (pdf[c].to_numpy() for c in ("f0", "f1", "rep", "kind"))
    u0, u1 = f0.view(np.uint64), f1.view(np.uint64)
    values = block.of(f0, f1)
    stored, asked = (np.flatnonzero(kind & bit) for bit in (1, 2))
    stored, asked = (rows[np.argsort(values[rows], kind="stable")] for rows in (stored, asked))
    if not len(stored) or not len(asked):
        return
    width = min(block.hi - block.lo, KEY_BITS)
    shift = block.hi - block.lo - width

    def candidates() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if ball(width, block.reach) <= len(stored):
            side = u1 if block.lo + block.hi <= 128 else u0
            keys = (values[rows].astype(np.int64) >> shift for rows in (stored, asked))
            yield from near_in_balls(*keys, width, block.reach, (side[stored], side[asked]), radius)
        else:
            a, b = _members(values[stored]), _members(values[asked])
            for v, q in Tree(a[0]).within(b[0], block.reach):
                yield from _products(a, b, v, q)

    for x, y in _gathered(candidates(), at_once):
        x, y = stored[x], asked[y]
        d = np.bitwise_count(u0[x] ^ u0[y]) + np.bitwise_count(u1[x] ^ u1[y])
        near = d <= radius
        x, y, d = x[near], y[near], d[near].astype(np.int32)
        near = (values[x] < values[y]) | (values[x] == values[y]) & (rep[x] < rep[y])
        near &= np.bitwise_count(values[x] ^ values[y]) <= block.reach
        yield x[near], y[near], d[near]


def _gathered(pieces: Iterator[tuple[np.ndarray, np.ndarray]], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= at_once:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def search(blocks: list[Block], k: int, pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """All pairs of a slice that block k must report; kind 1: stored, 2: asked, 3: both."""
    f0, f1, rep = (pdf[c].to_numpy() for c in ("f0", "f1", "rep"))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for x, y, d in _near(blocks[k], pdf, radius):
        for other in blocks[:k]:
            mine = np.bitwise_count(other.of(f0[x], f1[x]) ^ other.of(f0[y], f1[y])) > other.reach
            x, y, d = x[mine], y[mine], d[mine]
        found.append((np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y]), d))
    a, b, d = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"a": a, "b": b, "dist": d})


class Forest:
    """Connected components of rows 0 to n - 1: label[i] is the least row of i's component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.label[x], self.label[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = self.label[self.label]
                if (above == self.label).all():
                    break
                self.label = above


def links(blocks: list[Block], k: int, pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """What the pairs that block k finds in a slice come to: of each fingerprint in one, a fingerprint that stands for its
    component within the slice, and the least distance to another.  Rows grow with the fingerprints, not with the pairs."""
    rep = pdf["rep"].to_numpy()
    forest, nearest = Forest(len(pdf)), np.full(len(pdf), 128, np.int32)
    for x, y, d in _near(blocks[k], pdf, radius):
        np.minimum.at(nearest, x, d)
        np.minimum.at(nearest, y, d)
        forest.join(x, y)
    rows = np.flatnonzero(nearest < 128)
    return pd.DataFrame({"a": rep[rows], "b": rep[forest.label[rows]], "dist": nearest[rows]})


def _by_slice(what: Callable, prints: DataFrame, radius: int, shard_rows: int, slice_rows: int) -> DataFrame:
    """``what`` of each slice of each block, as (a, b, dist)."""
    if not 0 <= radius < 128:
        raise ValueError("radius must be from 0 to 127")
    n = prints.count()
    blocks = blocks_for(n, radius)
    depth = max(0, math.ceil(math.log2(n / shard_rows))) if n else 0
    rows = bounded_sample(prints.select("f0", "f1"), n, SAMPLE_PER_SHARD << depth, "f0", "f1").collect() if depth else []
    s0, s1 = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    trees = [grow(b.of(s0, s1), depth) for b in blocks]
    slices: list[dict[int, int]] = []
    for b, tree in zip(blocks, trees):
        visits = {leaf: len(at) / len(rows) for leaf, at, _ in route(b.of(s0, s1), tree, b.reach)} if rows else {}
        slices.append({leaf: max(1, round(visits.get(leaf, 1.0) * n / slice_rows)) for leaf in range(len(tree) // 2 + 1)})

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f0, f1, rep = (pdf[c].to_numpy() for c in ("f0", "f1", "rep"))
            turn = (f0.view(np.uint64) ^ f1.view(np.uint64)) >> np.uint64(20)
            for k, (block, tree) in enumerate(zip(blocks, trees)):
                for leaf, at, home in route(block.of(f0, f1), tree, block.reach):
                    m = slices[k][leaf]
                    own = (turn[at] % np.uint64(m)).astype(np.int64)
                    for part in range(m):
                        asked = own == part
                        kind = home.astype(np.int8) + 2 * asked.astype(np.int8)
                        sent = kind > 0
                        rows = at[sent]
                        yield pd.DataFrame({"block": np.full(len(rows), k, np.int32), "leaf": np.full(len(rows), leaf, np.int32), "slice": np.full(len(rows), part, np.int32), "f0": f0[rows], "f1": f1[rows], "rep": rep[rows], "kind": kind[sent]})

    def found(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return what(blocks, int(key[0]), pdf, radius)

    sent = prints.select("f0", "f1", "rep").mapInPandas(send, "block int, leaf int, slice int, f0 long, f1 long, rep long, kind byte")
    return sent.groupBy("block", "leaf", "slice").applyInPandas(found, "a long, b long, dist int")


def near_pairs(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Of distinct fingerprints (f0, f1, rep): every pair within the radius, as (a, b, dist) of reps, a < b."""
    return _by_slice(search, prints, radius, shard_rows, slice_rows)


def near_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(a, b, dist) with the components and the least distances of near_pairs, without its pairs: see ``links``; b may be a."""
    return _by_slice(links, prints, radius, shard_rows, slice_rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; labels of neighbours, then labels of labels, until none changes."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        seen = both.join(labels.toDF("other", "theirs"), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(seen, "node").select("node", F.least("label", "theirs").alias("label"), F.col("label").alias("was"))
        root = labels.toDF("label", "above")
        step = step.join(root, "label").select("node", F.least("label", "above").alias("label"), "was")
        step = cut(step)
        if step.where("label < was").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, group_id, nearest, keep) for every document.

    group_id is the smallest doc_id of the group, nearest the least distance to another document
    within the radius (null without one), keep whether the document is the one that stays.
    """
    prints = cut(fingerprints(docs).dropDuplicates())
    distinct = cut(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    found = cut(near_links(distinct, radius, shard_rows))
    nearest = found.groupBy(F.col("a").alias("rep")).agg(F.min("dist").alias("dist"))
    of = (
        distinct.join(components(found.where("a <> b")).toDF("rep", "label"), "rep", "left")
        .join(nearest, "rep", "left")
        .select("f0", "f1", F.coalesce("label", "rep").alias("group"), F.when(F.col("copies") > 1, 0).otherwise(F.col("dist")).alias("near"))
    )
    every = project(docs, doc_id=("doc_id", "long")).where("doc_id is not null")
    grouped = prints.join(of, ["f0", "f1"]).select("doc_id", "group", "near")
    return (
        every.select("doc_id", F.lit(None).cast("long").alias("group"), F.lit(None).cast("int").alias("near"))
        .union(grouped)
        .groupBy("doc_id")
        .agg(F.min("group").alias("group"), F.min("near").alias("nearest"))
        .select("doc_id", F.coalesce("group", "doc_id").alias("group_id"), "nearest")
        .withColumn("keep", F.col("group_id") == F.col("doc_id"))
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
