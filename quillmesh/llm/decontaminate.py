"""Benchmark decontamination: every passage of the corpus queries a BM25 index of test items.

Passages are overlapping token windows, twice as long as the longest item and half
overlapping, so an item that occurs in a document lies whole in one of them.  Scores are
BM25 of the passage's distinct terms against an item, divided by the item's score against
itself; every item with at least ``threshold`` is retrieved and then verified: shares of
the word trigrams of its question and of its answer that occur in the passage.

Retrieval is exact.  Each item's commonest terms, up to ``residue`` of its self-score, are
its residue; an item can only reach the threshold if its other terms reach
``threshold - residue``.  A first pass, vectorised over all passages, adds up list maxima
of those terms, then block maxima, and drops passages that cannot reach that.  The rest run
block-max WAND: cursors over postings sorted by item, a pivot where list maxima could
reach the threshold, a check of the pivot's block maxima, which skips whole blocks, and
only then the score.

The index is made of the test items alone (driver-side, shipped in parts of at most
``items_per_part``); the corpus is scanned once for each part and never shuffled.

Question and answer of an item: what is before and after its last question mark; without
one, all sentences but the last, and the last; an item of a single sentence is both.

Defined cases: null or empty texts have no passages; null or wordless items are ignored;
null doc_id: no row (the pipeline's filter judges such rows too); repeated doc_ids: one row
for each item; items with equal texts are all retrieved.  Very long texts: more windows.
Ties between passages: the earliest.  Extra columns: ignored, or kept by the pipeline's
filter.  Empty tables: no rows.  The test items are read on the driver; more text than
``MOST_BYTES`` is an error, as the index of all of it is shipped to every executor.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import project, table

THRESHOLD = 0.6
RESIDUE = 0.3
OVERLAP = 0.5
K1, B = 1.2, 0.75
BLOCK = 16
ITEMS_PER_PART = 20_000
MOST_BYTES = 256 << 20
EPS = 1e-9
_WORD = re.compile(r"\w+")
_FIELDS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, position int"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(tokens: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[str, str]:
    at = text.rfind("?") + 1
    if at and words(text[:at]) and words(text[at:]):
        return text[:at], text[at:]
    parts = [p for p in re.split(r"(?<=[.!?…])\s+", text.strip()) if words(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Index:
    """Postings of a part of the items; impacts are shares of the item's self-score."""

    items: list[int]
    stride: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    lists: list[tuple[list[int], list[float], list[float]]] = field(default_factory=list)  # items, impacts, block maxima
    top: list[float] = field(default_factory=list)
    strong: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # by strong term and item block
    strong_id: dict[str, int] = field(default_factory=dict)
    questions: list[tuple[set, set]] = field(default_factory=list)


def build(items: list[tuple[int, str]], threshold: float = THRESHOLD, residue: float = RESIDUE, items_per_part: int = ITEMS_PER_PART) -> list[Index]:
    known = [(i, t, Counter(words(t))) for i, t in sorted(items, key=lambda x: (x[0], x[1]))]
    known = [x for x in known if x[2]]
    df = Counter(w for _, _, c in known for w in c)
    n, mean = len(known), sum(sum(c.values()) for _, _, c in known) / max(1, len(known))
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    stride = max([sum(c.values()) for _, _, c in known], default=1)
    residue = min(residue, threshold / 2)
    parts = []
    for start in range(0, n, items_per_part):
        part = known[start : start + items_per_part]
        index = Index([i for i, _, _ in part], stride)
        postings: dict[str, list[tuple[int, float]]] = {}
        strong: dict[str, list[tuple[int, float]]] = {}
        for at, (_, text, counts) in enumerate(part):
            norm = K1 * (1 - B + B * sum(counts.values()) / mean)
            raw = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            own, left = sum(raw.values()), residue
            for w in sorted(raw, key=lambda w: (-df[w], w)):
                share = raw[w] / own
                postings.setdefault(w, []).append((at, share))
                left -= share
                if left < 0:
                    strong.setdefault(w, []).append((at, share))
            q, a = question_and_answer(text)
            index.questions.append((grams(words(q)), grams(words(a))))
        for w in sorted(postings):
            index.vocabulary[w] = len(index.lists)
            at, share = [p for p, _ in postings[w]], [s for _, s in postings[w]]
            index.lists.append((at, share, [max(share[k : k + BLOCK]) for k in range(0, len(share), BLOCK)]))
            index.top.append(max(share))
        blocks = min(64, max(1, len(part) // 8))
        index.strong = np.zeros((len(strong), blocks + 1), np.float32)
        for k, w in enumerate(sorted(strong)):
            index.strong_id[w] = k
            for at, share in strong[w]:
                b = 1 + at * blocks // len(part)
                index.strong[k, b] = max(index.strong[k, b], share)
                index.strong[k, 0] = max(index.strong[k, 0], share)
        parts.append(index)
    return parts


def wand(index: Index, terms: set[int], threshold: float) -> list[tuple[int, float]]:
    """Items whose score against the terms is at least the threshold, by block-max WAND."""
    goal = threshold - EPS
    cursors = [[index.lists[t][0][0], 0, t] for t in terms]  # current item, position, term
    found = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(cursors):
            bound += index.top[t]
            if bound >= goal:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, after = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(index.items)
        for c in cursors[: pivot + 1]:
            at = index.lists[c[2]][0]
            block = bisect.bisect_left(at, item, c[1]) // BLOCK
            if block * BLOCK < len(at):
                bound += index.lists[c[2]][2][block]
                after = min(after, at[min(block * BLOCK + BLOCK, len(at)) - 1] + 1)
        if bound < goal:
            target = max(after, item + 1)
        elif cursors[0][0] == item:
            score = math.fsum(index.lists[t][1][p] for at, p, t in cursors[: pivot + 1])
            if score >= goal:
                found.append((item, score))
            target = item + 1
        else:
            target = item
        moved = []
        for c in cursors[: pivot + 1]:
            at = index.lists[c[2]][0]
            p = bisect.bisect_left(at, target, c[1])
            if p < len(at):
                moved.append([at[p], p, c[2]])
        cursors = moved + cursors[pivot + 1 :]
    return found


def candidates(index: Index, token_lists: list[list[str]], threshold: float, residue: float) -> list[tuple[int, int]]:
    """(text, window) that could reach the threshold; window w covers tokens from w * stride for two strides."""
    get, stride = index.strong_id.get, index.stride
    rows, positions, terms = [], [], []
    for row, tokens in enumerate(token_lists):
        ids = list(map(get, tokens))
        for k, t in enumerate(ids):
            if t is not None:
                rows.append(row)
                positions.append(k)
                terms.append(t)
    if not rows:
        return []
    row, window, term = np.array(rows, np.int64), np.array(positions, np.int64) // stride, np.array(terms, np.int64)
    earlier = window > 0
    row, window, term = np.concatenate([row, row[earlier]]), np.concatenate([window, window[earlier] - 1]), np.concatenate([term, term[earlier]])
    widest, n_terms = int(window.max()) + 1, len(index.strong_id)
    key = np.unique((row * widest + window) * n_terms + term)
    place, term = key // n_terms, key % n_terms
    starts = np.nonzero(np.r_[True, place[1:] != place[:-1]])[0]
    goal = threshold - min(residue, threshold / 2) - 1e-4
    maxima = np.add.reduceat(index.strong[term, 0], starts)
    alive = maxima >= goal
    if not alive.any():
        return []
    chosen = np.repeat(alive, np.diff(np.r_[starts, len(place)]))
    place, term = place[chosen], term[chosen]
    starts = np.nonzero(np.r_[True, place[1:] != place[:-1]])[0]
    kept = []
    step = 65_536
    for k in range(0, len(starts), step):
        lo, hi = starts[k], starts[k + step] if k + step < len(starts) else len(place)
        sums = np.add.reduceat(index.strong[term[lo:hi], 1:], starts[k : k + step] - lo, axis=0)
        kept.append(place[starts[k : k + step]][(sums >= goal).any(axis=1)])
    return [(int(p) // widest, int(p) % widest) for p in np.concatenate(kept)]


def retrieve(index: Index, texts: list[str], threshold: float = THRESHOLD, residue: float = RESIDUE, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item_id, score, question overlap, answer overlap, position) of verified hits: the best passage for each text and item."""
    token_lists = [words(t) for t in texts]
    best: dict[tuple[int, int], tuple] = {}
    for row, window in candidates(index, token_lists, threshold, residue):
        tokens = token_lists[row][window * index.stride : (window + 2) * index.stride]
        terms = {t for t in map(index.vocabulary.get, set(tokens)) if t is not None}
        hits = wand(index, terms, threshold)
        if not hits:
            continue
        for item, score in hits:
            asked, answered = (len([g for g in side if g in _grams_of(tokens, side)]) / max(1, len(side)) for side in index.questions[item])
            if asked >= overlap and answered >= overlap:
                entry = (round(score, 9), round(asked, 9), round(answered, 9), -window * index.stride)
                at = (row, item)
                if at not in best or entry > best[at]:
                    best[at] = entry
    return [(row, index.items[item], s, q, a, -p) for (row, item), (s, q, a, p) in sorted(best.items())]


def _grams_of(tokens: list[str], like: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    n = len(next(iter(like))) if like else 0
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def load_items(benchmark: DataFrame) -> list[tuple[int, str]]:
    rows = project(benchmark, item_id=("item_id", "long"), text=("text", "string")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of test items; split them, {MOST_BYTES} at once")
    return [(r["item_id"], r["text"]) for r in rows.distinct().collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, position): verified hits, the best passage of each document and item."""
    spark = docs.sparkSession
    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string")).where("doc_id is not null and text is not null")

    def scan(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k in range(0, len(pdf), 512):
                    some = pdf.iloc[k : k + 512]
                    hits = retrieve(shared.value, some["text"].tolist(), threshold, RESIDUE, overlap)
                    ids = some["doc_id"].to_numpy()
                    yield pd.DataFrame([(ids[h[0]], *h[1:]) for h in hits], columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "position"])

        return rows.mapInPandas(look, _FIELDS)

    parts = build(load_items(benchmark), threshold, RESIDUE, items_per_part)
    if not parts:
        return spark.createDataFrame([], _FIELDS)
    hits = reduce(DataFrame.union, map(scan, parts))
    rank = F.struct("score", "question_overlap", "answer_overlap", -F.col("position"))
    best = hits.groupBy("doc_id", "item_id").agg(F.max(rank).alias("best"))
    return best.select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", (-F.col("best").getField("col4")).alias("position"))


def without_test_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs without a verified hit, with all their columns; rows stay where they are, so nothing is shuffled."""
    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(p) for p in build(load_items(benchmark), threshold)]
    where = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                texts = [t or "" for t in some.column(where).to_pylist()]
                hit = {h[0] for p in parts for h in retrieve(p.value, texts, threshold, RESIDUE, overlap)}
                yield some.filter(pa.array([i not in hit for i in range(len(texts))], pa.bool_())) if hit else some

    return docs.mapInArrow(clean, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
