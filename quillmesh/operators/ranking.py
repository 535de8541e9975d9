"""From two ranked legs to hits: fusion, boosts, keyword guard, cap by note, top k.

``ranked`` below is (qid, leg, rank, chunk_id, note_id, position, tags, links, overlap): leg
0 is the vector leg, 1 the lexical one, overlap the number of the query's keywords in the
chunk.  It holds queries x overfetch rows, so what follows is small whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.functions import text as tx

_LEG = 1_000_000
_NONE = F.array


def fuse(ranked: DataFrame, rrf_k: int) -> DataFrame:
    """Reciprocal-rank fusion by chunk_id; blank ids keep their rank but are dropped; the payload is the one seen first."""
    seen = F.col("leg") * _LEG + F.col("rank")
    payload = F.struct("note_id", "position", "tags", "links", "overlap")
    fused = (
        ranked.where(F.coalesce("chunk_id", F.lit("")) != "")
        .groupBy("qid", "chunk_id")
        .agg(F.round(F.sum(1.0 / (F.lit(max(1, rrf_k)) + F.col("rank"))), 6).alias("rrf"), F.min(seen).alias("seen"), F.min_by(payload, seen).alias("p"))
    )
    return fused.select("qid", "chunk_id", "rrf", "seen", "p.*")


def aliases(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(alias, note_id): id, id without .md, its last part, title, lower-cased; the first chunk in order wins, then that order of kinds.

    wanted: a small table (alias) to restrict to before anything is shuffled.
    """
    note = F.coalesce("note_id", F.lit(""))
    bare = F.regexp_replace(note, r"(?i)\.md$", "")
    kinds = F.array(note, bare, F.substring_index(bare, "/", -1), tx.strip(F.coalesce("title", F.lit(""))))
    each = chunks.where(note != "").select("note_id", "position", F.posexplode(F.transform(kinds, F.lower)).alias("kind", "alias")).where("alias <> ''")
    if wanted is not None:
        each = each.join(F.broadcast(wanted), "alias", "left_semi")
    return each.groupBy("alias").agg(F.min_by("note_id", F.struct("note_id", "position", "kind")).alias("note_id"))


def link_keys(ranked: DataFrame, first: int) -> DataFrame:
    """(qid, alias, at): link targets of the first vector hits, at their place."""
    hits = ranked.where((F.col("leg") == 0) & (F.col("rank") <= first))
    each = hits.select("qid", "rank", F.posexplode(F.coalesce("links", _NONE().cast("array<string>"))).alias("nth", "link"))
    key = F.lower(tx.strip(F.substring_index(F.substring_index(tx.strip(F.col("link")), "|", 1), "#", 1)))
    return each.where(tx.strip(F.col("link")) != "").select("qid", key.alias("alias"), F.struct("rank", "nth").alias("at"))


def related_notes(keys: DataFrame, alias_table: DataFrame, most: int) -> DataFrame:
    """(qid, note_id): the first ``most`` distinct notes that the links lead to."""
    found = keys.join(alias_table, "alias").groupBy("qid", "note_id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("qid").orderBy("at", "note_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("qid", "note_id")


def tag_overlap(wanted: Column, tags: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.size(F.array_intersect(F.coalesce(wanted, empty), F.transform(F.filter(F.coalesce(tags, empty), lambda t: t != ""), F.lower)))


def keywords(terms: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """(qid, keywords) from (qid, term, at, idf or null): latin letters or digits, or rare; the first in query order."""
    kept = terms.where(F.col("term").rlike("[a-z0-9ıſ]") | (F.coalesce("idf", F.lit(0.0)) >= cfg.keyword_idf_min))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    kept = kept.withColumn("nth", nth).where(F.col("nth") <= cfg.keyword_max)
    return kept.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]).alias("keywords"))


def rescore(fused: DataFrame, asked: DataFrame, related: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """Adds ``score``; asked: (qid, qtags, n_keywords)."""
    linked = related.select("qid", "note_id", F.lit(True).alias("linked"))
    rows = fused.join(F.broadcast(asked), "qid", "left").join(F.broadcast(linked), ["qid", "note_id"], "left")
    score = F.col("rrf") + cfg.tag_boost * tag_overlap(F.col("qtags"), F.col("tags")) + F.when(F.col("linked"), cfg.link_boost).otherwise(0.0)
    if cfg.keyword_guard:
        guard = F.when(F.col("overlap") == 0, -cfg.keyword_penalty).otherwise(cfg.keyword_bonus * F.col("overlap"))
        score = score + F.when(F.coalesce("n_keywords", F.lit(0)) > 0, guard).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 6))


def diversify(scored: DataFrame, most: int) -> DataFrame:
    """At most ``most`` chunks of a note for each query, best first; blank notes aren't capped."""
    order = Window.partitionBy("qid", "note_id").orderBy(F.desc("score"), F.desc("rrf"), "seen")
    return scored.withColumn("of_note", F.row_number().over(order)).where((F.col("of_note") <= max(1, most)) | (F.coalesce("note_id", F.lit("")) == "")).drop("of_note")


def top_hits(scored: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    rows = diversify(scored, cfg.max_per_note) if cfg.diversify and cfg.max_per_note > 0 else scored
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("rrf"), "seen")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, cfg.k))
