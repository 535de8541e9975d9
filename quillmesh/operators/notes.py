"""Markdown files to notes: frontmatter, title, tags, links.

Only the YAML block needs Python (an Arrow UDF over the frontmatter, not the text); the
rest are column expressions, and nothing is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as tx

FRONTMATTER = rf"(?s)\A---{tx.WS}*\n(.*?)\n---{tx.WS}*\n?"


def normalize_tags(raw: object) -> list[str]:
    """A string is one tag, a list one for each member, anything else none; one leading # goes."""
    if isinstance(raw, str):
        raw = [raw]
    if not isinstance(raw, list):
        return []
    bare = (str(t).strip() for t in raw)
    return [t for t in (b[1:] if b.startswith("#") else b for b in bare) if t]


def read_frontmatter(block: str | None) -> tuple[bool, str | None, list[str]]:
    """(whether it is YAML, title, tags)."""
    import yaml

    try:
        data = yaml.safe_load(block or "") or {}
    except yaml.YAMLError:
        return False, None, []
    if not isinstance(data, dict):
        return True, None, []
    titles = [data[k].strip() for k in ("title", "Title") if isinstance(data.get(k), str) and data[k].strip()]
    key = next((k for k in ("tags", "tag") if k in data), None)
    return True, titles[0] if titles else None, normalize_tags(data[key]) if key else []


def _read_blocks(block: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_frontmatter(b) for b in block], columns=["ok", "title", "tags"])


def frontmatter(block: Column) -> Column:
    # Made on use: the workers import this module without a session.
    return F.pandas_udf(_read_blocks, "ok boolean, title string, tags array<string>", F.PandasUDFType.SCALAR)(block)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def heading_title(body: Column) -> Column:
    """From the first line that is a title: "# ..." even if nothing follows, else any # line with text."""

    def title(line: Column) -> Column:
        bare = tx.strip(F.regexp_replace(line, "^#+", ""))
        return F.when(line.startswith("# "), tx.strip(F.substring(line, 3, 1 << 30))).when(line.startswith("#") & (bare != ""), bare)

    marked = F.filter(tx.lines(body), lambda line: line.startswith("#"))
    return F.get(F.filter(F.transform(marked, title), lambda x: x.isNotNull()), 0)


def notes_from_files(files: DataFrame) -> DataFrame:
    """files: path (relative), text and optionally created, modified; one note each."""
    have = set(files.columns)
    stamps = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("created", "modified")]
    raw = files.select("path", F.regexp_replace("text", "\r\n?", "\n").alias("text"), *stamps)
    marked = raw.withColumn("block", F.when(F.col("text").rlike(FRONTMATTER), F.regexp_extract("text", FRONTMATTER, 1)))
    parsed = marked.withColumn("front", F.when(F.col("block").isNotNull(), frontmatter(F.col("block"))))
    body = F.when(F.col("front.ok"), F.regexp_replace("text", FRONTMATTER, "")).otherwise(F.col("text"))
    parsed = parsed.withColumn("content", body)
    tags = F.array_sort(F.array_union(F.coalesce("front.tags", F.array().cast("array<string>")), tx.inline_tags(F.col("content"))))
    return parsed.select(
        F.col("path").alias("id"),
        F.coalesce("front.title", heading_title(F.col("content")), stem(F.col("path"))).alias("title"),
        tags.alias("tags"),
        tx.wikilinks(F.col("text")).alias("links"),
        "content",
        "created",
        "modified",
    )


def exclude_tags(notes: DataFrame, tags: list[str]) -> DataFrame:
    """Without the notes that carry any of the tags."""
    if not tags:
        return notes
    banned = F.array(*[F.lit(t) for t in tags])
    return notes.where(~F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), banned))


def get_note(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id).limit(1)
