"""Texts that are part of other texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.functions.layout import checked_broadcast

#: Parts that are looked for by a word; more are compared one by one.
MOST_PARTS = 10_000


def containing(texts: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(the columns of texts but text, key): the texts (.., text) that contain a part (key, part), letter for letter.

    A word inside a part, with something on either side of it, is a whole word of any text that contains
    the part.  Words of the texts are made once; only texts with a part's longest such word are compared
    with it, instead of every text with every part.
    """
    rest = [c for c in texts.columns if c != "text"]
    inner = F.regexp_extract_all("part", F.lit(rf"(?<=[^\p{{L}}\p{{N}}_-])({tx.WORD})(?=[^\p{{L}}\p{{N}}_-])"), F.lit(1))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    known = parts.where(F.col("part").isNotNull()).withColumn("word", longest).persist()
    words = known.where(F.col("word").isNotNull()).select("word").distinct().limit(MOST_PARTS + 1).collect()
    if len(words) > MOST_PARTS:
        return texts.join(known, F.col("text").contains(F.col("part"))).select(*rest, key)
    bare = checked_broadcast(known.where(F.col("word").isNull()))
    out = texts.join(bare, F.col("text").contains(F.col("part"))).select(*rest, key)
    if words:
        there = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0)), lambda w: w.isin([r.word for r in words])))
        marked = texts.withColumn("_words", there).where(F.size("_words") > 0)
        each = marked.select("*", F.explode("_words").alias("word")).join(checked_broadcast(known.where(F.col("word").isNotNull())), "word")
        out = each.where(F.col("text").contains(F.col("part"))).select(*rest, key).unionByName(out)
    return out
