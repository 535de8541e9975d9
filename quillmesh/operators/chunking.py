"""Notes to sections, sentences and overlapping chunks; nothing shuffles, as a note is one row until its chunks are numbered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as tx

SIZE, OVERLAP = 300, 60
_MARKS = ".!?…"
_BREAK = re.compile(rf"(?<=[{_MARKS}]) ")
_HEADING = rf"^#{{1,6}}{tx.INLINE_WS}+"


def clean_markdown(c: Column) -> Column:
    for pattern, to in (
        (rf"(?md)^{tx.WS}*#{{1,6}}{tx.WS}+", ""),
        (rf"(?md)^{tx.WS}*[-*+]{tx.WS}+", ""),
        (rf"(?md)^{tx.WS}*\d+\.{tx.WS}+", ""),
        ("[_*`]{2,}", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return tx.squeeze(c)


def split_sentences(flat: str) -> list[str]:
    """Of a text with single spaces: up to a run of . ! ? … before a space or the end; a mark alone can't be a whole sentence and opens the next one."""
    out, held = [], ""
    for piece in _BREAK.split(flat) if flat else []:
        piece, held = f"{held} {piece}" if held else piece, ""
        if len(piece) == 1 and piece in _MARKS:
            held = piece
        else:
            out.append(piece)
    return [*out, held] if held else out


#: A sentence of a text with single spaces, as ``split_sentences`` cuts; possessive, so nothing is tried twice.
SENTENCE = rf"(?:[{_MARKS}] )?+[^ ]++(?:(?<![{_MARKS}]) [^ ]++)*+"


def _sentences_of(flat: Column) -> Column:
    return F.regexp_extract_all(flat, F.lit(SENTENCE), F.lit(0))


def sentences(c: Column) -> Column:
    return _sentences_of(tx.squeeze(F.coalesce(c, F.lit(""))))


def sections(content: Column, note_title: Column) -> Column:
    """Array of (section, text) in order; text before a first heading is "Introduction", without headings the note's title."""
    whole = tx.unified(F.coalesce(content, F.lit("")))
    pieces = F.split(whole, rf"(?md)(?={_HEADING})")

    def piece(p: Column, at: Column) -> Column:
        headed = p.rlike(_HEADING)
        heading = tx.strip(F.regexp_replace(F.substring_index(p, "\n", 1), _HEADING, ""))
        rest = F.when(F.instr(p, "\n") > 0, F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise("")
        name = F.when(headed, F.when(heading == "", "Section").otherwise(heading)).when(whole.rlike(rf"(?md){_HEADING}"), "Introduction").otherwise(note_title)
        return F.struct(name.alias("section"), tx.strip(F.when(headed, rest).otherwise(p)).alias("text"))

    return F.filter(F.transform(pieces, piece), lambda s: s["text"] != "")


def pack_sentences(found: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    current: list[str] = []
    for sentence in found:
        words = sentence.split(" ")
        if len(words) >= size:
            if current:
                out.append(" ".join(current))
            out.append(sentence)
            current = []
        elif len(current) + len(words) <= size:
            current += words
        else:
            if current:
                out.append(" ".join(current))
            current = (current[-overlap:] if overlap > 0 else []) + words
    return [*out, " ".join(current)] if current else out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, made once."""
    return F.get(F.transform(F.array(value), body), 0)


def _spans(words_of: Column, size: int, overlap: int) -> Column:
    """(at, n) of each chunk from the number of words of each sentence: every chunk is a run of words of its text."""
    span = lambda at, n: F.struct(at.alias("at"), n.alias("n"))
    state = lambda out, at, n, upto: F.struct(out.alias("out"), at.alias("at"), n.alias("n"), upto.alias("upto"))
    zero = F.lit(0)
    closed = lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(span(a["at"], a["n"])))).otherwise(a["out"])

    def add(a: Column, w: Column) -> Column:
        again = F.least(F.lit(max(overlap, 0)), a["n"])
        return (
            F.when(w >= size, state(F.concat(closed(a), F.array(span(a["upto"], w))), zero, zero, a["upto"] + w))
            .when(a["n"] + w <= size, state(a["out"], F.when(a["n"] > 0, a["at"]).otherwise(a["upto"]), a["n"] + w, a["upto"] + w))
            .otherwise(state(closed(a), a["upto"] - again, again + w, a["upto"] + w))
        )

    return F.aggregate(words_of, state(F.array().cast("array<struct<at:int,n:int>>"), zero, zero, zero), add, closed)


def _packed(flat: Column, size: int, overlap: int) -> Column:
    words_of = F.transform(_sentences_of(flat), lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)
    text = lambda words: F.transform(_spans(words_of, size, overlap), lambda c: F.array_join(F.slice(words, c["at"] + 1, c["n"]), " "))
    return _let(F.split(flat, " "), text)


def pack(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of a text: whole sentences up to ``size`` words; a new chunk starts with the last ``overlap`` words of the one before, a sentence of ``size`` words or more stands alone.

    The packing is a fold over numbers of words; texts are cut by its result alone, and nothing leaves the JVM.
    """
    return _let(clean_markdown(F.coalesce(text, F.lit(""))), lambda flat: _packed(flat, size, overlap))


def chunk_notes(notes: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of notes, numbered through each note from 1; notes without an id or with the same one are numbered each for itself."""
    empty = F.array().cast("array<string>")
    named = notes.select(
        F.coalesce("id", F.lit("")).alias("note_id"),
        F.coalesce(F.nullif("title", F.lit("")), F.substring_index(F.coalesce("id", F.lit("")), "/", -1)).alias("title"),
        F.coalesce("tags", empty).alias("tags"),
        F.coalesce("links", empty).alias("links"),
        "content",
    )
    cut = named.withColumn("parts", sections(F.col("content"), F.col("title"))).drop("content")
    packed = F.transform("parts", lambda p: pack(p["text"], size, overlap))
    of_note = F.flatten(F.zip_with("parts", packed, lambda p, found: F.transform(found, lambda t: F.struct(p["section"].alias("section"), t.alias("text")))))
    each = cut.select("note_id", "title", "tags", "links", F.posexplode(of_note).alias("at", "chunk"))
    position = (F.col("at") + 1).alias("position")
    chunk_id = F.concat("note_id", F.lit("#"), (F.col("at") + 1).cast("string"))
    return each.select(chunk_id.alias("chunk_id"), "note_id", "title", "chunk.section", "chunk.text", "tags", "links", position)
