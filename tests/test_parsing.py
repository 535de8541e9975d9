from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.operators import chunking, notes


def value(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    t = "The Cat-5, a_b Ёж и ÉTÉ! x 42"
    assert value(spark, t, tx.embed_tokens) == ["the", "cat-5", "a_b", "ёж", "и", "été", "x", "42"]
    assert value(spark, t, tx.lex_tokens) == ["cat-5", "a_b", "ёж", "été", "42"]
    assert value(spark, "", tx.embed_tokens) == [] and value(spark, None, tx.lex_tokens) == []


def test_stable_hash(spark):
    import hashlib

    for t in ("a", "ёж", "word-1"):
        assert value(spark, t, tx.stable_hash) == int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little")


def test_tags_and_links(spark):
    assert value(spark, "#a/b x#no ##dd #A #a/b", tx.inline_tags) == ["a/b", "dd", "A", "a/b"]
    assert value(spark, "#A #b #a", tx.query_tags) == ["a", "b"]
    assert value(spark, "[[t|alias]] [[ t ]] [[t#h]] [[]] [[|x]]", tx.wikilinks) == ["t", "t#h"]


def test_white_space_and_lines(spark):
    assert value(spark, "\u00a0 a\u2003b\u2028 ", tx.squeeze) == "a b"
    for t in ("a\nb", "a\r\nb\r", "a\x0bb\x85c", "a\n\n", "x\u2028y"):
        assert value(spark, t, tx.lines) == t.splitlines()


def note_of(spark, text, path="d/My.note.md"):
    return notes.notes_from_files(spark.createDataFrame([(path, text)], "path string, text string")).first()


def test_frontmatter(spark):
    n = note_of(spark, "---\ntitle: ' A '\ntags: [x, '#y', '', 3]\n---\nbody #z [[l]]")
    assert (n.title, n.tags, n.links, n.content) == ("A", ["3", "x", "y", "z"], ["l"], "body #z [[l]]")
    assert note_of(spark, "---\nTitle: B\ntag: one, two\n---\nx").tags == ["one, two"]
    n = note_of(spark, "---\ntags:\ntag: no\n---\n# Head\nx")
    assert (n.title, n.tags) == ("Head", [])
    n = note_of(spark, "---\n- a\n- b\n---\ntext")
    assert (n.title, n.content) == ("My.note", "text")
    broken = "---\na: [\n---\ntext #t"
    n = note_of(spark, broken)
    assert (n.content, n.tags) == (broken, ["t"])
    assert note_of(spark, "x\n---\ntitle: no\n---\n").title == "My.note"
    assert note_of(spark, "---\r\ntitle: W\r\n---\r\nbody").content == "body"


def test_titles(spark):
    assert note_of(spark, "text\n##  Deep ##\n# Later").title == "Deep ##"
    assert note_of(spark, "#tag first\n# Real").title == "tag first"
    assert note_of(spark, "# \n# Real").title == ""
    assert note_of(spark, "###\nplain", "x/.md").title == ".md"
    assert note_of(spark, "plain", "a.b").title == "a"


def test_exclude_tags(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["X"]), ("c", None)], "id string, tags array<string>")
    assert sorted(r.id for r in notes.exclude_tags(df, ["x"]).collect()) == ["b", "c"] and notes.exclude_tags(df, []).count() == 3


def sections_of(spark, text, title="N"):
    df = spark.createDataFrame([(text, title)], "c string, t string")
    return [(s.section, s.text) for s in df.select(chunking.sections(F.col("c"), F.col("t")).alias("s")).first().s]


def test_sections(spark):
    assert sections_of(spark, "just text\nmore") == [("N", "just text\nmore")]
    assert sections_of(spark, "lead\n# A\na\n##  \nb\n### Empty\n\n#no head") == [("Introduction", "lead"), ("A", "a"), ("Section", "b"), ("Empty", "#no head")]
    assert sections_of(spark, "# A\n\n# B\n ") == [] and sections_of(spark, "") == [] and sections_of(spark, None) == []
    assert sections_of(spark, "####### seven\nx") == [("N", "####### seven\nx")]


def test_clean_and_sentences(spark):
    assert value(spark, "# Head\n- item\n 12. num\n**bold** a*b __u__", chunking.clean_markdown) == "Head item num bold a*b u"
    assert value(spark, "One. Two?! 3.5 is… yes  tail", chunking.sentences) == ["One.", "Two?!", "3.5 is…", "yes tail"]
    assert value(spark, "  ", chunking.sentences) == []


def plain_pack(text, size, overlap):
    text = " ".join(text.split())
    found = [m for m in re.findall(r"(.+?[.!?…]+)(?:\s+|$)", text)]
    rest = re.sub(r".+?[.!?…]+(?:\s+|$)", "", text).strip()
    out, cur = [], []
    for s in found + ([rest] if rest else []):
        words = s.split()
        if len(words) >= size:
            out += [" ".join(cur)] if cur else []
            out.append(s)
            cur = []
        elif len(cur) + len(words) <= size:
            cur = cur + words
        else:
            out.append(" ".join(cur)) if cur else None
            cur = (cur[-overlap:] if overlap > 0 else []) + words
    return out + ([" ".join(cur)] if cur else [])


def test_packing_equals_a_plain_version(spark):
    rng = random.Random(0)
    texts = [" ".join("w" * rng.randint(1, 3) + rng.choice(["", "", "", "", ".", "!"]) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((8, 3), (8, 0), (5, 9), (300, 60), (1, 1)):
        got = [r.x for r in df.select(chunking.pack(F.col("t"), size, overlap).alias("x")).collect()]
        assert got == [plain_pack(t, size, overlap) for t in texts]


def test_chunks_are_numbered_through_the_note(spark):
    rows = [("a/b.md", "", None, None, "lead. in\n# A\none. two.\n# B\nthree."), ("c.md", "T", ["x"], ["l"], ""), ("d.md", "T", ["x"], ["l"], "z")]
    got = chunking.chunk_notes(spark.createDataFrame(rows, "id string, title string, tags array<string>, links array<string>, content string")).collect()
    got = sorted((r.chunk_id, r.title, r.section, r.text, r.position, r.tags) for r in got)
    assert got == [("a/b.md#1", "b.md", "Introduction", "lead. in", 1, []), ("a/b.md#2", "b.md", "A", "one. two.", 2, []), ("a/b.md#3", "b.md", "B", "three.", 3, []), ("d.md#1", "T", "T", "z", 1, ["x"])]


def test_notes_without_an_id_or_with_the_same_one_are_numbered_each_for_itself(spark):
    rows = [(None, "A", None, None, "one.\n# H\ntwo."), (None, "B", None, None, "three."), ("n.md", "C", None, None, "four."), ("n.md", "D", None, None, "five.\n# H\nsix.")]
    made = chunking.chunk_notes(spark.createDataFrame(rows, "id string, title string, tags array<string>, links array<string>, content string"))
    got = sorted((r.title, r.chunk_id, r.position, r.text) for r in made.collect())
    assert got == [("A", "#1", 1, "one."), ("A", "#2", 2, "two."), ("B", "#1", 1, "three."), ("C", "n.md#1", 1, "four."), ("D", "n.md#1", 1, "five."), ("D", "n.md#2", 2, "six.")]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_sentences_equal_the_regular_expression():
    rng = random.Random(4)
    for _ in range(3000):
        flat = " ".join("".join(rng.choice("ab.!") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 8)))
        found = [m.strip() for m in re.findall(r"(.+?[.!?…]+)(?:\s+|$)", flat)]
        rest = re.sub(r".+?[.!?…]+(?:\s+|$)", "", flat).strip()
        assert chunking.split_sentences(flat) == found + ([rest] if rest else []), flat


def test_long_texts_take_linear_time(spark):
    import time

    began = time.time()
    for t in ("word " * 200_000, "a." * 200_000, "! " * 100_000, "x" * 500_000):
        assert len(value(spark, t, lambda c: chunking.pack(c))) >= 1
    assert time.time() - began < 60
