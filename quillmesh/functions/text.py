"""Column expressions for text: white space, lines, tokens, tags, links, stable hashes.

All of them are JVM-side.  White space is Unicode white space and a line ends at any
Unicode line boundary, which is wider than what the engine's own functions assume.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
INLINE_WS = r"[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_-]+"
TAG = r"(?<![\p{L}\p{N}_])#([\p{L}\p{N}_/-]+)"
LINK = r"\[\[([^\]]++)\]\]"

#: Alphabetical; English, then Russian.
STOPWORDS = frozenset(
    "a an and are for he i in is it of on or she that the these they this those to was we were with without you "
    "а без бы быть в во вы да для до его ее ещё еще есть её же за и из или их как ко к ли мой мы на наш не нет ни но о об он она они оно "
    "от по при про с со та так там твой те тоже тот тут ты у уже что эта эти этот это я ваш".split()
)


def strip(c: Column) -> Column:
    """Looks at the ends only, unlike a regular expression."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def unified(c: Column) -> Column:
    """All line ends as a newline."""
    return F.regexp_replace(c, LINE_END, "\n")


def lines(c: Column) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    return F.split(F.regexp_replace(unified(c), r"\n\z", ""), "\n")


def embed_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def lex_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: (F.length(x) >= 2) & ~x.isin(*sorted(STOPWORDS)))


def lex_tokens(c: Column) -> Column:
    return lex_of(embed_tokens(c))


def inline_tags(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TAG), F.lit(1))


def query_tags(c: Column) -> Column:
    """Lower-cased distinct tags in order."""
    return F.array_distinct(F.transform(inline_tags(c), F.lower))


def wikilinks(c: Column) -> Column:
    """Targets in order, without repeats; what follows a bar is an alias."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LINK), F.lit(1))
    targets = F.transform(found, lambda x: strip(F.substring_index(x, "|", 1)))
    return F.array_distinct(F.filter(targets, lambda x: x != ""))


def stable_hash(token: Column) -> Column:
    """First four bytes of the MD5 digest, little-endian."""
    h = F.md5(token)
    turned = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.conv(turned, 16, 10).cast("long")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
