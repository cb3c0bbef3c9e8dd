"""Expressions over text: tokens, sentences, HTML, URLs and label buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits; a Han character is a token of its own.
TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
SENTENCE_END = r"[。！？.\n]"


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: str | Column) -> Column:
    """Trimmed non-empty sentences in order."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def bucket(term: str | Column, size: int = 64) -> Column:
    """A term's bucket: the first 32 bits of its MD5 modulo `size`."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def html_text(html: str | Column) -> Column:
    """Text without scripts, styles, comments and tags, white space made single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def label_bucket(label: str | Column, size: int = 10) -> Column:
    """|h| mod size, h folding code units as h * 31 + c in signed 32-bit arithmetic."""
    codes = F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda v: F.pmod(v + 2147483648, F.lit(4294967296)) - 2147483648
    return F.pmod(F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))), F.lit(size)).cast("int")
