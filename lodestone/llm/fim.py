"""Fill-in-the-middle arrangements of texts, in DataFrame functions alone, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word of ASCII letters or any other single character (code point).
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"


def draws(doc_id: str | Column, seed: int = 1) -> list[Column]:
    """Four numbers under 2**32 for a document: the first 8-digit groups of the sha256 of `seed:doc_id` (a null id is empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def arrange(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) for each row of `docs` (doc_id, text; other columns are ignored).

    The text's n units are cut in two places that depend on seed and doc_id alone.  form: `plain` (output is the text,
    the parts are null) for empty and null texts, texts that hold a mark, and 100 - percent of a hundred others; `spm` for
    spm_percent of a hundred of the rest, suffix first; else `psm`.  Rows are judged one by one: repeated rows give
    repeated results, an empty table none, and a null doc_id counts as an empty one.  A text's units are one array in one row.
    """
    h = draws("doc_id", seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), *(h[i].alias(f"h{i + 1}") for i in range(4)))
    places = [(F.col(x) % (F.size("units") + 1)).cast("int") for x in ("h1", "h2")]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "units", F.size("units").cast("long").alias("n"), F.least(*places).alias("lo"), F.greatest(*places).alias("hi"), form.alias("form"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, length), ""))
    parts = cut.select("doc_id", "text", "n", "form", part(F.lit(0), F.col("lo")).alias("prefix"), part(F.col("lo"), F.col("hi") - F.col("lo")).alias("middle"), part(F.col("hi"), F.size("units") - F.col("hi")).alias("suffix"))
    mark = {x: F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE)}
    psm = F.concat(mark[PREFIX], "prefix", mark[SUFFIX], "suffix", mark[MIDDLE], "middle")
    spm = F.concat(mark[SUFFIX], "suffix", mark[PREFIX], "prefix", mark[MIDDLE], "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that was arranged, from the arrangement and its form alone: a mark can't arise where two parts meet."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    piece = F.split(output, _MARK, -1)
    psm, spm = F.concat(piece[1], piece[3], piece[2]), F.concat(piece[2], piece[3], piece[1])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digests(arranged: DataFrame) -> DataFrame:
    """The lengths of prefix and middle, and the sha256 of output and of the text restored from it."""
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return arranged.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
