"""Where a regular expression matches in texts, in code points, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_hits(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, th, text) of the distinct texts that hold a match; th tells texts under one doc_id apart."""
    return docs.where(F.col("text").rlike(pattern)).select("doc_id", F.xxhash64("text").alias("th"), "text").distinct()


def match_spans(hits: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """(doc_id, th, start, end, part) of every leftmost non-overlapping match; part is its `group`.

    What lies between matches comes from split() and the matches from regexp_extract_all(), which scan alike; a
    running sum of their lengths gives the places.  length() counts code points.
    """
    regex = F.lit(pattern)
    pieces = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", regex, F.lit(0)).alias("hit"), F.regexp_extract_all("text", regex, F.lit(group)).alias("part"))
    rows = hits.select("doc_id", "th", F.posexplode(pieces).alias("i", "p")).select("doc_id", "th", "i", F.length("p.gap").alias("gap"), F.length("p.hit").alias("size"), F.col("p.part").alias("part"))
    before = Window.partitionBy("doc_id", "th").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(before)).where("size is not null")
    return rows.select("doc_id", "th", (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), "part")
