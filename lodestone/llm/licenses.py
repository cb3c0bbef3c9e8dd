"""License scanning: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of text, or a window over adjacent lines a little longer than the template, as a set of words; it
matches a template if it holds at least `containment` of the template's words, and those among them that tell the
template from another label's notice.  The templates' words are ordered by how often they occur in the corpus, rarest first.
A block that matches must hold one of the first |T| - ceil(containment * |T|) + 1 of a template's (prefix filter), have at
least ceil(containment * |T|) words (length filter), and from their first shared word on enough words of both the template
and the block must be left (positional filter).  Survivors are verified on the whole sets, so every match is found.  Blocks are made
of those texts only whose own set of words would match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that licenses ask to be put in works, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_rows(spark: SparkSession, templates) -> DataFrame:
    """(t, label, words, length) with distinct lower-case words and the number of all."""
    listed = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)))
    rows = spark.range(1).select(F.explode(listed).alias("x")).select("x.*")
    words = F.array_remove(F.split(F.lower("text"), _NOT_WORD), "")
    return rows.select("t", "label", F.array_distinct(words).alias("words"), F.size(words).alias("length")).where("size(words) > 0")


def _telling(row, rows) -> list[str]:
    """The words of a template that another label's template, which holds enough of the others, is without."""
    return sorted({w for r in rows if r.label != row.label and len(set(row.words) & set(r.words)) >= row.need for w in set(row.words) - set(r.words)})


def _blocks(texts: DataFrame, containment: float) -> DataFrame:
    """`texts` (low, of, need, length, others) with `words`, one row for each line and window of at least `need` words.

    Windows begin at words of the template and are its length / `containment` words long, across line breaks.
    """
    texts = texts.withColumn("width", F.ceil(F.col("length") / F.lit(containment)).cast("int"))
    words = lambda text: F.array_remove(F.split(text, _NOT_WORD), "")
    lines = F.transform(F.split("low", "\n", -1), lambda line: F.array_distinct(words(line)))
    windows = F.transform(
        F.array(words(F.col("low"))),
        lambda s: F.transform(F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_contains(F.col("of"), F.element_at(s, i))), lambda i: F.array_distinct(F.slice(s, i, F.col("width")))),
    )[0]
    enough = F.filter(F.concat(lines, windows), lambda b: F.size(b) >= F.col("need"))
    return texts.select(*texts.drop("low", "width", "length").columns, F.explode(enough).alias("words"))


def license_labels(docs: DataFrame, templates=TEMPLATES, containment: float = 0.9) -> DataFrame:
    """(doc_id, th, labels, score) of the distinct texts with a block that matches a template; th is the text's hash.

    Templates are a bounded list and are broadcast; blocks are never paired with each other.
    """
    spark = docs.sparkSession
    need = F.ceil(F.col("size") * F.lit(containment)).cast("int")
    t = _template_rows(spark, templates).withColumn("size", F.size("words")).withColumn("need", need)
    known = t.collect()
    literal = lambda words: F.array(*(F.lit(w) for w in words)).cast("array<string>")
    vocabulary = sorted({w for r in known for w in r.words})
    listed = spark.range(1).select(F.explode(literal(vocabulary)).alias("word"))
    counted = docs.select(F.explode(F.split(F.lower("text"), _NOT_WORD)).alias("word")).join(F.broadcast(listed), "word").groupBy("word").agg(F.count("*").alias("times"))
    times = {r.word: r.times for r in counted.collect()}  # of the templates' words alone
    ordered = sorted(vocabulary, key=lambda w: (times.get(w, 0), w))
    place = {w: i + 1 for i, w in enumerate(ordered)}
    entries = [(r.t, place[w], pos, r.size, r.need) for r in known for pos, w in enumerate(sorted(r.words, key=place.get)) if pos <= r.size - r.need]
    index = spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t", "rank", "pos", "size", "need"), e))) for e in entries))).alias("x")).select("x.*")
    terms = sorted({ordered[e[1] - 1] for e in entries})

    some = F.lit(False)
    for w in terms:
        some = some | F.contains(F.col("low"), F.lit(w))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.lower("text").alias("low")).where(some)
    wanted = F.array(*(F.struct(F.lit(r.t).alias("t"), literal(r.words).alias("words"), F.lit(r.need).alias("need")) for r in known))
    own = F.array_intersect(F.split("low", _NOT_WORD), literal(ordered))
    held = F.transform(F.array(own), lambda v: F.filter(wanted, lambda x: F.size(F.array_intersect(v, x["words"])) >= x["need"]))[0]
    texts = texts.select("doc_id", "th", "low", F.explode(held).alias("x")).select("doc_id", "th", "low", F.col("x.t").alias("t"))
    must = F.array(*(F.struct(F.lit(r.t).alias("t"), literal(_telling(r, known)).alias("must")) for r in known))
    t = t.withColumn("must", F.filter(must, lambda x: x["t"] == F.col("t"))[0]["must"])
    of = t.select("t", "label", "must", "need", "length", F.col("words").alias("of"))
    blocks = _blocks(texts.join(F.broadcast(of), "t"), containment).drop("need")
    # A block as the ranks of its words that any template has, in the same order as the templates' own.
    ranks = F.array_sort(F.filter(F.transform("words", lambda w: F.array_position(literal(ordered), w)), lambda k: k > 0))
    ranked = blocks.withColumn("ranks", ranks)
    shared = ranked.select("*", F.posexplode("ranks").alias("at", "rank")).join(F.broadcast(index), ["rank", "t"])
    # From a shared word on, the rest of the block and that of the template bound what else they share; the first one lets all matches pass.
    shared = shared.where("size(words) >= need and 1 + least(size(ranks) - at - 1, size - pos - 1) >= need")
    pairs = shared.select("doc_id", "th", "words", "label", "must", "of").distinct().where("size(array_except(must, words)) = 0")
    common = F.size(F.array_intersect("words", "of"))
    scored = pairs.withColumn("score", common / F.size("of")).where(common >= F.ceil(F.size("of") * F.lit(containment)))
    return scored.groupBy("doc_id", "th").agg(F.collect_set("label").alias("labels"), F.max("score").alias("score"))


def _places(phrase: str) -> dict[str, Column]:
    """Of a phrase in the padded words: its number of places, and its first and last one's word index."""
    between = "  ".join(phrase.split())
    mark, words = f" {between} ", len(phrase.split())
    count = ((F.length("padded") - F.length(F.replace("padded", F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    spaces = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")
    first = F.when(F.contains("padded", F.lit(mark)), spaces(F.substring_index("padded", mark, 1)))
    last = F.when(F.contains("padded", F.lit(mark)), F.col("n_words") - spaces(F.substring_index("padded", mark, -1)) - words)
    return {"count": F.when(F.contains("padded", F.lit(mark)), count).otherwise(F.lit(0).cast("long")), "first": first, "last": last}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = 0.9) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; others are ignored) with the phrase counts and the labels.

    n_words, n_base, first_word, last_word, base_labels, labels (base ones and the method's) and score, the highest
    containment of a matched template or 0.  A null or empty text has no words; repeated rows have equal results; a
    null doc_id is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Each word between two spaces of its own, so that a place can begin where another ends.
    bare = F.trim(F.regexp_replace(F.lower("text"), _NOT_WORD, "  "))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" "))).alias("padded"))
    rows = rows.withColumn("n_words", ((F.length("padded") - F.length(F.replace("padded", F.lit(" "), F.lit("")))) / 2).cast("long"))
    found = [_places(p) for p, _ in PHRASES]
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(f["count"] > 0, label) for f, (_, label) in zip(found, PHRASES))))))
    rows = rows.select("doc_id", "th", "n_words", sum((f["count"] for f in found[1:]), found[0]["count"]).alias("n_base"), F.least(*(f["first"] for f in found)).alias("first_word"), F.greatest(*(f["last"] for f in found)).alias("last_word"), labels.alias("own"))
    more = license_labels(docs, templates, containment).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("labels").alias("more"), "score")
    out = rows.join(more, F.expr("doc_id <=> d and th = t"), "left")
    every = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
