"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations throughout.

Lines are compared as sequences of words in lower case.  Two lines are near when one word's insertion, deletion or
substitution turns one into the other (an edit bound of 1).  The earliest of equal or near lines, by (doc_id, line),
stays.

1. Equal lines are collapsed by hash, so that a line in a third of all documents is one row from then on.
2. A line emits a hashed key for every variant with one word deleted, with the word's place (for substitutions)
   and without (for insertions and deletions), and for itself; equal keys join.  For long lines keys are sums of hashes
   of (word, place), taken from running sums, so a line of n words costs n additions rather than n lines of n words.
   Only lines that share a half with another line emit variants: one edit leaves one half as it is, so others have
   no near line.
3. Lines under a key need no pairs: the key's earliest line is the only one that matters to the others.  Each such
   pair is verified on its words.
4. The most frequent lines find their places by broadcast, so that no task gets all rows of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import broadcast_if_small, columns, table

_ID = ["h1", "h2", "n"]
_POS = "struct(doc_id, th, line)"
_WIDE = 0xFFFFFFFFFF
#: Bounds of the query and the pipeline: every equal line that isn't blank goes, and one edit in five words or more is near.
WHOLE = {"min_words": 1, "min_near_words": 5}
#: Lines of up to this many words write their variants out; longer ones (and those of just so many) take them from running sums.
WRITTEN_OUT = 32
#: The most frequent lines, up to this many, meet their places by broadcast; all others by a shuffle.
HOT_LINES = 10_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, at) of every line, at being its words with a space between; th tells texts under one doc_id apart."""
    low = F.lower("text")
    odd = F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\x0b")) | F.contains(low, F.lit("\f"))
    plain = F.when(odd, F.translate(low, "\t\x0b\f\r", "    ")).otherwise(low)
    parts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(plain, "\n", -1)).alias("line", "raw"))
    raw = F.col("raw")
    loose = F.contains(raw, F.lit("  ")) | F.startswith(raw, F.lit(" ")) | F.endswith(raw, F.lit(" "))
    return parts.select("doc_id", "th", "line", F.when(loose, F.trim(F.regexp_replace(raw, " +", " "))).otherwise(raw).alias("at"))


def _halves() -> Column:
    """Keys of the halves that a line shares with a near one, seen from the longer of the two (of n or n + 1 words).

    h1 and h2 are the hashes of the first floor(n / 2) words and of the others, which are two of the four already; h3 has one
    word more, on the left of an odd line and on the right of an even one.  Keys of left halves are even, of right ones odd.
    """
    left, right = "2 * shiftright(xxhash64('p', {}), 1)", "2 * shiftright(xxhash64('s', {}), 1) + 1"
    keys = [left.format("n, h1"), right.format("n, h2"), left.format("n + 1, if(n % 2 = 0, h1, h3)"), right.format("n + 1, if(n % 2 = 0, h3, h2)")]
    return F.expr(f"array({', '.join(keys)})")


def _variants(alive: DataFrame) -> DataFrame:
    """(id, i, kind, key) of lines (id, n, words, left, right): each without its word i, as such (del) and with its place (sub), and itself (own).

    A line that shares only its left half with others has its edit to them in the right one, and the other way round, so
    only words of that half are left out, with one more on its edge.
    """
    begin, end = "if(right, 0, greatest(n div 2 - 1, 0))", "if(left, n - 1, least(n div 2 + 1, n - 1))"
    without = "concat(slice(words, 1, i), slice(words, i + 2, n))"
    sub = f"struct('sub' as kind, i as i, xxhash64('sub', n, i, {without}) as key)"
    gap = f"struct('del' as kind, i as i, xxhash64('indel', n - 1, {without}) as key)"
    own = "struct('own' as kind, cast(0 as int) as i, xxhash64('indel', n, words) as key)"
    short = alive.where(F.col("n") <= WRITTEN_OUT)
    short = short.select("id", F.explode(F.expr(f"array_append(flatten(transform(sequence(cast({begin} as int), cast({end} as int)), i -> array({sub}, {gap}))), {own})")).alias("v")).select("id", "v.i", "v.kind", "v.key")

    # Running sums of hashes of (word, place) and of (word, place - 1), under two seeds.
    word = alive.where(F.col("n") >= WRITTEN_OUT).select("id", "n", F.expr(begin).alias("begin"), F.expr(end).alias("end"), F.posexplode("words").alias("i", "w"))
    for s in (1, 2):
        word = word.withColumn(f"f{s}", F.xxhash64("w", "i", F.lit(s)).bitwiseAND(_WIDE)).withColumn(f"g{s}", F.xxhash64("w", F.col("i") - 1, F.lit(s)).bitwiseAND(_WIDE))
    whole, so_far = Window.partitionBy("id"), Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    for s in (1, 2):
        word = word.withColumn(f"all{s}", F.sum(f"f{s}").over(whole)).withColumn(f"deleted{s}", F.coalesce(F.sum(f"f{s}").over(so_far), F.lit(0)) + F.sum(f"g{s}").over(whole) - F.coalesce(F.sum(f"g{s}").over(so_far), F.lit(0)) - F.col(f"g{s}"))
    inside = F.col("i").between(F.col("begin"), F.col("end"))
    kinds = [
        F.when(inside, F.struct(F.lit("sub").alias("kind"), F.xxhash64(F.lit("sub"), "n", "i", F.col("all1") - F.col("f1"), F.col("all2") - F.col("f2")).alias("key"))),
        F.when(inside, F.struct(F.lit("del").alias("kind"), F.xxhash64(F.lit("indel"), F.col("n") - 1, F.lit(-1), "deleted1", "deleted2").alias("key"))),
        F.when(F.col("i") == 0, F.struct(F.lit("own").alias("kind"), F.xxhash64(F.lit("indel"), "n", F.lit(-1), "all1", "all2").alias("key"))),
    ]
    return short.unionByName(word.select("id", "i", F.explode(F.array_compact(F.array(*kinds))).alias("v")).select("id", "i", "v.kind", "v.key"))


def gone_lines(docs: DataFrame, min_words: int = 3, min_near_words: int = 8) -> DataFrame:
    """(doc_id, th, line) of every line of docs (doc_id, not null, and text) of which an earlier one is equal or near.

    Lines of under `min_words` words are never gone; those of under `min_near_words` only if an equal one is earlier.
    """
    docs = docs.where("text is not null")
    seen = _lines(docs).withColumn("n", F.when(F.col("at") == "", 0).otherwise(F.octet_length("at") - F.octet_length(F.replace("at", F.lit(" "), F.lit(""))) + 1))
    part = lambda count: F.expr(f"xxhash64(substring_index(at, ' ', {count}))")
    seen = seen.select("doc_id", "th", "line", "n", part("cast(n div 2 as int)").alias("h1"), part("cast(n div 2 - n as int)").alias("h2"), part("cast(if(n % 2 = 0, -1 - n div 2, n div 2 + 1) as int)").alias("h3"))
    seen = table(seen)
    unique = table(seen.where(F.col("n") >= max(min_words, 1)).groupBy(*_ID).agg(F.min(F.expr(_POS)).alias("first"), F.count("*").alias("times"), F.min("h3").alias("h3")))

    # Lines that share a half with another line, and which half.
    half = unique.where(F.col("n") >= min_near_words).select(*_ID, F.explode(F.array_distinct(_halves())).alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    half = half.join(shared, "half", "left_semi").groupBy(*_ID).agg(F.max(F.col("half") % 2 == 0).alias("left"), F.max(F.col("half") % 2 != 0).alias("right"))
    alive = table(half.join(unique, _ID).select(*_ID, "first", "left", "right"))
    ids = alive.select(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).distinct()
    chosen = docs.withColumn("th", F.xxhash64("text")).join(broadcast_if_small(table(ids)), ["doc_id", "th"], "left_semi").select("doc_id", "text")
    places = broadcast_if_small(alive.select(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), F.col("first.line").alias("line"), *_ID, "left", "right"))
    full = _lines(chosen).join(places, ["doc_id", "th", "line"]).groupBy(*_ID, "doc_id", "th", "line", "left", "right").agg(F.max("at").alias("at"))
    alive = table(full.select(*_ID, "left", "right", F.expr(_POS).alias("first"), F.split("at", " ").alias("words")).withColumn("id", F.xxhash64(*_ID, "first")))

    variant = table(_variants(alive))
    # Most keys are one line's alone; only the others need the lines' places.
    keys = table(variant.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    variant = table(variant.join(broadcast_if_small(keys), "key", "left_semi").join(alive.select("id", "first"), "id"))

    # The earliest line under each key, of each kind; a line looks to the kind that completes its own.
    earliest = variant.groupBy("key", "kind").agg(F.min(F.struct("first", "id", "i")).alias("e"), F.count("*").alias("under"))
    wanted = F.when(F.col("kind") == "del", "own").when(F.col("kind") == "own", "del").otherwise("sub")
    looks = earliest.where("kind <> 'sub' or under > 1").select("key", F.col("kind").alias("other"), "e")
    pairs = variant.withColumn("other", wanted).join(looks, ["key", "other"]).where("e.first < first").select("id", "i", "kind", F.col("e.id").alias("id2"), F.col("e.i").alias("i2"))
    text = alive.select("id", "words"), alive.select(F.col("id").alias("id2"), F.col("words").alias("words2"))
    without = "concat(slice({0}, 1, {1}), slice({0}, {1} + 2, size({0})))"
    one, two = without.format("words", "i"), without.format("words2", "i2")
    verified = f"case kind when 'sub' then i = i2 and {one} = {two} when 'del' then {one} = words2 else words = {two} end"
    near = pairs.distinct().join(text[0], "id").join(text[1], "id2").where(verified).select("id").distinct()
    near = table(alive.join(near, "id", "left_semi").select(*_ID).withColumn("near", F.lit(True)))

    judged = unique.select(*_ID, "first", "times").join(near, _ID, "left").where("times > 1 or near").select(*_ID, "first", "times", F.coalesce("near", F.lit(False)).alias("near"))
    judged = table(judged)
    hot = judged.orderBy(F.desc("times"), *_ID).limit(HOT_LINES)
    by_broadcast = seen.join(F.broadcast(hot), _ID)
    by_shuffle = seen.join(F.broadcast(hot.select(*_ID)), _ID, "left_anti").join(judged, _ID)
    return by_broadcast.unionByName(by_shuffle).where(f"near or first <> {_POS}").select("doc_id", "th", "line")


def dedup_lines(docs: DataFrame, min_words: int = 3, min_near_words: int = 8) -> DataFrame:
    """Every row of `docs` (doc_id, text, any others) with its repeated lines taken out of text, then n_lines and n_removed.

    A null text stays null with 0 lines.  Rows with equal doc_id and text are one document and share one fate; a
    null doc_id sorts first.  A document of which all lines are gone has the empty text.  Line breaks are `\\n`.
    Columns of `docs` named n_lines or n_removed are replaced; all others stay, whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    gone = gone_lines(docs.select(number.alias("doc_id"), "text"), min_words, min_near_words)
    gone = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    keyed = docs.select(F.struct(*columns(docs)).alias("row"), number.alias("doc_id"), F.xxhash64("text").alias("th"))
    out = keyed.join(gone, ["doc_id", "th"], "left")
    # The lines between one that is gone and the next.
    lines = "split(row.text, '\\n', -1)"
    runs = f"transform(array({lines}), x -> flatten(transform(sequence(0, size(gone)), k -> slice(x, if(k = 0, 0, gone[k - 1] + 1) + 1, if(k = size(gone), size(x), gone[k]) - if(k = 0, 0, gone[k - 1] + 1)))))[0]"
    text = F.expr(f"if(gone is null, row.text, array_join({runs}, '\\n'))")
    n_lines = F.expr(f"if(row.text is null, 0, size({lines}))")
    own = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*own, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
