"""Secret scanning: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates of the battery are all runs of 20 or more characters of the encodings' alphabets, without padding.  For each, the encoding is
inferred (digits, letters of one case, hex, base32, letters and digits, or base64) and three tests measure how far its
characters are from uniform draws from that alphabet: chi-squared uniformity (Wilson-Hilferty), the number of runs above
and below the alphabet's middle, and lag-1 serial correlation.  Fisher's method joins them into one statistic, which is
small for random characters and grows with the length of a text.

The null hypothesis is that a candidate is text.  Its distribution is that of dictionary-like runs: the words of all
documents, written without spaces and cut in turn to the length of each band.  A candidate's p-value is the share of
those that look as random as it does, and Benjamini-Hochberg within each band of lengths decides which are secrets, so
that the rate bounds the share of texts among what is called secret.  P-values are binned, so the control needs counts alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.spans import distinct_hits, match_spans
from lodestone.llm.store import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the rule's length can't pass, and a match of these two can only be a run's longest.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "digits": "0123456789",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
#: Bands of lengths: twice the binary logarithm, rounded down.  Text runs of a band have the least length in it.
FIRST_BAND, LAST_BAND = 8, 14
#: The statistic is binned by this many to one, up to a limit.
FINE, LIMIT = 8, 100
#: The least lengths of the bands, to which a text's letters are cut in turn.
CUTS = tuple(max(20, math.ceil(2 ** (of / 2))) for of in range(FIRST_BAND, LAST_BAND + 1))


def _phi(z: Column) -> Column:
    """The normal distribution function, to about 1e-4."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def battery(tokens: DataFrame, forced: str | None = None) -> DataFrame:
    """Adds encoding (or the forced one), band and f, the joint statistic of the tests, to rows with a string `part`."""
    bare = F.regexp_replace("part", r"=+$", "")
    encoding = (
        F.when(bare.rlike(r"^[0-9]+$"), "digits")
        .when(bare.rlike(r"^(?:[a-z]+|[A-Z]+)$"), "letters")
        .when(bare.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(bare.rlike(r"^[A-Z2-7]+$"), "base32")
        .when(bare.rlike(r"^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )
    encoding = F.lit(forced) if forced else encoding
    t = tokens.withColumn("encoding", encoding).withColumn("bare", F.when(F.col("encoding").isin("hex", "letters"), F.lower(bare)).otherwise(bare))
    alphabet, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, a in ALPHABETS.items():
        alphabet, size = F.when(F.col("encoding") == name, a).otherwise(alphabet), F.when(F.col("encoding") == name, 64 if name == "base64" else len(a)).otherwise(size)
    t = t.withColumn("alphabet", alphabet).withColumn("k", size.cast("double")).withColumn("n", F.length("bare").cast("double"))
    t = t.withColumn("x", F.expr("transform(split(bare, ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    t = t.withColumn("squares", F.expr("aggregate(transform(array_distinct(x), v -> cast(size(filter(x, u -> u = v)) as double)), 0D, (s, c) -> s + c * c)"))
    t = t.withColumn("high", F.expr("cast(size(filter(x, v -> v >= k / 2)) as double)"))
    t = t.withColumn("runs", F.expr("1 + cast(size(filter(sequence(1, size(x) - 1), i -> (x[i] >= k / 2) <> (x[i - 1] >= k / 2))) as double)"))
    t = t.withColumn("mu", F.expr("aggregate(x, 0D, (s, v) -> s + v) / n"))
    t = t.withColumn("var", F.expr("aggregate(x, 0D, (s, v) -> s + (v - mu) * (v - mu))"))
    t = t.withColumn("cov", F.expr("aggregate(sequence(1, size(x) - 1), 0D, (s, i) -> s + (x[i] - mu) * (x[i - 1] - mu))"))
    return _joined(t).select(*tokens.columns, "encoding", "band", "f")


def _joined(t: DataFrame) -> DataFrame:
    """Adds band and f to rows of part, n, k, squares, high, runs, var and cov: three tests in one statistic."""
    chi, free = F.col("squares") * F.col("k") / F.col("n") - F.col("n"), F.col("k") - 1
    z = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    t = t.withColumn("p1", 1 - _phi(z))
    mean = 2 * F.col("high") * (F.col("n") - F.col("high")) / F.col("n") + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (F.col("n") - 1), F.lit(1e-9)))
    t = t.withColumn("p2", 2 * (1 - _phi(F.least(F.abs(F.col("runs") - mean) / spread, F.lit(9.0)))))
    r = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(1.0)
    t = t.withColumn("p3", 2 * (1 - _phi(F.least(F.abs(r * F.sqrt("n") + 1 / F.sqrt("n")), F.lit(9.0)))))
    fisher = -2 * sum(F.log(F.greatest(F.col(p), F.lit(1e-12))) for p in ("p1", "p2", "p3"))
    band = F.least(F.greatest(F.floor(2 * F.log2(F.length("part"))), F.lit(FIRST_BAND)), F.lit(LAST_BAND)).cast("int")
    return t.withColumn("f", fisher).withColumn("band", band)


def _bin() -> Column:
    return F.least(F.floor(F.col("f") * FINE), F.lit(LIMIT * FINE)).cast("int")


def null_runs(texts: DataFrame) -> DataFrame:
    """(part): the plain letters of each text, each in one run: of CUTS[0] letters, CUTS[1] and so on, and again from the first."""
    letters = texts.select(F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("s"))
    rounds = letters.select(F.explode(F.regexp_extract_all("s", F.lit(f".{{1,{sum(CUTS)}}}"), F.lit(0))).alias("s"))
    parts = F.array(*(F.substring("s", sum(CUTS[:i]) + 1, size) for i, size in enumerate(CUTS)))
    return rounds.select(F.posexplode(parts).alias("i", "part")).where(F.length("part") == F.array(*map(F.lit, CUTS))[F.col("i")]).select("part")


def letter_battery(runs: DataFrame) -> DataFrame:
    """(part, family, band, f) of runs (part) of a to z, in each family: as by battery(), but from counts of letters, since all texts go through."""
    letters = ALPHABETS["letters"]
    counts = F.array(*(F.length("part") - F.length(F.replace("part", F.lit(c), F.lit(""))) for c in letters))
    t = runs.select("part", F.length("part").cast("double").alias("n"), counts.alias("c"), F.transform(F.split("part", ""), lambda c: F.ascii(c) - 97).alias("x"))
    of = lambda weight: sum((F.col("c")[i] * weight(i) for i in range(26)), F.lit(0)).cast("double")
    t = t.withColumns({"squares": sum((F.col("c")[i] * F.col("c")[i] for i in range(26)), F.lit(0)).cast("double"), "s1": of(lambda i: i), "s2": of(lambda i: i * i)})
    t = t.withColumn("both", F.expr("cast(aggregate(sequence(1, size(x) - 1), 0, (s, i) -> s + x[i] * x[i - 1]) as double)")).withColumn("mu", F.col("s1") / F.col("n"))
    ends = F.col("x")[0] + F.element_at("x", -1)
    t = t.withColumns({"var": F.col("s2") - F.col("s1") * F.col("mu"), "cov": F.col("both") - F.col("mu") * (2 * F.col("s1") - ends) + (F.col("n") - 1) * F.col("mu") * F.col("mu")})
    found = None
    for family, name in enumerate(("letters", "alnum")):
        k = len(ALPHABETS[name])
        middle = math.ceil(k / 2) - ALPHABETS[name].index("a")
        sides = F.translate("part", letters, "0" * middle + "1" * (26 - middle))
        turns = sum((F.length("part") - F.length(F.replace(sides, F.lit(p), F.lit("")))) / 2 for p in ("01", "10"))
        one = t.withColumns({"k": F.lit(float(k)), "high": of(lambda i, m=middle: int(i >= m)), "runs": 1 + turns})
        one = _joined(one).select("part", F.lit(family).alias("family"), "band", "f")
        found = one if found is None else found.unionByName(one)
    return found


def text_runs(texts: DataFrame) -> DataFrame:
    """(family, bin, n) by band: how many runs of plain letters, of all texts, have the statistic in each bin; family 0 against 26 letters, 1 against 62 characters."""
    return letter_battery(null_runs(texts)).groupBy("family", "band", _bin().alias("bin")).agg(F.count("*").alias("n"))


def discoveries(tested: DataFrame, null: DataFrame, rate: float) -> DataFrame:
    """The rows of battery() that aren't text, at a false-discovery rate; null is that of text_runs()."""
    family = F.when(F.col("encoding") == "letters", 0).otherwise(1)
    tested = tested.withColumn("family", family).withColumn("bin", _bin())
    at = ["family", "band"]
    counts = tested.groupBy(*at, "bin").agg(F.count("*").alias("c"))  # of these and of the null's, 2 * 7 * LIMIT * FINE rows at most
    both = counts.unionByName(null, allowMissingColumns=True).groupBy(*at, "bin").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    whole, below = Window.partitionBy(*at), Window.partitionBy(*at).orderBy("bin")
    ranked = both.select(*at, "bin", (F.sum("n").over(below) + 1).alias("as_random"), (F.sum("n").over(whole) + 1).alias("texts"), F.sum("c").over(below).alias("rank"), F.sum("c").over(whole).alias("m"))
    cut = ranked.where((F.col("m") > 0) & (F.col("as_random") * F.col("m") <= rate * F.col("rank") * F.col("texts"))).groupBy(*at).agg(F.max("bin").alias("cut"))
    return tested.join(F.broadcast(cut), at).where("bin <= cut").drop("family", "bin", "cut")


def scan_secrets(docs: DataFrame, rate: float = 0.1) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; others are ignored): doc_id, n_assign, n_access, n_hex,
    base_sha256, spans and n_random, the number of spans that the battery adds.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind (assign, access, hex, random),
    comma-joined.  A null or empty text has none, and repeated rows have equal results.  A null doc_id is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hits = table(distinct_hits(docs, f"{ASSIGN}|{ACCESS}|{CANDIDATE}"))
    kinds = [("assign", ASSIGN, 2, "length(part) >= 6"), ("access", ACCESS, 0, "true"), ("hex", HEX, 0, "true")]
    found = None
    for k, (kind, pattern, group, keep) in enumerate(kinds):
        one = match_spans(hits.where(F.col("text").rlike(pattern)), pattern, group).where(keep).select("doc_id", "th", F.lit(k).alias("k"), F.lit(kind).alias("kind"), "start", "end")
        found = one if found is None else found.unionByName(one)
    tested = table(battery(match_spans(hits, CANDIDATE).where("length(regexp_replace(part, '=+$', '')) >= 20")))
    random = discoveries(tested, text_runs(docs), rate).select("doc_id", "th", F.lit(3).alias("k"), F.lit("random").alias("kind"), "start", "end")
    found = found.unionByName(random).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "k", "kind", "end"))).alias("s"))
    written = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    found = found.select(
        F.col("doc_id").alias("d"),
        F.col("th").alias("t"),
        *(F.expr(f"cast(size(filter(s, x -> x.k = {k})) as bigint)").alias(f"n_{kind}") for k, (kind, *_) in enumerate([*kinds, ("random", "")])),
        F.expr(written.format("filter(s, x -> x.k < 3)")).alias("base"),
        F.expr(written.format("s")).alias("spans"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("th")).join(found, F.expr("doc_id <=> d and th = t"), "left")
    n = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in ("assign", "access", "hex")}
    return rows.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_random", F.lit(0).cast("long")).alias("n_random"))
