"""Periodic runs of words: stretches that repeat a short pattern, found by counting matches at each lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel
from lodestone.llm.store import narrow_batches

WORD = r"[^\x20\x09-\x0D]+"
#: Pairs of places of rare words that are in memory at once.
PAIR_BLOCK = 1 << 20
#: Cells of the frequent words' indicator vectors that are transformed at once.
FFT_CELLS = 1 << 20


def _spans(count: np.ndarray) -> np.ndarray:
    """0, 1, .., count - 1 for each count."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def lag_matches(codes: np.ndarray, most: int, heavy: int | None = None) -> np.ndarray:
    """For lags 0 to `most`, how many places hold the word that stands lag places on (place 0 of the result is void).

    Words with at most `heavy` places: the differences of all pairs of their places are counted.  The others, of which there are
    under n / heavy, are counted by autocorrelation of their indicator vectors: squared magnitudes of transforms add up,
    so one inverse transform gives the sum, which rounding makes exact.  Any `heavy` gives the same counts.
    """
    n = len(codes)
    heavy = max(4, int(n**0.5)) if heavy is None else heavy
    order = np.argsort(codes, kind="stable")
    times = np.bincount(codes)
    first = np.cumsum(times) - times
    found = np.zeros(most + 1, np.int64)
    # Rare words: each place with all later ones of the word, in blocks of about PAIR_BLOCK pairs.
    words = codes[order]
    later = (first + times)[words] - 1 - np.arange(n)
    later[times[words] > heavy] = 0
    ends = np.cumsum(later)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIR_BLOCK, "right")))
        left = np.repeat(np.arange(a, b), later[a:b])
        apart = order[left + 1 + _spans(later[a:b])] - order[left]
        found += np.bincount(apart[apart <= most], minlength=most + 1)
        a = b
    frequent = np.flatnonzero(times > heavy)
    if len(frequent):
        size = 1 << (n + most).bit_length()  # no lag up to `most` wraps around
        power, rows = np.zeros(size // 2 + 1), max(1, FFT_CELLS // size)
        for i in range(0, len(frequent), rows):
            some = frequent[i : i + rows]
            marks = np.zeros((len(some), size))
            for r, w in enumerate(some):
                marks[r, order[first[w] : first[w] + times[w]]] = 1
            z = np.fft.rfft(marks)
            power += (z.real**2 + z.imag**2).sum(axis=0)
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return found


def _stretches(hit: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal stretches of true of at least that length."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    keep = edge[1::2] - edge[::2] >= least
    yield from zip(edge[::2][keep].tolist(), edge[1::2][keep].tolist())


def islands(codes: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal stretches, of `least` (4 or more) places at least, that hold the word q places on.

    Such a stretch covers at least four places of a grid of steps of a quarter of `least`, all of which match; only
    around four matches in a row of the grid is every place compared.
    """
    n, step = len(codes) - q, max(1, least // 4)
    for a, b in _stretches(codes[:n:step] == codes[q : q + n : step], 4):
        lo, hi = max(0, (a - 1) * step + 1), min(n, b * step)
        for x, y in _stretches(codes[lo:hi] == codes[lo + q : hi + q], least):
            yield lo + x, lo + y


def runs_of(codes: np.ndarray, min_length: int = 6, min_times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted by start, then period.

    A run of period q holds min_times * q words or more, so at least (min_times - 1) * q places match at that lag; lags with
    fewer matches are not looked at.  A stretch that has a smaller period too is a run of that one alone, with the same ends,
    since its length is at least twice both.
    """
    n = len(codes)
    most = n // min_times
    if n < min_length or not most:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(min_length - lags, (min_times - 1) * lags)
    found = lag_matches(codes, most)
    shortest: dict[tuple[int, int], int] = {}
    for q in (np.flatnonzero(found[1:] >= need[1:]) + 1).tolist():
        for a, b in islands(codes, q, int(need[q])):
            shortest.setdefault((a, b + q - a), q)
    return sorted((a, length, q) for (a, length), q in shortest.items())


def _run(min_length: int, min_times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, kept = [], [], []
            for text in batch["text"]:
                raw = text.as_buffer()
                words = raw.to_pybytes().split() if raw is not None else []
                ids: dict[bytes, int] = {}
                codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
                runs = runs_of(codes, min_length, min_times)
                if runs:
                    keep = np.ones(len(words), bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                counts.append(len(codes))
                found.append([{"start": s, "length": k, "period": p} for s, k, p in runs])
                kept.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = 6, min_times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of `docs` (doc_id, text; other columns are ignored).

    Words are separated by white space of ASCII.  A run is a maximal stretch of words with smallest period q (words q apart are
    the same) of at least max(min_length, min_times * q) words, min_times being 3 or more; `runs` has all of them as (start,
    length, period) by start, then period.  `collapsed` has the words, with single spaces between, without those that lie in a
    run after its first q words.  A null or empty text has no words, no runs and an empty `collapsed`; repeated rows give repeated
    results, and a null doc_id is carried through.  A row is judged by itself, in one task.
    """
    if min_length < 5 or min_times < 3:
        raise ValueError("runs have at least 5 words and repeat at least 3 times")
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel.tidy(_run(min_length, min_times)), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of documents, by the crc32 of the id, repeat some of their words up to the end.

    Let h be the crc32 and g = h // 10.  If h % 10 is 0, word i of n counts as word a + (i - a) % p from a = g % n on, with
    p = 1 + (n - a) // (3 + g % 8).  A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), words.alias("w"), F.floor(h / 10).cast("long").alias("g"))
    a = F.expr("cast(g % size(w) as int)")
    cut = cut.withColumn("a", F.when(F.size("w") > 0, a)).withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one (ties: smallest start, then period), and the sha256 of all and of the collapsed text."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), listed.alias("listed"), "collapsed")
    exponent = F.expr("(-1000 * b.less) div b.period")
    return out.select("doc_id", "n_runs", F.col("b.start").alias("start"), (-F.col("b.less")).alias("length"), F.col("b.period").alias("period"), exponent.alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
