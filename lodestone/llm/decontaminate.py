"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment over words.

Words are runs of letters and digits in lower case.  Every n-word window of a benchmark item is a seed, however many
documents hold it: a copy that is edited alike in many documents has no other.  One pass looks up the seeds in every
window of every document and aligns the item with the passages around its seeds, with gaps and substitutions, which
scores edited and paraphrased copies.  A passage that holds too few of the item's words to reach the threshold, as
around a turn of phrase, isn't aligned; an alignment scores at most all shared words, so no match is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel
from lodestone.llm.store import narrow_batches

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of benchmark items that are broadcast at once (16 bytes each); more items are handled in further passes.
ITEM_WORDS = 2_000_000
_BITS = 22


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the passage position where it ends."""
    g = GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        t = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP, out=t[1:])
        row = np.maximum(np.maximum.accumulate(np.maximum(t, 0) - g) + g, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Seeds:
    """Sorted seed hashes with a bit table in front, and in which items each seed stands, all in arrays (20 bytes a seed)."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], n: int) -> None:
        self.items, self.n = items, n
        grams = [kernel.hash_grams(h, np.array([0, len(h)]), n)[0] for _, h in items]
        g = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(g, kind="stable")
        self.sorted, begin = np.unique(g[order], return_index=True)
        self.begin = np.append(begin, len(g))
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in grams])[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.sorted >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Indexes of the windows that are seeds."""
        near = np.flatnonzero(self.table[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(near) or not len(self.sorted):
            return near[:0]
        k = np.minimum(np.searchsorted(self.sorted, g[near]), len(self.sorted) - 1)
        return near[self.sorted[k] == g[near]]


def _windows(texts: pa.Array, seeds: Seeds):
    """(row, its word hashes, its windows that are seeds and their positions) of the rows that have any."""
    for a, _, raw, off in kernel.slices(pc.utf8_lower(texts)):
        s, e, first = kernel.words(raw, off, marks=True)
        h = kernel.hash_words(raw, s, e)
        g, begin = kernel.hash_grams(h, first, seeds.n)
        found = seeds.hits(g)
        if len(found):
            row = np.searchsorted(begin, found, "right") - 1
            for i in np.unique(row):
                mine = found[row == i]
                yield a + int(i), h[first[i] : first[i + 1]], g[mine], mine - begin[i]


def _match(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        for batch in batches:
            docs, out = batch["doc_id"].to_pylist(), []
            for row, h, g, at in _windows(batch["text"], seeds):
                hits: dict[int, list[int]] = defaultdict(list)
                for j, p in zip(np.searchsorted(seeds.sorted, g).tolist(), at.tolist()):
                    for k in seeds.item[seeds.begin[j] : seeds.begin[j + 1]].tolist():
                        hits[k].append(p)
                for k, ps in hits.items():
                    item_id, item = seeds.items[k]
                    reach, best, i = len(item) + len(item) // 4 + 4, (0.0, 0, 0), 0
                    while i < len(ps):  # passages whose seeds lie within an item's reach of each other are one
                        j = i
                        while j + 1 < len(ps) and ps[j + 1] - ps[j] <= reach:
                            j += 1
                        lo = max(0, ps[i] - reach)
                        passage = h[lo : ps[j] + reach]
                        if np.isin(item, passage).sum() / len(item) >= threshold:
                            score, end = align(item, passage)
                            best = max(best, (score / (MATCH * len(item)), lo + end, j - i + 1))
                        i = j + 1
                    if best[0] >= threshold:
                        out.append((docs[row], item_id, *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "end_word", "n_seeds"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, end_word, n_seeds) for each row of `docs` and distinct benchmark item that align.

    score is the alignment's share of the item's full score (0 to 1, at least `threshold`); n_seeds counts the seeds of its
    passage.  Null and empty texts, and items of under n words, match nothing; repeated documents are repeated in the
    result, repeated items are not; ids may be null.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    passes = int(words) // ITEM_WORDS + 1
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()  # ITEM_WORDS words or so
        hashed = []
        for item_id, text in sorted(part, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            raw = np.frombuffer(pc.utf8_lower(text).as_py().encode(), np.uint8)
            s, e, _ = kernel.words(raw, np.array([0, len(raw)]), marks=True)
            if len(s) >= n:
                hashed.append((item_id, kernel.hash_words(raw, s, e)))
        shared = spark.sparkContext.broadcast(Seeds(hashed, n))
        found = docs.mapInArrow(kernel.tidy(_match(shared, threshold)), "doc_id long, item_id long, score double, end_word long, n_seeds long")
        out = found if out is None else out.unionByName(found)
    return out
