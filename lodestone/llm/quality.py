"""Quality rules: base counts and a distribution-divergence test against language references.

A document's shares of character classes and of the commonest words of a language are compared with that language's
reference by Jensen-Shannon distance.  References are the summed counts of a bounded sample of documents that labels
call good; the sample's bound is a parameter, the commonest words are those of the sample.  A document is rejected
if its characters are far from every reference, or if both its characters and its words are less far.  Texts of under `min_words` words
are too short for a histogram to tell and are left to the base rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernel
from lodestone.llm.store import narrow_batches

#: Character classes: lower-case, upper-case, digit, white space, stops, other ASCII, other characters' lead and following bytes.
CLASSES = 7
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x21:0x7F] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[:9] = _CLASS[0x0E:0x20] = _CLASS[0x7F] = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_HISTOGRAM_EDGE = b".,;:!?\"'()"


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two histograms; 1 if one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(parts / 2, 0)))


def _bare(word: bytes) -> bytes:
    return word.lower().strip(_HISTOGRAM_EDGE)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, kind, item, n): words as kind w, classes as kind c."""
    for batch in batches:
        n: Counter = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            raw = (text or "").encode()
            n.update((lang or "", "w", w.decode(errors="replace")) for w in map(_bare, raw.split()) if w)
            for c, k in enumerate(np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES).tolist()):
                n[lang or "", "c", str(c)] += k
        columns = zip(*n) if n else ((), (), ())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(n.values()), pa.int64())], ["lang", "kind", "item", "n"])


def fit_references(sample: DataFrame, top_words: int) -> dict[str, dict]:
    """(lang, text) rows -> for each language its class counts, commonest words and their shares: top_words + 8 rows each."""
    n = sample.select("lang", "text").mapInArrow(kernel.tidy(_tally), "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    total = n.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    # The best of each of 16 parts first, so that no task gets all words of a language.
    most, best = max(top_words, CLASSES), (F.desc("n"), "item")
    part = n.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(16)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind", "part").orderBy(*best))).where(F.col("r") <= most).drop("part", "r")
    top = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(*best))).where(F.col("r") <= most).join(F.broadcast(total), ["lang", "kind"])
    out: dict[str, dict] = {}
    for r in top.orderBy("lang", "kind", "r").collect():
        ref = out.setdefault(r.lang, {"chars": np.zeros(CLASSES), "words": [], "shares": [], "total": 0})
        if r.kind == "c":
            ref["chars"][int(r.item)] = r.n
        elif len(ref["words"]) < top_words:
            ref["words"].append(r.item.encode())
            ref["shares"].append(r.n)
            ref["total"] = r.total
    for ref in out.values():
        ref["shares"] = np.array([*ref["shares"], ref["total"] - sum(ref["shares"])], float)
    return {k: v for k, v in out.items() if v["total"]}


def _repeated(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the number of words that lie in a 3-word window occurring twice or more in it."""
    g, begin = kernel.hash_grams(h, first, 3)
    rows = len(first) - 1
    if not len(g):
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(begin))
    keyed = g + kernel.mix(row.astype(np.uint64) + np.uint64(7))  # so that windows of different rows differ
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(h) + 1, bool)
    at = np.arange(len(g)) + (first[:-1] - begin[:-1])[row]
    for j in range(3):
        inside[at[twice] + j] = True
    total = np.concatenate([[0], np.cumsum(inside[:-1])])
    return total[first[1:]] - total[first[:-1]]


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def _rules(refs: dict[str, dict], limits: dict):
    names = sorted(refs)
    place = [{w: i for i, w in enumerate(refs[k]["words"])} for k in names]
    common = set().union(*place) if place else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")}
            for _, _, raw, off in kernel.slices(batch["text"]):
                s, e, first = kernel.words(raw, off)
                h = kernel.hash_words(raw, s, e, fold=False)
                n_words = np.diff(first)
                lead = np.concatenate([[0], np.cumsum(_LEAD[raw] & ~kernel._SPACE[raw])])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
                repeats = _repeated(h, first)
                word_chars, n_symbols = np.diff(lead[off]), np.diff(symbols[off])
                failed = (n_words < limits["min_base_words"]) | (100 * repeats > limits["max_repeat_percent"] * n_words)
                for i in range(len(off) - 1):
                    text = raw[off[i] : off[i + 1]].tobytes()
                    dc = dw = None
                    if names and not failed[i] and n_words[i] >= limits["min_words"]:
                        chars = np.bincount(_CLASS[raw[off[i] : off[i + 1]]], minlength=CLASSES)
                        found = Counter(x for x in map(_bare, text.split()) if x in common)
                        dc, dw = 1.0, 1.0
                        for name, at in zip(names, place):
                            ref = refs[name]
                            words = np.zeros(len(at) + 1)
                            for w, c in found.items():
                                if w in at:
                                    words[at[w]] = c
                            words[-1] = n_words[i] - words.sum()
                            dc, dw = min(dc, js_distance(chars, ref["chars"])), min(dw, js_distance(words, ref["shares"]))
                    out["n_dup_lines"].append(_dup_lines(text))
                    out["char_distance"].append(dc)
                    out["word_distance"].append(dw)
                    out["kept"].append(bool(not failed[i] and (dc is None or dc <= limits["max_char_distance"] and (dc <= limits["joint_char_distance"] or dw <= limits["joint_word_distance"]))))
                for k, v in (("n_words", n_words), ("word_chars", word_chars), ("n_symbols", n_symbols), ("n_repeat_words", repeats), ("base_failed", failed)):
                    out[k] += v.tolist()
            types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "char_distance": pa.float64(), "word_distance": pa.float64()}
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], [*batch.schema.names, *out])

    return run


def reference_sample(docs: DataFrame, labels: DataFrame | None, rows: int) -> DataFrame | None:
    """(lang, text) of the documents with quality 1 and toxic 0 among the `rows` such ids with the smallest hashes."""
    if labels is None:
        return None
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", lang.alias("lang"), "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")


_TYPES = {"long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}
#: What the rules add to a document's columns.
RULE = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double".split(", "))])


def quality_rules(
    docs: DataFrame,
    labels: DataFrame | None = None,
    *,
    sample_rows: int = 5000,
    top_words: int = 40,
    min_base_words: int = 50,
    max_repeat_percent: int = 50,
    min_words: int = 50,
    max_char_distance: float = 0.24,
    joint_char_distance: float = 0.15,
    joint_word_distance: float = 0.33,
) -> DataFrame:
    """All rows and columns of `docs` (text; lang for the references' languages) with the columns of the rules after them.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words count over the whole text; base_failed and kept
    are the verdicts; char_distance and word_distance are null where the method doesn't judge.  A null text counts as
    empty, which fails the base rules.  Without labels, or with none that are good, only the base rules judge.
    Columns of `docs` that have a rule column's name are dropped.  Repeated rows are judged alike.
    `sample_rows` bounds the labelled documents that the references are fitted on.
    """
    narrow_batches(docs.sparkSession)
    sample = reference_sample(docs, labels, sample_rows)
    refs = fit_references(sample, top_words) if sample is not None else {}
    limits = {"min_base_words": min_base_words, "max_repeat_percent": max_repeat_percent, "min_words": min_words, "max_char_distance": max_char_distance, "joint_char_distance": joint_char_distance, "joint_word_distance": joint_word_distance}
    docs = docs.drop(*RULE.names)
    # Python takes columns by names without dots and quotes; they get their own back afterwards.
    plain = docs.toDF(*(c if c in ("text", "lang") else f"c{i}" for i, c in enumerate(docs.columns)))
    judged = plain.mapInArrow(kernel.tidy(_rules(refs, limits)), T.StructType([*plain.schema.fields, *RULE.fields]))
    return judged.toDF(*docs.columns, *RULE.names)
