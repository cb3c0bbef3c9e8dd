"""Chunking strategies: character windows, recursive separators, markdown sections, semantic breaks and long splits.

Character and markdown chunks are DataFrame plans.  Recursive and long splits are folds over pieces, which run as
Arrow-batched Python over rows, as semantic breaks do, which look at one document alone; both keep every chunk within its size.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import SENTENCE_END

STRATEGIES = ("character", "semantic", "recursive", "markdown")
SEPARATORS = ("\n\n", "。", "，", " ", "")
LONG = 6000
#: Characters of chunks in a frame that goes back to Spark.
FRAME = 1 << 20
_SENTENCE, _NINE = re.compile(SENTENCE_END), Decimal("1e-9")


@dataclass(frozen=True)
class ChunkConfig:
    """What a strategy needs; `strategy` is one of STRATEGIES."""

    strategy: str = "markdown"
    size: int = 1000
    overlap: int = 200
    separators: tuple[str, ...] = SEPARATORS
    percentile: float = 0.95
    min_chunk_size: int = 0

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; one of {STRATEGIES}")
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and less than size")


def not_blank(docs: DataFrame) -> DataFrame:
    """Documents with text other than white space; others have no chunks."""
    return docs.where(r"text is not null and text rlike '\\S'")


def character(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, chunk): windows of `size`, `size - overlap` apart, until one reaches the end."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / step)).cast("int")
    at = not_blank(docs).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return at.select("doc_id", "chunk_index", F.substring("text", F.col("chunk_index") * step + 1, F.lit(size)).alias("chunk"))


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split by the first separator that occurs, which stays with the piece it begins; then merge pieces up to `size`."""

    def pieces(t: str, seps: tuple[str, ...]) -> list[str]:
        if len(t) <= size:
            return [t]
        for k, sep in enumerate(seps):
            if sep and sep in t:
                first, *rest = t.split(sep)
                parts = [p for p in (first, *(sep + r for r in rest)) if p]
                return [x for p in parts for x in pieces(p, seps[k + 1 :])]
        return [t[i : i + size] for i in range(0, len(t), size)]

    chunks: list[str] = []
    held: list[str] = []
    length = 0
    for p in pieces(text, separators):
        if held and length + len(p) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    return [*chunks, "".join(held)] if held else chunks


def fill(units: list[tuple[str, str]], limit: int) -> list[str]:
    """Greedy chunks of (glue, text) units of at most `limit` characters each; a unit's glue stands before it unless it begins a chunk."""
    chunks: list[list[str]] = []
    room = -1
    for glue, text in units:
        need = len(glue) + len(text)
        if need <= room:
            chunks[-1] += [glue, text]
            room -= need
        else:
            chunks.append([text])
            room = limit - len(text)
    return ["".join(c) for c in chunks]


_STOP = re.compile(r"(?<=。)|(?<=\. )")


def split_long(text: str, limit: int = LONG) -> list[str]:
    """Chunks of at most `limit` characters that break at paragraphs, in longer paragraphs after stops, in longer sentences anywhere."""
    units: list[tuple[str, str]] = []
    for paragraph in text.split("\n\n"):
        glue = "\n\n"
        for sentence in [paragraph] if len(paragraph) <= limit else _STOP.split(paragraph):
            for at in range(0, len(sentence), limit):
                units.append((glue, sentence[at : at + limit]))
                glue = ""
    return [c for c in fill(units, limit) if c.strip()]


def _frames(batch: pd.DataFrame, split: Callable[[str], list[str]]) -> Iterator[pd.DataFrame]:
    """The chunks of a batch of documents in frames of about FRAME characters, so that those of a whole batch are never held at once."""
    rows, held = [], 0
    for d, t in zip(batch["doc_id"], batch["text"]):
        for i, c in enumerate(split(t)):
            rows.append((d, i, c))
            held += len(c)
            if held >= FRAME:
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk"])
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk"])


def _by_row(docs: DataFrame, split: Callable[[str], list[str]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(batch, split)

    return not_blank(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, chunk_index int, chunk string")


def recursive(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    return _by_row(docs, lambda t: split_recursive(t, size, overlap, separators))


def long_split(docs: DataFrame, limit: int = LONG) -> DataFrame:
    """(doc_id, chunk_index, chunk); only texts over `limit` go through Python."""
    whole = not_blank(docs).where(F.length("text") <= limit).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"))
    return whole.unionByName(_by_row(docs.where(F.length("text") > limit), lambda t: split_long(t, limit)))


def markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, chunk): the trimmed lines between headers of levels 1 to 6; headers in code fences are text."""
    lines = not_blank(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    so_far = Window.partitionBy("doc_id").orderBy("i")
    fenced = F.pmod(F.sum(F.col("line").startswith("```").cast("int")).over(so_far), F.lit(2)) == 1
    lines = lines.withColumn("header", ~fenced & F.col("line").rlike(r"^#{1,6}\s+\S"))
    lines = lines.withColumn("section", F.sum(F.col("header").cast("int")).over(so_far)).where(~F.col("header") & (F.col("line") != ""))
    parts = lines.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("chunk"))
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1).alias("chunk_index")
    return parts.select("doc_id", index, "chunk")


@functools.lru_cache(1 << 16)
def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64


def sentence_distances(sentences: list[str]) -> list[float]:
    """1 - cosine of each sentence's hashed word counts and the next one's, rounded half up to 9 places."""
    counts = [Counter(map(_bucket, s.split(" "))) for s in sentences]
    norms = [math.sqrt(sum(c * c for c in v.values())) for v in counts]
    out = []
    for v, w, n, m in zip(counts, counts[1:], norms, norms[1:]):
        x = 1 - sum(c * w[b] for b, c in v.items() if b in w) / (n * m)
        out.append(float(Decimal(repr(x)).quantize(_NINE, ROUND_HALF_UP)))
    return out


def _percentile(values: list[float], part: float) -> float:
    """As Spark's percentile: between the two nearest values."""
    ordered, at = sorted(values), (len(values) - 1) * part
    low, high = math.floor(at), math.ceil(at)
    a, b = ordered[low], ordered[high]
    return a if a == b else (high - at) * a + (at - low) * b


def split_semantic(text: str, percentile: float = 0.95, min_chunk_size: int = 0) -> list[str]:
    """Sentences, joined; a break follows each that is farther from the next than the text's percentile of distances."""
    sentences = [s for s in (x.strip(" ") for x in _SENTENCE.split(text)) if s]
    far = sentence_distances(sentences)
    limit = _percentile(far, percentile) if far else 0.0
    chunks, held = [], []
    for i, s in enumerate(sentences):
        held.append(s)
        if i < len(far) and far[i] > limit:
            chunks.append(" ".join(held))
            held = []
    if held:
        chunks.append(" ".join(held))
    if min_chunk_size:  # a chunk that is too short goes with those after it
        parts, chunks, held = chunks, [], []
        for p in parts:
            held.append(p)
            if len(p) >= min_chunk_size:
                chunks.append(" ".join(held))
                held = []
        if held:
            chunks.append(" ".join(held))
    return chunks


def semantic(docs: DataFrame, percentile: float = 0.95, min_chunk_size: int = 0) -> DataFrame:
    """(doc_id, chunk_index, chunk) by split_semantic()."""
    return _by_row(docs.where("doc_id is not null"), lambda t: split_semantic(t, percentile, min_chunk_size))


def chunk(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """(doc_id, chunk_index, chunk) by the configured strategy."""
    if config.strategy == "character":
        return character(docs, config.size, config.overlap)
    if config.strategy == "recursive":
        return recursive(docs, config.size, config.overlap, config.separators)
    if config.strategy == "semantic":
        return semantic(docs, config.percentile, config.min_chunk_size)
    return markdown(docs)


def with_metadata(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks of documents with document_name, chunk_size and total_chunks."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return chunks.join(names, "doc_id").select("doc_id", "document_name", "chunk_index", F.length("chunk").alias("chunk_size"), total.alias("total_chunks"), "chunk")


def clear_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with nothing but their place and text."""
    return chunks.select("doc_id", "chunk_index", "chunk")
