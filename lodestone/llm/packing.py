"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Only the counts of pieces by length reach the driver: at most `capacity` numbers, whatever the corpus.  Best-fit
decreasing runs on these counts, longest first, with open bins as classes of equal content; a segment tree over
the remaining capacities gives the tightest open class in logarithmic time.  Equal pieces fill equal bins in one
step, so the plan is the plan of the document-by-document algorithm, and its size is bounded by the capacity: a
length opens and splits a fixed number of classes, and a class takes at most as many steps as distinct lengths fit
in a bin.  Pieces then look up their places by length and rank among the pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import kernel
from lodestone.llm.store import narrow_batches, table

#: Pieces of one length that are ranked in one task; a longer run is divided by a hash.
RANKED_ROWS = 200_000
#: Words that a Python worker's memo of token ids holds (about 200 bytes each) before it starts anew.
MEMO_WORDS = 300_000


class CapacityTree:
    """A segment tree over remaining capacities 0..n that finds the smallest open one of at least a size."""

    def __init__(self, n: int) -> None:
        self.width = 1 << (n + 1).bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, change: int) -> None:
        i = capacity + self.width
        while i:
            self.count[i] += change
            i //= 2

    def tightest(self, size: int) -> int | None:
        """The smallest capacity >= size with an open class: up to the first right-hand sibling that has one, then down."""
        i = size + self.width
        if self.count[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """counts of pieces by length -> steps (length, first rank, each, first bin, offset) and the number of bins.

    In a step, `each` pieces of the length go side by side from `offset` into every bin of a run of bins; ranks
    of a length are given to the steps in order.
    """
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> runs of bins (first, number)
    steps, bins = [], 0

    def put(first: int, number: int, left: int) -> None:
        if number and left:
            open_[left].append((first, number))
            tree.add(left, 1)

    for length in sorted(counts, reverse=True):
        rest, rank = counts[length], 0
        while rest:
            left = tree.tightest(length)
            if left is None:
                left, first, number = capacity, bins, -(-rest // (capacity // length))
                bins += number
            else:
                first, number = open_[left].pop()
                tree.add(left, -1)
            each = left // length
            full = min(number, rest // each)
            if full:
                steps.append((length, rank, each, first, capacity - left))
                rank, rest = rank + full * each, rest - full * each
                put(first, full, left - each * length)
            if full < number and rest:  # fewer are left than fill one more bin
                steps.append((length, rank, rest, first + full, capacity - left))
                put(first + full, 1, left - rest * length)
                rank, rest, full = rank + rest, 0, full + 1
            put(first + full, number - full, left)
    return steps, bins


#: What the memo's fast way takes: Latin-1 letters, before at most one stop.  NFC leaves such words as they are.
_PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else one from U+0100 up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}
    return {b: others.get(b) or chr(b) for b in range(256)}


_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _spans(text: bytes, limit: int = kernel.SLICE_BYTES) -> Iterator[bytes]:
    """`text` in spans of at least `limit` bytes (the last may be shorter), each of which ends before ASCII white space."""
    a = 0
    while found := _SPACE.search(text, a + limit):
        yield text[a : found.start()]
        a = found.start()
    yield text[a:]


_encoders: dict[str, object] = {}


def tokenizer(path: str):
    """Text -> array of uint32 ids without special tokens, through a memo of the pieces between ASCII white space.

    For a byte-level BPE that lower-cases and drops white space, as word_bpe_49k.json: no token of it crosses white
    space, so each run of other characters is tokenised once and remembered (in the Python worker, over its tasks).
    Plain words go to the BPE model itself, all others through the whole library pipeline.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    model, letters = t.model, _byte_letters()
    memo: dict[bytes, bytes] = {}

    stops = {c.encode(): np.array([model.tokenize(c)[0].id], "<u4").tobytes() for c in ".,!?;:"}

    def learn(piece: bytes) -> bytes:
        stop = stops.get(piece[-1:], b"")
        stem = piece[:-1] if stop else piece
        if (ids := memo.get(stem)) and _PLAIN.fullmatch(stem.decode()):
            return ids + stop
        word = stem.decode()
        if _PLAIN.fullmatch(word):
            ids = memo[stem] = array("I", [x.id for x in model.tokenize(word.lower().encode().decode("latin-1").translate(letters))]).tobytes()
            return ids + stop
        return array("I", t.encode(piece.decode(), add_special_tokens=False).ids).tobytes()

    def encode(text: bytes) -> np.ndarray:
        if b"\xcc" not in text and b"\xcd" not in text:  # no combining marks, with which case and composition interact
            text = text.lower()
        found = text.split()
        try:
            return np.frombuffer(b"".join(map(memo.__getitem__, found)), "<u4")
        except KeyError:
            new = {w for w in found if w not in memo}
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = set(found)
            for w in new:
                memo[w] = learn(w)
            return np.frombuffer(b"".join(map(memo.__getitem__, found)), "<u4")

    _encoders[path] = encode
    return encode


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), np.array([end_id], "<u4")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())):
                ids = np.concatenate([*map(encode, _spans(text.as_py() or b"")), end])
                for k, a in enumerate(range(0, len(ids), capacity)):
                    x = ids[a : a + capacity]
                    for column, v in zip(out, (doc, k, a, len(x), zlib.crc32(x.tobytes()))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(steps, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = steps.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            # Steps are in order of falling length and rising rank: one sorted key for both.
            at = np.searchsorted(a["key"], (capacity - length) * (1 << 45) + rank, "right") - 1
            k = rank - a["rank"][at]
            seq, place = a["bin"][at] + k // a["each"][at], a["offset"][at] + k % a["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq, pa.int64()), pa.array(place, pa.int64())], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack every row of `docs` (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    A document is its token ids and then `end_id`; a null or empty text is `end_id` alone.  Longer documents are cut
    into pieces of `capacity`, the last one shorter.  Returns for each piece doc_id, piece, start, length, ids_crc32,
    sequence_id and offset; sequences have no gaps.  Repeated rows are packed as often as they occur; a null doc_id
    is kept as such.  No rows give no pieces.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = table(docs.mapInArrow(kernel.tidy(_pieces(tokenizer_path, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    steps, _ = plan(counts, capacity)
    a = np.array(steps or [(capacity, 0, 1, 0, 0)], np.int64)
    packed = {"key": (capacity - a[:, 0]) * (1 << 45) + a[:, 1], "rank": a[:, 1], "each": a[:, 2], "bin": a[:, 3], "offset": a[:, 4]}

    # Ranks within a length: in buckets of bounded size, each starting after the buckets before it.
    crowded = [(n, c // RANKED_ROWS + 1) for n, c in sorted(counts.items()) if c > RANKED_ROWS]
    if crowded:  # a row for each such length, at most `capacity`
        split = F.broadcast(spark.createDataFrame(crowded, "length long, buckets long"))
        spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.coalesce("buckets", F.lit(1)))
        hashed = table(pieces.join(split, "length", "left").withColumn("bucket", spread).drop("buckets"))
    else:
        hashed = pieces.withColumn("bucket", F.lit(0).cast("long"))
    sizes = hashed.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    begin = sizes.select("length", "bucket", (F.sum("rows").over(Window.partitionBy("length").orderBy("bucket")) - F.col("rows")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = hashed.withColumn("within", within).join(begin, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(spark.sparkContext.broadcast(packed), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
