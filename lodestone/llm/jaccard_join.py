"""N-gram Jaccard join: grouped prefix join over word shingles.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles.

1. Documents with the same set are one class.  The same pass counts shingles in a fixed-size table of
   counters, whose magnitudes give a global order, rare first.  The order only decides which shingles form
   a prefix; any order gives the same links, so rough counts cost no result.
2. The prefix of a set of n is its first n - ceil(percent * n / 100) + 1 shingles in that order.  Classes with
   identical prefix and size are collapsed into one group, and only groups are posted under prefix shingles.
3. Group pairs that share a shingle are filtered by size and position: with pos shingles before the shared one,
   at most min(n1 - pos1, n2 - pos2) can be common, and (100 + percent) * common >= percent * (n1 + n2) is needed.
   A pair passes at its first common shingle if it links, so nothing is lost.
4. Groups are expanded to classes; pairs are filtered by parity bitmaps of about a bit a shingle, whose differing
   bits are at most the unshared shingles, and verified on the full sets.  In a round of stars each member meets only one
   pivot under its shingle; classes found connected are then joined no more.  Rounds with other pivots follow while
   some shingle has many pairs across components, and the last round verifies every remaining
   pair of classes in different components.  A group of thousands of copies thus costs pairs in proportion to its
   size, and no link between components goes unseen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import kernel
from lodestone.llm.components import components
from lodestone.llm.store import narrow_batches, table

#: Ends of candidate pairs are broadcast up to this many (40 MB); beyond it their join with the texts is shuffled.
BROADCAST_ENDS = 1_000_000
#: 2**COUNTER_BITS counters give the order of shingles (a byte each in the driver and the broadcast).
COUNTER_BITS = 21
#: Classes that a task remembers having posted, before it starts anew.
SEEN_CLASSES = 200_000
#: Groups of one size under a key have PIVOTS pivots if there are more than PAIRS_FOR_EACH pairs across components each.  Rounds
#: of stars, STAR_ROUNDS at most, end when there are PAIRS_LEFT each or fewer.
STAR_ROUNDS, PAIRS_FOR_EACH, PAIRS_LEFT, PIVOTS = 4, 16, 64, 16
_BLOCK = 1 << 16


def class_hash(x: np.ndarray) -> int:
    """A set's 63-bit fingerprint."""
    return int(kernel.mix(kernel.mix(x).sum(keepdims=True) ^ (x * kernel._COEF[3]).sum(keepdims=True))[0] >> np.uint64(1))


def parity_bits(x: np.ndarray) -> bytes:
    """A bit for each of 2**j >= n residues of the hashes: whether an odd number of them has it."""
    m = max(64, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def differences(x: bytes, y: bytes) -> int:
    """At most the number of elements that two sets don't share, from their parities: a shared element cancels out."""
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    m = min(len(a), len(b))
    return int((np.bitwise_xor.reduce(a.reshape(-1, m)) ^ np.bitwise_xor.reduce(b.reshape(-1, m))).sum())


def _near_enough(percent: int):
    """Keeps pairs (a, b, n1, n2, x, y) whose parities allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch["n1"].to_numpy() + batch["n2"].to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            keep = pa.array([differences(x, y) <= d for x, y, d in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), most.tolist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    return run


def scan(k: int, bits: int):
    """documents -> a row (doc_id, n, c, parity) each, then this task's shingle counts in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids, n, c, parity = batch["doc_id"], [], [], []
            for _, x, _ in kernel.shingle_sets(batch["text"], k):
                n.append(len(x))
                c.append(class_hash(x) if len(x) else 0)
                parity.append(parity_bits(x) if len(x) else None)
                np.add.at(counts, (x >> np.uint64(64 - bits)).astype(np.int64), 1)
            void = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(parity, pa.binary()), *void], ["doc_id", "n", "c", "parity", "block", "counts"])
        for b in range(0, len(counts), _BLOCK):
            if counts[b : b + _BLOCK].any():
                packed = zlib.compress(np.minimum(counts[b : b + _BLOCK], 65535).astype("<u2").tobytes(), 1)  # a magnitude is enough
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([b // _BLOCK], pa.int32()), pa.array([packed], pa.binary())], ["doc_id", "n", "c", "parity", "block", "counts"])

    return run


def _add_blocks(mean: float | None = None):
    """Sums of blocks of counters as float32; with `mean`, a byte for each counter instead: how far above the mean it is, in half powers
    of two of 1.5 standard deviations of chance sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
                raw = zlib.decompress(packed)
                x = np.frombuffer(raw, "<u2" if len(raw) == 2 * _BLOCK else "<f4")
                if b in total:
                    total[b] += x
                else:
                    total[b] = x.astype(np.float32)
        for b, x in total.items():
            if mean is not None:
                x -= mean
                x /= 1.5 * max(1.0, mean) ** 0.5
                np.maximum(x, 0.5, out=x)
                np.log2(x, out=x)
                x *= 2
                np.ceil(x, out=x)
                x = np.clip(x, 0, 62, out=x).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["block", "counts"])

    return run


def _ranks(scanned: DataFrame, bits: int) -> np.ndarray:
    """One byte for each of 2**bits counters; summed and ranked by executors, so that the driver gets bytes alone."""
    total = scanned.where("n is not null").agg(F.sum("n")).first()[0] or 0
    mean = total / (1 << bits)
    blocks = scanned.where("block is not null").select("block", "counts")
    parts = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Two levels, so that no task adds up what all tasks have counted.
    blocks = blocks.repartition(parts, F.xxhash64("block", "counts")).mapInArrow(kernel.tidy(_add_blocks()), "block int, counts binary")
    blocks = blocks.repartition(max(1, (1 << bits) // _BLOCK), "block").mapInArrow(kernel.tidy(_add_blocks(mean)), "block int, counts binary")
    ranks = np.zeros(1 << bits, np.uint8)
    for block, packed in blocks.collect():  # 2**bits bytes in all, whatever the input
        ranks[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return ranks


def _post(k: int, percent: int, bits: int, ranks):
    """documents -> (key, g, n, pos, c) for each prefix shingle of each class new to this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = ranks.value, set()
        for batch in batches:
            keys, gs, ns, ps, cs = [], [], [], [], []
            if len(seen) > SEEN_CLASSES:
                seen.clear()  # repeats go later on anyway
            for _, x, _ in kernel.shingle_sets(batch["text"], k):
                if not len(x):
                    continue
                n, c = len(x), class_hash(x)
                if (n, c) in seen:
                    continue
                seen.add((n, c))
                y = (rank[(x >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (x >> np.uint64(7))
                p = n - -(-percent * n // 100) + 1
                y = np.sort(np.partition(y, p - 1)[:p] if p < n else y)
                g = int((kernel.hash_run(y) ^ np.uint64(n)) >> np.uint64(1))
                keys.append(y.astype(np.int64))
                gs.append(np.full(p, g))
                ns.append(np.full(p, n))
                ps.append(np.arange(p))
                cs.append(np.full(p, c))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)).cast(t) for z, t in ((keys, pa.int64()), (gs, pa.int64()), (ns, pa.int32()), (ps, pa.int32()), (cs, pa.int64()))], ["key", "g", "n", "pos", "c"])

    return run


def shingle_pairs(k: int):
    """(doc_id, c, a, b, side, text) -> (a, b, x, y): the sorted shingle hashes as x (side 0) or y (side 1), if c is the text's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []  # one document's rows are together
            which = np.searchsorted(new, np.arange(len(ids)), "right") - 1
            sets = [x for _, x, _ in kernel.shingle_sets(batch["text"].take(pa.array(new, pa.int64())), k)]
            fingerprints = np.array([class_hash(x) if len(x) else 0 for x in sets], np.int64)
            side = batch["side"].to_numpy()
            keep = np.flatnonzero(fingerprints[which] == batch["c"].to_numpy()) if len(ids) else np.zeros(0, np.int64)
            for i in range(0, len(keep), 500):
                some = keep[i : i + 500]
                at = pa.array(some, pa.int64())
                x, y = ([sets[which[r]].tobytes() if side[r] == s else None for r in some] for s in (0, 1))
                yield pa.RecordBatch.from_arrays([batch["a"].take(at), batch["b"].take(at), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b", "x", "y"])

    return run


def verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep, pa.bool_())), batch["b"].filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, bits: int = COUNTER_BITS) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_copies.

    `docs` has doc_id and text; other columns are ignored.  A text of fewer than k words has its whole sequence as
    its one shingle; a null, empty or blank text has none and is linked with nothing.  Repeated rows are returned
    as often as they occur.  A row with a null doc_id links nothing and has a null component.
    n_copies counts the documents with the same set.  2**bits counters order the shingles, a byte each of which is
    broadcast.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = table(docs.mapInArrow(kernel.tidy(scan(k, bits)), "doc_id long, n long, c long, parity binary, block int, counts binary"))
    rows = scanned.where("n is not null").select("doc_id", "n", "c")
    classes = scanned.where("n > 0 and doc_id is not null").groupBy("n", "c").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.min("parity").alias("parity"))

    multi, members = prefix_postings(docs, scanned, classes, k, percent, bits)
    return _link(docs, rows, classes, multi, members, k, percent)


def prefix_postings(docs, scanned, classes, k, percent, bits) -> tuple[DataFrame, DataFrame]:
    """Postings (key, g, n, pos) of the groups that may link with others, and their members (g, n, c, id, parity): steps 2 and 3."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_ranks(scanned, bits))
    posted = docs.where("doc_id is not null").select("text").mapInArrow(kernel.tidy(_post(k, percent, bits, ranks)), "key long, g long, n int, pos int, c long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    # One exchange by key serves the removal of repeats and the windows alike.
    posted = posted.repartition(parts, "key").distinct()
    under = Window.partitionBy("key")
    far = 100 + percent
    multi = (
        posted.withColumn("posts", F.count("*").over(under))
        .withColumn("least_n", F.min("n").over(under))
        .withColumn("most", F.max(F.expr(f"100 * n - {far} * pos")).over(under))
        # What can't pass the filter with any other group under the key isn't carried on.
        .where(f"posts > 1 and {far} * (n - pos) - {percent} * n >= {percent} * least_n and most >= {percent} * n")
    )
    posts = table(multi.drop("posts", "least_n", "most"))
    multi = posts.select("key", "g", "n", "pos").distinct()
    members = table(posts.select("g", F.col("n").cast("long").alias("n"), "c").distinct().join(classes, ["n", "c"]).select("g", "n", "c", "id", "parity"))
    return multi, members


def _link(docs, rows, classes, multi, members, k, percent):
    far = 100 + percent
    known = members.select(F.col("id").alias("doc_id"), "c").distinct()
    signs = members.groupBy("id").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    passes = f"{far} * least(n1 - pos1, n2 - pos2) >= {percent} * (n1 + n2)"

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link.  Sets are made of just the documents in pairs whose parities pass, and shuffled once, by pair."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(signs.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("parity").alias("x")), "a").join(signs.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("parity").alias("y")), "b")
        pairs = table(pairs.select("a", "b", "n1", "n2", "x", "y").mapInArrow(_near_enough(percent), "a long, b long"))
        ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.lit(0).alias("side")), F.struct(F.col("b").alias("doc_id"), F.lit(1).alias("side")))).alias("e"))
        ends = table(ends.select("a", "b", "e.doc_id", "e.side").join(known, "doc_id"))
        if ends.count() <= BROADCAST_ENDS:
            ends = F.broadcast(ends)
        sets = docs.join(ends, "doc_id").select("doc_id", "c", "a", "b", "side", "text").mapInArrow(kernel.tidy(shingle_pairs(k)), "a long, b long, x binary, y binary")
        both = sets.groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y")).where("x is not null and y is not null")
        return table(both.mapInArrow(verify(percent), "a long, b long"))

    def one_for_each(pairs: DataFrame, placed: DataFrame, turn: int) -> DataFrame:
        """For pairs of groups, one member of either with every member of the other that lies in another component."""
        one = placed.groupBy(F.col("g").alias("g1")).agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(turn))).alias("p"))
        every = placed.select(F.col("g").alias("g2"), F.col("id").alias("b"), F.col("component").alias("cb"))
        either = pairs.unionByName(pairs.select(F.col("g2").alias("g1"), F.col("g1").alias("g2")))
        return either.join(one, "g1").join(every, "g2").where("p.component <> cb").select(F.col("p.id").alias("a"), "b")

    def apart(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The groups whose members lie in several components, and the postings of keys under which groups of several do."""
        spread = placed.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        m = multi.join(spread, "g").withColumn("size", F.expr(f"cast(floor(ln(n) / ln(100 / {percent}D)) as int)") if percent < 100 else F.col("n"))
        keys = m.groupBy("key").agg(F.min("lo").alias("k_lo"), F.max("hi").alias("k_hi")).where("k_lo <> k_hi").select("key")
        return spread.where("lo <> hi").select(F.col("g").alias("g1"), F.col("g").alias("g2")), table(m.join(keys, "key", "left_semi"))

    def stars(m: DataFrame, turn: int) -> DataFrame:
        """Pairs of groups: each with a pivot under its key, and in crowds with each of several pivots of its size."""
        what = F.struct("g", "n", "pos", "lo", "hi")
        picked = m.join(crowds(m, PAIRS_FOR_EACH), ["key", "size"], "left_semi")
        order = Window.partitionBy("key", "size").orderBy(F.xxhash64("g", F.lit(turn)), "g")
        pivots = picked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).select("key", "size", what.alias("p"))
        met = picked.join(pivots, ["key", "size"]).select("p", "g", "n", "pos", "lo", "hi")
        if not turn:
            met = met.unionByName(m.join(m.groupBy("key").agg(F.min_by(what, F.xxhash64("g")).alias("p")), "key").select("p", "g", "n", "pos", "lo", "hi"))
        met = met.where("g <> p.g and not (lo = hi and p.lo = p.hi and lo = p.lo)")
        return met.where(f"{far} * least(n - pos, p.n - p.pos) >= {percent} * (n + p.n)").select(F.col("p.g").alias("g1"), F.col("g").alias("g2")).distinct()

    def crowds(m: DataFrame, least: int) -> DataFrame:
        """(key, size) under which groups of about one size have more than `least` pairs across components each."""
        near = m.where(f"{far} * (n - pos) >= {2 * percent} * n")  # others pass with no group of their size
        inside = near.groupBy("key", "size", F.expr("if(lo = hi, lo, -g)").alias("in")).agg(F.count("*").alias("c"))
        pairs = inside.groupBy("key", "size").agg(F.expr("(sum(c) * sum(c) - sum(c * c)) / 2").alias("pairs"), F.sum("c").alias("posts"))
        return pairs.where(f"pairs > {least} * posts").select("key", "size")

    edges, placed = None, members.select("g", "n", "id", F.col("id").alias("component"))
    for turn in range(STAR_ROUNDS + 1):
        wide, m = apart(placed)
        if turn == STAR_ROUNDS or turn and crowds(m, PAIRS_LEFT).isEmpty():
            break
        star = table(stars(m, turn).unionByName(wide))  # else the driver plans the whole round as one query, anew after each of its stages
        found = verified(one_for_each(star, placed, turn))
        edges = found if edges is None else edges.unionByName(found)
        so_far = components(edges)
        placed = table(members.join(so_far.withColumnRenamed("node", "id"), "id", "left").select("g", "n", "id", F.coalesce("component", "id").alias("component")))

    one = m.select("key", F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = m.select("key", F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    g_pairs = one.join(two, "key").where(f"g1 < g2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2) and {passes}").select("g1", "g2").distinct()
    # Within a group whose classes lie in several components, its classes meet as under a key of their own.
    g_pairs = g_pairs.unionByName(wide)
    left = placed.select(F.col("g").alias("g1"), F.col("id").alias("a"), F.col("component").alias("ca"))
    right = placed.select(F.col("g").alias("g2"), F.col("id").alias("b"), F.col("component").alias("cb"))
    rest = g_pairs.join(left, "g1").join(right, "g2").where("ca <> cb and (g1 <> g2 or a < b)").select("a", "b")
    more = verified(rest)

    final = components(edges.unionByName(more)).withColumnRenamed("node", "id")
    named = classes.join(final, "id", "left").select("n", "c", "n_copies", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, ["n", "c"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(doc_id is null, null, coalesce(component, doc_id))").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
