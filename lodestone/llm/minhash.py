"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

1. A document's signature has CHUNKS * WIDTH symbols: for each of as many hash functions, 16 bits of the least hash over the set of its
   distinct shingles.  Two signatures differ in a symbol with a probability of one less the Jaccard similarity (and 2**-16).
   Documents with the same set are one class.
2. Signatures at most DISTANCE = 19 symbols apart are found without exception: of 10 chunks one at least has one error or none.  A
   chunk's allowed errors are enumerated by leaving each of its symbols out in turn, which gives one key for each
   chunk and symbol, 50 in all.
3. Under each key, all members first meet a pivot, or several in a crowd, round by round; what is found connected isn't paired again,
   and all pairs across components are then compared.  Pairs whose signatures are within the distance, and whose parity bitmaps allow the similarity,
   are confirmed on their full sets.  Postings carry 256 of these parities, so that most pairs which can't link aren't made at all.
4. Documents that share a passage, or much of an original, crowd keys without being near.  Those that stand under a key with more
   than CROWD classes meet under the rarest shingles among them instead (the prefixes of the Jaccard join): two
   documents that link share such a shingle too, and a pair with any key that isn't crowded is found under that one.

At a similarity of 0.85, 7.5 of 50 symbols differ on average; a pair right at that bound is over 19 with a probability of 2e-5, one
at 0.9 with 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel
from lodestone.llm.components import components, labels
from lodestone.llm.jaccard_join import BROADCAST_ENDS, COUNTER_BITS, class_hash, differences, parity_bits, prefix_postings, scan, shingle_pairs, verify
from lodestone.llm.store import narrow_batches, table

CHUNKS, WIDTH, DISTANCE = 10, 5, 19
#: Classes under one key, beyond which they meet under rare shingles.
CROWD = 64
#: Rounds of pivots end when at most PAIRS_LEFT pairs across components for each posting are left, or after ROUNDS of them.  A key with
#: more than FEW members in several components has PIVOTS pivots from the second round on.  Between rounds, what lies within HOPS links counts as connected.
ROUNDS, PAIRS_LEFT, FEW, PIVOTS, HOPS = 4, 16, 16, 4, 4
_SYMBOLS = CHUNKS * WIDTH
_XOR = kernel.mix(np.arange(1, _SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[:, None]
_TIMES = (kernel.mix(np.arange(501, _SYMBOLS + 501, dtype=np.uint64)) | np.uint64(1))[:, None]
_BLOCK = 8192
#: Words of parities that postings carry, so that pairs which can't link are left out where they meet.
FOLD = ("f0", "f1", "f2", "f3")


def signature(x: np.ndarray) -> bytes:
    """The 16-bit symbols of a set of shingle hashes, little-endian."""
    least = None
    for i in range(0, len(x), _BLOCK):
        one = ((x[i : i + _BLOCK] ^ _XOR) * _TIMES).min(axis=1)
        least = one if least is None else np.minimum(least, one)
    return (kernel.mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def folded(x: np.ndarray) -> list[int]:
    """The parities of a set's hashes by 256 residues, as signed 64-bit words."""
    bits = np.packbits(np.bincount((x & np.uint64(64 * len(FOLD) - 1)).astype(np.int64), minlength=64 * len(FOLD)) & 1)
    return bits.view(np.int64).tolist()


def _scan(k: int):
    """documents -> (doc_id, n, c, sign, *FOLD): the size and fingerprint of the shingle set, its signature followed by its parities, and these folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, sign, fold = [], [], [], [[] for _ in FOLD]
            for _, x, _ in kernel.shingle_sets(batch["text"], k):
                n.append(len(x))
                c.append(class_hash(x) if len(x) else 0)
                sign.append(signature(x) + parity_bits(x) if len(x) else None)
                for column, word in zip(fold, folded(x)):
                    column.append(word)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(sign, pa.binary()), *(pa.array(f, pa.int64()) for f in fold)], ["doc_id", "n", "c", "sign", *FOLD])

    return run


def _within(distance: int, percent: int):
    """(a, b, c1, c2) of the pairs (a, b, n1, n2, c1, c2, x, y) whose signatures are within the distance and whose parities allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch["x"].to_pylist(), batch["y"].to_pylist()
            signs = (np.frombuffer(b"".join(v[: 2 * _SYMBOLS] for v in side), "<u2").reshape(-1, _SYMBOLS) for side in (x, y))
            total = batch["n1"].to_numpy() + batch["n2"].to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            keep = np.not_equal(*signs).sum(axis=1) <= distance
            for i in np.flatnonzero(keep):
                keep[i] = differences(x[i][2 * _SYMBOLS :], y[i][2 * _SYMBOLS :]) <= most[i]
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep)) for c in ("a", "b", "c1", "c2")], ["a", "b", "c1", "c2"])

    return run


def chunk_keys(sign: str) -> list:
    """A key for each chunk and each symbol left out of it."""
    keys = []
    for c in range(CHUNKS):
        for d in range(WIDTH):
            start = 2 * WIDTH * c + 1
            rest = F.concat(F.substring(sign, start, 2 * d), F.substring(sign, start + 2 * d + 2, 2 * (WIDTH - 1 - d)))
            keys.append(F.xxhash64(F.lit(WIDTH * c + d), rest))
    return keys


def _links(docs: DataFrame, classes: DataFrame, postings: DataFrame, k: int, percent: int, distance: int) -> DataFrame:
    """(a, b) links among the ids of classes (n, c, id, sign), for postings (key, id, n, pos, *FOLD): those that join all components."""
    far = 100 + percent
    unshared = " + ".join(f"bit_count({f} ^ {{0}}{f})" for f in FOLD)  # at most the shingles that two sets don't share
    passes = f"{far} * least(n - pos, {{0}}n - {{0}}pos) >= {percent} * (n + {{0}}n) and {unshared} <= n + {{0}}n - 2 * (({percent} * (n + {{0}}n) + {far - 1}) div {far})"

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link: by signature and parities first, and then by full sets, which are made of the documents in question alone."""
        side = lambda end, n, c, x: classes.select(F.col("id").alias(end), F.col("n").alias(n), F.col("c").alias(c), F.col("sign").alias(x))
        both = pairs.distinct().join(side("a", "n1", "c1", "x"), "a").join(side("b", "n2", "c2", "y"), "b")
        near = table(both.select("a", "b", "n1", "n2", "c1", "c2", "x", "y").mapInArrow(_within(distance, percent), "a long, b long, c1 long, c2 long"))
        ends = near.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("c1").alias("c"), F.lit(0).alias("side")), F.struct(F.col("b").alias("doc_id"), F.col("c2").alias("c"), F.lit(1).alias("side")))).alias("e")).select("a", "b", "e.*")
        ends = F.broadcast(ends) if 2 * near.count() <= BROADCAST_ENDS else ends
        sets = docs.join(ends, "doc_id").select("doc_id", "c", "a", "b", "side", "text").mapInArrow(kernel.tidy(shingle_pairs(k)), "a long, b long, x binary, y binary")
        sets = sets.groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y")).where("x is not null and y is not null")
        return table(sets.mapInArrow(verify(percent), "a long, b long"))

    edges, m = None, postings.withColumn("component", F.col("id"))
    for turn in range(ROUNDS + 1):
        spread = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        m = table(m.join(spread, "key", "left_semi")) if turn else m
        if turn == ROUNDS or turn and _pairs_left(m) <= PAIRS_LEFT:
            break
        member = F.struct("id", "n", "pos", "component", *FOLD)
        pivots = m.groupBy("key").agg(F.count("*").alias("posts"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.array(*(F.min_by(member, F.xxhash64("id", F.lit(turn * PIVOTS + j))) for j in range(PIVOTS if turn else 1))).alias("ps"))
        pivots = pivots.where("lo <> hi").select("key", F.expr(f"if(posts > {FEW}, array_distinct(ps), slice(ps, 1, 1))").alias("ps"))
        met = m.join(pivots, "key").select("id", "n", "pos", "component", *FOLD, F.explode("ps").alias("p")).where("p.component <> component and p.id <> id").where(passes.format("p."))
        found = verified(met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")))
        edges = found if edges is None else edges.unionByName(found)
        connected = labels(edges, HOPS).withColumnRenamed("node", "id")
        m = table(postings.join(connected, "id", "left").select("key", "id", "n", "pos", *FOLD, F.coalesce("component", "id").alias("component")))
    other = m.select("key", *(F.col(c).alias(f"o_{c}") for c in ("id", "n", "pos", "component", *FOLD)))
    rest = m.join(other, "key").where("id < o_id and component <> o_component").where(passes.format("o_"))
    return edges.unionByName(verified(rest.select(F.col("id").alias("a"), F.col("o_id").alias("b"))))


def _pairs_left(m: DataFrame) -> float:
    """Pairs across components under the keys, for each posting."""
    inside = m.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("posts"), F.sum(F.col("c") * F.col("c")).alias("same"))
    row = inside.agg((F.sum(F.col("posts") * F.col("posts") - F.col("same")) / 2).alias("pairs"), F.sum("posts").alias("posts")).first()
    return row.pairs / row.posts if row.posts else 0.0


def minhash_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept, n_copies.

    Documents whose signatures are at most `distance` (19 at most) apart link if 100 * common >= percent * union for their sets of k-word
    shingles.  `docs` has doc_id and text; other columns are ignored.  A text of fewer than k words has its
    whole sequence as its one shingle; a null, empty or blank text has none and is linked with nothing.  kept tells whether the
    document is its component's smallest.  Repeated rows are returned as often as they occur; a row with a null doc_id links
    nothing, has a null component and is kept.
    """
    if not 0 <= distance <= 2 * CHUNKS - 1:
        raise ValueError(f"{CHUNKS} chunks with an error each find signatures up to {2 * CHUNKS - 1} apart")
    narrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = table(docs.mapInArrow(kernel.tidy(_scan(k)), "doc_id long, n long, c long, sign binary, " + ", ".join(f"{f} long" for f in FOLD)))
    rows = scanned.select("doc_id", "n", "c")
    classes = table(scanned.where("n > 0 and doc_id is not null").groupBy("n", "c").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.min(F.struct("sign", *FOLD)).alias("s")).select("n", "c", "id", "n_copies", "s.*"))
    posted = classes.select(F.explode(F.array(*chunk_keys("sign"))).alias("key"), F.col("id").alias("g"), F.col("n").cast("int").alias("n"), *FOLD)
    posts = posted.groupBy("key").agg(F.count("*").alias("posts")).where("posts > 1")
    shared = table(posted.join(posts, "key").select("key", "g", "n", *FOLD, (F.col("posts") > crowd).alias("crowded")))
    postings = shared.where("not crowded").select("key", F.col("g").alias("id"), "n", F.lit(0).alias("pos"), *FOLD)
    busy = table(shared.where("crowded").select(F.col("g").alias("doc_id")).distinct())
    if not busy.isEmpty():
        some = docs.join(busy, "doc_id", "left_semi")
        counted = table(some.mapInArrow(kernel.tidy(scan(k, COUNTER_BITS)), "doc_id long, n long, c long, parity binary, block int, counts binary"))
        rare, members = prefix_postings(some, counted, classes.withColumnRenamed("sign", "parity"), k, percent, COUNTER_BITS)
        folds = classes.select("id", F.col("n").cast("int").alias("n"), *FOLD)
        postings = postings.unionByName(rare.join(members.select("g", "id"), "g").join(folds, ["id", "n"]).select("key", "id", "n", "pos", *FOLD))
    links = _links(docs, classes, table(postings), k, percent, distance)
    named = components(links).withColumnRenamed("node", "id")
    named = classes.join(named, "id", "left").select("n", "c", "n_copies", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, ["n", "c"], "left")
    component = F.expr("if(doc_id is null, null, coalesce(component, doc_id))")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
