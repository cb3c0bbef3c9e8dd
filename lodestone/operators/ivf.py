"""A kept index for dense retrieval: a coarse quantiser (IVF) whose cells are Parquet partitions, with product-quantised codes.

build() fits both quantisers on a bounded sample and writes every vector into the partition of its nearest cell, beside a code of
one byte for each part of what separates it from the cell's centre.  open_index() serves any number of searches: a batch of
queries reads the codes (not the vectors) of the cells that it probes, and scores exactly what the codes shortlist.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lexical import top_k
from lodestone.operators.vector import cosine
from lodestone.session import small

#: Queries whose vectors are in memory at once.
QUERY_BLOCK = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in blocks of rows."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """k centres of the rows of x; a centre that loses all its rows starts anew at a random row."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        times = np.bincount(of, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres = np.where(times[:, None] > 0, total / np.maximum(times, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return centres


@dataclass(frozen=True)
class Quantisers:
    """centres: cells x dimensions; books: for each part of the dimensions, up to 256 centres of residuals."""

    centres: np.ndarray
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit rows."""
        cell = _nearest(x, self.centres)
        rest, codes, at = x - self.centres[cell], [], 0
        for book in self.books:
            codes.append(_nearest(rest[:, at : at + book.shape[1]], book))
            at += book.shape[1]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.hstack([book[codes[:, m]] for m, book in enumerate(self.books)])

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The cells, from the one most similar to each query on."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")


def fit(sample: np.ndarray, cells: int, parts: int = 16, seed: int = 42) -> Quantisers:
    rng, x = np.random.default_rng(seed), _unit(sample)
    centres = _k_means(x, min(cells, len(x)), rng)
    rest = x - centres[_nearest(x, centres)]
    cuts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
    return Quantisers(centres, [_k_means(np.ascontiguousarray(rest[:, c]), min(256, len(x)), rng) for c in cuts])


def calibrate(q: Quantisers, sample: np.ndarray, k: int = 10, target: float = 0.95, queries: int = 200) -> tuple[int, int]:
    """(cells to probe, length of the shortlist) with which at least `target` of the k best are found, half the misses allowed to each."""
    x = _unit(sample)
    some = x[:queries]
    exact = some @ x.T
    k, part = min(k, len(x)), 1 - (1 - target) / 2
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    cell, codes = q.encode(x)
    place = np.argsort(q.order(some), axis=1)  # of each cell in a query's order
    probes = int(np.quantile(np.take_along_axis(place, cell[best], axis=1), part, method="higher")) + 1
    rough = some @ q.decode(cell, codes).T
    ahead = [(rough[i] > rough[i, b]).sum() for i in range(len(some)) for b in best[i]]
    return probes, max(4 * k, int(np.quantile(ahead, part, method="higher")) + 1)


def build(vectors: DataFrame, path: str, cells: int | None = None, parts: int = 16, sample: int = 20_000, target: float = 0.95, seed: int = 42) -> Index:
    """Write an index of all `vectors` (vec_id, embedding) to `path` and open it.

    The quantisers, and how many cells a search probes and how long its shortlist is, are fitted on at most `sample` vectors, which
    a hash of the ids picks.  cells: the square root of the number of vectors, 4096 at most, unless given.  Vectors that are
    null or not of the first one's length aren't indexed; a column beside the two is ignored.  A cell with very many
    vectors is split over files and tasks, since only its name is shared.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null and vec_id is not null")
    first = vectors.select(F.size("embedding").alias("n")).where("n > 0").first()
    size = first["n"] if first else 1
    vectors = vectors.where(F.size("embedding") == size)
    n = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").collect()  # `sample` rows at most
    x = np.array([r.embedding for r in chosen], np.float32).reshape(-1, size) if chosen else np.zeros((1, size), np.float32)
    q = fit(x, cells or min(4096, max(1, round(n**0.5))), parts, seed)
    probes, shortlist = calibrate(q, x, target=target)
    shared = spark.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes = shared.value.encode(_unit(batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], ["vec_id", "embedding", "code", "cell"])

    stored = vectors.mapInArrow(run, "vec_id long, embedding array<float>, code binary, cell int")
    stored.hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    meta = {"probes": probes, "shortlist": shortlist, "size": size, "vectors": n, "seed": seed}
    rows = [("meta", 0, [], json.dumps(meta))] + [("centre", i, c.tolist(), None) for i, c in enumerate(q.centres)]
    rows += [(f"book {m:04d}", i, c.tolist(), None) for m, book in enumerate(q.books) for i, c in enumerate(book)]
    spark.createDataFrame(rows, "what string, i int, v array<float>, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/quantisers")
    return open_index(spark, path)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    quantisers: Quantisers
    probes: int
    shortlist: int
    size: int
    vectors: int

    def table(self, cells: list[int] | None = None) -> DataFrame:
        """(vec_id, embedding, code, cell), of all cells or of some, whose partitions alone are read."""
        rows = self.spark.read.schema("vec_id long, embedding array<float>, code binary, cell int").parquet(f"{self.path}/cells")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def probed(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """queries x cells: whether a query probes a cell."""
        order = self.quantisers.order(_unit(x))[:, : probes or self.probes]
        marks = np.zeros((len(x), len(self.quantisers.centres)), bool)
        np.put_along_axis(marks, order, True, axis=1)
        return marks

    def search(self, queries: DataFrame, k: int, probes: int | None = None, shortlist: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, vec_id, score, rank) of about the k most similar vectors of each query (vec_id, embedding), ties by vec_id.

        Scores are exact; what may be missed are vectors in cells that aren't probed, or that codes rank behind the shortlist.
        Queries come to the driver in blocks of `block` vectors.  What their codes leave is ranked and scored for all blocks together, so that
        a task's memory doesn't grow with their number.
        """
        shortlist = max(k, shortlist or self.shortlist)
        q = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("q")).where(F.size("q") == self.size)
        blocks, rough, all_cells = -(-q.count() // block) or 1, None, set()
        for b in range(blocks):
            rows = (q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else q).collect()
            x = np.array([r.q for r in rows], np.float32).reshape(-1, self.size)
            marks = self.probed(x, probes)
            shared = self.spark.sparkContext.broadcast((np.array([r.query_id for r in rows], np.int64), _unit(x), marks, self.quantisers))
            cells = np.flatnonzero(marks.any(axis=0)).tolist()
            one = self.table(cells).select("vec_id", "code", "cell").mapInArrow(_rough(shared, shortlist), "query_id long, vec_id long, cell int, score float")
            rough, all_cells = one if rough is None else rough.unionByName(one), all_cells | set(cells)
        near = top_k(rough, "query_id", shortlist, "vec_id").select("query_id", "vec_id", "cell")
        exact = self.table(sorted(all_cells)).select("vec_id", "cell", "embedding").join(near, ["cell", "vec_id"]).join(small(q), "query_id")
        return top_k(exact.select("query_id", "vec_id", cosine("embedding", "q").alias("score")).where("score is not null"), "query_id", k, "vec_id")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that build() has written; the quantisers (a few thousand rows) come to the driver."""
    rows = spark.read.parquet(f"{path}/quantisers").orderBy("what", "i").collect()
    meta = json.loads(next(r.text for r in rows if r.what == "meta"))
    of = lambda what: np.array([r.v for r in rows if r.what == what], np.float32)
    books = [of(what) for what in sorted({r.what for r in rows if r.what.startswith("book")})]
    return Index(spark, path, Quantisers(of("centre"), books), meta["probes"], meta["shortlist"], meta["size"], meta["vectors"])


def _rough(shared, most: int):
    """Batches of (vec_id, code, cell) -> for each query that probes the cell its `most` best by code, ties by vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, marks, quantisers = shared.value
        for batch in batches:
            vec = batch["vec_id"].to_numpy()
            if not len(vec) or not len(ids):
                continue
            cell = batch["cell"].to_numpy()
            codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(vec), -1)
            at = np.argsort(vec, kind="stable")
            vec, cell = vec[at], cell[at]
            scores = np.where(marks[:, cell], (queries @ quantisers.decode(cell, codes[at]).T).round(5), -np.inf)
            if len(vec) > most:
                last = np.partition(scores, len(vec) - most, axis=1)[:, len(vec) - most, None]
                ties = scores == last
                keep = (scores > last) | (ties & (ties.cumsum(axis=1) <= most - (scores > last).sum(axis=1, keepdims=True)))
            else:
                keep = np.ones(scores.shape, bool)
            of, row = np.nonzero(keep & np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(vec[row]), pa.array(cell[row], pa.int32()), pa.array(scores[of, row], pa.float32())], ["query_id", "vec_id", "cell", "score"])

    return run
