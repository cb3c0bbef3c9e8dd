"""Rank fusion and multi-question retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lexical import bm25, top_k
from lodestone.operators.vector import hash_search
from lodestone.session import materialise

RRF = 60


def fuse(legs: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of (item_id, doc_id, rank) lists: score = sum of 1 / (60 + rank)."""
    every = None
    for leg in legs:
        leg = leg.select("item_id", "doc_id", "rank")
        every = leg if every is None else every.unionByName(leg)
    fused = every.groupBy("item_id", "doc_id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 6).alias("score"))
    return top_k(fused, "item_id", k, "doc_id")


def hybrid(docs: DataFrame, questions: DataFrame, k: int = 4, depth: int = 10) -> DataFrame:
    """Hashed-vector and BM25 legs of `depth` each, fused."""
    return fuse([hash_search(docs, questions, depth), bm25(docs, questions, depth)], k)


def multi_query(hits: DataFrame) -> DataFrame:
    """Concatenate each question's hits (question_ord, rank, pk, ...) and keep the first of each pk; rows without one stay."""
    seen = Window.partitionBy("pk").orderBy("question_ord", "rank")
    keyed = hits.where("pk is not null").withColumn("n", F.row_number().over(seen)).where("n = 1").drop("n")
    return keyed.unionByName(hits.where("pk is null"))


def retriever(docs: DataFrame, kind: str = "rrf", k: int = 4) -> Callable[[DataFrame], DataFrame]:
    """A function of questions (item_id, text) by name: similarity (hashed vectors), lexical (BM25) or rrf (both, fused)."""
    kinds = {"similarity": lambda q: hash_search(docs, q, k), "lexical": lambda q: bm25(docs, q, k), "rrf": lambda q: hybrid(docs, q, k)}
    if kind not in kinds:
        raise ValueError(f"unknown retriever {kind!r}; one of {sorted(kinds)}")
    return kinds[kind]


def retrieve_each(search: Callable[[DataFrame], DataFrame], questions: list[DataFrame]) -> tuple[DataFrame | None, list[int]]:
    """The hits of all questions with question_ord, and the numbers of those that failed, which are left out."""
    hits, failed = None, []
    for n, q in enumerate(questions):
        try:
            one = materialise(search(q).withColumn("question_ord", F.lit(n)), "hits")
        except Exception:  # one question's failure is not the others'
            failed.append(n)
            continue
        hits = one if hits is None else hits.unionByName(one)
    return hits, failed
