"""Kept indexes: recall and pruning of the vector index; skipping and exactness of the text index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ivf, lexical, postings, vector

SF = "/root/testdata/sf0.001"


def scan_rows(df):
    """Rows that the scans of a plan gave when it ran, from the plan's metrics."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan parquet"):
            found.append((node.metrics().apply("numOutputRows").value(), node.toString()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 100 directions, with copies and odd ones."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((100, 32))
    x = centres[rng.integers(0, 100, 6000)] + 0.35 * rng.standard_normal((6000, 32))
    x[5000:5400] = x[17]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, []), (9003, [1.0, 2.0]), (9004, [0.0] * 32), (None, x[0].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit("x").alias("code"), F.lit(1).alias("a.cell")).cache()


@pytest.fixture(scope="module")
def index(clustered, tmp_path_factory):
    return ivf.build(clustered, str(tmp_path_factory.mktemp("ivf") / "i"))


def recall(got, want):
    b = {(r.query_id, r.vec_id) for r in want.collect()}
    return len({(r.query_id, r.vec_id) for r in got.collect()} & b) / len(b)


def test_recall_and_vectors_read(spark, clustered, index):
    queries = clustered.where("vec_id % 20 = 0 and vec_id < 9000")
    good = clustered.where("size(embedding) = 32 and vec_id is not null")
    assert recall(index.search(queries, 10), vector.search(good, queries, 10)) >= 0.95
    marks = index.probed(np.array([r.embedding for r in queries.collect()]))
    sizes = dict(index.table().groupBy("cell").count().collect())
    assert sum(sizes.get(c, 0) * int(m.sum()) for c, m in enumerate(marks.T)) < 0.1 * marks.shape[0] * 6001
    one = clustered.where("vec_id = 40")
    for rows, plan in scan_rows(index.search(one, 10)):
        assert rows < 600 and ("cell" in plan and "PartitionFilters: [cell" in plan or rows <= 1)
    assert index.table().count() == index.vectors == 6001


def test_opened_again_it_finds_the_same(spark, clustered, index):
    queries = clustered.where("vec_id in (3, 17, 5100, 9004) or vec_id = 9003")
    again = ivf.open_index(spark, index.path)
    a, b = (sorted(map(tuple, i.search(queries, 12, block=2).collect())) for i in (index, again))
    assert a == b and {r[0] for r in a} == {3, 17, 5100}
    copies = [r[1] for r in sorted(a, key=lambda r: (r[0], r[3])) if r[0] == 5100]
    assert copies == [17, *range(5000, 5011)]  # equal scores by vec_id


def test_empty_tables(spark, index, clustered, tmp_path):
    none = clustered.where("vec_id < 0")
    assert index.search(none, 5).count() == 0
    empty = ivf.build(none, str(tmp_path / "i"))
    assert empty.vectors == 0 and empty.search(clustered.where("vec_id < 3"), 5).count() == 0


def test_given_vectors_are_found_as_in_a_scan(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0")
    index = ivf.build(v, str(tmp_path / "i"))
    assert recall(index.search(q, 10), vector.search(v, q, 10)) >= 0.9
    every = index.search(q, 10, probes=10_000, shortlist=500)
    assert recall(every, vector.search(v, q, 10)) == 1
    assert index.shortlist < 0.1 * index.vectors


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(-1, None), (-2, ""), (-3, "... !"), (-4, "the"), (-5, "the " * 3000), (-6, "the rare zyzzyva"), (-7, "the rare zyzzyva")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(more).select("*", F.lit("x").alias("term"), F.lit(1).alias("a.b"))


@pytest.fixture(scope="module")
def text_index(docs, tmp_path_factory):
    return postings.build(docs, str(tmp_path_factory.mktemp("postings") / "p"), buckets=5, range_docs=4)


@pytest.fixture(scope="module")
def questions(spark):
    odd = [(1000, "zyzzyva"), (1001, "the"), (1002, "no_such_word_at_all"), (1003, ""), (1004, None), (1005, "The THE zyzzyva rare rare")]
    return spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame(odd, "item_id long, text string"))


@pytest.mark.parametrize("k", [1, 4, 500])
def test_scores_are_those_of_the_scan(docs, text_index, questions, k):
    got = sorted(map(tuple, text_index.search(questions, k).select("item_id", "doc_id", "score", "rank").collect()))
    assert got == sorted(map(tuple, lexical.bm25(docs, questions, k).select("item_id", "doc_id", "score", "rank").collect()))


def test_blocks_are_skipped_and_texts_not_read(spark, text_index, questions):
    counted = text_index.skipped(questions, 3).agg(F.sum("blocks").alias("b"), F.sum("skipped").alias("s")).first()
    assert counted.s > 0.1 * counted.b
    plan = text_index.search(questions, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan


def test_one_term_reads_one_partition(spark, text_index):
    one = spark.createDataFrame([(1, "zyzzyva")], "item_id long, text string")
    terms, only = text_index._terms(one)
    files = text_index._read("blocks", postings._BLOCKS, only).inputFiles()
    assert len(only) == 1 and {f.split("bucket=")[1].split("/")[0] for f in files} == {str(only[0])} and terms.count() == 1
    assert [(r.doc_id, r.rank) for r in text_index.search(one, 5).collect()] == [(-7, 1), (-6, 2)]


def test_postings_of_the_index_and_empty_tables(spark, docs, text_index, questions, tmp_path):
    assert sorted(map(tuple, text_index.postings().collect())) == sorted(map(tuple, lexical.postings(docs).collect()))
    empty = postings.build(docs.where("doc_id > 1000000"), str(tmp_path / "p"))
    assert empty.n == 0 and empty.search(questions, 3).count() == 0
    assert text_index.search(questions.where("item_id < 0"), 3).count() == 0


def test_blocks_of_queries_are_ranked_together(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = ivf.build(v, str(tmp_path / "v"))
    asked = v.where("vec_id % 3 = 0")
    one, many = index.search(asked, 5), index.search(asked, 5, block=4)
    assert sorted(many.collect()) == sorted(one.collect())
    ranks = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("row_number()")
    assert ranks(many) == ranks(one)
