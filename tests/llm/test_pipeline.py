"""The pipeline's stages, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import entry, pii
from lodestone.llm.components import components
from lodestone.llm.store import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_decisions_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None), (90002, ""), (90003, docs.where("doc_id = 0").first().text)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, table(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not ids & {90001, 90002, 90003} and 0 in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_near_duplicates_keep_the_smallest(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text + " end"), (3, text + " end"), (9, "other words entirely here now"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == [3, 7, 9]


def test_stages_take_columns_of_any_name(spark):
    """Dots, quotes, spaces and the stages' own names; structs with odd fields; each is there afterwards as it was."""
    names = ["a.b", "with `quote`", "a space", "kept", "n_words", "n_lines", "n_removed", "gone", "__mine", "held", "c", "key", "th", "row", "rows", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").repartition(2)
    odd = F.struct(F.lit(1).alias("x y"), F.lit("z").alias("p.q"))
    docs = table(docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names), odd.alias("of all")))
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, SF))
        assert docs.columns == first, name
    for r in docs.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r["of all"]["x y"] == 1 and r["of all"]["p.q"] == "z"
    assert docs.count() > 20 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    out = pii.pseudonymise(docs, "k")
    assert out.columns[: len(first)] == first and out.where("`a.b` is null").count() == 0


def test_the_key_of_pseudonyms_is_the_sessions(spark):
    class Away:
        conf = spark.conf
        sparkContext = type("", (), {"master": "yarn"})

    assert entry.pii_key(spark)
    with pytest.raises(ValueError):
        entry.pii_key(Away)


def _runs(spark) -> dict[int, int]:
    """The nodes of each query that the driver has run, by number."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList()
    return {(i := seen.apply(k).executionId()): store.planGraph(i).allNodes().size() for k in range(seen.size())}


def test_the_driver_plans_near_duplicates_in_small_queries(spark):
    """The driver holds every plan, and tells it to listeners anew after each of its stages; one of a whole round had 158 nodes here."""
    before = _runs(spark)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i:]])) for i in range(40)] + [(100 + i, f"unlike {i} and {i} or {i} but {i}") for i in range(40)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r.doc_id for r in kept.collect()} == {0, *range(100, 140)}
    sizes = [n for i, n in _runs(spark).items() if i not in before]
    assert len(sizes) > 10 and max(sizes) < 120, sizes


def test_components_end_with_the_step_that_makes_stars(spark):
    edges = table(spark.createDataFrame([(1, 2), (1, 3), (9, 1), (20, 30)], "a long, b long"))
    before = _runs(spark)
    found = components(edges)
    assert len(_runs(spark).keys() - before.keys()) <= 3  # the edges, one step, and whether they are stars; with a step that changes nothing, 5
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (9, 1), (20, 20), (30, 20)]
