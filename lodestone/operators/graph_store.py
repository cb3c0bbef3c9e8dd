"""A kept entity graph that grows by insert batches: mergeable counts, folded when they are read.

Each batch adds three increments: its number of documents, the document frequency of its terms, and the number of times that each
sentence (as its set of terms) occurs.  Counts add up, whatever the order and size of batches; which terms are entities depends on the
whole corpus, so those bounds are applied on reading, before any pairing.  What is kept grows with the input, pairs of terms are made of
entities alone, and a search makes only those that its question touches.  An increment is an append to a written table under the
batch's number, so a repeated insert adds nothing, and one that broke off halfway adds what it lacks; until then readers see the
batches that all three tables have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import SENTENCE_END, tokens
from lodestone.session import materialise, small
from lodestone.sources.tables import Table

_WRITER = "insert"
#: Pairs of terms that a partition counts at most, about.
PAIRS = 4_000_000


def term_counts(docs: DataFrame, min_length: int) -> DataFrame:
    """(term, df): in how many documents (of this batch) each term of at least that length occurs."""
    terms = docs.select(F.explode(F.array_distinct(F.filter(tokens("text"), lambda t: F.length(t) >= min_length))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def sentence_counts(docs: DataFrame, min_length: int) -> DataFrame:
    """(terms, n): how often each sentence occurs that has two terms of at least that length; terms are distinct and sorted."""
    sentence = docs.select(F.explode(F.split("text", SENTENCE_END)).alias("s"))
    terms = F.array_sort(F.array_distinct(F.filter(tokens("s"), lambda t: F.length(t) >= min_length)))
    return sentence.select(terms.alias("terms")).where(F.size("terms") > 1).groupBy("terms").agg(F.count("*").alias("n"))


def numbered(terms: DataFrame) -> DataFrame:
    """(term, id): the terms, stored, with numbers from 0 on; the driver sees how many each partition has."""
    keyed = materialise(terms.select("term", F.monotonically_increasing_id().alias("id")), "nodes")
    part, row = F.shiftrightunsigned("id", 33).cast("int"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for p, n in sorted(map(tuple, keyed.groupBy(part).count().collect())):
        before += [F.lit(p), F.lit(total)]
        total += n
    return keyed.select("term", (F.create_map(*before)[part] + row).cast("int").alias("id")) if before else keyed.select("term", F.col("id").cast("int"))


@dataclass(frozen=True)
class GraphStore:
    spark: SparkSession
    path: str
    min_length: int = 5

    @staticmethod
    def create(spark: SparkSession, path: str, min_length: int = 5, buckets: int = 8) -> GraphStore:
        """An empty graph at `path`."""
        store = GraphStore(spark, path, min_length)
        kinds = {"documents": ("batch long, n long", ["batch"]), "nodes": ("term string, df long", ["term"]), "edges": ("terms array<string>, n long", ["terms"])}
        for kind, (schema, key) in kinds.items():
            Table.create(spark.createDataFrame([], schema), f"{path}/{kind}", key, 1 if kind == "documents" else buckets)
        return store

    def _table(self, kind: str) -> Table:
        return Table(self.spark, f"{self.path}/{kind}")

    def insert(self, docs: DataFrame, batch: int) -> None:
        """Add the documents (doc_id, text) of a batch; batches are numbered upwards, and one inserted again changes nothing.

        A null or empty text counts as a document without terms.
        """
        n = docs.agg(F.count("*").alias("n")).select(F.lit(batch).cast("long").alias("batch"), "n")
        self._table("nodes").append(term_counts(docs, self.min_length), _WRITER, batch)
        self._table("edges").append(sentence_counts(docs, self.min_length), _WRITER, batch)
        self._table("documents").append(n, _WRITER, batch)

    def batch(self) -> int:
        """The last batch that all three tables have; -1 if there is none."""
        return min(self._table(kind).epoch(_WRITER) for kind in ("documents", "nodes", "edges"))

    def _rows(self, kind: str) -> DataFrame:
        table = self._table(kind)
        return table.read(table.as_of_epoch(_WRITER, self.batch()))

    def documents(self) -> int:
        return self._rows("documents").agg(F.sum("n")).first()[0] or 0

    def entities(self, min_df: int = 3, max_share: float = 0.2) -> DataFrame:
        """(term, df) of the terms that are specific enough in the whole corpus."""
        df = self._rows("nodes").groupBy("term").agg(F.sum("df").alias("df"))
        return df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * self.documents()))

    def edges(self, min_weight: int = 2, ents: DataFrame | None = None) -> DataFrame:
        """(src, dst, weight) between entities that share at least `min_weight` sentences."""
        nodes, pairs = self.numbered_edges(min_weight, ents)
        for end in ("src", "dst"):
            pairs = pairs.join(small(nodes.select(F.col("id").alias(end), F.col("term").alias(f"{end}_term"))), end)
        return pairs.select(F.col("src_term").alias("src"), F.col("dst_term").alias("dst"), "weight")

    def numbered_edges(self, min_weight: int = 2, ents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(term, id) of the entities, and (src, dst, weight) of the edges by id.

        A sentence goes to each of its entities with the ids of those behind it, and pairs are made and counted there, in as many
        partitions as keep the counts of one in memory.
        """
        nodes = numbered((self.entities() if ents is None else ents).select("term"))
        rows = self._rows("edges")
        most = rows.agg(F.sum(F.expr("size(terms) * (size(terms) - 1) div 2"))).first()[0] or 0
        placed = rows.withColumn("place", F.monotonically_increasing_id()).select("place", "n", F.posexplode("terms").alias("i", "term"))
        held = placed.join(small(nodes), "term").groupBy("place", "n").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("ids"))
        first = held.where(F.size("ids") > 1).select("n", F.expr("transform(ids, x -> x.id)").alias("ids")).select("n", "ids", F.posexplode("ids").alias("i", "src"))
        rest = first.select("src", "n", F.expr("slice(ids, i + 2, size(ids))").alias("ids")).where(F.size("ids") > 0)
        pairs = rest.repartition(-(-int(most) // PAIRS) or 1, "src").select("src", "n", F.explode("ids").alias("dst"))
        return nodes, pairs.groupBy("src", "dst").agg(F.sum("n").alias("weight")).where(F.col("weight") >= min_weight)

    def edges_of(self, terms: DataFrame, min_weight: int = 2, ents: DataFrame | None = None) -> DataFrame:
        """The rows of edges() with at least one end among `terms` (term), from the sentences that hold one of these."""
        ents = (self.entities() if ents is None else ents).select("term")
        asked = materialise(ents.join(small(terms.select("term").distinct()), "term", "left_semi"), "asked")
        hits = self._rows("edges").select("n", "terms", F.explode("terms").alias("end")).join(small(asked.withColumnRenamed("term", "end")), "end")
        pairs = hits.select("end", "n", F.explode("terms").alias("other")).where("end <> other").groupBy("end", "other").agg(F.sum("n").alias("weight")).where(F.col("weight") >= min_weight)
        pairs = pairs.join(small(ents.withColumnRenamed("term", "other")), "other", "left_semi")
        return pairs.select(F.least("end", "other").alias("src"), F.greatest("end", "other").alias("dst"), "weight").distinct()

    def compact(self) -> None:
        """Fold the batches so far into one increment each; contents stay the same."""
        if self._table("documents").epoch(_WRITER) < 0 or len({self._table(k).epoch(_WRITER) for k in ("documents", "nodes", "edges")}) > 1:
            return  # nothing yet, or an insert broke off and has to be repeated first
        last = self.batch()
        folds = {"nodes": (["term"], "df"), "edges": (["terms"], "n")}
        for kind, (key, count) in folds.items():
            self._table(kind).overwrite(self._rows(kind).groupBy(*key).agg(F.sum(count).alias(count)))
        self._table("documents").overwrite(self._rows("documents").agg(F.lit(last).cast("long").alias("batch"), F.sum("n").alias("n")))
