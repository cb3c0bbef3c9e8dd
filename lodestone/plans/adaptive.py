"""The adaptive plan: whether to retrieve, how to expand a question, which retrieval, and prompts.

Decisions are columns, so all questions are decided in one plan.  A model may be injected for each decision as a
function of a DataFrame; the defaults are rules, so that results are reproducible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

MODES = ("vector_only", "graph_only", "no_retrieval", "auto")
#: Words that ask for relations between things.
RELATION = r"\b(relation|relationship|between|connect|connection|compare|link)"
CONNECTIVES = r"[.?;\n]|,? and |,? or "
NO_DOCUMENTS = "No related documents were found."

_models: dict[str, Callable[..., Callable]] = {}


def register_model(name: str, factory: Callable[..., Callable]) -> None:
    """Register a factory of batch functions (list of prompts -> list of answers) as `provider:model`."""
    provider, _, model = name.partition(":")
    if not provider or not model:
        raise ValueError("a model's name is provider:model")
    _models[name.replace("-", "_")] = factory


def model(name: str, **options) -> Callable:
    key = name.replace("-", "_")
    if key not in _models:
        raise KeyError(f"no model registered as {name!r}")
    return _models[key](**options)


_embeddings: dict[str, Callable[..., Callable]] = {}
#: What models answer in, by decision.
SCHEMAS = {"need": "need_retrieval boolean, extracted_question string", "type": "retrieval_type string, reasoning string", "expansion": "subquestions array<string>"}


def register_embedding(name: str, factory: Callable[..., Callable]) -> None:
    """Register a factory of batch functions (list of texts -> list of vectors) as `provider:model`, and no other form."""
    provider, _, of = name.partition(":")
    if not provider or not of or ":" in of:
        raise ValueError("an embedding's name is provider:model")
    _embeddings[name] = factory


def embed(docs: DataFrame, name: str, **options) -> DataFrame:
    """(doc_id, embedding) of every text by a registered embedding, which is made once for each task."""
    if name not in _embeddings:
        raise KeyError(f"no embedding registered as {name!r}")
    factory = _embeddings[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = factory(**options)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "embedding": list(of(batch["text"].fillna("").tolist()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, embedding array<float>")


def structured(answers: DataFrame, decision: str) -> DataFrame:
    """`answers` with the JSON in answer parsed by the decision's schema; what doesn't parse is null."""
    return answers.withColumn("answer", F.from_json("answer", SCHEMAS[decision]))


def with_fallback(streamed: Callable[[], DataFrame], invoked: Callable[[], DataFrame]) -> DataFrame:
    """The streamed answer, or where its stream fails, that of one plain call."""
    try:
        return streamed()
    except Exception:  # any failure of the stream, which is foreign code, has the same way out
        return invoked()


def cached_ask(prompts: DataFrame, cache: DataFrame, factory: Callable[[], Callable]) -> tuple[DataFrame, DataFrame]:
    """Answers from `cache` (key, answer) where it has the prompt's MD5, from the model for the others; and the rows to add to the cache."""
    keyed = prompts.withColumn("key", F.md5("prompt"))
    held = keyed.join(cache.select("key", "answer"), "key")
    asked = ask(keyed.join(cache.select("key"), "key", "left_anti"), factory)
    return held.drop("key").unionByName(asked.drop("key")), asked.select("key", "answer").dropDuplicates(["key"])


def graph_question(expanded: DataFrame) -> DataFrame:
    """Adds graph_question: the first sub-question, or the question where there is none."""
    return expanded.withColumn("graph_question", F.when(F.size("subquestions") > 0, F.col("subquestions")[0]).otherwise(F.col("text")))


def ask(prompts: DataFrame, factory: Callable[[], Callable], failure: str = "The answer could not be generated.") -> DataFrame:
    """Adds `answer`; the model is made once for each task, and a batch that fails gets `failure`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = factory()
        for batch in batches:
            try:
                got = list(answer(batch["prompt"].tolist()))
            except Exception:  # the model is foreign code: its failure is a result here
                got = [failure] * len(batch)
            yield batch.assign(answer=got)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{schema}, answer string")


def clean_questions(questions: Column) -> Column:
    """Trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(questions, lambda q: F.trim(q)), lambda q: q != ""))


def expand(questions: DataFrame) -> DataFrame:
    """Adds subquestions: none for a blank question, the question itself if nothing splits it."""
    cleaned = clean_questions(F.split("text", CONNECTIVES))
    return questions.withColumn("subquestions", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.array().cast("array<string>")).otherwise(cleaned))


def need(questions: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds need_retrieval: by mode, or in auto if the question has three tokens and isn't plain arithmetic."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "auto":
        return questions.withColumn("need_retrieval", F.lit(mode != "no_retrieval"))
    return questions.withColumn("need_retrieval", (F.size(tokens("text")) >= 3) & ~F.col("text").rlike(r"^[0-9+*/(). -]+$"))


def classify(questions: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds retrieval_type: graph_only for questions about relations, else vector_only; a set mode decides outright."""
    if mode in ("vector_only", "graph_only"):
        return questions.withColumn("retrieval_type", F.lit(mode))
    return questions.withColumn("retrieval_type", F.when(F.lower("text").rlike(RELATION), "graph_only").otherwise("vector_only"))


def assemble(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, context, documents): the hits of each question as numbered documents, in rank order."""
    held = hits.join(docs, "doc_id").select("item_id", "rank", F.concat(F.lit("[document "), "rank", F.lit(" - "), "source", F.lit("] "), "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return held.groupBy("item_id").agg(F.array_join(lines, "\n").alias("context"), F.count("*").alias("documents"))


def answer_prompt(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds prompt: the question with its numbered documents, or with a note that there are none."""
    joined = questions.join(contexts, "item_id", "left")
    head = F.concat(F.lit("Answer from these "), F.coalesce("documents", F.lit(0)), F.lit(" documents.\n"))
    return joined.withColumn("prompt", F.concat(head, F.coalesce("context", F.lit(NO_DOCUMENTS)), F.lit("\nQuestion: "), "text"))


def direct_prompt(questions: DataFrame) -> DataFrame:
    return questions.withColumn("prompt", F.concat(F.lit("Answer from general knowledge.\nQuestion: "), "text"))


#: What a model is asked before anything is retrieved; {question} is the user's.  Each answer is JSON of the fields that structured() reads.
DECISIONS = {
    "need": 'Does answering need the documents? Small talk, arithmetic and general knowledge do not.\nReply as JSON: {"need_retrieval": true or false, "extracted_question": the question without the rest, "reasoning": why}.\nQuestion: {question}',
    "type": 'Which search fits? graph_only for relations between things, vector_only for facts about one.\nReply as JSON: {"retrieval_type": "vector_only" or "graph_only", "reasoning": why}.\nQuestion: {question}',
    "expansion": 'Split the question into parts that can be searched one by one; one that is simple stays whole.\nReply as JSON: {"subquestions": a list}.\nQuestion: {question}',
}


def decision_prompts(questions: DataFrame) -> DataFrame:
    """(item_id, kind, prompt) for each decision about each question; a null question counts as empty."""
    prompts = F.array(*(F.struct(F.lit(kind).alias("kind"), F.replace(F.lit(text), F.lit("{question}"), F.trim(F.coalesce("text", F.lit("")))).alias("prompt")) for kind, text in DECISIONS.items()))
    return questions.select("item_id", F.explode(prompts).alias("p")).select("item_id", "p.kind", "p.prompt")


def run(questions: DataFrame, vector: Callable[[DataFrame], DataFrame], graph: Callable[[DataFrame], DataFrame], docs: DataFrame, mode: str = "auto") -> DataFrame:
    """All questions through the plan: (item_id, prompt), each by its own branch; the branches are filters."""
    decided = classify(need(questions, mode), mode)
    by_vector = decided.where("need_retrieval and retrieval_type <> 'graph_only'")
    by_graph = decided.where("need_retrieval and retrieval_type = 'graph_only'")
    hits = vector(by_vector).select("item_id", "doc_id", "rank").unionByName(graph(by_graph).select("item_id", "doc_id", "rank"))
    asked = answer_prompt(decided.where("need_retrieval").select("item_id", "text"), assemble(hits, docs)).select("item_id", "prompt")
    return asked.unionByName(direct_prompt(decided.where("not need_retrieval")).select("item_id", "prompt"))
