"""Chunkers as table functions for SQL: SELECT * FROM split_recursive(TABLE(documents), 1000, 200).

Each takes a table with a string column `text` and gives, for each chunk, the table's other columns with chunk_index and chunk; which
columns these are is found out when the query is analysed.  Rows with a null or blank text give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.operators import chunk


def _analyze(numbers: tuple[str, ...], least: tuple[int, ...], table: AnalyzeArgument, *given: AnalyzeArgument) -> AnalyzeResult:
    if not table.isTable or "text" not in table.dataType.names or not isinstance(table.dataType["text"].dataType, T.StringType):
        raise ValueError("the first argument must be a table with a string column `text`")
    if len(given) != len(numbers):
        raise ValueError(f"after the table, give {', '.join(numbers)}")
    for name, low, argument in zip(numbers, least, given):
        if not argument.isConstantExpression or not isinstance(argument.value, int) or argument.value < low:
            raise ValueError(f"{name} must be a constant of at least {low}")
    fields = [f for f in table.dataType.fields if f.name != "text"]
    if clash := {"chunk_index", "chunk"} & {f.name for f in fields}:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    return AnalyzeResult(T.StructType([*fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())]))


def _splitter(split: Callable[..., list[str]], numbers: tuple[str, ...], least: tuple[int, ...]) -> type:
    class Splitter:
        @staticmethod
        def analyze(table: AnalyzeArgument, *given: AnalyzeArgument) -> AnalyzeResult:
            return _analyze(numbers, least, table, *given)

        def eval(self, row, *given: int) -> Iterator[tuple]:
            text = row["text"]
            if text is None or not text.strip():
                return
            rest = [row[name] for name in row.__fields__ if name != "text"]
            for i, piece in enumerate(split(text, *given)):
                yield (*rest, i, piece)

    return Splitter


FUNCTIONS = {
    "split_recursive": _splitter(chunk.split_recursive, ("size", "overlap"), (1, 0)),
    "split_long": _splitter(chunk.split_long, ("limit",), (1,)),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL; their rows travel in Arrow batches."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, useArrow=True))
