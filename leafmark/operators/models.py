"""Models by name: a registry, and a table function that SQL calls with a model's name.

A model turns a text into rows of its own schema. `embedder(models)` makes a table function whose result type is that of the model
named in its first argument, which must be a constant: a name that is not known, or none, is an error when the query is
analysed, before anything runs. A model is loaded once in each task, when its first text comes. A null text is an empty one.

    register(spark, MODELS)
    spark.sql("SELECT d.doc_id, e.* FROM documents d, LATERAL embed('letters', d.text) e")
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass
class Model:
    """load() gives the function from a text to rows; schema is the type of these, which tasks have no JVM to parse."""

    load: Callable[[], Callable[[str], Iterator[tuple]]]
    schema: T.StructType


_VECTOR = T.ArrayType(T.DoubleType())


def _letters() -> Callable[[str], Iterator[tuple]]:
    """A stand-in for a model of one vector: counts of the first letters of the alphabet."""

    def run(text: str) -> Iterator[tuple]:
        low = text.lower()
        yield ([float(low.count(chr(97 + k))) for k in range(8)],)

    return run


def _lines() -> Callable[[str], Iterator[tuple]]:
    """A stand-in for a model of many vectors: for each line its length and its blanks."""

    def run(text: str) -> Iterator[tuple]:
        for tok, line in enumerate(text.split("\n")):
            yield tok, [float(len(line)), float(line.count(" "))]

    return run


MODELS: dict[str, Model] = {"letters": Model(_letters, T.StructType().add("vec", _VECTOR)), "lines": Model(_lines, T.StructType().add("tok", T.LongType()).add("vec", _VECTOR))}


def embedder(models: dict[str, Model]):
    """The table function (model, text) over these models."""

    class Embed:
        def __init__(self):
            self.loaded: dict[str, Callable] = {}

        @staticmethod
        def analyze(model: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            known = f"one of {', '.join(sorted(models))}"
            if not model.isConstantExpression or not isinstance(model.value, str):
                raise ValueError(f"the model must be a constant name, {known}")
            if model.value not in models:
                raise ValueError(f"no model {model.value}: {known}")
            if not isinstance(text.dataType, T.StringType):
                raise ValueError("a model takes a text")
            return AnalyzeResult(schema=models[model.value].schema)

        def eval(self, model: str, text: str):
            if model not in self.loaded:
                self.loaded[model] = models[model].load()
            yield from self.loaded[model](text or "")

    return udtf(Embed)


def register(spark: SparkSession, models: dict[str, Model] = MODELS, name: str = "embed") -> None:
    """Makes the table function known to SQL under that name."""
    spark.udtf.register(name, embedder(models))


def embed(rows: DataFrame, model: str, models: dict[str, Model] = MODELS, text: str = "text") -> DataFrame:
    """rows with the columns of the model's rows, a row for each that it makes of the text."""
    return rows.lateralJoin(embedder(models)(F.lit(model), F.col(text).outer()))
