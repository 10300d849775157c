"""Tables that hold what operators must put up with."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Columns whose names operators use inside or give to results.
CLASHING = "id_ string, text_ string, row_ long, n long, cls long, kept boolean, score double, hashes string, key_ long"
LONG = "word and another one again " * 8000
TEXTS = [
    (1, "A plain text of a few words."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "same text twice, five words"),
    (5, "same text twice, five words"),
    (6, "same text twice, five words"),
    (None, "a row without an id"),
    (7, "\n\t  \x0b "),
    (8, "日本語 and 𝒰nicode é ½"),
]


def awkward(spark: SparkSession, texts=TEXTS, extra: str = "lang string, source string, n_chars long") -> DataFrame:
    """Documents with nulls, an empty and a very long text, ties, repeated rows and clashing columns."""
    schema = f"doc_id long, text string, {extra}, {CLASHING}"
    width = len(schema.split(", ")) - 2
    return spark.createDataFrame([(i, t, *[None] * width) for i, t in texts], schema)


def empty(spark: SparkSession) -> DataFrame:
    return awkward(spark, [])


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))
