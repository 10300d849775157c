"""Classes in chunks, for labels with more classes than one vector should hold.

A chunk is a range of the classes in order. A cell then has a row per chunk with a vector over the chunk's
classes, so memory goes by ``CLASSES_PER_VECTOR`` and not by the number of classes. With fewer classes there
are no chunks and every vector is whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.sources.staging import stage

# Classes of one vector, about: chunks are cut by a sample of the classes.
CLASSES_PER_VECTOR = 4096

CHUNK = "class_chunk"


@dataclass(frozen=True)
class ClassChunks:
    """``table`` has a row per chunk: its number, its classes in order and their counts."""

    table: DataFrame
    ids: tuple[int, ...]
    num_classes: int
    #: Sum of the classes' counts.
    num_rows: int
    #: Bytes of the classes as text.
    text: int

    def sizes(self) -> DataFrame:
        return self.table.select(CHUNK, F.size("classes").alias("size"))

    def places(self) -> DataFrame:
        """(class, chunk, place in the chunk)."""
        return self.table.select(CHUNK, F.posexplode("classes").alias("place", "class"))


def class_chunks(y: DataFrame, path: str | None = None) -> ClassChunks | None:
    """The chunks of the classes in ``y`` (class, n), staged; nothing if one vector holds them all."""
    if y.limit(CLASSES_PER_VECTOR + 1).count() <= CLASSES_PER_VECTOR:
        return None
    parts = -(-y.count() // CLASSES_PER_VECTOR)
    ranges = stage(y.select("class", "n").repartitionByRange(parts, "class").withColumn(CHUNK, F.spark_partition_id()), "class_ranges")
    entries = ranges.groupBy(CHUNK).agg(F.sort_array(F.collect_list(F.struct("class", "n"))).alias("entries"))
    once = F.size(F.array_distinct("entries.class")) == F.size("entries")
    classes = F.when(once, F.col("entries.class")).otherwise(F.raise_error(F.lit("a class has several prior rows")))
    table = entries.select(CHUNK, classes.alias("classes"), F.col("entries.n").alias("counts"))
    return read_chunks(stage(table, "class_table", path, width=CLASSES_PER_VECTOR))


def read_chunks(table: DataFrame) -> ClassChunks:
    total = lambda c, each: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(each(b), F.lit(0)))
    text = total("classes", lambda c: F.octet_length(c).cast("bigint"))
    found = table.select(CHUNK, F.size("classes").alias("size"), total("counts", lambda n: n).alias("rows"), text.alias("text")).collect()
    ids = tuple(sorted(r[CHUNK] for r in found))
    return ClassChunks(table, ids, *(sum(r[c] for r in found) for c in ("size", "rows", "text")))


def entries_by_chunk(counts: DataFrame, keys: Sequence[str], chunks: ClassChunks, columns: Sequence[str], name: str) -> DataFrame:
    """(keys, chunk, entries): the classes of a key that are there, as (place, columns) in order of place.

    A class that is not among the chunks has no chunk.
    """
    places = chunks.places().withColumnRenamed("class", "__class")
    placed = counts.join(places, F.col("class").eqNullSafe(F.col("__class")), "left")
    return placed.groupBy(*keys, CHUNK).agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias(name))


def counts_of(entries: str, size: str) -> Column:
    """A vector of ``size`` counts out of (place, n) in order of place, zero where there is none; no entries are null.

    The zeros up to an entry are made with it, so no place is searched for.
    """
    zero, found = F.lit(0).cast("bigint"), F.coalesce(entries, F.array().cast("array<struct<place:int,n:bigint>>"))
    before = F.concat(F.array(F.lit(-1)), found["place"])
    twice = F.raise_error(F.lit("a cell is counted twice for one class")).cast("array<bigint>")
    each = lambda e, last: F.concat(F.array_repeat(zero, e["place"] - last - 1), F.array(F.coalesce(e["n"], zero)))
    pieces = F.zip_with(found, F.slice(before, F.lit(1), F.size(found)), lambda e, last: F.when(e["place"] > last, each(e, last)).otherwise(twice))
    rest = F.array_repeat(zero, F.col(size) - 1 - F.element_at(before, -1))
    return F.flatten(F.concat(pieces, F.array(rest)))


def whole_vectors(rows: DataFrame, keys: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """The rows of all chunks of a key as one row with whole vectors."""
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(CHUNK, *vectors))).alias("parts"))
    return parts.select(*keys, *[F.flatten(F.col(f"parts.{v}")).alias(v) for v in vectors])
