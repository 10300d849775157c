"""Ranked lexical search by dense blocks: item weights times document impacts, as matrix products.

Terms are runs of letters and digits, where every character beyond ASCII counts as
a letter and only A-Z are lower-cased. A term's weight in an item and its impact in
a document are integers, so a score is an exact integer whatever the order of its
sum. Items are cut into tiles of at most ``TILE_ITEMS``, each with the vocabulary
that its own items use; a tile's columns are cut again so that no partial sum can
reach 2**53. Products in float64 are therefore exact, and the tiles' sums are added
as 64-bit integers.

Documents are tokenized once: a written table keeps each one's length and the counts
of the terms that some item uses. Document frequencies, the number of documents and
their length come from that table, over all documents. Each task keeps the best of
every item as it reads, ties by id, and hands on at most ``top`` rows an item.
Items are taken in blocks of about ``BLOCK_TERMS`` terms, one after the other, so
what is sent to the tasks does not grow with the number of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kadence.llm.batches import slices
from kadence.llm.shipping import ship
from kadence.sources.staging import stage

#: Rows of an item in the result.
TOP = 10
#: Items and vocabulary columns of a tile, and terms of a block of items.
TILE_ITEMS, TILE_TERMS, BLOCK_TERMS = 256, 1024, 200_000
#: Impacts stay below this, so columns whose weights sum to ``_MOST`` at most stay below 2**53.
_IMPACT = 1_000_000
_MOST = 2**53 // _IMPACT
#: Sub-groups of an item's rows that are ranked before the item is.
_SPREAD = 64

_SPACED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8, with repeats, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_, text_) to (item_, term, times)."""
    schema = StructType([items.schema["item_"], *StructType.fromDDL("term binary, times long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counted = [Counter(terms(t)) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(c) for c in counted])
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array([t for c in counted for t in c], pa.binary()),
                pa.array([n for c in counted for n in c.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["item_", "term", "times"])

    return items.mapInArrow(run, schema).groupBy("item_", "term").agg(F.sum("times").alias("times"))


def _counts(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id_, text_) to (id_, n, ids, times): all terms counted, those of the vocabulary by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in slices(batches):
            lengths, sizes, ids, times = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                known = Counter(map(number, found))
                known.pop(None, None)
                lengths.append(len(found))
                sizes.append(len(known))
                ids += known.keys()
                times += known.values()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [
                batch.column(0),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id_", "n", "ids", "times"])

    return documents.mapInArrow(run, "id_ long, n long, ids array<int>, times array<long>")


def _frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; tasks send sums, at most one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "held"])

    rows = counts.select("ids").mapInArrow(run, "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))
    found = rows.toPandas()
    held = np.zeros(size, np.int64)
    held[found["term"].to_numpy(np.int64)] = found["held"].to_numpy(np.int64)
    return held


class Tile:
    """Some items' weights over the columns of their own vocabulary."""

    def __init__(self, weights: dict[int, dict[int, int]], size: int) -> None:
        """``weights``: item to term to weight; ``size``: terms of the whole vocabulary."""
        self.items = sorted(weights)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # column of each term or -1; weights by column and item
        # A weight beyond the bound is laid over several layers, each a column of its own.
        layers: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for term, weight in weights[item].items():
                for layer, start in enumerate(range(0, weight, _MOST)):
                    layers.setdefault((layer, term), []).append((i, min(_MOST, weight - start)))
        held, columns = np.zeros(len(self.items), np.int64), []
        for key in sorted(layers):
            added = np.zeros(len(self.items), np.int64)
            for i, weight in layers[key]:
                added[i] = weight
            # A part holds one layer only, so that a term is one column of it.
            full = columns and (len(columns) == TILE_TERMS or columns[0][0][0] != key[0])
            if full or (held + added > _MOST).any():
                self._close(columns, size)
                held, columns = np.zeros(len(self.items), np.int64), []
            held += added
            columns.append((key, added))
        if columns:
            self._close(columns, size)

    def _close(self, columns: list[tuple[tuple[int, int], np.ndarray]], size: int) -> None:
        place = np.full(size, -1, np.int64)
        place[[term for (_, term), _ in columns]] = np.arange(len(columns))
        self.parts.append((place, np.array([w for _, w in columns], np.float64)))

    def scores(self, rows: np.ndarray, ids: np.ndarray, impacts: np.ndarray, n: int) -> np.ndarray:
        """Documents x items, from the documents' (row, term, impact)."""
        total = np.zeros((n, len(self.items)), np.int64)
        for place, weights in self.parts:
            at = place[ids]
            known = at >= 0
            block = np.zeros((n, len(weights)))
            block[rows[known], at[known]] = impacts[known]
            total += (block @ weights).astype(np.int64)
        return total


class Best:
    """The ``top`` rows of each item of a tile: score down, then id up, ids that are null last."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.least = np.zeros(items, np.int64)  # the last kept score, once an item has all its rows
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is null, id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        least = np.maximum(self.least, 1)
        if len(scores) > self.top:
            least = np.maximum(least, np.partition(scores, len(scores) - self.top, axis=0)[-self.top])
        at, item = np.nonzero(scores >= least)  # equal scores all stay, until ids decide
        if not len(at):
            return
        new = (item, scores[at, item], null[at], ids[at])
        item, score, null, ids = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item, score, null, ids = item[order], score[order], null[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.top
        self.rows = [item[kept], score[kept], null[kept], ids[kept]]
        last = place == self.top - 1
        self.least[item[last]] = score[last]


def _scored(counts: DataFrame, tiles: list[dict[int, dict[int, int]]], names: pa.Array, field, size: int, totals: tuple[int, int], top: int) -> DataFrame:
    """(item_, id_, score): the best of every item in each task."""
    n_documents, n_terms = totals
    schema = StructType([field, *StructType.fromDDL("id_ long, score long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [Tile(t, size) for t in tiles]
        best = [Best(len(t.items), top) for t in built]
        for batch in slices(batches):
            lists = batch.column(2)
            if not len(lists.flatten()):
                continue
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            lengths = np.array([25 + 75 * n * n_documents // n_terms for n in batch.column(1).to_pylist()], np.int64)
            impacts = 1_000_000_000 * times // (1000 * times + 8 * lengths[rows])
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for tile, kept in zip(built, best, strict=True):
                kept.add(tile.scores(rows, ids, impacts, batch.num_rows), null, doc_ids)
        for tile, kept in zip(built, best, strict=True):
            item, score, null, doc_ids = kept.rows
            items = np.array(tile.items, np.int64)[item]
            columns = [names.take(pa.array(items)), pa.array(doc_ids, mask=null.astype(bool)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_", "id_", "score"])

    return counts.mapInArrow(run, schema)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """Ranks within items; an item's rows meet in some groups first, so that no task sees all tasks' rows of it."""
    order = (F.col("score").desc(), F.col("id_").asc_nulls_last())
    spread = rows.withColumn("part", F.pmod(F.hash("id_", "score"), F.lit(_SPREAD)))
    few = spread.withColumn("rank", F.row_number().over(Window.partitionBy("item_", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_").orderBy(*order))).filter(F.col("rank") <= top)


def rank(
    documents: DataFrame,
    id_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str,
    item_text_col: str,
    *,
    top: int = TOP,
) -> DataFrame:
    """For each item its ``top`` documents of the highest score above 0: item, rank from 1, document, score.

    Equal scores go by ascending document id, rows without one last. Every row of ``documents`` is a document,
    also where ids repeat; a null text has no terms. Rows of equal item and text count once; further texts of an
    item, or of the null item, add their terms to it. Items without a known term, and an empty table on either
    side, give no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text_")).distinct()
    field = asked.schema["item_"]
    wanted = stage(_item_terms(asked), "item_terms")
    blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    ranked = None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_"), F.lit(blocks)) == block).toArrow()
        vocabulary = {t: i for i, t in enumerate(sorted(set(rows.column("term").to_pylist())))}
        number: dict = {}
        asks: list[dict[int, int]] = []
        for item, term, times in zip(*(rows.column(c).to_pylist() for c in ("item_", "term", "times")), strict=True):
            if item not in number:
                number[item] = len(asks)
                asks.append({})
            asks[number[item]][vocabulary[term]] = times
        counts = stage(_counts(docs, vocabulary), "term_counts")
        n, length = counts.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        weights = [term_weight(n, int(d)) for d in _frequencies(counts, len(vocabulary))]
        weighed = [{t: times * weights[t] for t, times in terms_.items() if weights[t]} for terms_ in asks]
        tiles = [
            {i: weighed[i] for i in range(start, min(start + TILE_ITEMS, len(asks)))}
            for start in range(0, len(asks), TILE_ITEMS)
        ]
        names = pa.array(list(number), rows.schema.field("item_").type)
        found = _ranked(_scored(counts, tiles, names, field, len(vocabulary), (n, length or 1), top), top)
        found = stage(found, "ranked") if blocks > 1 else found
        ranked = found if ranked is None else ranked.unionByName(found)
    return ranked.select(F.col("item_").alias(item_col), "rank", F.col("id_").alias("doc_id"), "score")
