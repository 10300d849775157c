"""Bounded-space online best-fit packing of token sequences.

Each task packs the documents it reads in the order it meets them. It keeps at
most ``open_bins`` sequences open, found by a bitset over free space: the
smallest free space that still takes a piece is one shift and one lowest-bit
lookup. When a piece fits nowhere and no further sequence may be opened, the
fullest open one is closed. Memory depends on ``open_bins`` and the batch, not
on the input, and nothing is shuffled. What tasks leave open at their ends is not
packed together; so that this stays a small share, small partitions are read
together, ``TASK_BYTES`` of text or more in a task.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType
from tokenizers import Tokenizer

from kadence.llm.batches import slices
from kadence.llm.byte_bpe import encode_text
from kadence.llm.shipping import ship

MAX_TOKENS = 2048
OPEN_BINS = 1024
#: Least text of a task on average, where the table has as much.
TASK_BYTES = 16 << 20
#: Sequences are numbered within the task that fills them.
_TASK_BITS = 40
#: Fixed: how byte-level vocabularies of this kind split text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same where white space stands alone.
SINGLE_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
_SPACES_MEET = re.compile(r"\s\s")
#: The first letter beyond the Latin blocks.
LATIN_END = "\u0250"


class OpenBins:
    """Open sequences by free space: a bitset of the free spaces in use and a stack of sequences for each."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.opened = 0, 0, 0
        self.stacks: dict[int, list[int]] = {}

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that takes a piece, and the piece's offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._pop(free)
        else:
            if self.count >= self.limit and length < self.capacity:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.stacks.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full size but the first, which takes the remainder."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


@functools.cache
def _byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary file stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextIds:
    """Ids of whole texts under a vocabulary file of the tokenizers library, as little-endian 32-bit numbers.

    That library encodes whatever holds letters beyond Latin. Latin text goes through tiktoken with the same
    vocabulary: the same merges, several times faster. Where no two white-space characters meet, the split
    pattern needs no look-ahead, which makes the split cheaper still.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        table = _byte_of_symbol()
        ranks = {bytes(table[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
        self.spaced = tiktoken.Encoding("spaced", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=SINGLE_SPACES, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True

    def of(self, text: str) -> bytes:
        if not (text.isascii() or max(text) < LATIN_END):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        encoding = self.spaced if _SPACES_MEET.search(text) else self.single
        return np.asarray(array("I", encode_text(encoding, text)), "<u4").tobytes()


@functools.cache
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def pack(
    df: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    *,
    max_tokens: int = MAX_TOKENS,
    open_bins: int = OPEN_BINS,
    end_id: int = 0,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset.

    A document is the ids of its text and then ``end_id``; a null or empty text is ``end_id`` alone. Only
    documents over ``max_tokens`` are cut. Rows that repeat are packed as often as they occur, an empty table
    gives no rows, and other columns are not read. Ids may be null or repeat; they are only carried along.
    """
    ship(df.sparkSession)
    source = df.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_in_"))
    schema = (
        StructType([source.schema.fields[0]])
        .add("piece", IntegerType())
        .add("start", LongType())
        .add("length", LongType())
        .add("ids", BinaryType())
        .add("sequence_id", LongType())
        .add("offset", LongType())
    )
    end = np.asarray([end_id], "<u4").tobytes()
    size = source.agg(F.sum(F.octet_length("text_in_"))).first()[0] or 0
    source = source.coalesce(max(1, size // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(tokenizer_path)
        bins = OpenBins(max_tokens, open_bins)
        base = TaskContext.get().partitionId() << _TASK_BITS
        for batch in slices(batches):
            rows, numbers, parts = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.of(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, max_tokens)):
                    sequence, offset = bins.place(length)
                    rows.append(row)
                    numbers.append((piece, start, length, base + sequence, offset))
                    parts.append(ids[4 * start : 4 * (start + length)])
            if not rows:
                continue
            piece, start, length, sequence, offset = np.asarray(numbers, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(piece.astype(np.int32)),
                    *map(pa.array, (start.copy(), length.copy())),
                    pa.array(parts, pa.binary()),
                    *map(pa.array, (sequence.copy(), offset.copy())),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)
