"""Byte-level BPE with the tiktoken library and a local rank file.

Texts are encoded without special tokens. A long text is first cut at places
where the split pattern must split anyway, so that no call sees an unbounded
string; the ids are those of the whole text. Decoding returns raw bytes, since a
list of ids need not end on a character.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from kadence.llm.batches import slices
from kadence.llm.shipping import ship

#: Texts over this many characters are cut before they are encoded.
CUT_AT = 65_536
#: A lone space between two visible characters: the pattern attaches the space to what follows,
#: and nothing before it can take it in.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Runs of white space from this length on are encoded apart: the library's matcher keeps a stack over a run.
LONG_RUN = 4096
#: Fixed: what the pattern takes for white space.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(f"{_WHITE}{{{LONG_RUN},}}")


@functools.cache
def load_encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; one per Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = CUT_AT) -> Iterator[str]:
    """``text`` in parts of ``size`` characters or more, cut only where the pattern splits."""
    start = 0
    while len(text) - start > size:
        found = _SAFE_CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def spaced_parts(text: str, size: int = CUT_AT) -> Iterator[tuple[str, bool]]:
    """``text`` in parts, and whether a part is one piece of the pattern.

    Such pieces are long runs of white space, all but the last character where visible text follows: the pattern
    leaves that one to what comes next.
    """
    start = 0
    for run in _RUN.finditer(text):
        for part in safe_parts(text[start : run.start()], size):
            yield part, False
        start = run.end() - (run.end() < len(text))
        yield text[run.start() : start], True
    for part in safe_parts(text[start:], size):
        yield part, False


def encode_text(encoding: tiktoken.Encoding, text: str, size: int = CUT_AT) -> list[int]:
    """The ids of a whole text."""
    if len(text) <= min(size, LONG_RUN):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for part, whole in spaced_parts(text, size):
        ids += encoding._encode_single_piece(part) if whole else encoding.encode_ordinary(part)
    return ids


def encode(
    df: DataFrame, text_col: str, ranks_path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Columns ``keep`` and the ids of each text as ``array<int>``. A null text counts as empty and has no ids.

    Rows are independent: repeated rows give repeated results, an empty table an empty one. Columns not in
    ``keep`` are not read, so their names cannot clash.
    """
    ship(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_in_"))
    schema = StructType([*source.schema.fields[:-1]]).add(ids_col, ArrayType(IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for batch in slices(batches):
            lists = [np.asarray(encode_text(encoding, t), np.int32) for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.concatenate([np.zeros(0, np.int32), *lists])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], ids_col])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str, ranks_path: str, pattern: str, bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes its ids stand for; null ids give null."""
    ship(df.sparkSession)
    at = df.columns.index(ids_col)
    schema = StructType([*df.schema.fields]).add(bytes_col, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for batch in slices(batches):
            # One row's ids at a time: as Python numbers they take ten times their space.
            decoded = [encoding.decode_bytes(x.values.to_numpy().tolist()) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: id, number of ids, digest of the ids as text, digest of the bytes decoded from them."""
    ids = encode(df, text_col, ranks_path, pattern, keep=(id_col,))
    both = decode(ids, "ids", ranks_path, pattern)
    return both.select(
        F.col(f"`{id_col}`"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
