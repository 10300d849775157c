"""Document fingerprints from prefix polynomial hashes.

The hash of a text's first i code points is kept for every i, modulo a prime. The
hash of any span follows from two entries, so spans are compared in constant time
and the longest common extension of two positions is found by binary search.

A fingerprint is a short string: the length, the hash of the whole text under two
primes, prefix hashes on a grid whose step is a power of two (grids of texts of
different length share points), and the smallest hashes of all spans of ``SPAN``
code points. Likeness is the larger of two shares: the common beginning, found by
binary search over the shared grid, and the overlap of the smallest span hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from kadence.llm.shipping import ship

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_879)
#: Grid points of a fingerprint: more than half of this many, at most all.
GRID = 32
#: Code points of a span, and how many span hashes are kept.
SPAN, SKETCH = 24, 32
#: Powers are remembered up to this exponent.
REMEMBERED = 1 << 20

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo ``prime``, by doubling."""
    known = _powers.get((base, prime), np.ones(1, np.int64))
    while len(known) < n:
        step = pow(base, len(known), prime)
        known = np.concatenate([known, known * step % prime])
    if len(known) <= REMEMBERED:
        _powers[base, prime] = known
    return known[:n]


def code_points(text: str) -> np.ndarray:
    """One more than each code point, so that leading zeros count."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


class PrefixHashes:
    """Prefix hashes of one text under one prime."""

    def __init__(self, codes: np.ndarray, which: int = 0) -> None:
        self.prime, self.base, self.n = PRIMES[which], BASES[which], len(codes)
        terms = codes * powers(self.base, self.prime, self.n) % self.prime
        self.sums = np.zeros(self.n + 1, np.int64)
        np.cumsum(terms, out=self.sums[1:])
        self.sums %= self.prime

    def spans(self, starts: np.ndarray | int, ends: np.ndarray | int) -> np.ndarray:
        """Hashes of spans, the same for equal spans wherever they stand."""
        inverse = powers(pow(self.base, -1, self.prime), self.prime, self.n + 1)
        return (self.sums[ends] - self.sums[starts]) % self.prime * inverse[starts] % self.prime


def equal_spans(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] have the same hash."""
    return bool(a.spans(i, i + length) == b.spans(j, j + length))


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The length of the longest common beginning of a[i:] and b[j:]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


class Fingerprint:
    """A text's fingerprint; ``text`` is its string form."""

    def __init__(self, text: str) -> None:
        codes = code_points(text)
        self.n = len(codes)
        self.step = 1 << max(0, (self.n - 1) // GRID).bit_length()
        self.prefix = PrefixHashes(codes)
        second = int((codes * powers(BASES[1], PRIMES[1], self.n) % PRIMES[1]).sum() % PRIMES[1])
        self.whole = int(self.prefix.sums[-1]) << 32 | second
        self.grid = self.prefix.sums[self.step :: self.step]
        starts = np.arange(max(1, self.n - SPAN + 1) if self.n else 0)
        spans = self.prefix.spans(starts, np.minimum(starts + SPAN, self.n)).astype(np.uint64)
        mixed = (spans * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        few = mixed if len(mixed) <= 8 * SKETCH else np.partition(mixed, 4 * SKETCH)[: 4 * SKETCH]
        smallest = np.unique(few)
        self.sketch = smallest[:SKETCH] if len(smallest) >= SKETCH else np.unique(mixed)[:SKETCH]
        self.text = ".".join(
            (f"{self.n:x}", f"{self.whole:016x}", self.grid.astype(">u4").tobytes().hex(), self.sketch.astype(">u4").tobytes().hex())
        )


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 for unrelated texts to 1 for equal ones; an empty text is like another empty one only."""
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    step = max(a.step, b.step)
    x, y = a.grid[step // a.step - 1 :: step // a.step], b.grid[step // b.step - 1 :: step // b.step]
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[middle - 1] == y[middle - 1]:
            low = middle
        else:
            high = middle - 1
    union = np.union1d(a.sketch, b.sketch)
    union = union[: max(len(a.sketch), len(b.sketch))] if max(len(a.sketch), len(b.sketch)) == SKETCH else union
    both = np.intersect1d(a.sketch, b.sketch, assume_unique=True)
    overlap = np.isin(union, both, assume_unique=True).mean()
    return float(max(low * step / max(a.n, b.n), overlap))


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points from the start of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's fingerprint and its likeness to its edited text and to the next row's text.

    Rows are in the order of their ids, nulls first, equal ids by text; after the last comes the first. The
    ids are cut into ranges at quantiles, and each range also gets the first row of the next one, so texts are
    shuffled once and every task streams its ranges with one row in hand. A null text counts as empty. An empty
    table gives no rows, a single row follows itself; other columns are not read.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    common_prefix, the code points that the edited text begins with unchanged.
    """
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id_"), key.alias("key_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_"))
    shares = [k / (4 * parts) for k in range(1, 4 * parts)]
    bounds = np.unique(np.asarray(rows.agg(F.percentile_approx("key_", shares, 10_000)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "right").astype(np.int32))

    ranged = rows.withColumn("range_", range_of("key_"))
    # One row per range, at most four per partition.
    firsts = sorted((r.range_, r.key_) for r in ranged.select("key_", "range_").groupBy("range_").agg(F.min("key_").alias("key_")).collect())
    before = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]
    ahead = spark.createDataFrame(before, "range_ int, key_ long")
    ahead = rows.drop("id_").join(F.broadcast(ahead), "key_").groupBy("range_", "key_").agg(F.min("text_").alias("text_"))
    both = ranged.withColumn("ahead_", F.lit(0)).unionByName(
        ahead.select(F.lit(None).cast("long").alias("id_"), "key_", "text_", "range_", F.lit(1).alias("ahead_"))
    )
    dealt = both.repartition(parts, "range_").sortWithinPartitions("range_", "ahead_", "key_", "text_")
    schema = StructType().add(id_col, LongType()).add("n_chars", LongType())
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, StringType())
    schema = schema.add("near_edited", DoubleType()).add("near_next", DoubleType()).add("common_prefix", LongType())
    return dealt.select("id_", "text_", "ahead_").mapInArrow(_stream(schema), schema)


def _stream(schema: StructType):
    arrow = pa.schema(
        [(f.name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.typeName()]) for f in schema.fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, Fingerprint] | None = None
        for batch in batches:
            out = []
            for id_, text, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Fingerprint(text)
                if held:
                    out.append(_result(*held, text, own))
                held = None if ahead else (id_, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow) if out else pa.RecordBatch.from_pylist([], schema=arrow)

    return run


def _result(id_: int | None, text: str, own: Fingerprint, following: str, next_: Fingerprint) -> tuple:
    edited = edit(text, following)
    changed = Fingerprint(edited) if edited != text else own
    same = common_extension(own.prefix, 0, changed.prefix, 0)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (id_, own.n, sha, own.text, changed.text, likeness(own, changed), likeness(own, next_), same)
