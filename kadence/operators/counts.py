"""Count tables: classes, attribute values and attribute pairs.

All counts are long tables keyed by attribute number. Every aggregate combines
on the map side, so a value or class that holds a large part of the rows reaches
the shuffle as one partial sum per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.sources.training import TrainingSet

# Equal rows are merged before pairs are formed when fewer than this share of the
# rows are distinct; above it the extra shuffle costs more than it saves.
REPEATING_ROWS = 0.1

# Attributes of a block. A table with more of them is counted by tiles, one block
# against another, so that a row gives at most TILE_ATTRS ** 2 lines in one job.
TILE_ATTRS = 64

XY_KEYS = ["attr_num", "attr_value", "class"]
PAIR_KEYS = ["attr_num1", "attr_value1", "attr_num2", "attr_value2", "class"]


def name_of(names: Mapping[int, str], num: Column) -> Column:
    """Attribute name for an attribute number (the map has one entry a column)."""
    width = max(names) + 1
    return F.get(F.array(*[F.lit(names.get(i)) for i in range(width)]), num)


def num_at(nums: Iterable[int], pos: Column) -> Column:
    """Attribute number for a position in an exploded attribute array."""
    return F.get(F.array(*[F.lit(n) for n in nums]), pos)


def repeat_ratio(ts: TrainingSet) -> float:
    """Distinct tuples over rows, from one approximate scan."""
    cols = [F.col(f"`{c}`") for c in (ts.label, *ts.attrs)]
    row = ts.df.agg(
        F.approx_count_distinct(F.xxhash64(*cols)).alias("d"), F.count(F.lit(1)).alias("n")
    ).first()
    return row["d"] / row["n"] if row["n"] else 1.0


def weighted_rows(ts: TrainingSet, pregroup: bool | str = False) -> DataFrame:
    """Label, attributes and a weight ``n``.

    With ``pregroup`` equal rows are merged first, which pays when tuples repeat;
    ``"auto"`` measures that. Without it each row weighs one and nothing moves.
    """
    cols = [F.col(f"`{c}`") for c in (ts.label, *ts.attrs)]
    if pregroup == "auto":
        pregroup = repeat_ratio(ts) < REPEATING_ROWS
    if pregroup:
        return ts.df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return ts.df.select(*cols, F.lit(1).cast("bigint").alias("n"))


def class_counts(ts: TrainingSet) -> DataFrame:
    """n(class)."""
    return ts.df.groupBy(F.col(f"`{ts.label}`").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_counts_of(xy: DataFrame, attr_num: int) -> DataFrame:
    """n(class) out of existing attribute counts, without another scan."""
    return xy.filter(F.col("attr_num") == attr_num).groupBy("class").agg(F.sum("n").alias("n"))


def attr_class_counts(ts: TrainingSet, pregroup: bool | str = False) -> DataFrame:
    """n(attribute, value, class) for all attributes in one scan."""
    return (
        weighted_rows(ts, pregroup)
        .select(F.col(f"`{ts.label}`").alias("class"), "n", F.posexplode(_values(ts.attrs)).alias("pos", "attr_value"))
        .groupBy("pos", "attr_value", "class")
        .agg(F.sum("n").alias("n"))
        .select(num_at(ts.attr_nums, F.col("pos")).alias("attr_num"), "attr_value", "class", "n")
    )


def fused_counts(
    ts: TrainingSet,
    pregroup: bool | str = False,
    skip_pairs: Iterable[tuple[str, str]] = (),
) -> DataFrame:
    """Attribute and pair counts from one scan.

    Each row is unpivoted twice: attribute i, then every attribute up to i. The
    diagonal is the attribute count, the rest is each unordered pair once, with
    ``attr_num1 >= attr_num2``. The plan does not grow with the table's width.
    """
    rows = (
        weighted_rows(ts, pregroup)
        .select(F.col(f"`{ts.label}`").alias("class"), "n", _values(ts.attrs).alias("row"))
        .select("class", "n", "row", F.posexplode("row").alias("i", "attr_value1"))
        .select(
            "class",
            "n",
            "i",
            "attr_value1",
            F.posexplode(F.slice("row", F.lit(1), F.col("i") + 1)).alias("j", "attr_value2"),
        )
    )
    return _summed(_without(rows, ts.attrs, ts.attrs, skip_pairs), ts.attr_nums, ts.attr_nums)


def _values(attrs: Iterable[str]) -> Column:
    return F.array(*[F.col(f"`{a}`") for a in attrs])


def _without(rows: DataFrame, first: Sequence[str], second: Sequence[str], skip_pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Leave out pairs of attributes; ``i`` and ``j`` are positions in ``first`` and ``second``."""
    i, j = ({a: n for n, a in enumerate(attrs)} for attrs in (first, second))
    for pair in skip_pairs:
        for a, b in (pair, pair[::-1]):
            if a in i and b in j:
                rows = rows.filter((F.col("i") != i[a]) | (F.col("j") != j[b]))
    return rows


def _summed(rows: DataFrame, first: Sequence[int], second: Sequence[int]) -> DataFrame:
    """Pair cells out of lines with positions, under the attribute numbers at these positions."""
    return (
        rows.groupBy("i", "attr_value1", "j", "attr_value2", "class")
        .agg(F.sum("n").alias("n"))
        .select(
            num_at(first, F.col("i")).alias("attr_num1"),
            "attr_value1",
            num_at(second, F.col("j")).alias("attr_num2"),
            "attr_value2",
            "class",
            "n",
        )
    )


def _columns(ts: TrainingSet, attrs: Sequence[str]) -> TrainingSet:
    """The training set with some of its attributes; only their columns are read."""
    kept = ts.df.select(*[F.col(f"`{c}`") for c in (ts.label, *attrs)])
    return replace(ts, df=kept, attrs=tuple(attrs), attr_nums=tuple(ts.num_of(a) for a in attrs))


def column_tiles(ts: TrainingSet, width: int = TILE_ATTRS) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Blocks of at most ``width`` attributes, each with itself and every block before it.

    Together the tiles hold each unordered pair of attributes once, and each attribute with itself.
    """
    if width < 1:
        raise ValueError("a tile has at least one attribute")
    blocks = [ts.attrs[start : start + width] for start in range(0, len(ts.attrs), width)]
    return [(block, before) for i, block in enumerate(blocks) for before in blocks[: i + 1]]


def tile_counts(
    ts: TrainingSet,
    tile: tuple[Sequence[str], Sequence[str]],
    pregroup: bool | str = False,
    skip_pairs: Iterable[tuple[str, str]] = (),
) -> DataFrame:
    """The fused counts of one tile. It reads the columns of its two blocks and no others."""
    upper, lower = tile
    if tuple(upper) == tuple(lower):
        return fused_counts(_columns(ts, upper), pregroup, skip_pairs)
    part = _columns(ts, (*lower, *upper))
    rows = (
        weighted_rows(part, pregroup)
        .select(F.col(f"`{ts.label}`").alias("class"), "n", _values(upper).alias("upper"), _values(lower).alias("lower"))
        .select("class", "n", "lower", F.posexplode("upper").alias("i", "attr_value1"))
        .select("class", "n", "i", "attr_value1", F.posexplode("lower").alias("j", "attr_value2"))
    )
    rows = _without(rows, upper, lower, skip_pairs)
    return _summed(rows, [ts.num_of(a) for a in upper], [ts.num_of(a) for a in lower])


def xy_of(fused: DataFrame) -> DataFrame:
    """The diagonal of fused counts: n(attribute, value, class)."""
    return fused.filter(F.col("attr_num1") == F.col("attr_num2")).select(
        F.col("attr_num1").alias("attr_num"), F.col("attr_value1").alias("attr_value"), "class", "n"
    )


def pairs_of(fused: DataFrame) -> DataFrame:
    """The off-diagonal of fused counts: each unordered pair once."""
    return fused.filter(F.col("attr_num1") != F.col("attr_num2"))


def pair_class_counts(ts: TrainingSet, pregroup: bool | str = False) -> DataFrame:
    """n(a1, v1, a2, v2, class), each unordered pair once (attr_num1 > attr_num2)."""
    return pairs_of(fused_counts(ts, pregroup))


def ordered_pair_counts(pairs: DataFrame) -> DataFrame:
    """Both orders of every pair, by mirroring the aggregated cells."""
    swapped = pairs.select(
        F.col("attr_num2").alias("attr_num1"),
        F.col("attr_value2").alias("attr_value1"),
        F.col("attr_num1").alias("attr_num2"),
        F.col("attr_value1").alias("attr_value2"),
        "class",
        "n",
    )
    return pairs.select(*PAIR_KEYS, "n").unionByName(swapped)


def value_marginals(xy: DataFrame) -> DataFrame:
    """n(attribute, value)."""
    return xy.groupBy("attr_num", "attr_value").agg(F.sum("n").alias("n"))


def pair_marginals(pairs: DataFrame) -> DataFrame:
    """n(a1, v1, a2, v2) without the class."""
    return pairs.groupBy("attr_num1", "attr_value1", "attr_num2", "attr_value2").agg(F.sum("n").alias("n"))


def attribute_domains(xy: DataFrame) -> DataFrame:
    """Distinct values of every attribute; a null counts as one value."""
    return xy.select("attr_num", "attr_value").distinct()


def domain_sizes(xy: DataFrame) -> DataFrame:
    """num_values per attribute."""
    return attribute_domains(xy).groupBy("attr_num").agg(F.count(F.lit(1)).alias("num_values"))


def with_num_values(xy: DataFrame) -> DataFrame:
    """Attribute counts with the domain size on each row."""
    return xy.join(domain_sizes(xy), "attr_num")


def drop_key_attributes(counts: DataFrame, key_nums: Iterable[int]) -> DataFrame:
    """Remove the counts of key columns that are not attributes themselves."""
    keys = list(key_nums)
    if not keys:
        return counts
    for column in ("attr_num", "attr_num1", "attr_num2"):
        if column in counts.columns:
            counts = counts.filter(~F.col(column).isin(keys))
    return counts
