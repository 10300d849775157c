"""Fixity of WARC archives by Merkle trees over ordered offset ranges.

Records are laid out in segments, one after the other. The hashes of the records
that start in one offset range form a leaf; every further level hashes up to
``FANOUT`` neighbours, first within segments, then across them, up to one root.
Two replicas are compared from the root down: a level is read only under nodes
that differ, and records only in ranges that differ.

All of it is joins and aggregates over bounded groups: a range holds no more
records than headers fit into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadence.sources.staging import stage

#: Bytes of an offset range, nodes under a parent, and ids that share a segment.
RANGE_BYTES, FANOUT, IDS_PER_SEGMENT = 65_536, 16, 1000
RECORD_COLUMNS = ("segment", "offset", "length", "record_id", "sha256")


def warc_record(id_: Column, url: Column, payload: Column) -> Column:
    """A resource record as it stands in a WARC file."""
    payload = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(id_.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))


def archive(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Records of a table in archive order: segment, offset, length, record_id, sha256.

    A segment holds ``IDS_PER_SEGMENT`` consecutive ids (-1 those without an id); within it records go by id,
    url and content, repeated rows side by side. Null urls and payloads are empty. Only hashes are sorted, not
    payloads. An empty table gives no records; other columns are not read.
    """
    id_, record = F.col(f"`{id_col}`"), warc_record(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{payload_col}`"))
    rows = df.select(
        F.coalesce(F.floor(id_ / IDS_PER_SEGMENT), F.lit(-1)).cast("long").alias("segment"),
        id_.cast("long").alias("record_id"),
        F.sha2(F.coalesce(F.col(f"`{url_col}`"), F.lit("")).cast("binary"), 256).alias("url_"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("sha256"),
    )
    order = Window.partitionBy("segment").orderBy("record_id", "url_", "sha256", "length").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("offset", F.sum("length").over(order) - F.col("length")).select(*RECORD_COLUMNS)


@dataclass(frozen=True)
class Tree:
    """``levels[0]`` are the offset ranges, the last level is the root; each is (segment, node, hash)."""

    records: DataFrame
    levels: tuple[DataFrame, ...]
    #: Levels up to this one lie within segments; above it the nodes are groups of segments.
    within: int


def _combine(nodes: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Parents over at most ``FANOUT`` children: the hash of their places and hashes in order."""
    children = F.array_sort(F.collect_list(F.struct(*order, "hash")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", *[c[o].cast("string") for o in order], c["hash"])), ",")
    return nodes.groupBy(*keys).agg(F.sha2(text.cast("binary"), 256).alias("hash"))


def _ranges(records: DataFrame) -> DataFrame:
    leaves = F.array_sort(F.collect_list(F.struct("offset", "length", "sha256")))
    text = F.array_join(
        F.transform(leaves, lambda r: F.concat_ws(":", r["offset"].cast("string"), r["length"].cast("string"), r["sha256"])), ","
    )
    node = F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node")
    return records.groupBy("segment", node).agg(F.sha2(text.cast("binary"), 256).alias("hash"))


def _height(count: int) -> int:
    """Levels above the lowest until one node is left."""
    height = 0
    while FANOUT**height < count:
        height += 1
    return height


def build_tree(records: DataFrame, heights: tuple[int, int] | None = None) -> Tree:
    """The tree of one replica. Replicas to be compared need equal ``heights``; see ``shared_heights``."""
    within, across = heights or shared_heights(records)
    up = F.floor(F.col("node") / FANOUT).cast("long").alias("node")
    levels = [stage(_ranges(records), "ranges")]
    for _ in range(within):
        levels.append(stage(_combine(levels[-1], [F.col("segment"), up], ["node"]), "nodes"))
    group = (F.floor(F.col("segment") / FANOUT)).cast("long").alias("segment")
    for _ in range(across):
        levels.append(stage(_combine(levels[-1], [group, F.lit(0).cast("long").alias("node")], ["segment"]), "nodes"))
    return Tree(records, tuple(levels), within)


def shared_heights(*records: DataFrame) -> tuple[int, int]:
    """Levels within segments and across them that bring each replica to one root."""
    sizes = [
        r.agg(F.max(F.floor(F.col("offset") / RANGE_BYTES)), F.min("segment"), F.max("segment")).first() for r in records
    ]
    sizes = [(n, low, high) for n, low, high in sizes if n is not None]
    if not sizes:
        return 0, 0
    across = 0
    # Negative segments stay below zero, so the walk ends when all numbers agree, or only -1 and 0 are left.
    low, high = min(s[1] for s in sizes), max(s[2] for s in sizes)
    while low != high and (low, high) != (-1, 0):
        low, high, across = low // FANOUT, high // FANOUT, across + 1
    return _height(max(s[0] for s in sizes) + 1), across


def audit(a: Tree, b: Tree) -> DataFrame:
    """Records in which two replicas differ: record_id, segment, offset, length, status.

    ``corrupt``: both have a record there, with different content; ``missing``: only ``a`` has one; ``extra``:
    only ``b`` has. Below nodes that agree nothing is compared. Equal replicas, and empty ones, give no rows.
    """
    if len(a.levels) != len(b.levels) or a.within != b.within:
        raise ValueError("the trees differ in height; build both with shared_heights(a, b)")
    top = len(a.levels) - 1
    # Each level is written: the plan of a level would hold that of the one above twice.
    bad = stage(_differing(a.levels[top], b.levels[top]), "differing")
    for level in range(top - 1, -1, -1):
        if level >= a.within:
            parents = [F.floor(F.col("segment") / FANOUT).cast("long"), F.lit(0).cast("long")]
        else:
            parents = [F.col("segment"), F.floor(F.col("node") / FANOUT).cast("long")]
        under = [_under(t.levels[level], parents, bad) for t in (a, b)]
        bad = stage(_differing(*under), "differing")
    place = [F.col("segment"), F.floor(F.col("offset") / RANGE_BYTES).cast("long")]
    x, y = (_under(t.records, place, bad) for t in (a, b))
    left = x.select("segment", "offset", *[F.col(c).alias(f"a_{c}") for c in ("length", "record_id", "sha256")])
    right = y.select("segment", "offset", *[F.col(c).alias(f"b_{c}") for c in ("length", "record_id", "sha256")])
    both = left.join(right, ["segment", "offset"], "full_outer")
    status = F.when(F.col("b_sha256").isNull(), "missing").when(F.col("a_sha256").isNull(), "extra").otherwise("corrupt")
    return both.filter(~F.col("a_sha256").eqNullSafe(F.col("b_sha256"))).select(
        F.coalesce("a_record_id", "b_record_id").alias("record_id"),
        "segment",
        "offset",
        F.coalesce("a_length", "b_length").alias("length"),
        status.alias("status"),
    )


def _differing(x: DataFrame, y: DataFrame) -> DataFrame:
    """Nodes of one level whose hashes differ, or that one side lacks."""
    other = y.withColumnRenamed("hash", "other_")
    return x.join(other, ["segment", "node"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("other_"))).select("segment", "node")


def _under(rows: DataFrame, parents: list[Column], bad: DataFrame) -> DataFrame:
    """Rows whose parent is among the differing nodes."""
    keyed = rows.withColumn("parent_segment_", parents[0]).withColumn("parent_node_", parents[1])
    named = bad.select(F.col("segment").alias("parent_segment_"), F.col("node").alias("parent_node_"))
    return keyed.join(named, ["parent_segment_", "parent_node_"], "left_semi").drop("parent_segment_", "parent_node_")


def root_hash(tree: Tree) -> DataFrame:
    """One row with the root's hash; several only where the top level could not be joined (segments -1 and 0)."""
    return tree.levels[-1].select("hash")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """``audit`` of two archives given as record tables."""
    a, b = stage(a, "records"), stage(b, "records")
    heights = shared_heights(a, b)
    return audit(*(build_tree(r, heights) for r in (a, b)))
