"""A trie of conversation prefixes by vertical bitmaps.

A node stands for a sequence of first turns, the root for none; conversations that
begin with it are its members. Its key is the exclusive-or of two 64-bit hashes of
every (position, turn), so keys of any prefix are prefix aggregates, and equal
sequences have equal keys wherever they are found.

Conversations are ordered by range, then cut into shards of consecutive
conversations, a long one into several: no task holds more than ``SHARD_ROWS`` turns.
A shard indexes each (position, turn) to the bitset of its conversations and walks
depth first: the parent's bitset and a posting give a child's, its popcount the
members, its lowest bit the smallest id, the bits that stop there the end list.
Nodes of one key from several shards are then summed.

Sums over subtrees need no walk over the whole tree. Nodes whose smallest member is
one conversation form a chain down to that conversation's end, and every node is in
one chain. A node's subtree is the rest of its own chain and the whole chains of those
members whose chains begin below it. The first is a suffix sum; for the second each
shard is walked once more, as far as chains lie below, and the members' totals are
added up from bit-sliced bitmaps: popcounts of the node's bitset with each binary place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kadence.llm.shipping import ship
from kadence.sources.staging import stage

#: Turns and conversations of a shard at most.
SHARD_ROWS, SHARD_CONVS = 32_768, 4096
#: Nodes of a chain that are summed together before chains are.
BLOCK = 1024
#: Characters of a text that order turns of one number and role, before a digest does.
TIE_CHARS = 64
#: Turns borrowed at most, and conversations that borrow from one.
BORROWED, FAMILY = 3, 20

_WORD = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(part, conv, pos, digest, words) of all turns, and (conv, part, length) of all conversations.

    Turns go by number, nulls first, equal ones by role, the text's first characters and a digest; repeated rows are
    turns of their own. ``pos`` counts from 1. A ``part`` is a range of conversations and positions; parts have about
    equal sizes whatever the conversations' lengths, and ``part`` in the second table is a conversation's first.
    Rows without a conversation are in none.
    """
    ship(df.sparkSession)
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = df.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        F.left(text, F.lit(TIE_CHARS)).alias("opening"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "turn", "role", "opening", "digest", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            at = np.arange(1, len(conv) + 1) - np.searchsorted(conv, conv)
            if conv[0] == last:
                at[conv == last] += held
            last, held = conv[-1], int(at[-1])
            columns = [pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(at), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "conv", "at", "digest", "words"])

    numbered = stage(rows.mapInArrow(number, "part int, conv long, at long, digest string, words long"), "numbered")
    stretches = numbered.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("rows"))
    each = Window.partitionBy("conv")
    before = F.coalesce(F.sum("rows").over(each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select("part", "conv", before.alias("before"), F.sum("rows").over(each).alias("length"), F.min("part").over(each).alias("first_part"))
    stretches = stage(stretches, "stretches")
    # A part continues at most one conversation, so these rows are as few as the parts.
    later = stretches.filter("before > 0").select("part", "conv", "before")
    turns = numbered.join(F.broadcast(later), ["part", "conv"], "left")
    turns = turns.select("part", "conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")
    return turns, stretches.filter("part = first_part").select("conv", "part", "length")


def with_borrowed_openings(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns replaced by those of conversation c - c % 20, h = crc32(c) % 4.

    If that conversation has fewer turns, or there is none, what it has takes the place of the h turns.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(BORROWED + 1))
    base = F.col("conv") - F.col("conv") % FAMILY
    given = convs.select(F.col("conv").alias("base"), F.col("length").alias("given"))
    asked = convs.select("conv", "part", "length", h.alias("h"), base.alias("base")).join(given, "base", "left")
    asked = stage(asked.withColumn("k", F.least("h", F.coalesce("given", F.lit(0)))), "asked")
    heads = turns.filter((F.col("pos") <= BORROWED) & (F.col("conv") % FAMILY == 0))
    heads = heads.select(F.col("conv").alias("base"), "pos", "digest", "words")
    borrowed = asked.filter("k > 0").join(heads, "base").filter("pos <= h").select("part", "conv", "pos", "digest", "words")
    own = turns.filter(F.col("pos") > h).join(asked.select("conv", "h", "k"), "conv")
    own = own.select("part", "conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words")
    length = F.col("k") + F.greatest(F.col("length") - F.col("h"), F.lit(0))
    return borrowed.unionByName(own), asked.select("conv", "part", length.alias("length"))


class Shard:
    """Consecutive conversations' turns and the bitsets of each (position, turn)."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.entries: dict[tuple[int, int, int], int] = {}  # where conversations come in: depth and key, to a bitset
        self.starts: list[int] = []  # each conversation's depth on entry, and its first row
        self.firsts: list[int] = []
        self.turns: list[tuple[int, int, int]] = []  # two hashes and the words
        self.postings: list[dict[tuple[int, int], int]] = []  # by position
        self.stops: dict[int, int] = {}  # depth to the conversations whose rows stop there
        self.ends: dict[int, int] = {}  # and to those that end there
        self.weights: list[tuple[int, ...]] = []

    def enter(self, conv: int, key: tuple[int, int], depth: int, weights: tuple[int, ...] = ()) -> None:
        bit = 1 << len(self.ids)
        self.ids.append(conv)
        self.starts.append(depth)
        self.firsts.append(len(self.turns))
        self.weights.append(weights)
        self.entries[depth, *key] = self.entries.get((depth, *key), 0) | bit

    def add(self, a: int, b: int, words: int) -> None:
        """The next turn of the conversation that entered last."""
        self.turns.append((a, b, words))

    @property
    def depth(self) -> int:
        return self.starts[-1] + len(self.turns) - self.firsts[-1]

    def key(self) -> tuple[int, int]:
        """The key of the last conversation's prefix so far."""
        (_, a, b) = next(k for k, bits in self.entries.items() if bits >> (len(self.ids) - 1) & 1)
        for x, y, _ in self.turns[self.firsts[-1] :]:
            a, b = a ^ x, b ^ y
        return a, b

    def index(self, lengths: list[int | None]) -> None:
        self.least = min(self.starts)
        rows = [*self.firsts[1:], len(self.turns)]
        for i, (start, first, end) in enumerate(zip(self.starts, self.firsts, rows, strict=True)):
            bit, depth = 1 << i, start + end - first
            for at in range(first, end):
                place = start + at - first - self.least
                while len(self.postings) <= place:
                    self.postings.append({})
                a, b, _ = self.turns[at]
                self.postings[place][a, b] = self.postings[place].get((a, b), 0) | bit
            self.stops[depth] = self.stops.get(depth, 0) | bit
            if lengths[i] == depth:
                self.ends[depth] = self.ends.get(depth, 0) | bit

    def walk(self) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """Depth, key, parent's key, words of the last turn and bitset of every node below an entry, and of the root."""
        stack = []
        for (depth, a, b), bits in self.entries.items():
            if not depth:
                yield 0, a, b, 0, 0, 0, bits
            stack.append((depth, a, b, bits))
        while stack:
            depth, a, b, bits = stack.pop()
            rest = bits & ~self.stops.get(depth, 0)
            while rest:
                i = (rest & -rest).bit_length() - 1
                x, y, words = self.turns[self.firsts[i] + depth - self.starts[i]]
                child = bits & self.postings[depth - self.least][x, y]
                rest &= ~child
                yield depth + 1, a ^ x, b ^ y, a, b, words, child
                stack.append((depth + 1, a ^ x, b ^ y, child))

    def members(self, bits: int) -> list[int]:
        found = []
        while bits:
            low = bits & -bits
            found.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return found

    def slices(self, place: int) -> list[int]:
        """One of the members' weights as bitmaps of its binary places."""
        out: list[int] = []
        for i, weights in enumerate(self.weights):
            value, at = weights[place], 0
            while value:
                if len(out) == at:
                    out.append(0)
                if value & 1:
                    out[at] |= 1 << i
                value, at = value >> 1, at + 1
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list[int | None]]]:
    """Sorted rows as shards, and each conversation's length where it is known.

    Columns: part, conv, pos, a, b, words, length, further weights. A row of position 0 opens a stretch: a, b
    are the key and words the depth on entry.
    """
    shard, lengths, length, weights = Shard(), [], None, ()
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for conv, pos, a, b, words, given, *more in zip(*columns, strict=True):
            if not pos:
                if len(shard.ids) >= SHARD_CONVS or len(shard.turns) >= SHARD_ROWS:
                    yield shard, lengths
                    shard, lengths = Shard(), []
                length, weights = given, tuple(more)
                shard.enter(conv, (a, b), words, weights)
                lengths.append(length)
                continue
            if len(shard.turns) >= SHARD_ROWS:
                key, depth = shard.key(), shard.depth
                yield shard, lengths
                shard, lengths = Shard(), [length]
                shard.enter(conv, key, depth, weights)
            shard.add(a, b, words)
    if shard.ids:
        yield shard, lengths


def _dealt(openings: DataFrame, rows: DataFrame, *weights: str) -> DataFrame:
    """Stretches and their turns by part, as ``_shards`` reads them."""
    head = openings.select("part", "conv", F.lit(0).cast("long").alias("pos"), "a", "b", F.col("start").alias("words"), "length", *weights)
    none = [F.lit(None).cast("long").alias(w) for w in ("length", *weights)]
    turns = rows.select("part", "conv", "pos", "a", "b", "words", *none)
    return head.unionByName(turns).repartition("part").sortWithinPartitions("part", "conv", "pos")


def _partial_nodes(dealt: DataFrame) -> DataFrame:
    """What each shard knows of its nodes; ``ends`` are ascending, and shards hold disjoint ranges of ids."""
    ddl = "a long, b long, parent_a long, parent_b long, depth long, words long, n long, least long, ends array<long>"
    arrow = pa.schema([*[pa.field(f.name, pa.int64()) for f in StructType.fromDDL(ddl)[:-1]], pa.field("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, lengths in _shards(batches):
            shard.index(lengths)
            out = []
            for depth, a, b, above_a, above_b, words, bits in shard.walk():
                ends = bits & shard.ends.get(depth, 0)
                least = shard.ids[(bits & -bits).bit_length() - 1]
                out.append((a, b, above_a, above_b, depth, words, bits.bit_count(), least, shard.members(ends)))
            if out:
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return dealt.mapInArrow(run, ddl)


def _weighed_nodes(dealt: DataFrame) -> DataFrame:
    """(a, b, saved, leaves) per shard: the members' weights added up in every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, lengths in _shards(batches):
            shard.index(lengths)
            saved, leaves = shard.slices(0), shard.slices(1)
            out = []
            for _, a, b, _, _, _, bits in shard.walk():
                sums = (sum((bits & s).bit_count() << i for i, s in enumerate(places)) for places in (saved, leaves))
                out.append((a, b, *sums))
            if out:
                columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "saved", "leaves"])

    return dealt.mapInArrow(run, "a long, b long, saved long, leaves long")


def _end_digests(partial: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of nodes where conversations end; lists are hashed as they stream by, however long."""
    rows = partial.filter(F.size("ends") > 0).select("a", "b", "ends", F.col("ends")[0].alias("first"))
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                said = ",".join(map(str, ends)).encode()
                if key == (a, b):
                    state.update(b"," + said)
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(said)
            yield _digest_rows(out)
        if key:
            yield _digest_rows([(*key, state.hexdigest())])

    return rows.mapInArrow(run, "a long, b long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "ends_sha256"])


def _value() -> Column:
    return (F.col("n") - 1) * F.col("words")


def _chain_sums(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Nodes with ``own_saved`` and ``own_leaves``, over the rest of their own chains.

    Long chains are summed by blocks first, so no task sees a chain whole.
    """
    single = nodes.filter("n = 1").withColumns({"own_saved": F.lit(0).cast("long"), "own_leaves": F.lit(1).cast("long")})
    shared = nodes.filter("n > 1").withColumn("block", F.floor(F.col("depth") / BLOCK))
    blocks = shared.groupBy("least", "block").agg(F.sum(_value()).alias("total"))
    below = Window.partitionBy("least").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("below", F.coalesce(F.sum("total").over(below), F.lit(0)))
    blocks = blocks.join(chains.select("least", F.col("leaves").alias("own_leaves")), "least").drop("total")
    rest = Window.partitionBy("least", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    shared = shared.join(blocks, ["least", "block"]).withColumn("own_saved", F.sum(_value()).over(rest) + F.col("below"))
    return shared.select(single.columns).unionByName(single)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie over turns and conversations as ``ordered_turns`` gives them.

    conv_id, the smallest member; depth; parent_conv_id, the parent's, null for the root; n_convs; n_children;
    n_leaves, the childless nodes of the subtree; saved_tokens, over the subtree the words of each node's last turn
    times its further members; ends_sha256 of the ids that end there. A node is in its own subtree. Without
    conversations there is no node, not even a root.
    """
    hashes = [F.xxhash64(F.lit(seed), "pos", "digest").alias(n) for seed, n in ((1, "a"), (2, "b"))]
    rows = stage(turns.select("part", "conv", "pos", "words", *hashes), "turns")
    found = rows.groupBy("part", "conv").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("rows"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("a", "b", "rows")]
    stretches = found.unionByName(convs.select("part", "conv", *zero)).groupBy("part", "conv")
    stretches = stretches.agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("rows").alias("rows"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    entering = [(F.bit_xor, "a", "a"), (F.bit_xor, "b", "b"), (F.sum, "rows", "start")]
    stretches = stretches.select("part", "conv", *[F.coalesce(f(c).over(before), F.lit(0)).alias(n) for f, c, n in entering])
    openings = stage(stretches.join(convs.select("conv", "length"), "conv"), "openings")

    partial = stage(_partial_nodes(_dealt(openings, rows)), "partial")
    same = {c: F.max(c).alias(c) for c in ("parent_a", "parent_b", "depth", "words")}
    merged = partial.groupBy("a", "b").agg(*same.values(), F.sum("n").alias("n"), F.min("least").alias("least"))
    merged = stage(merged, "merged")
    children = merged.filter("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(merged.join(children, ["a", "b"], "left").na.fill(0, ["n_children"]), "nodes")

    chains = nodes.groupBy("least").agg(
        F.min("depth").alias("top"), F.sum(_value()).alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")
    )
    chains = stage(chains, "chains")
    hanging = openings.join(chains.withColumnRenamed("least", "conv"), "conv").filter("start < top")
    above = rows.join(hanging.select("part", "conv", "top"), ["part", "conv"]).filter("pos < top")
    weighed = _weighed_nodes(_dealt(hanging, above, "saved", "leaves")).groupBy("a", "b")
    weighed = weighed.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))

    parents = nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("least").alias("parent_conv_id"))
    out = _chain_sums(nodes, chains).join(weighed, ["a", "b"], "left").join(_end_digests(partial), ["a", "b"], "left")
    out = out.join(parents, ["parent_a", "parent_b"], "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        (F.col("own_leaves") + F.coalesce("more_leaves", none)).alias("n_leaves"),
        (F.col("own_saved") + F.coalesce("more_saved", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The trie of a table of conversations; other columns are not read. See ``ordered_turns`` and ``trie``."""
    return trie(*ordered_turns(df, conv_col, turn_col, role_col, text_col))
