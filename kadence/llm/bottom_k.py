"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its five-word shingles, hashed to 64 bits; the sketch is
the ``SKETCH`` smallest hashes. Documents with equal sets form a class, and only
classes are compared. Two sets with a similarity of 0.75 or more hold at least
``SHARED`` common values among the smallest of their union, but for a chance below
one in 10**8; all of those stand in both sketches. So a class whose retained values
stand in too few other inverted lists is linked with nothing. Sketches of small
sets are the sets, where the bound is exact.

The classes left bring their full sets, which get inverted lists of their own, over
each set's rarest values only: two linked sets share one of them, and where the
first shared value stands in both bounds what they can share at all. Pairs within
these bounds are filtered by an estimate on the union of both sketches and then
decided on the full sets. As only components are asked for, a list's members are
first compared with one of them; later only members of different components meet,
so that a group of copies costs a multiple of its size. In the end every pair
within the bounds and across components has been compared, so no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.llm.batches import slices
from kadence.llm.components import connected_components
from kadence.llm.shipping import ship
from kadence.sources.staging import stage

WORDS, PERCENT = 5, 75
SKETCH, SHARED = 64, 27
#: Up to this size the union of two linked sets fits a sketch, and bounds are exact.
SMALL = SKETCH * PERCENT // 100
#: Rounds in which list members are compared with one of them, before all others are.
STAR_ROUNDS = 2

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _tables.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    if len(known) <= 1 << 21:
        _tables[base] = known
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    line = np.frombuffer(b" ".join(parts), np.uint8)
    ends = np.append(np.flatnonzero(line == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((line.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(line)), out=sums[1:])
    each = _mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(line))[starts])
    width = min(words, len(parts))
    joined = np.full(len(parts) - width + 1, width, np.uint64)
    for k in range(width):
        joined = _mix(joined * np.uint64(_BASE) + each[k : len(each) - width + 1 + k])
    return np.unique(joined.view(np.int64))


def _sets(df: DataFrame, sketch: int | None) -> DataFrame:
    """(id_, text_) to (id_, n, digest, hashes): the ``sketch`` smallest or all."""
    id_field = df.schema["id_"]
    schema = f"id_ {id_field.dataType.simpleString()}, n long, digest string, hashes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(t) for t in batch.column(1).to_pylist()]
            kept = [s[:sketch] for s in sets]
            offsets = np.zeros(len(kept) + 1, np.int32)
            np.cumsum([len(s) for s in kept], out=offsets[1:])
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *kept]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id_", "n", "digest", "hashes"])

    return df.select("id_", "text_").mapInArrow(run, schema)


def _least_shared(size: Column) -> Column:
    """Common values that a sketch of this size needs with any partner's."""
    return F.when(size <= SMALL, F.ceil(size * PERCENT / 100)).otherwise(F.lit(SHARED)).cast("int")


def _shared_values(sets: DataFrame) -> DataFrame:
    """(cls, n, shared): the values of each class that other classes hold too, the rarest first."""
    values = sets.select("cls", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return values.join(often, "value").groupBy("cls").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared")
    )


def candidates(classes: DataFrame) -> DataFrame:
    """(cls) of the classes whose sketches share enough values with others' to be linked with any."""
    shared = _shared_values(classes.select("cls", "hashes"))
    return shared.filter(F.size("shared") >= _least_shared(F.col("n"))).select("cls")


def inverted_lists(sets: DataFrame) -> DataFrame:
    """(value, cls, n, left): each set under its rarest values, as far as linked sets must meet.

    ``left`` counts the set's values from this one on in the order of rarity, where values of one set
    only come first. Two sets whose first common value is this one share at most the smaller ``left``.
    """
    shared = _shared_values(sets)
    placed = shared.select("cls", "n", F.size("shared").alias("found"), F.posexplode("shared").alias("pos", "x"))
    placed = placed.select(F.col("x.value").alias("value"), "cls", "n", (F.col("found") - F.col("pos")).alias("left"))
    return placed.filter(100 * F.col("left") >= PERCENT * F.col("n"))


def _may_link(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether sets of these sizes can be linked if this is their first common value."""
    need = PERCENT * (a["n"] + b["n"])
    sized = 100 * F.least(a["n"], b["n"]) >= PERCENT * F.greatest(a["n"], b["n"])
    return sized & ((100 + PERCENT) * F.least(a["left"], b["left"]) >= need)


def _star(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs of each list's hub with its members of other components; every turn draws other hubs."""
    rank = F.col("cls") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    hubs = lists.groupBy("value").agg(F.min(F.struct(rank.alias("r"), "cls", "label", "n", "left")).alias("hub"))
    hubs = hubs.select("value", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("cls", "label", "n", "left")])
    bound = _may_link({c: F.col(c) for c in ("n", "left")}, {c: F.col(f"hub_{c}") for c in ("n", "left")})
    same = lists["value"] == hubs["value"]
    joined = lists.join(hubs, same & (F.col("label") != F.col("hub_label")) & bound)
    return joined.select(F.least("cls", "hub_cls").alias("a"), F.greatest("cls", "hub_cls").alias("b")).distinct()


def _across(lists: DataFrame) -> DataFrame:
    """All pairs of list members in different components within the bounds, by way of the components' own bounds."""
    groups = lists.groupBy("value", "label").agg(F.max("left").alias("left"), F.min("n").alias("n"))
    x, y = (groups.select(*[F.col(c).alias(f"{k}_{c}") for c in groups.columns]) for k in "xy")
    # The smallest size and the largest rest of a component bound every one of its members.
    bound = (100 + PERCENT) * F.least("x_left", "y_left") >= PERCENT * (F.col("x_n") + F.col("y_n"))
    pairs = x.join(y, (F.col("x_value") == F.col("y_value")) & (F.col("x_label") < F.col("y_label")) & bound)
    pairs = pairs.select(F.col("x_value").alias("value"), "x_label", "y_label", "y_left", "y_n")
    a, b = (lists.select(*[F.col(c).alias(f"{k}_{c}") for c in lists.columns]) for k in "ab")
    own = (100 + PERCENT) * F.least("a_left", "y_left") >= PERCENT * (F.col("a_n") + F.col("y_n"))
    met = pairs.join(a, (F.col("value") == F.col("a_value")) & (F.col("x_label") == F.col("a_label")) & own)
    met = met.select("value", "y_label", "a_cls", "a_n", "a_left")
    bound = _may_link({c: F.col(f"a_{c}") for c in ("n", "left")}, {c: F.col(f"b_{c}") for c in ("n", "left")})
    met = met.join(b, (F.col("value") == F.col("b_value")) & (F.col("y_label") == F.col("b_label")) & bound)
    return met.select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b")).distinct()


def _linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links: those whose sizes and sketches allow it, decided on the full sets."""

    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("cls").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    sized = pairs.join(side(classes, "a", "n", "hashes"), "a").join(side(classes, "b", "n", "hashes"), "b")
    sized = sized.filter(100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n"))
    union = F.slice(F.array_sort(F.array_union("a_hashes", "b_hashes")), 1, SKETCH)
    common = F.array_intersect(union, F.array_intersect("a_hashes", "b_hashes"))
    likely = sized.filter(SKETCH * F.size(common) >= SHARED * F.size(union)).select("a", "b")
    full = likely.join(side(sets, "a", "hashes"), "a").join(side(sets, "b", "hashes"), "b")
    inter = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return full.filter(100 * inter >= PERCENT * (F.size("a_hashes") + F.size("b_hashes") - inter)).select("a", "b")


def _components(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked with another class."""
    members = stage(candidates(classes), "members")
    wanted = classes.select("cls", F.col("digest").alias("digest_")).join(members, "cls", "left_semi")
    found = _sets(texts.join(members, texts["id_"] == members["cls"], "left_semi"), None)
    sets = found.join(wanted, (found["id_"] == wanted["cls"]) & (found["digest"] == wanted["digest_"])).select("cls", "hashes")
    sets = stage(sets.dropDuplicates(["cls"]), "sets")
    lists = stage(inverted_lists(sets), "lists")
    labelled, links = lists.withColumn("label", F.col("cls")), None
    for turn in range(STAR_ROUNDS + 1):
        pairs = stage(_star(labelled, turn) if turn < STAR_ROUNDS else _across(labelled), "pairs")
        new = stage(_linked(pairs, classes, sets), "links")
        links = new if links is None else links.unionByName(new)
        if turn < STAR_ROUNDS:
            known = _nearby(links)
            labelled = lists.join(known, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
            labelled = stage(labelled.select("value", "cls", "n", "left", "label"), "labelled")
    return connected_components(links)


def _nearby(links: DataFrame) -> DataFrame:
    """(cls, label): equal labels mean one component, found by two steps along the links; what they miss is compared."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("b")).select("cls", F.least("cls", "b").alias("label")), "nearby")
    further = least.select(F.col("cls").alias("label"), F.col("label").alias("further"))
    return least.join(further, "label", "left").select("cls", F.coalesce("further", "label").alias("label"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links of ``PERCENT`` per cent similarity reach; the document of that
    id is the one kept. Words are split at ASCII white space with A-Z in lower case; a document of fewer than
    five words is one shingle, and a null or empty one is linked with nothing. Repeated rows share a component.
    Rows without an id are compared with nothing: they have no component and are kept. An empty table gives no
    rows; other columns are not read.
    """
    ship(df.sparkSession)
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_"))
    sketched = stage(_sets(texts, SKETCH), "sketches")
    classes = sketched.filter("n > 0 and id_ is not null").groupBy("digest").agg(
        F.min("id_").alias("cls"), F.first("n").alias("n"), F.first("hashes").alias("hashes")
    )
    classes = stage(classes, "classes")
    labels = _components(texts, classes)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        F.col("digest").alias("digest_"), F.coalesce("component", "cls").alias("component_")
    )
    known = F.when((F.col("n") > 0) & F.col("id_").isNotNull(), F.col("component_"))
    rows = sketched.join(named, F.col("digest") == F.col("digest_"), "left").withColumn("component_id", F.coalesce(known, "id_"))
    return rows.select(
        F.col("id_").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id_") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_representatives(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` per group of near-duplicates, with all its columns, and every row without an id.

    Of rows that repeat an id within a group, one stays.
    """
    found = stage(near_duplicates(df, id_col, text_col), "near_duplicates")
    kept = found.filter(F.col("kept") & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("kept_id_"))
    repeated = not found.groupBy(id_col).count().filter(f"count > 1 and `{id_col}` is not null").isEmpty()
    rows = df.filter(F.col(f"`{id_col}`").isNotNull())
    rows = rows.join(kept.distinct() if repeated else kept, F.col(f"`{id_col}`") == F.col("kept_id_"), "left_semi")
    if repeated:
        rows = rows.dropDuplicates([id_col])
    return rows.unionByName(df.filter(F.col(f"`{id_col}`").isNull()))
