"""N-gram Jaccard join by size bands, tiles and bitmap signatures.

A document is the set of its three-word shingles, hashed to 64 bits; equal sets form
a class, and classes are compared. A band holds the sizes of one octave. Linked sets
lie in one band or in two that touch, so a set near the upper end of its band also
visits the next.

Within a band every set has a *sample*, its hashes below a limit fixed for the band:
all of a small set, about ``SAMPLE`` to twice as many of a larger one. A tile is what
one band's sets hold under one sampled value. Linked sets share most of their samples,
so only each sample's rarest values make tiles, as many as two samples with the least
common share cannot avoid. That share is exact where the sample is the set; elsewhere it
is ``SHARE`` per cent, which linked sets miss with a chance below 1 in 10**9.

Every set also has a bitmap signature: the parity of its values in as many bits as its
band asks for. Two signatures differ in no more bits than the sets have values that are
not common, so the bits that differ bound the overlap from above. Pairs within the
bound are decided by intersecting the sorted sets.

As only components are asked for, tile members first meet one of them, twice; then
the tiles that still hold several components are compared whole, in sub-tiles of about
``TILE`` rows a side: its most frequent component against all others, and these among
themselves. A group of copies that has come together costs a multiple of its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.llm.batches import slices
from kadence.llm.bottom_k import shingle_hashes
from kadence.llm.components import connected_components
from kadence.llm.shipping import ship
from kadence.sources.staging import stage

WORDS, PERCENT = 3, 90
#: Least mean size of a sample that is not the whole set, and per cent of it that linked sets share.
SAMPLE, SHARE = 64, 60
#: Rows on each side of a sub-tile, on average.
TILE = 1024
#: Bits of a signature: once to twice the set's size, within these limits.
LEAST_BITS, MOST_BITS = 64, 65_536
#: Rounds in which tile members are compared with one of them, before all others are.
STAR_ROUNDS = 2
#: Rows of a tile task that are compared at a time.
_BUFFER = 4096

_SETS = "id_ long, n long, digest string, bands array<struct<band:int,vals:array<long>,signature:binary>>"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def band_of(n: int) -> int:
    return n.bit_length() - 1


def bands_of(n: int) -> list[int]:
    """The own band of a set of n values, and the next if sets there can be linked with it."""
    own = band_of(n)
    return [own, own + 1] if 100 * n >= PERCENT * 2 ** (own + 1) else [own]


def sampled(values: np.ndarray, band: int) -> np.ndarray:
    """Those of the sorted values that lie in the band's sample."""
    if 2**band <= SAMPLE:
        return values
    return values[: np.searchsorted(values, -(1 << 63) + (SAMPLE << 64 - band))]


def signature(values: np.ndarray, band: int) -> np.ndarray:
    """The parity of the values in each of the band's bits, as 64-bit words."""
    bits = min(MOST_BITS, max(LEAST_BITS, 2 << band))
    at = (values.view(np.uint64) * _SPREAD) >> np.uint64(65 - bits.bit_length())
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the rows of two arrays of signatures differ."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def may_link(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with at least ``apart`` values that are not common can be linked."""
    overlap = np.minimum(np.minimum(x, y), (x + y - apart) // 2)
    return 100 * overlap >= PERCENT * (x + y - overlap)


def _sets(texts: DataFrame) -> DataFrame:
    """(id_, text_) to (id_, n, digest, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(t, WORDS) for t in batch.column(1).to_pylist()]
            bands = [bands_of(len(s)) if len(s) else [] for s in sets]
            each = [(b, sampled(s, b), signature(s, b).tobytes()) for s, bs in zip(sets, bands, strict=True) for b in bs]
            entries = pa.StructArray.from_arrays(
                [
                    pa.array([b for b, _, _ in each], pa.int32()),
                    _lists([v for _, v, _ in each]),
                    pa.array([s for _, _, s in each], pa.binary()),
                ],
                names=["band", "vals", "signature"],
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32))
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                pa.ListArray.from_arrays(offsets, entries),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id_", "n", "digest", "bands"])

    return texts.mapInArrow(run, _SETS)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _whole_sets(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, hashes) of the members; their texts are read again, so sets are kept of these only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(t, WORDS) for t in batch.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.string()), _lists(sets)], names=["id_", "digest", "hashes"]
            )

    wanted = members.select("cls", F.col("least_id").alias("id_"), "digest")
    found = texts.join(wanted.select("id_"), "id_", "left_semi").select("id_", "text_")
    # An id may stand on several rows; the class is the row of its digest.
    found = found.mapInArrow(run, "id_ long, digest string, hashes array<long>")
    return found.join(wanted, ["id_", "digest"]).select("cls", "hashes").dropDuplicates(["cls"])


def tiles(bands: DataFrame) -> DataFrame:
    """(band, value, cls): each set of a band under the rarest values of its sample that others hold too."""
    values = bands.select("band", "cls", F.size("vals").alias("size"), F.explode("vals").alias("value"))
    often = values.groupBy("band", "value").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = values.join(often, ["band", "value"]).groupBy("cls", "band").agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("held", "value"))).alias("shared")
    )
    share = F.when(F.pow(F.lit(2), "band") <= SAMPLE, F.lit(PERCENT)).otherwise(F.lit(SHARE))
    placed = shared.withColumn("share", share).select("cls", "band", "size", "share", F.size("shared").alias("found"), F.posexplode("shared").alias("at", "x"))
    # Values that no other set holds are the rarest, so these are the last of the sample.
    left = F.col("found") - F.col("at")
    return placed.filter(100 * left >= F.col("share") * F.col("size")).select("band", F.col("x.value").alias("value"), "cls")


def _words(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(rows, -1)


def _bounded(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b, band) whose sizes and signatures allow a link."""

    def side(name: str) -> DataFrame:
        return signatures.select(F.col("cls").alias(name), "band", *[F.col(c).alias(f"{name}_{c}") for c in ("n", "signature")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # All signatures of a band have one length.
            for band in np.unique(batch.column(2).to_numpy()):
                rows = batch.filter(pa.array(batch.column(2).to_numpy() == band))
                x, y = rows.column(3).to_numpy(), rows.column(5).to_numpy()
                apart = differing(_words(rows.column(4), len(x)), _words(rows.column(6), len(x)))
                yield rows.filter(pa.array(may_link(x, y, apart))).select([0, 1])

    both = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
    return both.select("a", "b", "band", "a_n", "a_signature", "b_n", "b_signature").mapInArrow(run, "a long, b long")


def _star(labelled: DataFrame, signatures: DataFrame, turn: int) -> DataFrame:
    """Pairs of each tile's hub with its members of other components.

    First tiles of like members have one hub, which joins most of them at once; later each draws its own.
    """
    rank = F.col("cls") if turn == 0 else F.xxhash64("cls", "value", F.lit(turn))
    hubs = labelled.groupBy("band", "value").agg(F.min(F.struct(rank.alias("r"), "cls", "label")).alias("hub"))
    hubs = hubs.select("band", "value", F.col("hub.cls").alias("hub"), F.col("hub.label").alias("hub_label"))
    met = labelled.join(hubs, ["band", "value"]).filter("label <> hub_label")
    pairs = met.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"), "band").distinct()
    return _bounded(pairs, signatures).distinct()


def _sub_tiles(labelled: DataFrame, signatures: DataFrame) -> DataFrame:
    """The rows of every tile with several components, a copy for each sub-tile they stand in.

    ``kind`` 0 sets blocks of the most frequent component against blocks of the others, 1 blocks of the
    others against each other. Rows of one sub-tile are compared if their ``own`` blocks differ, or ``inner`` holds.
    """
    counted = labelled.groupBy("band", "value", "label").agg(F.count(F.lit(1)).alias("size"))
    split = counted.groupBy("band", "value").agg(
        F.max_by("label", F.struct("size", "label")).alias("most"),
        F.max("size").alias("mass"),
        F.sum("size").alias("rows"),
        F.count(F.lit(1)).alias("labels"),
    )
    split = split.filter("labels > 1").withColumn("bm", F.ceil(F.col("mass") / TILE).cast("int"))
    split = split.withColumn("bo", F.ceil((F.col("rows") - F.col("mass")) / TILE).cast("int"))
    rows = labelled.join(split.select("band", "value", "most", "bm", "bo", "labels"), ["band", "value"])
    is_most = F.col("label") == F.col("most")
    own = F.pmod(F.xxhash64("cls"), F.when(is_most, F.col("bm")).otherwise(F.col("bo"))).cast("int")
    held = labelled.groupBy("cls", "band").agg(F.sort_array(F.collect_list("value")).alias("held"))
    rows = rows.withColumn("is_most", is_most).withColumn("own", own).join(signatures.join(held, ["cls", "band"]), ["cls", "band"])

    def at(count: str, kind: int, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda x: F.struct(F.lit(kind).alias("kind"), *make(x)))

    mass = at("bo", 0, lambda x: (F.col("own").alias("i"), x.alias("j")))
    across = at("bm", 0, lambda x: (x.alias("i"), F.col("own").alias("j")))
    among = at("bo", 1, lambda x: (F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    none = F.slice(among, 1, 0)
    sub = F.when(F.col("is_most"), mass).otherwise(F.concat(across, F.when(F.col("labels") > 2, among).otherwise(none)))
    rows = rows.withColumn("sub", F.explode(sub))
    inner = (F.col("sub.kind") == 1) & (F.col("sub.i") == F.col("sub.j"))
    side = F.when(F.col("sub.kind") == 0, F.col("is_most").cast("int") - 2).otherwise(F.col("own"))
    return rows.select("band", "value", "sub.*", inner.alias("inner"), side.alias("own"), "n", "cls", "label", "signature", "held")


def _compared(sub: DataFrame) -> DataFrame:
    """(a, b) of the pairs in a sub-tile that are of different components and within the bounds, once each."""
    keys = ["band", "value", "kind", "i", "j"]
    rows = sub.repartition(*keys).sortWithinPartitions(*keys, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= _BUFFER:
                starts = np.flatnonzero(_starts(held))
                if starts[-1]:  # the last sub-tile may go on
                    yield from _pairs(held.slice(0, starts[-1]))
                    held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from _pairs(held)

    # Two sets may meet in two bands.
    return rows.mapInArrow(run, "a long, b long").distinct()


class _Held:
    """The tiles of each row's set, as sets made when they are first asked for."""

    def __init__(self, lists: pa.Array) -> None:
        self.lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.sets: dict[int, frozenset[int]] = {}

    def of(self, row: int) -> frozenset[int]:
        if row not in self.sets:
            self.sets[row] = frozenset(self.lists[row].as_py())
        return self.sets[row]

    def first(self, x: int, y: int) -> int:
        return min(self.of(x) & self.of(y))


def _starts(table: pa.Table) -> np.ndarray:
    """Whether a row begins a sub-tile."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in ("band", "value", "kind", "i", "j"):
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return new


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Every row with the ones after it in its sub-tile, one distance after another; rows go by size, so most stop early.

    A pair is given in the first tile that holds both only.
    """
    all_bands = table.column("band").to_numpy()
    for band in np.unique(all_bands):
        part = table.filter(pa.array(all_bands == band)).combine_chunks()
        tile = np.cumsum(_starts(part))
        n, cls, label, own, value = (part.column(c).to_numpy() for c in ("n", "cls", "label", "own", "value"))
        held = _Held(part.column("held"))
        inner = part.column("inner").to_numpy(zero_copy_only=False)
        words = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint64).reshape(len(n), -1)
        at = np.arange(len(n))
        step = max(1, (1 << 22) // words.shape[1])
        for distance in range(1, len(n)):
            at = at[at + distance < len(n)]
            at = at[(tile[at] == tile[at + distance]) & (100 * n[at] >= PERCENT * n[at + distance])]
            if not len(at):
                break
            met = at[(label[at] != label[at + distance]) & (inner[at] | (own[at] != own[at + distance]))]
            for start in range(0, len(met), step):
                x = met[start : start + step]
                y = x + distance
                good = may_link(n[x], n[y], differing(words[x], words[y]))
                x, y = x[good], y[good]
                first = np.fromiter((held.first(i, j) == value[i] for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
                a, b = cls[x[first]], cls[y[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sorted sets intersect enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = batch.column(2), batch.column(3)
            xs, ys = (c.flatten().to_numpy(zero_copy_only=False) for c in (x, y))
            xo, yo = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in (x, y))
            links = []
            for k in range(batch.num_rows):
                a, b = xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]]
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
                links.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield batch.filter(pa.array(links, pa.bool_())).select([0, 1])

    x, y = (sets.select(F.col("cls").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "a_hashes", "b_hashes")
    return both.mapInArrow(run, "a long, b long")


def _components(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked with another class."""
    bands = classes.select("cls", "n", F.explode("bands").alias("x")).select("cls", "n", "x.*")
    rows = stage(tiles(bands), "tiles")
    members = rows.select("cls").distinct()
    signatures = stage(bands.drop("vals").join(members, "cls", "left_semi"), "signatures")
    sets = stage(_whole_sets(texts, classes.select("cls", "least_id", "digest").join(members, "cls", "left_semi")), "sets")
    labelled, links = rows.withColumn("label", F.col("cls")), None
    for turn in range(STAR_ROUNDS + 1):
        pairs = _star(labelled, signatures, turn) if turn < STAR_ROUNDS else _compared(_sub_tiles(labelled, signatures))
        new = stage(_linked(stage(pairs, "pairs"), sets), "links")
        links = new if links is None else links.unionByName(new)
        if turn < STAR_ROUNDS:
            known = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("label"))
            labelled = stage(rows.join(known, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    return connected_components(links)


def similar_components(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id.

    ``component_id`` is the smallest id that links of ``PERCENT`` per cent similarity reach. Words are split at
    ASCII white space with A-Z in lower case; a document of fewer than three words is one shingle, and a null or
    empty one is linked with nothing. Repeated rows, and different texts under one id, are compared like any
    others, so an id has as many rows as before. Rows without an id are compared with nothing and have no
    component. An empty table gives no rows; other columns are not read.
    """
    ship(df.sparkSession)
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_"))
    rows = stage(_sets(texts), "shingled")
    classes = rows.filter("n > 0 and id_ is not null").groupBy("digest").agg(
        F.min("id_").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    # Several texts may share an id, so classes are numbered; the written table fixes the numbers.
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    labels = _components(texts, classes)
    placed = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        "digest", "least_id", F.coalesce("component", "cls").alias("component")
    )
    placed = stage(placed, "placed")
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_"))
    named = placed.join(least, "component").select(F.col("digest").alias("digest_"), "component_")
    known = F.when((F.col("n") > 0) & F.col("id_").isNotNull(), F.col("component_"))
    result = rows.drop("bands").join(named, F.col("digest") == F.col("digest_"), "left")
    return result.select(F.col("id_").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(known, "id_").alias("component_id"))
