"""Whole learning runs: structure (pass 1) and parameters (pass 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadence.conventions import DEFAULT_K, NULL_TOKEN
from kadence.functions import measures
from kadence.operators import counts as C
from kadence.operators import star as S
from kadence.operators import structure as T
from kadence.operators.chunks import CLASSES_PER_VECTOR, class_chunks
from kadence.operators.compiled import BROADCAST_BYTES, keep_cells
from kadence.operators.network import Network
from kadence.operators.params import chunked_cells, chunked_model_table, conditional_counts, model_table, prior_counts
from kadence.sources.staging import is_complete, new_stage_path, stage, stage_parts
from kadence.sources.training import TrainingSet, encode_categories


def _at(path: str | None, name: str) -> str | None:
    return f"{path}/{name}" if path else None


def stage_fused(
    ts: TrainingSet,
    name: str,
    path: str | None = None,
    pregroup: bool | str = False,
    skip_pairs: Sequence[tuple[str, str]] = (),
    tile_attrs: int = C.TILE_ATTRS,
    resume: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Attribute and pair counts, staged in one table.

    The diagonal goes to its own partition, so reading the small attribute counts never touches the pair cells.
    Up to ``tile_attrs`` attributes take one scan. More are counted tile by tile, each a job of its own that reads its
    columns only and is written before the next begins; ``resume`` keeps the tiles an earlier run wrote to ``path``.
    """
    if resume and path is None:
        raise ValueError("only a run with a path of its own can be resumed")

    def split(fused: DataFrame) -> DataFrame:
        return fused.withColumn("pair", (F.col("attr_num1") != F.col("attr_num2")).cast("int"))

    def part(tile: tuple[Sequence[str], Sequence[str]]) -> Callable[[], DataFrame]:
        return lambda: split(C.tile_counts(ts, tile, pregroup, skip_pairs))

    tiles = C.column_tiles(ts, tile_attrs)
    if len(tiles) == 1:
        fused = stage(part(tiles[0])(), name, path, partition_by=["pair"])
    else:
        described = repr((ts.label, ts.attrs, ts.attr_nums, ts.null_policy, tile_attrs, sorted(skip_pairs)))
        layout = hashlib.sha256(described.encode()).hexdigest()[:16]
        path = path or new_stage_path(ts.df.sparkSession, name)
        parts = [part(tile) for tile in tiles]
        fused = stage_parts(parts, name, path, layout, partition_by=["pair"], resume=resume).drop("part")
    return C.xy_of(fused.filter(F.col("pair") == 0)), fused.filter(F.col("pair") == 1).drop("pair")


def stage_counts(
    ts: TrainingSet,
    with_pairs: bool = True,
    pregroup: bool | str = False,
    path: str | None = None,
    tile_attrs: int = C.TILE_ATTRS,
    resume: bool = False,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The training rows as staged xy and pair counts, and n(class), by ``stage_fused``.

    ``path`` is overwritten, but for the tiles that ``resume`` keeps.
    """
    if not ts.attrs:
        raise ValueError("no attributes besides the label")
    if with_pairs:
        xy, pairs = stage_fused(ts, "counts", _at(path, "counts"), pregroup, (), tile_attrs, resume)
    else:
        # One line per attribute is too little to merge rows for, unless asked.
        xy = stage(C.attr_class_counts(ts, pregroup is True), "counts", _at(path, "counts"))
        pairs = None
    return xy, pairs, _stage_classes(xy, ts.attr_nums[0], path)


def _stage_classes(xy: DataFrame, attr_num: int, path: str | None) -> DataFrame:
    """n(class), one row per class, kept apart because every measure reads it."""
    return stage(C.class_counts_of(xy, attr_num).coalesce(1), "classes", _at(path, "classes"))


def learn_structure(
    df: DataFrame,
    label: str,
    k: int = DEFAULT_K,
    *,
    null_policy: str = "category",
    null_token: str = NULL_TOKEN,
    empty_as_null: bool = False,
    exclude: Sequence[str] = (),
    pregroup: bool | str = False,
    tile_attrs: int = C.TILE_ATTRS,
    stage_path: str | None = None,
    resume: bool = False,
) -> DataFrame:
    """The structure table of a k-dependence network over a flat table.

    A table with more than ``tile_attrs`` attributes is counted in tiles of columns. If such a run is ended, the
    same call with ``resume`` and the same ``stage_path`` counts only the tiles that are missing.
    """
    ts = encode_categories(
        df.drop(*exclude), label, null_policy=null_policy, null_token=null_token, empty_as_null=empty_as_null
    )
    xy, pairs, y = stage_counts(ts, k > 0, pregroup, stage_path, tile_attrs, resume)
    structure = structure_of(xy, pairs, y, k, ts.names, ts.label, ts.label_num, complete=ts.complete)
    return stage(structure.coalesce(1), "structure", _at(stage_path, "structure"))


def structure_of(
    xy: DataFrame,
    pairs: DataFrame | None,
    y: DataFrame,
    k: int,
    names: dict[int, str],
    label: str,
    label_num: int,
    complete: bool,
) -> DataFrame:
    """Structure from count tables; ``complete`` counts take the join-free measures."""
    if complete:
        terms = stage(measures.attribute_terms(xy).coalesce(1), "terms")
        mi, sizes = measures.mutual_information_complete(terms, y), terms.select("attr_num", "num_values")
    else:
        mi, sizes = measures.mutual_information(xy, y), C.domain_sizes(xy)
    ranked = T.rank_attributes(mi)
    if k == 0:
        return T.naive_structure(ranked, sizes, y, names, label, label_num)
    if complete:
        cmi = measures.conditional_mutual_information_complete(pairs, terms, y)
    else:
        cmi = measures.conditional_mutual_information(pairs, xy, y)
    return T.assemble_structure(ranked, T.select_parents(ranked, cmi, k), sizes, y, names, label, label_num)


def plan_star(
    star: S.StarSet, plan: str = "auto", sketches: DataFrame | None = None
) -> tuple[S.StarSet, set[tuple[int, int]]]:
    """Choose how each dimension is counted; the fact is not read for it.

    ``factorised`` joins dimensions to counts of the fact only, or to its rows
    if keys hardly repeat. ``joined`` joins them all to the fact. ``auto`` decides per dimension by how often keys repeat, as far as
    ``sketches`` of an earlier count or, without them, the sizes of the tables
    tell. Of two dimensions whose keys hardly repeat together one is joined.
    Without the 'category' null policy every dimension is counted by key, and
    such pairs over joined rows.
    """
    moved, flat = _star_choice(star, plan, sketches)
    return (S.join_dimensions(star, moved) if moved else star), flat


def _star_choice(star: S.StarSet, plan: str, sketches: DataFrame | None) -> tuple[list[int], set[tuple[int, int]]]:
    """Dimensions to join, and pairs of the others to count over joined rows."""
    if plan not in ("auto", "factorised", "joined"):
        raise ValueError(f"unknown star plan {plan!r}")
    if plan == "joined":
        return list(range(len(star.dims))), set()
    if plan == "factorised":
        return [], set()
    n_rows, per_key, per_pair = S.key_statistics(star, sketches)
    joinable = star.fact.complete
    by_key = [i for i, d in enumerate(star.dims) if not joinable or S.counted_by_key(d, n_rows, per_key[i])]
    apart = {
        pair
        for pair, distinct in per_pair.items()
        if set(pair) <= set(by_key) and n_rows < S.ROWS_PER_KEY_PAIR * distinct
    }
    while joinable and apart:
        # The dimension that settles most pairs, then the one that adds the fewest columns.
        first = max(by_key, key=lambda i: (sum(i in pair for pair in apart), -len(star.dims[i].attrs)))
        by_key.remove(first)
        apart = {pair for pair in apart if first not in pair}
    return [i for i in range(len(star.dims)) if i not in by_key], apart


def stage_star_counts(
    star: S.StarSet,
    with_pairs: bool = True,
    plan: str = "auto",
    path: str | None = None,
    sketches: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Staged xy and pair counts of a whole star, unused keys removed, and n(class).

    The fact table is scanned once for the counts; dimensions counted by key are
    joined to those counts, never to the fact rows. A run with a ``path`` takes
    sketches of its keys in the same scan and leaves them there, where the next
    run's ``auto`` finds them unless it is given others.
    """
    S.check_unique_keys(star)
    kept = _at(path, "key_sketches")
    if sketches is None and plan == "auto" and kept and is_complete(star.fact.df.sparkSession, kept):
        sketches = star.fact.df.sparkSession.read.schema(S.SKETCHES).parquet(kept)
    moved, flat = _star_choice(star, plan, sketches)
    watched, taken = S.watch_keys(star) if kept else (star, None)
    if with_pairs and plan == "factorised" and star.dims and star.fact_attr_nums and not S.keys_repeat(star, sketches):
        rows = S.star_fused_counts(watched).withColumn("pair", (F.col("attr_num1") != F.col("attr_num2")).cast("int"))
        fused = stage(rows, "star_counts", _at(path, "star_counts"), partition_by=["pair"])
        xy = C.xy_of(fused.filter(F.col("pair") == 0))
        y = _stage_classes(xy, star.fact_attr_nums[0], path)
        if taken is not None and not y.isEmpty():
            stage(S.taken_sketches(taken, y), "key_sketches", kept)
        return xy, fused.filter(F.col("pair") == 1).drop("pair"), y
    star, watched = (S.join_dimensions(x, moved) if moved else x for x in (star, watched))
    fact = watched.fact
    if with_pairs:
        keys = {d.fk for d in star.dims if d.key_is_attr}
        skip = [(star.dims[i].fk, star.dims[j].fk) for i, j in flat]
        skip = [(a, b) for a, b in skip if a != b and not keys.issuperset((a, b))]
        fact_xy, fact_pairs = stage_fused(fact, "fact", _at(path, "fact"), skip_pairs=skip)
    else:
        fact_xy, fact_pairs = stage(C.attr_class_counts(fact), "fact", _at(path, "fact")), None
    y = _stage_classes(fact_xy, fact.attr_nums[0], path)
    # Spark answers a job over no rows without running it, so nothing is watched then.
    if taken is not None and not y.isEmpty():
        stage(S.taken_sketches(taken, y), "key_sketches", kept)
    if fact.complete:
        # Only columns moved in from a dimension can be null here.
        fact_xy = fact_xy.filter(F.col("attr_value").isNotNull())
        if with_pairs:
            fact_pairs = fact_pairs.filter(F.col("attr_value1").isNotNull() & F.col("attr_value2").isNotNull())
    if not star.dims:
        return fact_xy, fact_pairs, y
    xy = fact_xy.unionByName(S.star_attr_counts(star, fact_xy))
    xy = stage(C.drop_key_attributes(xy, star.dropped_keys), "star_xy", _at(path, "star_xy"))
    if not with_pairs:
        return xy, None, y
    pairs = fact_pairs.unionByName(S.star_pair_counts(star, fact_xy, fact_pairs, flat))
    pairs = stage(C.drop_key_attributes(pairs, star.dropped_keys), "star_pairs", _at(path, "star_pairs"))
    return xy, pairs, y


def learn_structure_star(
    fact: DataFrame,
    label: str,
    dims: Sequence[S.Dim],
    k: int = DEFAULT_K,
    *,
    fact_name: str = "fact",
    null_policy: str = "category",
    null_token: str = NULL_TOKEN,
    empty_as_null: bool = False,
    plan: str = "auto",
    check_keys: bool = False,
    stage_path: str | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """The structure table over a star; see ``plan_star`` for how it is counted.

    Fact rows that point at missing dimension rows still count for fact
    attributes. Whether there are any shows in the staged counts; if so, the
    measures use the general plan, which does not need the counts to be
    consistent. ``check_keys`` makes it an error. A dimension with several rows
    of one key is an error in every plan. ``sketches`` (``key_sketches``, of one
    or more parts of the fact) inform the ``auto`` plan.
    """
    star = S.encode_star(
        fact,
        label,
        dims,
        fact_name=fact_name,
        null_policy=null_policy,
        null_token=null_token,
        empty_as_null=empty_as_null,
    )
    xy, pairs, y = stage_star_counts(star, k > 0, plan, stage_path, sketches)
    lost = []
    if star.fact.complete:
        # One row per dimension.
        lost = S.lost_rows(star, xy, y).filter("orphan_rows > 0").collect()
    elif check_keys:
        lost = S.orphan_keys(star, C.attr_class_counts(_keys_only(star))).filter("orphan_rows > 0").collect()
    if check_keys and lost:
        raise ValueError("fact rows without a dimension row: " + ", ".join(f"{r.table_name} {r.orphan_rows}" for r in lost))
    complete = star.fact.complete and not lost
    names = {n: a for n, a in star.names.items() if n not in star.dropped_keys}
    structure = structure_of(xy, pairs, y, k, names, star.fact.label, star.fact.label_num, complete)
    return stage(S.star_structure(structure, star).coalesce(1), "structure", _at(stage_path, "structure"))


def _keys_only(star: S.StarSet) -> TrainingSet:
    """The fact's foreign keys as a training set of their own."""
    fks = list(dict.fromkeys(d.fk for d in star.dims))
    fact = star.fact
    return TrainingSet(
        fact.df.select(F.col(f"`{fact.label}`"), *[F.col(f"`{c}`") for c in fks]),
        fact.label,
        fact.label_num,
        tuple(fks),
        tuple(fact.num_of(c) for c in fks),
        fact.null_policy,
    )


def learn_parameters(
    df: DataFrame,
    structure: DataFrame,
    *,
    fill: str = "sparse",
    null_policy: str = "category",
    null_token: str = NULL_TOKEN,
    empty_as_null: bool = False,
    pregroup: bool | str = False,
    stage_path: str | None = None,
) -> DataFrame:
    """The model table for a structure, from one scan of the used columns.

    With more classes than a vector holds, the cells are staged as vectors by chunk of the classes; the table's rows
    are read out of these and ``compile_model`` takes the vectors. A named ``stage_path`` gets the rows themselves.
    """
    net = Network.from_structure(structure)
    used = [F.col(f"`{c}`") for c in (*[n.name for n in net.nodes], net.label)]
    ts = encode_categories(
        df.select(*used), net.label, null_policy=null_policy, null_token=null_token, empty_as_null=empty_as_null
    )
    counts = stage(conditional_counts(ts, net, pregroup), "conditional", _at(stage_path, "conditional"))
    chunks = class_chunks(prior_counts(counts))
    if chunks is None:
        return stage(model_table(counts, net, fill), "model", _at(stage_path, "model"))
    cells = stage(chunked_cells(counts, net, chunks, fill), "model_cells", width=CLASSES_PER_VECTOR)
    rows = chunked_model_table(cells, net, chunks, BROADCAST_BYTES)
    return stage(rows, "model", _at(stage_path, "model")) if stage_path else keep_cells(rows, cells, chunks)


def learn_parameters_star(
    fact: DataFrame, label: str, dims: Sequence[S.Dim], structure: DataFrame, *, fact_name: str = "fact", **options
) -> DataFrame:
    """The model table over a star: the used columns joined once, then counted."""
    encoding = {k: options[k] for k in ("null_policy", "null_token", "empty_as_null") if k in options}
    star = S.encode_star(fact, label, dims, fact_name=fact_name, **encoding)
    S.check_unique_keys(star)
    net = Network.from_structure(structure)
    return learn_parameters(S.star_join(star, net), structure, **options)
