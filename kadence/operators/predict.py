"""Scoring rows with a compiled model.

A lookup of the nested model answers all levels of a value; ``path`` backoff takes
one more. Two physical plans with the same result:

* ``rowwise`` - every attribute looks its cells up in one broadcast table, and the
  class vectors add up within the row. Nothing is shuffled. Used when the model
  fits the broadcast limit by its measured size and is not too wide.
* ``evidence`` - rows unpivot to (row, attribute) evidence that is joined to the
  nested model by key and summed per row. Rows are summed under a number of their
  own, so ids may repeat. Classes are summed in columns of a chunk, so the plan is
  the same for any number of them.

A model in chunks of classes is scored chunk by chunk under either plan: a row is there once per chunk, with the
vectors of that chunk, from the lookup to its probabilities (``chunk_log_scores`` and what follows it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.conventions import NULL_TOKEN, parent_columns
from kadence.functions.probability import m_estimate, normalise_vector
from kadence.operators.chunks import CHUNK, whole_vectors
from kadence.operators.compiled import BROADCAST_BYTES, CompiledModel, bucket_count, bucket_of, cell_buckets, path_buckets, path_of
from kadence.operators.network import Network
from kadence.operators.params import evidence_struct
from kadence.sources.training import category

ROW_ID = "row_id"

# One number per input row, within a plan; the caller's ids may repeat.
ROW_KEY = "row_key_"

# Decimal places to which probabilities are compared.
TIE_PLACES = 12

# Most lookups the rowwise plan chains in one stage; wider networks unpivot.
MAX_ROW_LOOKUPS = 60

# Classes that are summed in columns of one row; further ones take further rows.
CLASS_CHUNK = 64


def with_row_id(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """The caller's id column as ``row_id``, else a generated number.

    Generated numbers are unique but not dense.
    """
    value = F.col(f"`{id_col}`") if id_col else F.monotonically_increasing_id()
    return df.withColumn(ROW_ID, value)


def _slot(net: Network, name: str) -> str:
    """Internal column of an attribute, free of clashes with carried columns."""
    return "value_" + str(next(n.attr_num for n in net.nodes if n.name == name))


def scoring_rows(
    df: DataFrame,
    net: Network,
    id_col: str | None = None,
    keep: Sequence[str] = (),
    null_policy: str = "category",
    null_token: str = NULL_TOKEN,
    empty_as_null: bool = False,
) -> DataFrame:
    """Row id, carried columns and one encoded column per model attribute.

    Attributes are matched by name, in any order. One the input lacks is null:
    it gives no evidence and ends the parent prefix where it is a parent.
    """
    present = {c.lower(): c for c in df.columns}
    values = []
    for node in net.nodes:
        if node.name.lower() in present:
            value = category(df, present[node.name.lower()], null_policy, null_token, empty_as_null)
        else:
            value = F.lit(None).cast("string")
        values.append(value.alias(_slot(net, node.name)))
    ids = with_row_id(df, id_col)
    return ids.select(ROW_ID, *[F.col(f"`{c}`") for c in keep], *values)


def distinct_profiles(rows: DataFrame, net: Network) -> DataFrame:
    """One row per distinct combination of the model's attributes in ``scoring_rows``; its ``row_id`` is a number.

    The numbers are given anew on each run, so stage the profiles before they are used twice.
    """
    slots = [_slot(net, n.name) for n in net.nodes]
    found = rows.select(F.lit(0).alias("one"), *slots).distinct().select(*slots)
    return found.select(F.monotonically_increasing_id().alias(ROW_ID), *slots)


def profile_of_rows(rows: DataFrame, profiles: DataFrame, net: Network, keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, carried columns, profile_id): the profile of every row."""
    slots = [_slot(net, n.name) for n in net.nodes]
    right = profiles.select(F.col(ROW_ID).alias("profile_id"), *[F.col(c).alias(f"__{c}") for c in slots])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in slots] or [F.lit(True)]
    return rows.join(right, same).select(ROW_ID, *[F.col(f"`{c}`") for c in keep], "profile_id")


def rows_to_evidence(rows: DataFrame, net: Network, keep: Sequence[str] = (), drop_null: bool = True) -> DataFrame:
    """One line per row and attribute: (row, attr_num, level, value, parent values).

    Without ``drop_null`` the top-ranked attribute stays even if it is null, so
    that a row without any evidence is still there to receive the prior.
    """
    structs = [evidence_struct(n, net.k, lambda c: F.col(_slot(net, c)), complete=False) for n in net.nodes]
    lines = rows.select(ROW_ID, *keep, F.explode(F.array(*structs)).alias("e")).select(ROW_ID, *keep, "e.*")
    has_value = F.col("attr_value").isNotNull()
    if not drop_null and net.nodes:
        has_value = has_value | (F.col("attr_num") == net.nodes[0].attr_num)
    return lines.filter(has_value)


def _look_up(df: DataFrame, keys: dict[str, Column], table: DataFrame, columns: dict[str, str], small: bool) -> DataFrame:
    """Left equi-join of a lookup table; ``keys`` maps its key columns to values of ``df``.

    A null value never matches.
    """
    right = table.select(
        *[F.col(c).alias(f"__{c}") for c in keys], *[F.col(c).alias(out) for c, out in columns.items()]
    )
    if small:
        right = F.broadcast(right)
    same = [value == F.col(f"__{c}") for c, value in keys.items()]
    return df.join(right, same, "left").drop(*[f"__{c}" for c in keys])


def _per_chunk(rows: DataFrame, model: CompiledModel) -> DataFrame:
    """Each row once per chunk of the model's classes."""
    return rows.withColumn(CHUNK, F.explode(F.lit(list(model.chunks.ids)))) if model.chunks else rows


def _chunk_keys(model: CompiledModel) -> dict[str, Column]:
    return {CHUNK: F.col(CHUNK)} if model.chunks else {}


def _found(path: str, k: int, columns: dict[str, str], first: int) -> dict[str, Column]:
    """Vectors of every level from ``first`` on, by the place of the line's own parents among a nested row's paths."""
    out = {}
    for level in range(first, k + 1):
        place = F.array_position(path, path_of(k, level))
        for column, name in columns.items():
            out[f"{name}_{level}"] = F.when(place > 0, F.get(column, (place - 1).cast("int")))
    return out


def match_with_backoff(
    evidence: DataFrame,
    model: CompiledModel,
    columns: Sequence[str] = ("log_prob",),
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Attach every matching level's cell to each evidence line.

    Adds ``<column>_<level>`` for levels 0..k, null where the level has no such
    cell. One equi-join on the value and the bucket of the first parent. Vectors
    are those of all classes, or of the line's chunk if the evidence comes per chunk.
    """
    num = F.col("attr_num")
    keys = {"attr_num": num, "attr_value": F.col("attr_value"), "bucket": bucket_of(bucket_count(cell_buckets(model.cell_sizes), num), model.k)}
    held = {c: f"nested_{c}" for c in ("path", *columns)}
    chunked = CHUNK in evidence.columns
    nested = model.nested if chunked else model.whole_nested()
    lines = _look_up(evidence, keys | (_chunk_keys(model) if chunked else {}), nested, held, model.nested_bytes(len(columns)) <= limit)
    found = _found("nested_path", model.k, {f"nested_{c}": c for c in columns}, 0)
    return lines.select(*evidence.columns, *[v.alias(c) for c, v in found.items()])


def match_paths(lines: DataFrame, model: CompiledModel, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Attach ``zero_<level>`` for levels 1..k: the vector of a value never seen under the line's parents, if these were."""
    if not model.k:
        return lines
    num = F.col("attr_num")
    bucket = bucket_of(bucket_count(path_buckets(model.path_sizes), num), model.k)
    # A line without parents has no path to look for.
    keys = {"attr_num": num, "bucket": F.when(F.col("parent1").isNotNull(), bucket)} | _chunk_keys(model)
    held = {"path": "nested_path", "zero_log_prob": "nested_zero"}
    found = _look_up(lines, keys, model.nested_paths, held, model.path_bytes() <= limit)
    zeros = _found("nested_path", model.k, {"nested_zero": "zero"}, 1)
    return found.select(*lines.columns, *[v.alias(c) for c, v in zeros.items()])


def matched_levels(matches: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """Long form of the matches: one line per (row, attribute, matched level)."""
    per_level = [
        F.struct(F.lit(level).alias("level"), *[F.col(f"{c}_{level}").alias(c) for c in columns])
        for level in range(k + 1)
    ]
    found = F.filter(F.array(*per_level), lambda m: m[columns[0]].isNotNull())
    return matches.select(ROW_ID, "attr_num", F.explode(found).alias("m")).select(ROW_ID, "attr_num", "m.*")


def deepest_match(matches: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """Only the deepest matched level of each (row, attribute)."""
    levels = range(k, -1, -1)
    level = F.coalesce(*[F.when(F.col(f"{columns[0]}_{i}").isNotNull(), F.lit(i)) for i in levels])
    best = [F.coalesce(*[F.col(f"{c}_{i}") for i in levels]).alias(c) for c in columns]
    return matches.select(ROW_ID, "attr_num", level.alias("level"), *best).filter(F.col("level").isNotNull())


def _deepest_vector(cells: Sequence[str], zeros: Sequence[str | None], backoff: str) -> Column:
    """The class vector an attribute contributes, from per-level lookups.

    ``pair``: the deepest level where the value was seen with these parents.
    ``path``: the deepest level where the parents were seen, with count zero
    for a value that was not; a value unknown to the domain is skipped.
    """
    if backoff == "pair":
        return F.coalesce(*[F.col(c) for c in reversed(cells)])
    order = [F.col(cells[0])]
    for cell, zero in zip(cells[1:], zeros[1:]):
        order = [F.col(cell), F.col(zero), *order]
    return F.when(F.col(cells[0]).isNotNull(), F.coalesce(*order))


def chunk_rows(lines: DataFrame, vectors: Sequence[str], classes: int, width: int) -> DataFrame:
    """A row per line and chunk of ``width`` classes; ``chunk`` is its number, vectors hold the chunk's entries.

    Vectors are cut before the line is repeated, so no chunk's row carries a whole vector.
    """
    if classes <= width:
        return lines.withColumn("chunk", F.lit(0))
    chunks = F.sequence(F.lit(0), F.lit((classes - 1) // width))
    cut = lambda c: F.struct(c.alias("chunk"), *[F.slice(v, c * width + 1, width).alias(v) for v in vectors])
    carried = [c for c in lines.columns if c not in vectors]
    return lines.select(*[F.col(f"`{c}`") for c in carried], F.inline(F.transform(chunks, cut)))


def _scores_by_evidence(rows: DataFrame, model: CompiledModel, keep: Sequence[str], backoff: str, limit: int) -> DataFrame:
    k = model.k
    carried = [ROW_KEY, *keep]
    lines = _per_chunk(rows_to_evidence(rows, model.net, carried, drop_null=False), model)
    lines = match_with_backoff(lines, model, ["log_prob"], limit)
    if backoff == "path":
        lines = match_paths(lines, model, limit)
    levels = range(k + 1)
    best = _deepest_vector([f"log_prob_{i}" for i in levels], [f"zero_{i}" for i in levels], backoff)
    # Ids and carried columns are grouping keys: as aggregates, texts would need a sort.
    if model.chunks:
        found = lines.groupBy(ROW_ID, *carried, CHUNK).agg(F.collect_list(best).alias("vectors"))
        sums = _sum_of("vectors", F.array_repeat(F.lit(0.0), F.size(F.get("vectors", F.lit(0)))))
        return found.select(ROW_ID, *carried, CHUNK, sums.alias("scores"), F.size("vectors").cast("bigint").alias("matched"))
    lines = chunk_rows(lines.select(ROW_ID, *carried, best.alias("best")), ["best"], model.num_classes, CLASS_CHUNK)
    width = min(CLASS_CHUNK, model.num_classes)
    sums = [F.sum(F.coalesce(F.get("best", F.lit(i)), F.lit(0.0))).alias(f"sum_{i}") for i in range(width)]
    totals = lines.groupBy(ROW_ID, *carried, "chunk").agg(*sums, F.count("best").alias("matched"))
    scores = F.array(*[F.col(f"sum_{i}") for i in range(width)])
    if model.num_classes <= CLASS_CHUNK:
        return totals.select(ROW_ID, *carried, scores.alias("scores"), "matched")
    parts = F.array_sort(F.collect_list(F.struct("chunk", scores.alias("part"))))
    whole = totals.groupBy(ROW_ID, *carried).agg(parts.alias("parts"), F.max("matched").alias("matched"))
    flat = F.slice(F.flatten(F.col("parts.part")), 1, model.num_classes)
    return whole.select(ROW_ID, *carried, flat.alias("scores"), "matched")


def _sum_of(vectors: str, nothing: Column) -> Column:
    return F.aggregate(vectors, nothing, lambda total, v: F.zip_with(total, v, lambda a, b: a + b))


def _scores_by_row(rows: DataFrame, model: CompiledModel, keep: Sequence[str], backoff: str) -> DataFrame:
    net = model.net
    slots = [_slot(net, n.name) for n in net.nodes]
    counts = cell_buckets(model.cell_sizes), path_buckets(model.path_sizes)
    vectors = [f"vector_{n.attr_num}" for n in net.nodes]
    ids = [*([ROW_KEY] if model.chunks else []), *keep, *_chunk_keys(model)]
    df = _per_chunk(rows, model).select(ROW_ID, *ids, *slots)
    for node, vector in zip(net.nodes, vectors):
        carried, k = df.columns, len(node.parents)
        bound = {c: F.col(_slot(net, p)) for c, p in zip(parent_columns(k), node.parents)}
        df = df.withColumns(bound) if bound else df
        own = F.col("attr_num") == node.attr_num
        keys = {"attr_value": F.col(_slot(net, node.name)), "bucket": bucket_of(F.lit(counts[0].get(node.attr_num, 1)), k)} | _chunk_keys(model)
        df = _look_up(df, keys, model.nested.filter(own), {"path": "nested_path", "log_prob": "nested_cell"}, small=True)
        found = _found("nested_path", k, {"nested_cell": "cell"}, 0)
        if backoff == "path" and k:
            keys = {"bucket": F.when(F.col("parent1").isNotNull(), bucket_of(F.lit(counts[1].get(node.attr_num, 1)), k))} | _chunk_keys(model)
            df = _look_up(df, keys, model.nested_paths.filter(own), {"path": "nested_way", "zero_log_prob": "nested_zero"}, small=True)
            found |= _found("nested_way", k, {"nested_zero": "zero"}, 1)
        df = df.select(*carried, *[v.alias(c) for c, v in found.items()])
        best = _deepest_vector([f"cell_{i}" for i in range(k + 1)], [f"zero_{i}" for i in range(k + 1)], backoff)
        df = df.select(*carried, best.alias(vector))
    matched = F.filter(F.array(*[F.col(v) for v in vectors]).cast("array<array<double>>"), lambda v: v.isNotNull())
    df = df.select(ROW_ID, *ids, matched.alias("vectors"))
    size = F.size(F.get("vectors", F.lit(0))) if model.chunks else F.lit(model.num_classes)
    sums = _sum_of("vectors", F.array_repeat(F.lit(0.0), size))
    return df.select(ROW_ID, *ids, sums.alias("scores"), F.size("vectors").cast("bigint").alias("matched"))


def _matched_scores(rows: DataFrame, model: CompiledModel, keep, backoff: str, plan: str, limit: int) -> DataFrame:
    """Sums without the prior and the number of matched attributes, per row and, in a model of chunks, per chunk."""
    if backoff not in ("pair", "path"):
        raise ValueError(f"unknown backoff {backoff!r}")
    if plan == "auto":
        size = model.nested_bytes() + (model.path_bytes() if backoff == "path" else 0)
        chain = sum(1 + (backoff == "path" and bool(n.parents)) for n in model.net.nodes)
        plan = "rowwise" if size <= limit and chain <= MAX_ROW_LOOKUPS else "evidence"
    if plan == "evidence" or model.chunks:
        rows = rows.withColumn(ROW_KEY, F.monotonically_increasing_id())
    if plan == "rowwise":
        return _scores_by_row(rows, model, keep, backoff)
    if plan == "evidence":
        return _scores_by_evidence(rows, model, keep, backoff, limit)
    raise ValueError(f"unknown plan {plan!r}")


def class_log_scores(
    rows: DataFrame,
    model: CompiledModel,
    *,
    keep: Sequence[str] = (),
    include_prior: bool = True,
    backoff: str = "pair",
    plan: str = "auto",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Sum of log probabilities per row, as an array ``scores`` in the order of classes.

    Rows come from ``scoring_rows``. With the prior every row is scored; without
    it a row that matches nothing has no score and is left out.
    """
    if model.chunks:
        scores = chunk_log_scores(rows, model, keep=keep, include_prior=include_prior, backoff=backoff, plan=plan, limit=limit)
        return whole_vectors(scores, [ROW_KEY, ROW_ID, *keep, "matched"], ["scores"]).select(ROW_ID, *keep, "scores", "matched")
    scores = _matched_scores(rows, model, keep, backoff, plan, limit).drop(ROW_KEY)
    if not include_prior:
        return scores.filter(F.col("matched") > 0)
    priors = F.transform("totals_", _log_prior(model))
    added = F.zip_with("scores", priors, lambda a, b: a + b)
    # A column of its own: a lambda may not hold the subquery that many classes are read with.
    return scores.withColumn("totals_", model.class_totals()).withColumn("scores", added).drop("totals_")


def _log_prior(model: CompiledModel):
    total, classes = F.lit(float(model.num_rows)), float(model.num_classes)
    return lambda n: F.log(m_estimate(n.cast("double"), total, classes))


def chunk_log_scores(
    rows: DataFrame,
    model: CompiledModel,
    *,
    keep: Sequence[str] = (),
    include_prior: bool = True,
    backoff: str = "pair",
    plan: str = "auto",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``class_log_scores`` under a number per row, a row per chunk of the model's classes.

    The numbers are given anew on each run, so stage the scores before they are used twice.
    """
    scores = _matched_scores(rows, model, keep, backoff, plan, limit)
    if not include_prior:
        return scores.filter(F.col("matched") > 0)
    scores = _look_up(scores, _chunk_keys(model), model.class_table, {"counts": "totals_"}, 8 * model.num_classes <= limit)
    # A row that matches nothing has no sums.
    priors = F.transform("totals_", _log_prior(model))
    added = F.when(F.col("matched") > 0, F.zip_with("scores", priors, lambda a, b: a + b)).otherwise(priors)
    return scores.withColumn("scores", added).drop("totals_")


def row_masses(scores: DataFrame) -> DataFrame:
    """(row number, peak, mass) of ``chunk_log_scores``: what its softmax needs of all chunks."""
    peak = F.array_max("scores")
    own = scores.select(ROW_KEY, "scores", peak.alias("peak"))
    mass = F.aggregate(F.zip_with("scores", F.array_repeat("peak", F.size("scores")), lambda s, p: F.exp(s - p)), F.lit(0.0), lambda a, b: a + b)
    own = own.select(ROW_KEY, "peak", mass.alias("mass"))
    parts = own.groupBy(ROW_KEY).agg(F.max("peak").alias("peak"), F.collect_list(F.struct("peak", "mass")).alias("parts"))
    each = F.zip_with("parts", F.array_repeat("peak", F.size("parts")), lambda part, p: part["mass"] * F.exp(part["peak"] - p))
    return parts.select(ROW_KEY, "peak", F.aggregate(each, F.lit(0.0), lambda a, b: a + b).alias("mass"))


def chunk_probabilities(scores: DataFrame, masses: DataFrame) -> DataFrame:
    """``probs`` instead of ``scores``, chunk by chunk."""
    masses = masses.withColumnRenamed(ROW_KEY, "__row")
    beside = lambda c: F.array_repeat(c, F.size("scores"))
    weights = F.zip_with("scores", beside("peak"), lambda s, peak: F.exp(s - peak))
    probs = F.zip_with(weights, beside("mass"), lambda w, mass: w / mass)
    found = scores.join(masses, F.col(ROW_KEY) == F.col("__row"))
    return found.select(*[c for c in scores.columns if c not in ("scores", "matched")], probs.alias("probs"))


def chunk_names(df: DataFrame, model: CompiledModel, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``names``: the classes of each row's chunk."""
    return _look_up(df, _chunk_keys(model), model.class_table, {"classes": "names"}, model.chunks.text + 24 * model.num_classes <= limit)


def best_of_chunks(probs: DataFrame, model: CompiledModel) -> DataFrame:
    """(row number, predicted class, its probability) out of all chunks; ties as in ``predict_class``."""
    own = probs.select(ROW_KEY, CHUNK, "probs", F.array_max("probs").alias("peak"))
    # Rounding is slow, and only what is as near to the chunk's highest as this can round to the same.
    near = F.zip_with("probs", F.array_repeat("peak", F.size("probs")), lambda p, peak: F.when(p > peak - 2 * 10.0**-TIE_PLACES, F.round(p, TIE_PLACES)))
    own = own.select(ROW_KEY, CHUNK, "probs", F.round("peak", TIE_PLACES).alias("top"), near.alias("near"))
    own = own.select(ROW_KEY, CHUNK, "probs", "top", F.array_position("near", F.col("top")).cast("int").alias("place"))
    # Chunks are in the order of classes: of equal ones the first has the smallest class.
    found = F.struct("top", (-F.col(CHUNK)).alias("before"), "place", F.element_at("probs", F.col("place")).alias("prob"))
    best = own.select(ROW_KEY, found.alias("found")).groupBy(ROW_KEY).agg(F.max("found").alias("best"))
    best = best.select(ROW_KEY, (-F.col("best.before")).alias("__chunk"), "best.place", F.col("best.prob").alias("predicted_prob"))
    found = best.join(model.class_table, F.col("__chunk") == F.col(CHUNK))
    return found.select(ROW_KEY, F.element_at("classes", F.col("place")).alias("predicted_class"), "predicted_prob")


def normalise_log_scores(scores: DataFrame, model: CompiledModel) -> DataFrame:
    """Softmax of the class scores of each row: ``probs`` instead of ``scores``."""
    carried = [c for c in scores.columns if c != "scores"]
    return scores.select(*carried, normalise_vector(F.col("scores")).alias("probs"))


def by_class(wide: DataFrame, model: CompiledModel, vector: str, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Long form (row, class, value) of a vector over the classes."""
    entries = F.arrays_zip(model.class_names().alias("class"), F.col(vector).alias(name))
    return wide.select(ROW_ID, *keep, F.explode(entries).alias("e")).select(ROW_ID, *keep, F.col("e.class").alias("class"), F.col(f"e.{name}").alias(name))


def predict_class(probs: DataFrame, model: CompiledModel, keep: Sequence[str] = ()) -> DataFrame:
    """Most probable class, its probability and the class -> probability map.

    On a tie the smallest class wins. Probabilities that agree to ``TIE_PLACES``
    places are a tie: sums of the same logs in another order differ in the last bit.
    """
    near = F.transform("probs", lambda p: F.round(p, TIE_PLACES))
    rows = probs.select(ROW_ID, *keep, "probs", near.alias("near"), model.class_names().alias("names"))
    place = F.array_position("near", F.array_max("near")).cast("int")
    return rows.select(
        ROW_ID,
        *keep,
        F.element_at("names", place).alias("predicted_class"),
        F.element_at("probs", place).alias("predicted_prob"),
        F.map_from_arrays("names", "probs").alias("class_probs"),
    )
