"""Whole scoring runs over a model table or an already compiled model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadence.operators import evaluate as E
from kadence.operators import predict as P
from kadence.operators.chunks import CLASSES_PER_VECTOR
from kadence.operators.compiled import BROADCAST_BYTES, CompiledModel, compile_model
from kadence.sources.staging import stage

Model = DataFrame | CompiledModel


def _compiled(model: Model, structure: DataFrame | None) -> CompiledModel:
    if isinstance(model, CompiledModel):
        return model
    if structure is None:
        raise ValueError("a model table needs its structure table")
    return compile_model(model, structure)


def _chunk_probabilities(rows: DataFrame, compiled: CompiledModel, keep, limit: int, **options) -> DataFrame:
    """Probabilities per row and chunk of the classes. The softmax reads the staged scores twice."""
    scores = stage(P.chunk_log_scores(rows, compiled, keep=keep, limit=limit, **options), "scores", width=CLASSES_PER_VECTOR)
    return P.chunk_probabilities(scores, stage(P.row_masses(scores), "masses"))


def _predict_chunks(rows: DataFrame, compiled: CompiledModel, keep, limit: int, **options) -> DataFrame:
    """(row number, row_id, carried columns, chunk, predicted_class, predicted_prob, names, probs), a row per chunk."""
    probs = _chunk_probabilities(rows, compiled, keep, limit, **options)
    best = stage(P.best_of_chunks(probs, compiled), "best").withColumnRenamed(P.ROW_KEY, "__row")
    found = probs.join(best, F.col(P.ROW_KEY) == F.col("__row")).drop("__row")
    return P.chunk_names(found, compiled, limit)


def _probabilities(rows, compiled, keep, include_prior, backoff, plan, limit) -> DataFrame:
    scores = P.class_log_scores(
        rows, compiled, keep=keep, include_prior=include_prior, backoff=backoff, plan=plan, limit=limit
    )
    return P.normalise_log_scores(scores, compiled)


def predict_proba(
    df: DataFrame,
    model: Model,
    structure: DataFrame | None = None,
    *,
    id_col: str | None = None,
    keep: Sequence[str] = (),
    include_prior: bool = True,
    backoff: str = "pair",
    plan: str = "auto",
    limit: int = BROADCAST_BYTES,
    **encoding,
) -> DataFrame:
    """(row_id, class, prob) for every row and class."""
    compiled = _compiled(model, structure)
    rows = P.scoring_rows(df, compiled.net, id_col, keep, **encoding)
    if compiled.chunks:
        probs = _chunk_probabilities(rows, compiled, keep, limit, include_prior=include_prior, backoff=backoff, plan=plan)
        entries = F.arrays_zip(F.col("names").alias("class"), F.col("probs").alias("prob"))
        return P.chunk_names(probs, compiled, limit).select(P.ROW_ID, *keep, F.inline(entries))
    probs = _probabilities(rows, compiled, keep, include_prior, backoff, plan, limit)
    return P.by_class(probs, compiled, "probs", "prob", keep)


def predict_classes(
    df: DataFrame,
    model: Model,
    structure: DataFrame | None = None,
    *,
    id_col: str | None = None,
    keep: Sequence[str] = (),
    include_prior: bool = True,
    backoff: str = "pair",
    plan: str = "auto",
    limit: int = BROADCAST_BYTES,
    **encoding,
) -> DataFrame:
    """(row_id, predicted_class, predicted_prob, class_probs) for every row."""
    compiled = _compiled(model, structure)
    rows = P.scoring_rows(df, compiled.net, id_col, keep, **encoding)
    return _predict_rows(rows, compiled, keep, include_prior, backoff, plan, limit)


def _predict_rows(rows, compiled, keep, include_prior, backoff, plan, limit) -> DataFrame:
    if not compiled.chunks:
        return P.predict_class(_probabilities(rows, compiled, keep, include_prior, backoff, plan, limit), compiled, keep)
    found = _predict_chunks(rows, compiled, keep, limit, include_prior=include_prior, backoff=backoff, plan=plan)
    whole = [P.ROW_ID, *keep, "predicted_class", "predicted_prob"]
    found = P.whole_vectors(found, [P.ROW_KEY, *whole], ["names", "probs"])
    return found.select(*whole, F.map_from_arrays("names", "probs").alias("class_probs"))


def predict_profiles(
    df: DataFrame,
    model: Model,
    structure: DataFrame | None = None,
    *,
    id_col: str | None = None,
    keep: Sequence[str] = (),
    include_prior: bool = True,
    backoff: str = "pair",
    plan: str = "auto",
    limit: int = BROADCAST_BYTES,
    in_parts: bool = False,
    **encoding,
) -> tuple[DataFrame, DataFrame]:
    """Predictions per profile, and (row_id, profile_id) of every row.

    A profile is a distinct combination of the model's attributes; rows that share one have the same result. The first
    table is that of ``predict_classes`` by ``profile_id``. With many classes the profiles are scored once, and what is
    derived from their probabilities can be joined to the rows without a vector of classes per row. Without the prior,
    profiles that match nothing have no prediction.

    With ``in_parts`` a profile of a model in chunks has a row per chunk: each with the prediction out of all classes,
    and ``class_probs`` of the chunk's classes. So no row holds a number for every class.
    """
    compiled = _compiled(model, structure)
    rows = P.scoring_rows(df, compiled.net, id_col, keep, **encoding)
    profiles = stage(P.distinct_profiles(rows, compiled.net), "profiles")
    if in_parts and compiled.chunks:
        found = _predict_chunks(profiles, compiled, (), limit, include_prior=include_prior, backoff=backoff, plan=plan)
        class_probs = F.map_from_arrays("names", "probs").alias("class_probs")
        predicted = found.select(P.ROW_ID, "predicted_class", "predicted_prob", class_probs)
    else:
        predicted = _predict_rows(profiles, compiled, (), include_prior, backoff, plan, limit)
    return predicted.withColumnRenamed(P.ROW_ID, "profile_id"), P.profile_of_rows(rows, profiles, compiled.net, keep)


def predict_sample(
    df: DataFrame,
    model: Model,
    structure: DataFrame | None = None,
    *,
    order_by: str,
    n: int = 100,
    **options,
) -> DataFrame:
    """Score the first ``n`` rows by ``order_by`` with the true label beside the result."""
    compiled = _compiled(model, structure)
    sample = df.orderBy(order_by).limit(n)
    return predict_proba(sample, compiled, id_col=order_by, keep=[compiled.net.label], **options)


def loocv(
    df: DataFrame,
    model: Model,
    structure: DataFrame | None = None,
    *,
    id_col: str | None = None,
    joint: bool = False,
    include_prior: bool = True,
    limit: int = BROADCAST_BYTES,
    **encoding,
) -> DataFrame:
    """Leave-one-out log scores of the training rows for every class and k."""
    compiled = _compiled(model, structure)
    label = compiled.net.label
    rows = P.scoring_rows(df, compiled.net, id_col, [label], **encoding)
    return E.loocv_scores(rows, compiled, label, joint=joint, include_prior=include_prior, limit=limit)
