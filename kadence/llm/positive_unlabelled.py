"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

Confirmed toxic texts are positives; all other texts, whatever they are, are the
unlabelled ones. With the share of toxic texts among them (the class prior) the
risk of a classifier is estimated from these two samples alone:

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

The second term is the risk on negatives; it is kept from going below zero, where
a model would only be fitting the positives it has seen.

A text's features are the distinct words it holds and their beginnings of four and
five letters. The features that set positives and unlabelled apart most are kept,
a few linear classifiers are trained on resampled data, one per task, and their
mean is the score. Every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadence.llm.batches import slices
from kadence.llm.shipping import ship
from kadence.sources.staging import stage

#: Bounds of the two samples that classifiers are fitted on.
POSITIVES, UNLABELLED = 20_000, 30_000
FEATURES, MIN_DOCS = 2048, 2
#: Standard errors by which a feature's shares in the two samples must differ; less is chance.
LEAST_APART = 3.0
CLASSIFIERS, STEPS, RATE, DECAY = 4, 200, 0.05, 1e-3
#: The prior where no labelled row tells it.
PRIOR = 0.1
BEGINNINGS = (4, 5)
PUNCTUATION = ".,;:!?\"'()[]{}<>-_*«»„“”¡¿"
#: Words whose features a worker remembers.
REMEMBERED = 1_000_000


def word_features(word: str) -> tuple[str, ...]:
    word = word.strip(PUNCTUATION)
    if not word:
        return ()
    return (word, *(f"{word[:k]}~" for k in BEGINNINGS if len(word) >= k))


def text_features(text: str) -> set[str]:
    return {f for word in set(text.lower().split()) for f in word_features(word)}


@dataclass(frozen=True)
class Model:
    """Linear classifiers on shared features; without features every text has the score of ``bias``."""

    features: dict[str, int]
    weights: np.ndarray  # classifiers x features
    bias: np.ndarray

    def scorer(self):
        known: dict[str, tuple[int, ...]] = {}

        def found(word: str) -> tuple[int, ...]:
            if len(known) >= REMEMBERED:
                known.clear()
            at = tuple(self.features[f] for f in word_features(word) if f in self.features)
            known[word] = at
            return at

        def score(text: str) -> float:
            hits: set[int] = set()
            for word in set(text.lower().split()):
                at = known.get(word)
                if at is None:
                    at = found(word)
                if at:
                    hits.update(at)
            margins = self.bias + self.weights[:, sorted(hits)].sum(axis=1)
            return float(np.clip(1 / (1 + np.exp(-np.clip(margins.mean(), -500, 500))), 0.0, 1.0))

        return score


def fit(pos: list[np.ndarray], unl: list[np.ndarray], n_features: int, prior: float, seed: int) -> np.ndarray:
    """Weights and, last, the bias of one classifier. Rows are arrays of feature numbers."""
    draw = np.random.default_rng(seed)
    rows = [pos[i] for i in draw.integers(0, len(pos), len(pos))] + [unl[i] for i in draw.integers(0, len(unl), len(unl))]
    n_pos, n = len(pos), len(rows)
    row_of = np.repeat(np.arange(n), [len(r) for r in rows])
    column_of = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    theta, first, second = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        f = np.bincount(row_of, theta[column_of], n) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        # Derivatives of the logistic losses: l(f) falls with 1 - p, l(-f) rises with p.
        negative_risk = np.logaddexp(0, f[n_pos:]).mean() - prior * np.logaddexp(0, f[:n_pos]).mean()
        g = np.concatenate([-prior * p[:n_pos] / n_pos, p[n_pos:] / (n - n_pos)])
        if negative_risk >= 0:
            g[:n_pos] -= prior * (1 - p[:n_pos]) / n_pos
        else:  # climb out of the overfit part only
            g = -g
        gradient = np.append(np.bincount(column_of, g[row_of], n_features) + DECAY * theta[:-1], g.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, unl): sampled texts of either kind that hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, positive in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[positive].update(text_features(text))
            names = list(seen[0] | seen[1])
            columns = [pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "pos", "unl"])

    partial = rows.mapInArrow(run, "feature string, pos long, unl long")
    return partial.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))


def _vectors(rows: DataFrame, features: dict[str, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                np.array(sorted(features[f] for f in text_features(t) if f in features), np.int16).tobytes()
                for t in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["positive", "found"])

    got = rows.mapInArrow(run, "positive int, found binary").toPandas()
    split = [[np.frombuffer(x, np.int16).astype(np.int64) for x in got.found[got.positive == k]] for k in (1, 0)]
    return split[0], split[1]


def _sampled(df: DataFrame, bound: int, salt: int, *columns: str) -> DataFrame:
    """All rows, or about ``bound`` of them drawn by the content of some columns."""
    n = df.count()
    if n <= bound:
        return df
    key = F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(1 << 30))
    return df.filter(key < int((1 << 30) * bound / n))


def train(positives: DataFrame, unlabelled: DataFrame, prior: float) -> Model:
    """A model from tables (id_, text_); sampled to the bounds above. Without positives it has no features."""
    spark = positives.sparkSession
    ship(spark)
    both = _sampled(positives, POSITIVES, 1, "id_", "text_").select("text_", F.lit(1).alias("positive")).unionByName(
        _sampled(unlabelled, UNLABELLED, 2, "id_", "text_").select("text_", F.lit(0).alias("positive"))
    )
    both = stage(both, "fitted_texts")
    sizes = {r.positive: r.n for r in both.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Model({}, np.zeros((1, 0)), np.array([-10.0]))
    if not n_pos or not n_unl:
        return nothing
    x, y = F.col("pos") / n_pos, F.col("unl") / n_unl
    pooled = (F.col("pos") + F.col("unl")) / (n_pos + n_unl)
    apart = (x - y) / F.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl))
    ranked = _counts(both).filter((F.col("pos") >= MIN_DOCS) & (pooled < 1)).select("feature", F.abs(apart).alias("apart"))
    ranked = ranked.filter(F.col("apart") >= LEAST_APART)
    chosen = [r.feature for r in ranked.orderBy(F.desc("apart"), "feature").limit(FEATURES).collect()]
    if not chosen:
        return nothing
    features = {f: i for i, f in enumerate(chosen)}
    data = spark.sparkContext.broadcast(_vectors(both, features))  # bounded by the samples and FEATURES
    size, prior = len(chosen), float(np.clip(prior, 1e-4, 0.9))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seed in frame.id:
                pos, unl = data.value
                yield pd.DataFrame({"seed": [seed], "theta": [fit(pos, unl, size, prior, int(seed)).tolist()]})

    fitted = spark.range(0, CLASSIFIERS, 1, CLASSIFIERS).mapInPandas(run, "seed long, theta array<double>").toPandas()
    theta = np.array(fitted.sort_values("seed").theta.tolist())
    return Model(features, theta[:, :-1], theta[:, -1])


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, score) per row; a null text is an empty one, which holds no feature. Repeated rows have equal scores."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_in_"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in slices(batches):
            scores = pa.array([scorer(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=[id_col, "score"])

    schema = type(rows.schema)([rows.schema.fields[0]]).add("score", "double")
    return rows.mapInArrow(run, schema)


def drop_toxic(df: DataFrame, text_col: str, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose score is below ``limit``, with all their columns."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer(t or "") < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str, folds: int = 5):
    """Whether a row's labels are kept from training."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from ``labels`` (id, toxic) and texts. Held-out rows give neither labels nor text.

    Labels say which texts are positives and, by their share among labelled rows, the prior; all texts outside
    the held-out fold are the unlabelled sample, labelled ones included. Ids labelled twice count as toxic if
    once so; null labels and ids are left out.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("label_id_"), F.col("toxic").cast("int").alias("toxic_"))
    known = known.filter(~held_out("label_id_") & F.col("toxic_").isNotNull() & F.col("label_id_").isNotNull())
    known = known.groupBy("label_id_").agg(F.max("toxic_").alias("toxic_"))
    share = known.agg(F.avg(F.col("toxic_").cast("double"))).first()[0]
    texts = docs.select(F.col(f"`{id_col}`").alias("id_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_"))
    texts = texts.filter(~held_out("id_"))
    # Sampled before they meet the texts, so their ids may be broadcast and no text is shuffled.
    toxic = F.broadcast(_sampled(known.filter("toxic_ = 1").select("label_id_"), POSITIVES, 1, "label_id_"))
    positives = texts.join(toxic, F.col("id_") == F.col("label_id_"), "left_semi")
    return train(positives, texts, PRIOR if share is None or share == 0 else share)


def fold_of(doc_id: int, folds: int = 5) -> int:
    """The fold as plain Python states it."""
    return zlib.crc32(str(doc_id).encode()) % folds
