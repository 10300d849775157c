import numpy as np

from kadence.llm import positive_unlabelled as pu
from tests.llm.samples import TEXTS, awkward, empty, prose


def corpus(n=600):
    """Every eighth text holds bad words; half of those are labelled, none of the others is."""
    texts = [(i, prose(i, 60, 400) + (f" {'awful nasty vile'.split()[i % 3]}x{i} horrid" if i % 8 == 0 else "")) for i in range(n)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(n) if i % 16 in (0, 3, 5, 7, 9, 11, 13)]
    return texts, labels


def tables(spark, texts, labels):
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_positives_are_found(spark):
    docs, labels = tables(spark, *corpus())
    rows = pu.score(docs, "doc_id", "text", pu.learn_toxicity(docs, labels)).collect()
    held = [(r.score >= 0.5, r.doc_id % 8 == 0) for r in rows if pu.fold_of(r.doc_id) == 0]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 8 == 0) for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    kept = {r.doc_id for r in pu.drop_toxic(docs, "text", pu.learn_toxicity(docs, labels)).collect()}
    assert kept == {r.doc_id for r in rows if r.score < 0.5}


def test_held_out_labels_are_not_used(spark):
    texts, labels = corpus(200)
    flipped = [(i, q, 1 - t if pu.fold_of(i) == 0 else t) for i, q, t in labels]
    a, b = (pu.learn_toxicity(*tables(spark, texts, x)) for x in (labels, flipped))
    assert a.features == b.features and np.allclose(a.weights, b.weights)


def test_fold_is_the_same_in_spark(spark):
    df = spark.range(500).select("id", pu.held_out("id").alias("h"))
    assert all(r.h == (pu.fold_of(r.id) == 0) for r in df.collect())


def test_negative_risk_stays_above_zero():
    draw = np.random.default_rng(0)
    pos = [np.array([0, 2 + i]) for i in range(20)]
    unl = [np.array([0, 40 + i]) if i < 10 else np.array([1, 40 + i]) for i in range(100)]
    theta = pu.fit(pos, unl, 150, 0.1, int(draw.integers(9)))
    assert theta[0] > theta[1]
    f = np.array([theta[r].sum() + theta[-1] for r in unl])
    positives = np.array([theta[r].sum() + theta[-1] for r in pos])
    assert np.logaddexp(0, f).mean() - 0.1 * np.logaddexp(0, positives).mean() > -0.05


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, None, 1), (5, 1, 0), (None, 1, 1), (6, 1, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = pu.learn_toxicity(docs, labels)
    rows = pu.score(docs, "doc_id", "text", model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    nothing = pu.learn_toxicity(empty(spark), labels.limit(0))
    assert not nothing.features
    assert pu.score(empty(spark), "doc_id", "text", nothing).count() == 0
    assert all(r.score < 0.5 for r in pu.score(docs, "doc_id", "text", nothing).collect())
    assert pu.drop_toxic(docs, "text", nothing).columns == docs.columns
