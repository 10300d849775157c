"""The hand table: exact expected numbers for both null policies."""

import pytest
from pyspark.sql import functions as F

import kadence as kd
from kadence.functions import measures as M
from kadence.operators import counts as C
from kadence.operators.network import Network
from kadence.sources.training import encode_categories


def _counts(hand, policy):
    ts = encode_categories(hand, "y", null_policy=policy, keep=["id"])
    fused = C.fused_counts(ts)
    return ts, C.xy_of(fused), C.pairs_of(fused), C.class_counts(ts)


@pytest.mark.parametrize("policy, c3, c1c3, c2c3", [("category", 0.099059, 0.278581, 0.170740), ("drop", 0.041391, 0.177507, 0.122306)])
def test_measures(hand, policy, c3, c1c3, c2c3):
    ts, xy, pairs, y = _counts(hand, policy)
    mi = {r.attr_num: round(r.mi, 6) for r in M.mutual_information(xy, y).collect()}
    assert mi == {0: 0.061054, 1: 0.061054, 2: c3}
    cmi = {(r.attr_num1, r.attr_num2): round(r.cmi, 6) for r in M.conditional_mutual_information(pairs, xy, y).collect()}
    assert cmi == {(1, 0): 0.020750, (2, 0): c1c3, (2, 1): c2c3}


def test_complete_measures_equal_general_ones(hand):
    _, xy, pairs, y = _counts(hand, "category")
    terms = M.attribute_terms(xy)
    general = {r.attr_num: r.mi for r in M.mutual_information(xy, y).collect()}
    for r in M.mutual_information_complete(terms, y).collect():
        assert r.mi == pytest.approx(general[r.attr_num], abs=1e-12)
    general = {(r.attr_num1, r.attr_num2): r.cmi for r in M.conditional_mutual_information(pairs, xy, y).collect()}
    for r in M.conditional_mutual_information_complete(pairs, terms, y).collect():
        assert r.cmi == pytest.approx(general[r.attr_num1, r.attr_num2], abs=1e-12)


def test_structure(hand_model):
    _, structure, _ = hand_model
    net = Network.from_structure(structure)
    assert [(n.name, n.parents, n.num_values) for n in net.nodes] == [
        ("c3", (), 3),
        ("c1", ("c3",), 2),
        ("c2", ("c3", "c1"), 2),
    ]
    assert (net.label, net.label_num, net.num_classes) == ("y", 3, 2)


@pytest.mark.parametrize("fill, expected", [("sparse", {"c3": 6, "c1": 14, "c2": 32}), ("dense", {"c3": 6, "c1": 16, "c2": 36})])
def test_model_rows(hand, hand_model, fill, expected):
    _, structure, _ = hand_model
    model = kd.learn_parameters(hand, structure, fill=fill)
    rows = {r.attr_name: r["count"] for r in model.groupBy("attr_name").count().collect()}
    assert rows == {**expected, None: 2}


QUERIES = [(1, "a", "x", "p"), (2, "b", "x", "~"), (3, "z", "y", "q"), (4, "b", "z", "p")]
EXPECTED = {
    (True, "pair"): [0.899468, 0.191893, 0.150000, 0.304698],
    (True, "path"): [0.899468, 0.495763, 0.150000, 0.304698],
    (False, "pair"): [0.921260, 0.236946, 0.187500, 0.364297],
    (False, "path"): [0.921260, 0.562500, 0.187500, 0.364297],
}


@pytest.mark.parametrize("plan", ["rowwise", "evidence"])
@pytest.mark.parametrize("prior, backoff", list(EXPECTED))
def test_probabilities(spark, hand_model, plan, prior, backoff):
    rows = spark.createDataFrame(QUERIES, "id int, c1 string, c2 string, c3 string")
    probs = kd.predict_proba(rows, hand_model[2], id_col="id", include_prior=prior, backoff=backoff, plan=plan)
    got = [round(r.prob, 6) for r in probs.filter("class = 'yes'").orderBy("row_id").collect()]
    assert got == EXPECTED[prior, backoff]
    sums = probs.groupBy("row_id").agg(F.sum("prob").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0, abs=1e-12) for r in sums)
