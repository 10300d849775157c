"""Random small tables against row-by-row results."""

import random

import pytest

import kadence as kd
from kadence.operators.network import Network
from tests import brute


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    rng = random.Random(request.param)
    rows = []
    for i in range(90):
        y = rng.choice("uvw")
        a = rng.choice("abc") if rng.random() < 0.5 else {"u": "a", "v": "b", "w": "c"}[y]
        b = a + rng.choice("12")
        c = rng.choice("pqrs")
        d = rng.choice("mn") if y == "u" else c
        rows.append(dict(id=i, a=a, b=b, c=c, d=d, y=y))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, a string, b string, c string, d string, y string").cache()
    structure = kd.learn_structure(df, "y", 2, exclude=["id"]).cache()
    model = kd.learn_parameters(df, structure)
    return rows, df, structure, model, kd.compile_model(model, structure)


def test_structure(case):
    rows, _, structure, *_ = case
    net = Network.from_structure(structure)
    assert {n.name: list(n.parents) for n in net.nodes} == brute.structure(rows, ["a", "b", "c", "d"], "y", 2)


@pytest.mark.parametrize("plan", ["rowwise", "evidence"])
@pytest.mark.parametrize("backoff", ["pair", "path"])
def test_predictions(case, spark, plan, backoff):
    rows, _, structure, _, model = case
    rng = random.Random(7)
    queries = [
        dict(id=i, a=rng.choice(["a", "b", "c", "new"]), b=rng.choice(["a1", "b2", "c1", "zz"]), c=rng.choice("pqrs"), d=rng.choice("mnpq"))
        for i in range(40)
    ]
    df = spark.createDataFrame([tuple(q.values()) for q in queries], "id int, a string, b string, c string, d string")
    parents = {n.name: list(n.parents) for n in model.net.nodes}
    got = {(r.row_id, r["class"]): r.prob for r in kd.predict_proba(df, model, id_col="id", plan=plan, backoff=backoff).collect()}
    for q in queries:
        for c, p in brute.probabilities(rows, parents, "y", q, backoff=backoff).items():
            assert got[q["id"], c] == pytest.approx(p, abs=1e-10)


def test_missing_column_shortens_the_parent_prefix(case, spark):
    rows, _, _, _, model = case
    parents = {n.name: list(n.parents) for n in model.net.nodes}
    gone = model.net.nodes[1].name
    queries = [{k: v for k, v in r.items() if k != gone and k != "y"} for r in rows[:20]]
    df = spark.createDataFrame([tuple(q.values()) for q in queries], ", ".join(f"{k} {'int' if k == 'id' else 'string'}" for k in queries[0]))
    got = {(r.row_id, r["class"]): r.prob for r in kd.predict_proba(df, model, id_col="id").collect()}
    for q in queries:
        for c, p in brute.probabilities(rows, parents, "y", q).items():
            assert got[q["id"], c] == pytest.approx(p, abs=1e-10)


@pytest.mark.parametrize("joint", [False, True])
@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_leave_one_out(case, joint, limit):
    rows, df, _, _, model = case
    parents = {n.name: list(n.parents) for n in model.net.nodes}
    want = brute.loocv(rows, parents, "y", 2, joint)
    got = {(r.row_id, r.k, r["class"]): r.log_score for r in kd.loocv(df, model, id_col="id", joint=joint, limit=limit).collect()}
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(v, abs=1e-10) for key, v in want.items())


def test_evidence_plan_without_broadcast(case):
    _, df, _, _, model = case
    small = kd.predict_proba(df, model, id_col="id", plan="rowwise").collect()
    shuffled = kd.predict_proba(df, model, id_col="id", plan="auto", limit=0).collect()
    assert {(r.row_id, r["class"], round(r.prob, 10)) for r in small} == {(r.row_id, r["class"], round(r.prob, 10)) for r in shuffled}
