"""Properties and edge cases of the single operators."""

import pytest
from pyspark.sql import functions as F

import kadence as kd
from kadence.functions import measures as M
from kadence.operators import counts as C
from kadence.operators import params as B
from kadence.operators import predict as P
from kadence.operators import structure as T
from kadence.operators.network import Network
from kadence.plans import learning as L
from kadence.sources.training import attribute_catalog, encode_categories, read_training, token_clashes


def rows(df):
    return sorted(map(str, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_must_exist(hand):
    with pytest.raises(ValueError, match="outcome"):
        encode_categories(hand, "outcome")
    assert encode_categories(hand, "Y").label == "y"


def test_nested_columns_are_rejected(hand):
    with pytest.raises(ValueError, match="nested"):
        encode_categories(hand.withColumn("c4", F.array("c1")), "y")


def test_attribute_numbers_count_the_label(hand):
    ts = encode_categories(hand.select("c1", "y", "c2"), "y")
    assert (ts.attr_nums, ts.label_num) == ((0, 2), 1)
    assert [tuple(r) for r in attribute_catalog(ts).orderBy("attr_num").collect()] == [
        (0, "c1", False),
        (1, "y", True),
        (2, "c2", False),
    ]


def test_null_policies(spark):
    df = spark.createDataFrame([("", "u"), (None, "u"), ("~", None)], "a string, y string")
    category = encode_categories(df, "y", empty_as_null=True).df
    assert rows(category) == ["Row(a='~', y='u')", "Row(a='~', y='u')", "Row(a='~', y='~')"]
    kept = encode_categories(df, "y", null_policy="drop").df
    assert kept.filter("a is null").count() == 1
    assert {r.attr_name: (r.n_null, r.n_token) for r in token_clashes(df, "y").collect()} == {"a": (1, 1), "y": (1, 0)}
    with pytest.raises(ValueError, match="null_policy"):
        encode_categories(df, "y", null_policy="other")


def test_read_training(spark, hand, tmp_path):
    hand.createOrReplaceTempView("hand_rows")
    hand.write.parquet(str(tmp_path / "rows"))
    by_query = read_training(spark, query="select * from hand_rows", view="training_view")
    assert rows(by_query) == rows(hand) == rows(read_training(spark, path=str(tmp_path / "rows")))
    assert rows(read_training(spark, table="training_view")) == rows(hand)
    with pytest.raises(ValueError, match="exactly one"):
        read_training(spark, query="select 1", table="t")


@pytest.mark.parametrize("policy", ["category", "drop"])
def test_pregrouping_changes_nothing(hand, policy):
    ts = encode_categories(hand, "y", null_policy=policy, keep=["id"])
    for pregroup in (True, "auto"):
        assert rows(C.fused_counts(ts, pregroup)) == rows(C.fused_counts(ts))
        assert rows(C.attr_class_counts(ts, pregroup)) == rows(C.attr_class_counts(ts))


def test_diagonal_is_the_attribute_count(hand):
    ts = encode_categories(hand, "y", null_policy="drop", keep=["id"])
    fused = C.fused_counts(ts)
    assert rows(C.xy_of(fused)) == rows(C.attr_class_counts(ts))
    assert C.pairs_of(fused).filter("attr_num1 <= attr_num2").count() == 0
    ordered = C.ordered_pair_counts(C.pairs_of(fused))
    assert ordered.count() == 2 * C.pairs_of(fused).count()


def test_null_counts_as_one_value(hand):
    for policy in ("category", "drop"):
        ts = encode_categories(hand, "y", null_policy=policy, keep=["id"])
        sizes = {r.attr_num: r.num_values for r in C.domain_sizes(C.attr_class_counts(ts)).collect()}
        assert sizes == {0: 2, 1: 2, 2: 3}


def test_ties_go_to_the_smaller_number(spark):
    mi = spark.createDataFrame([(3, 0.5), (1, 0.5 + 1e-15), (2, 0.5 - 1e-15), (0, 0.1)], "attr_num int, mi double")
    ranks = {r.attr_num: r.mi_rank for r in T.rank_attributes(mi).collect()}
    assert ranks == {1: 1, 2: 2, 3: 3, 0: 4}


def test_pair_without_cmi_is_still_a_candidate(spark):
    ranked = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "attr_num int, mi_rank int")
    cmi = spark.createDataFrame([(1, 0, 0.2)], "attr_num1 int, attr_num2 int, cmi double")
    got = {(r.attr_num, r.parent_num, r.cmi_rank) for r in T.select_parents(ranked, cmi, 2).collect()}
    assert got == {(1, 0, 1), (2, 0, 1), (2, 1, 2)}


def test_single_attribute(hand):
    structure = kd.learn_structure(hand.select("c1", "y"), "y", 2)
    net = Network.from_structure(structure)
    assert [(n.name, n.parents) for n in net.nodes] == [("c1", ())]


@pytest.mark.parametrize("policy", ["category", "drop"])
def test_naive_network_is_naive_bayes(hand, policy):
    structure = kd.learn_structure(hand, "y", 0, exclude=["id"], null_policy=policy)
    assert structure.filter("cmi_rank is not null").count() == 0
    model = kd.compile_model(kd.learn_parameters(hand, structure, null_policy=policy), structure)
    for plan in ("rowwise", "evidence"):
        probs = kd.predict_proba(hand, model, id_col="id", plan=plan, null_policy=policy)
        p = {(r.row_id, r["class"]): r.prob for r in probs.collect()}
        # Row 1 (a, x, p): class sizes 8 and 6; a 3 and 4, x 3 and 4, p 3 and 4.
        nulls = 0 if policy == "category" else 1
        no = (8.5 / 15) * (3.5 / 9) * (3.5 / 9) * ((3 + 1 / 3) / (9 - nulls))
        yes = (6.5 / 15) * (4.5 / 7) * (4.5 / 7) * ((4 + 1 / 3) / 7)
        assert p[1, "yes"] == pytest.approx(yes / (yes + no), abs=1e-12)


def test_parents_count_is_the_sum_of_the_children(hand, hand_model):
    model = hand_model[0].filter("attr_name is not null")
    keys = ["attr_num", "level", "parent1", "parent2", "class"]
    sums = model.groupBy(*keys).agg(F.sum("n").alias("s"), F.min("parents_count").alias("lo"), F.max("parents_count").alias("hi"))
    assert sums.filter("s <> lo or s <> hi").count() == 0


@pytest.mark.parametrize("k", [1, 2])
def test_grouping_sets_equal_explode(hand, k):
    ts = encode_categories(hand, "y", keep=["id"])
    net = Network.from_structure(kd.learn_structure(hand, "y", k, exclude=["id"]))
    assert rows(B.conditional_counts_grouping_sets(ts, net)) == rows(B.conditional_counts(ts, net))
    assert rows(B.conditional_counts(ts, net, pregroup=True)) == rows(B.conditional_counts(ts, net))
    with pytest.raises(ValueError, match="category"):
        B.conditional_counts_grouping_sets(encode_categories(hand, "y", null_policy="drop", keep=["id"]), net)


def test_null_parent_ends_the_prefix(spark):
    df = spark.createDataFrame([("a", None, "z", "u"), ("a", "m", "z", "u"), ("b", "m", None, "v")], "c string, p string, q string, y string")
    ts = encode_categories(df, "y", null_policy="drop")
    sizes = C.domain_sizes(C.attr_class_counts(ts))
    structure = T.structure_from_parents(sizes, 2, ts.names, "y", 3, {"p": [], "q": ["p"], "c": ["p", "q"]})
    counts = B.conditional_counts(ts, Network.from_structure(structure))
    got = {(r.level, r.attr_value, r.parent1, r.parent2, r["class"], r.n) for r in counts.filter("attr_num = 0").collect()}
    assert got == {
        (0, "a", None, None, "u", 2),
        (1, "a", "m", None, "u", 1),
        (2, "a", "m", "z", "u", 1),
        (0, "b", None, None, "v", 1),
        (1, "b", "m", None, "v", 1),
    }


def test_sparse_and_dense_agree_on_seen_cells(hand, hand_model):
    model, structure, _ = hand_model
    dense = kd.learn_parameters(hand, structure, fill="dense")
    assert model.exceptAll(dense).count() == 0
    extra = dense.exceptAll(model)
    assert extra.count() == 6 and extra.filter("n > 0").count() == 0


def test_dense_model_scores_by_path(hand, hand_model):
    _, structure, sparse = hand_model
    dense = kd.compile_model(kd.learn_parameters(hand, structure, fill="dense"), structure)
    by_path = kd.predict_proba(hand, sparse, id_col="id", backoff="path").withColumn("prob", F.round("prob", 10))
    by_pair = kd.predict_proba(hand, dense, id_col="id", backoff="pair").withColumn("prob", F.round("prob", 10))
    assert rows(by_path) == rows(by_pair)


def test_row_without_evidence(spark, hand_model):
    model = hand_model[2]
    df = spark.createDataFrame([(1, "new", "new", "new")], "id int, c1 string, c2 string, c3 string")
    for plan in ("rowwise", "evidence"):
        probs = {r["class"]: r.prob for r in kd.predict_proba(df, model, id_col="id", plan=plan).collect()}
        assert probs["yes"] == pytest.approx((6.5 / 15) / (6.5 / 15 + 8.5 / 15))
        assert kd.predict_proba(df, model, id_col="id", plan=plan, include_prior=False).count() == 0


def test_tie_goes_to_the_first_class(spark):
    df = spark.createDataFrame([(1, "a", "u"), (2, "a", "v")], "id int, c string, y string")
    structure = kd.learn_structure(df, "y", 0, exclude=["id"])
    out = kd.predict_classes(df, kd.learn_parameters(df, structure), structure, id_col="id")
    assert [(r.predicted_class, r.predicted_prob, r.class_probs) for r in out.collect()] == [("u", 0.5, {"u": 0.5, "v": 0.5})] * 2


def test_generated_ids_and_sample(hand, hand_model):
    model, structure, compiled = hand_model
    out = kd.predict_classes(hand, compiled, keep=["id", "y"])
    assert out.select("row_id").distinct().count() == 14 and set(out.columns) >= {"id", "y"}
    sample = kd.predict_sample(hand, model, structure, order_by="id", n=3)
    assert {(r.row_id, r.y) for r in sample.collect()} == {(1, "yes"), (2, "yes"), (3, "yes")}


def test_prune_equals_smaller_network(hand, hand_model):
    model, structure, _ = hand_model
    small = kd.prune_structure(structure, 3, 1)
    assert rows(kd.prune_model(model, structure, 3, 1)) == rows(kd.learn_parameters(hand, small))
    naive = kd.prune_structure(structure, 2, 0)
    net = Network.from_structure(naive)
    assert [(n.name, n.parents) for n in net.nodes] == [("c3", ()), ("c1", ())]
    assert rows(kd.prune_model(model, structure, 2, 0)) == rows(kd.learn_parameters(hand, naive))


def test_model_size(hand_model):
    model = hand_model[0]
    sizes = {r.attr_name: (r.leaf_nodes, r.parameters, r.total_parameters) for r in kd.model_size(model, 2).collect()}
    # c3 is a root; c1 has three parent values; c2 has five parent pairs.
    assert sizes == {"c3": (1, 6, 40), "c1": (3, 12, 40), "c2": (5, 20, 40)}


def test_save_and_load(spark, hand_model, tmp_path):
    model, structure, _ = hand_model
    kd.save_structure(structure, str(tmp_path / "s"))
    kd.save_model(model, str(tmp_path / "m"))
    loaded = kd.load_structure(spark, str(tmp_path / "s"))
    assert [r.attr_name for r in loaded.collect()] == ["y", "c3", "c1", "c2", "c2"]
    assert {(r.attr_name, r.parent, r.parent_num, r.num_parents) for r in loaded.collect()} >= {
        ("c2", "c3", 2, 2),
        ("c2", "c1", 0, 2),
        ("c3", None, None, 0),
    }
    assert rows(kd.load_model(spark, str(tmp_path / "m"), 2)) == rows(model)
    with pytest.raises(ValueError, match="parent3"):
        kd.load_model(spark, str(tmp_path / "m"), 3)


def test_summary(hand_model):
    model, structure, _ = hand_model
    row = kd.model_summary(model, structure, 2).first()
    assert (row.n_rows, row.attributes, row.predictors, row.label, row.classes) == (
        14,
        ["c1", "c2", "c3"],
        ["c3", "c1", "c2"],
        "y",
        ["no", "yes"],
    )
    assert row.class_probs == pytest.approx([8.5 / 15, 6.5 / 15]) and row.leaf_nodes == [1, 3, 5] and row.parameters == 40


def test_counts_stay_on_the_map_side_and_prune_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(100).selectExpr("id % 3 as a", "id % 5 as b", "id % 2 as y", "id as unused").write.parquet(path)
    ts = encode_categories(spark.read.parquet(path).select("a", "b", "y"), "y")
    plan = plan_of(C.fused_counts(ts))
    assert "partial_sum" in plan and "unused" not in plan and plan.count("Exchange") == 1
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_scoring_plan_without_shuffle(hand, hand_model):
    plan = plan_of(kd.predict_proba(hand, hand_model[2], id_col="id", plan="rowwise"))
    assert "hashpartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = plan_of(kd.predict_proba(hand, hand_model[2], id_col="id", plan="evidence", limit=0))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_learning_has_no_cross_join(hand):
    ts = encode_categories(hand, "y", null_policy="drop", keep=["id"])
    xy, pairs, y = L.stage_counts(ts)
    for df in (M.conditional_mutual_information(pairs, xy, y), L.structure_of(xy, pairs, y, 2, ts.names, "y", 3, False)):
        assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_stage_path_is_reset(hand, tmp_path):
    path = str(tmp_path / "run")
    first = kd.learn_structure(hand, "y", 2, exclude=["id"], stage_path=path).count()
    again = kd.learn_structure(hand.limit(10), "y", 1, exclude=["id"], stage_path=path)
    assert first == 5 and again.filter("cmi_rank = 2").count() == 0
