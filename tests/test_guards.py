"""Results do not depend on the plan, and inputs that would give wrong answers raise."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import kadence as kd
from kadence.operators import params as B
from kadence.operators import predict as P
from kadence.operators.network import Network
from kadence.plans import learning as L
from kadence.sources import staging


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_rows_of_one_id_are_scored_apart_in_every_plan(hand, hand_model):
    _, _, compiled = hand_model
    repeated = hand.withColumn("id", F.col("id") % 3)
    results = []
    for plan in ("rowwise", "evidence"):
        out = kd.predict_proba(repeated, compiled, id_col="id", plan=plan)
        results.append(_sorted(out.withColumn("prob", F.round("prob", 10))))
    assert len(results[0]) == 28 and results[0] == results[1]


def test_leave_one_out_keeps_rows_of_one_id_apart(hand, hand_model):
    _, _, compiled = hand_model
    apart = kd.loocv(hand, compiled, id_col="id").drop("row_id")
    same = kd.loocv(hand.withColumn("id", F.lit(1)), compiled, id_col="id").drop("row_id")
    key = lambda df: _sorted(df.withColumn("log_score", F.round("log_score", 10)))
    assert key(apart) == key(same)


def test_exact_ties_go_to_the_smaller_class(spark):
    """Counts (9, 2, 6) and (2, 6, 9) out of 11 have equal products, but their logs add up unequally."""
    rows = []
    for cls, ones in (("u", (9, 2, 6)), ("v", (2, 6, 9))):
        rows += [(*[int(i < n) for n in ones], cls) for i in range(11)]
    df = spark.createDataFrame(rows, "a int, b int, c int, y string")
    structure = kd.learn_structure(df, "y", 0)
    new = spark.createDataFrame([(1, 1, 1)], "a int, b int, c int")
    model = kd.learn_parameters(df, structure)
    for plan in ("rowwise", "evidence"):
        got = kd.predict_classes(new, model, structure, plan=plan).first()
        assert got.predicted_class == "u" and got.predicted_prob == pytest.approx(0.5)


def test_a_row_that_was_never_counted_cannot_be_left_out(spark, hand, hand_model):
    _, _, compiled = hand_model
    only = hand.groupBy("c1").agg(F.collect_set("y").alias("ys"))
    assert only.count() == 2
    seen_no = spark.createDataFrame([("z", "w", "r", "no")] * 3, "c1 string, c2 string, c3 string, y string")
    more = hand.drop("id").unionByName(seen_no)
    structure = kd.learn_structure(more, "y", 1)
    model = kd.learn_parameters(more, structure)
    stranger = spark.createDataFrame([("z", "w", "r", "yes")], "c1 string, c2 string, c3 string, y string")
    with pytest.raises(Exception, match="never counted"):
        kd.loocv(stranger, model, structure).collect()


def test_a_model_cell_without_a_class_is_refused(hand, hand_model):
    model, structure, _ = hand_model
    torn = model.filter(~((F.col("attr_name") == "c1") & (F.col("class") == "yes") & (F.col("attr_value") == "a")))
    with pytest.raises(Exception, match="no row for some class"):
        kd.compile_model(torn, structure)


def test_a_log_below_zero_is_an_error(spark, tmp_path):
    counts = spark.createDataFrame([("a", 2)], "v string, n long")
    counts.write.parquet(f"{tmp_path}/add/batch=0")
    counts.withColumn("n", F.col("n") * -3).write.parquet(f"{tmp_path}/drop/batch=0")
    with pytest.raises(Exception, match="never counted"):
        kd.logged_counts(spark, counts.schema, f"{tmp_path}/add", f"{tmp_path}/drop").collect()


@pytest.mark.parametrize("plan", ["auto", "factorised", "joined"])
def test_repeated_dimension_keys_are_refused(spark, plan):
    fact = spark.createDataFrame([(1, "x", "u"), (2, "y", "v")], "fk int, a string, y string")
    dim = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "pk int, d string")
    dims = [kd.Dim("dim", dim, "pk", "fk")]
    with pytest.raises(ValueError, match="several rows"):
        kd.learn_structure_star(fact, "y", dims, 1, plan=plan)
    good = [kd.Dim("dim", dim.dropDuplicates(["pk"]), "pk", "fk")]
    structure = kd.learn_structure_star(fact, "y", good, 1, plan=plan)
    with pytest.raises(ValueError, match="several rows"):
        kd.learn_parameters_star(fact, "y", dims, structure)


def test_orphans_show_in_the_counts(spark):
    fact = spark.createDataFrame([(i % 5, "xy"[i % 2], "uv"[i % 3 % 2]) for i in range(60)], "fk int, a string, y string")
    dim = spark.createDataFrame([(i, "pq"[i % 2]) for i in range(4)], "pk int, d string")
    dims = [kd.Dim("dim", dim, "pk", "fk")]
    structures = [_sorted(kd.learn_structure_star(fact, "y", dims, 1, plan=p)) for p in ("auto", "factorised", "joined")]
    assert structures[0] == structures[1] == structures[2]
    star = kd.encode_star(fact, "y", dims)
    xy, _, y = L.stage_star_counts(star)
    assert [tuple(r) for r in L.S.lost_rows(star, xy, y).collect()] == [("dim", "fk", 12)]
    for plan in ("auto", "factorised", "joined"):
        with pytest.raises(ValueError, match="dim 12"):
            kd.learn_structure_star(fact, "y", dims, 1, plan=plan, check_keys=True)


def test_no_private_folder_away_from_local_mode(spark, monkeypatch, tmp_path):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_root(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_root(Session())
    monkeypatch.setattr(Context, "getCheckpointDir", lambda self: f"{tmp_path}/given/")
    assert staging.staging_root(Session()) == f"{tmp_path}/given"


def test_a_run_removes_its_own_tables(spark, hand):
    kept = staging.stage(hand, "kept")
    with kd.staging_run(spark) as root:
        structure = kd.learn_structure(hand, "y", 1, exclude=["id"]).collect()
        assert glob.glob(f"{root}/*/*")
    assert structure and not os.path.exists(root) and kept.count() == 14


def test_a_stored_model_scores_without_compiling(spark, hand, hand_model, tmp_path):
    model, structure, compiled = hand_model
    kd.compile_model(model, structure, path=f"{tmp_path}/m")
    again = kd.load_compiled(spark, f"{tmp_path}/m")
    assert again.classes == compiled.classes and again.class_counts == compiled.class_counts
    assert again.cell_rows == compiled.cell_rows and again.path_rows == compiled.path_rows
    for backoff in ("pair", "path"):
        got, want = (_sorted(kd.predict_proba(hand, m, id_col="id", backoff=backoff)) for m in (again, compiled))
        assert got == want


def test_updated_counts_give_the_model_of_all_rows(spark, hand):
    first, second = hand.filter("c3 = 'p'"), hand.filter("c3 is null or c3 <> 'p'")
    structure = kd.learn_structure(hand, "y", 2, exclude=["id"])
    net = Network.from_structure(structure)
    counts = [kd.conditional_counts(kd.encode_categories(df, "y", keep=["id"]), net) for df in (first, second)]
    merged = kd.model_table(kd.add_rows(*counts), net, sizes_from_counts=True)
    assert _sorted(merged) == _sorted(kd.learn_parameters(hand, structure))


@pytest.mark.parametrize("columns", [3, 4, 64])
def test_grouping_sets_in_blocks(hand, hand_model, monkeypatch, columns):
    _, structure, _ = hand_model
    net = Network.from_structure(structure)
    ts = kd.encode_categories(hand, "y", keep=["id"])
    if columns == 3:
        monkeypatch.setattr(B, "GROUPING_COLUMNS", 3)
        with pytest.raises(ValueError, match="wider"):
            B.conditional_counts_grouping_sets(ts, net)
        return
    monkeypatch.setattr(B, "GROUPING_COLUMNS", columns)
    assert _sorted(B.conditional_counts_grouping_sets(ts, net)) == _sorted(B.conditional_counts(ts, net))


def test_flat_counts_hot_keys_do_not_meet_in_the_level_zero_join(spark, hand, hand_model):
    _, structure, _ = hand_model
    net = Network.from_structure(structure)
    counts = staging.stage(kd.conditional_counts(kd.encode_categories(hand, "y", keep=["id"]), net), "conditional")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = B.sparse_cells(counts, B.prior_counts(counts), net.k)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 1  # the few totals of level 0


def test_scoring_plans_leave_no_internal_column(hand, hand_model):
    _, _, compiled = hand_model
    rows = P.scoring_rows(hand, compiled.net, "id")
    for plan in ("rowwise", "evidence"):
        assert P.ROW_KEY not in P.class_log_scores(rows, compiled, plan=plan).columns
