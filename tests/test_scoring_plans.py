"""Shapes of the scoring plans, many classes, the grid of the dense fill and compacted logs."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import kadence as kd
from kadence.functions import measures as M
from kadence.functions.probability import normalise_vector
from kadence.operators import params as B
from kadence.operators import predict as P


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("backoff, most", [("pair", 3), ("path", 5)])
def test_evidence_is_exchanged_once_per_lookup(spark, hand, hand_model, no_broadcast, backoff, most):
    """The lines and the model to their join, then the lines to their rows; the paths' lookup adds two."""
    compiled = hand_model[2]
    rows = P.scoring_rows(hand, compiled.net, "id")
    scores = P.class_log_scores(rows, compiled, plan="evidence", backoff=backoff, limit=0)
    assert plan_of(scores).count("Exchange hashpartitioning") <= most
    assert scores.count() == hand.count()


def test_leave_one_out_needs_no_sort(hand, hand_model):
    plan = plan_of(kd.loocv(hand, hand_model[2], id_col="id"))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def buyers(spark, classes):
    return spark.createDataFrame([(f"a{i % 3}", f"b{i % 5}", f"c{i % classes:04d}") for i in range(4 * classes)], "a string, b string, y string")


def test_many_classes(spark):
    sizes = {}
    for classes in (150, 170):
        df = buyers(spark, classes)
        structure = kd.learn_structure(df, "y", 1)
        model = kd.compile_model(kd.learn_parameters(df, structure), structure)
        rows = {p: {(r.row_id, r["class"]): r.prob for r in kd.predict_proba(df.limit(9), model, plan=p).collect()} for p in ("rowwise", "evidence")}
        assert len(rows["evidence"]) == 9 * classes
        assert all(math.isclose(rows["rowwise"][key], p, rel_tol=1e-9) for key, p in rows["evidence"].items())
        left_out = kd.loocv(df, model)
        assert left_out.count() == df.count() * classes * 2
        sizes[classes] = [len(plan_of(kd.predict_classes(df, model, plan="evidence"))), len(plan_of(left_out))]
    for a, b in zip(*sizes.values(), strict=True):
        assert abs(a - b) < 0.02 * a


def test_profiles_are_scored_once(spark):
    df = buyers(spark, 150)
    structure = kd.learn_structure(df, "y", 1)
    model = kd.compile_model(kd.learn_parameters(df, structure), structure)
    odd = spark.createDataFrame([(None, "b1"), (None, "b1"), ("new", None), (None, None)], "a string, b string")
    rows = df.select("a", "b").unionByName(odd).withColumn("id", F.monotonically_increasing_id())
    profiles, members = kd.predict_profiles(rows, model, id_col="id", keep=["a"], plan="evidence")
    assert members.count() == rows.count() == 604
    assert profiles.count() == rows.select("a", "b").distinct().count() == 18
    want = {r.row_id: r for r in kd.predict_classes(rows, model, id_col="id", keep=["a"], plan="evidence").collect()}
    found = members.join(profiles, "profile_id").collect()
    assert len(found) == len(want)
    for r in found:
        assert (r.a, r.predicted_class) == (want[r.row_id].a, want[r.row_id].predicted_class)
        assert all(math.isclose(p, want[r.row_id].class_probs[c], rel_tol=1e-9) for c, p in r.class_probs.items())


def test_chunks_do_not_repeat_whole_vectors(spark):
    lines = spark.range(2).select("id", F.when(F.col("id") == 1, F.sequence(F.lit(1), F.lit(10))).alias("v"))
    out = P.chunk_rows(lines, ["v"], 10, 4)
    assert sorted(map(tuple, out.select("id", "chunk", "v").collect())) == [
        (0, 0, None), (0, 1, None), (0, 2, None), (1, 0, [1, 2, 3, 4]), (1, 1, [5, 6, 7, 8]), (1, 2, [9, 10])
    ]
    # Nothing cuts a chunk out of a vector that the repeated row still has.
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "slice" not in plan.split("Generate")[0]


def test_class_vectors_are_linear_in_the_classes(spark):
    """Twelve thousand classes in every cell: searching each one in a list takes minutes."""
    n = 12000
    rows = spark.range(40 * n).select((F.col("id") % 40).alias("cell"), F.concat(F.lit("c"), (F.col("id") / 40).cast("int")).alias("class"), "id")
    counts = rows.filter("cell > 0 or class <> 'c7'").select("cell", "class", F.col("id").alias("n"))
    classes = B.class_list(rows.select("class").distinct())
    start = time.time()
    found = B.class_vectors(counts, ["cell"], classes, "n").select("cell", F.size("n").alias("size"), F.get("n", F.lit(2)).alias("third"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("sum"))
    found = {r.cell: r for r in found.collect()}
    probs = spark.range(40).select(normalise_vector(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: -F.log(i.cast("double")))).alias("p"))
    assert all(math.isclose(r.s, 1.0) for r in probs.select(F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("s")).collect())
    assert time.time() - start < 120
    assert len(found) == 40 and all(r.size == n for r in found.values())
    # Third in order is c10, after c0, c1.
    assert found[3].third == 10 * 40 + 3
    assert found[0].sum == sum(40 * i for i in range(n)) - 280 and found[1].sum == sum(40 * i + 1 for i in range(n))
    with pytest.raises(Exception, match="counted twice"):
        B.class_vectors(counts.union(counts.limit(1)), ["cell"], classes, "n").collect()


def test_left_out_scores_by_chunks(spark, hand, hand_model, monkeypatch):
    from kadence.operators import evaluate as E

    whole = sorted(map(str, kd.loocv(hand, hand_model[2], id_col="id").collect()))
    monkeypatch.setattr(E, "LOOCV_SUMS", 1)
    monkeypatch.setattr(P, "CLASS_CHUNK", 1)
    assert sorted(map(str, kd.loocv(hand, hand_model[2], id_col="id").collect())) == whole
    one = kd.predict_proba(hand, hand_model[2], id_col="id", plan="evidence").collect()
    monkeypatch.undo()
    assert sorted(map(str, one)) == sorted(map(str, kd.predict_proba(hand, hand_model[2], id_col="id", plan="evidence").collect()))


def test_buckets_of_many_paths(spark):
    """A value under 400 parents is spread over buckets, and every path is found in its own."""
    rows = [(f"v{i % 2}", f"p{i % 400}", f"y{i % 3}") for i in range(2400)]
    df = spark.createDataFrame(rows, "v string, p string, y string")
    structure = kd.learn_structure(df, "y", 1)
    compiled = kd.compile_model(kd.learn_parameters(df, structure), structure)
    held = compiled.nested.select(F.size("path").alias("n")).collect()
    assert len(held) > 30 and max(r.n for r in held) < 60
    evidence = P.rows_to_evidence(P.scoring_rows(df, compiled.net), compiled.net)
    matched = P.match_with_backoff(evidence, compiled, ["support"], limit=0)
    assert matched.filter("level = 1 and support_1 is null or support_0 is null").count() == 0


def test_the_dense_grid_is_cut_in_blocks(spark, hand, hand_model, monkeypatch):
    whole = sorted(map(str, kd.learn_parameters(hand, hand_model[1], fill="dense").collect()))
    monkeypatch.setattr(B, "PATHS_PER_BLOCK", 2)
    monkeypatch.setattr(B, "VALUES_PER_BLOCK", 1)
    assert sorted(map(str, kd.learn_parameters(hand, hand_model[1], fill="dense").collect())) == whole
    paths = spark.range(90).select(F.lit(0).alias("attr_num"), F.lit(0).alias("level"), F.col("id").alias("x"))
    domains = spark.range(70).select(F.lit(0).alias("attr_num"), F.col("id").cast("string").alias("attr_value"))
    monkeypatch.setattr(B, "PATHS_PER_BLOCK", 30)
    monkeypatch.setattr(B, "VALUES_PER_BLOCK", 10)
    monkeypatch.setattr(B, "path_columns", lambda k: ["attr_num", "level", "x"])
    assert B._grid(paths, domains, 0).distinct().count() == 90 * 70


def test_measures_join_no_pair_cells(spark):
    """A two-valued attribute against a wide one, with null values and classes that add nothing."""
    cells = Counter()
    for i in range(3000):
        cells[("h" if i % 2 else None if i % 50 == 0 else "t", str(i * i % 211), None if i % 97 == 0 else f"y{i % 3 == 0}")] += 1
    pairs = spark.createDataFrame([(1, b, 0, a, y, n) for (a, b, y), n in cells.items()], "attr_num1 int, attr_value1 string, attr_num2 int, attr_value2 string, class string, n long")
    sums = {}
    for (a, b, y), n in cells.items():
        for key in ((0, a, y), (1, b, y), ("y", y)):
            sums[key] = sums.get(key, 0) + n
    xy = spark.createDataFrame([(*k, n) for k, n in sums.items() if k[0] != "y"], "attr_num int, attr_value string, class string, n long")
    y = spark.createDataFrame([(k[1], n) for k, n in sums.items() if k[0] == "y"], "class string, n long")
    found = M.conditional_mutual_information(pairs, xy, y)
    expected = sum(
        n / 3000 * math.log2(n * sums["y", c] / (sums[0, a, c] * sums[1, b, c])) for (a, b, c), n in cells.items() if a is not None and c is not None
    )
    assert math.isclose(found.first().cmi, expected, rel_tol=1e-9)


def test_a_log_counts_the_same_before_and_after_compaction(spark, hand, tmp_path):
    log = str(tmp_path / "log")
    schema = spark.createDataFrame([], "c1 string, class string, n long").schema
    count = lambda part: hand.filter(part).groupBy("c1", F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    counted = lambda: sorted(map(str, kd.logged_counts(spark, schema, log).collect()))
    assert kd.compact_log(spark, schema, log) == -1 and counted() == []
    for b, part in enumerate(("id <= 4", "id > 4 and id <= 8", "id > 8")):
        count(part).write.parquet(f"{log}/batch={b}")
        before = counted()
        assert kd.compact_log(spark, schema, log) == b and counted() == before
    count("id <= 4").write.mode("overwrite").parquet(f"{log}/batch=0")  # replayed
    assert counted() == before == sorted(map(str, count("true").collect()))
    kd.drop_covered(spark, log)
    assert counted() == before and not (tmp_path / "log" / "batch=1").exists()
    assert kd.compact_log(spark, schema, log) == 2
