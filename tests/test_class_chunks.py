"""Models whose classes are too many for one vector: the same results, chunk by chunk."""

import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import kadence as kd
from kadence.operators import chunks as K
from kadence.operators import predict as P
from kadence.sources import staging

NEW = [(1, "a1", "b1"), (1, "a1", "b1"), (2, None, "b1"), (3, "new", None), (4, None, None), (5, "new", "new")]


def buyers(spark, classes):
    rows = [(f"a{i % 3}", None if i % 11 == 0 else f"b{i * i % 5}", f"c{(i // 3) % classes:04d}") for i in range(4 * classes)]
    return spark.createDataFrame(rows, "a string, b string, y string")


def same(found, wanted):
    found, wanted = (sorted(map(tuple, df.collect()), key=str) for df in (found, wanted))
    assert len(found) == len(wanted) > 0
    for a, b in zip(found, wanted, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, dict):
                assert list(x) == list(y) and all(math.isclose(p, y[c], rel_tol=1e-9) for c, p in x.items())
            else:
                assert math.isclose(x, y, rel_tol=1e-9) if isinstance(x, float) else x == y


def both(spark, monkeypatch, classes, width, **options):
    """The rows, their structure, and (model table, compiled model) with whole vectors and by chunks of ``width``."""
    df = buyers(spark, classes)
    structure = kd.learn_structure(df, "y", 1)
    models = []
    for most in (classes, width):
        monkeypatch.setattr(K, "CLASSES_PER_VECTOR", most)
        model = kd.learn_parameters(df, structure, **options)
        models.append((model, kd.compile_model(model, structure)))
    assert models[0][1].chunks is None and len(models[1][1].chunks.ids) > 1
    return df, structure, *models


def test_no_row_holds_a_number_for_every_class(spark):
    """Five thousand classes, as they come: vectors stay below the limit in every table that scoring reads."""
    df = buyers(spark, 5000)
    structure = kd.learn_structure(df, "y", 1)
    compiled = kd.compile_model(kd.learn_parameters(df, structure), structure)
    longest = lambda table, c: table.agg(F.max(F.size(c))).first()[0]
    assert longest(compiled.cells, "n") < 4096 and longest(compiled.paths, "zero_log_prob") < 4096
    assert longest(compiled.nested.select(F.explode("log_prob").alias("v")), "v") < 4096
    profiles, members = kd.predict_profiles(df.limit(20), compiled, plan="evidence", in_parts=True)
    assert longest(profiles, "class_probs") < 4096
    each = profiles.groupBy("profile_id").agg(F.sum(F.size("class_probs")).alias("n"), F.countDistinct("predicted_class", "predicted_prob").alias("found"))
    assert members.count() == 20 and {(r.n, r.found) for r in each.collect()} == {(5000, 1)}


@pytest.mark.parametrize("fill", ["sparse", "dense"])
def test_chunks_change_no_result(spark, monkeypatch, tmp_path, fill):
    df, structure, (rows, whole), (chunked_rows, chunked) = both(spark, monkeypatch, 51, 9, fill=fill)
    same(chunked_rows, rows)
    assert (chunked.classes, chunked.class_counts) == (whole.classes, whole.class_counts)
    assert (chunked.cell_rows, chunked.path_rows, chunked.nested_bytes()) == (whole.cell_rows, whole.path_rows, whole.nested_bytes())
    new = spark.createDataFrame(NEW, "id int, a string, b string")
    for options in ({"plan": "rowwise"}, {"plan": "evidence", "backoff": "path"}, {"plan": "evidence", "include_prior": False, "limit": 0}):
        same(kd.predict_proba(new, chunked, id_col="id", **options), kd.predict_proba(new, whole, id_col="id", **options))
    same(kd.predict_classes(new, chunked, id_col="id", keep=["b"]), kd.predict_classes(new, whole, id_col="id", keep=["b"]))
    same(kd.loocv(df.withColumn("id", F.hash("a", "b", "y")), chunked, id_col="id"), kd.loocv(df.withColumn("id", F.hash("a", "b", "y")), whole, id_col="id"))
    encoded = P.scoring_rows(new, whole.net, "id")
    flat = lambda m: P.class_log_scores(encoded, m).select("row_id", "matched", F.posexplode("scores"))
    same(flat(chunked), flat(whole))
    # Out of the rows alone, and as stored.
    kd.compile_model(chunked_rows.select("*"), structure, path=f"{tmp_path}/m")
    again = kd.load_compiled(spark, f"{tmp_path}/m")
    assert again.classes == whole.classes and again.chunks.num_rows == whole.num_rows
    same(kd.predict_proba(new, again, id_col="id", backoff="path"), kd.predict_proba(new, whole, id_col="id", backoff="path"))


def test_profiles_in_parts_add_up(spark, monkeypatch):
    _, _, (_, whole), (_, chunked) = both(spark, monkeypatch, 40, 7)
    new = spark.createDataFrame(NEW, "id int, a string, b string")
    joined = lambda found: found[1].join(found[0], "profile_id").drop("profile_id")
    want = joined(kd.predict_profiles(new, whole, id_col="id"))
    same(joined(kd.predict_profiles(new, chunked, id_col="id")), want)
    parts = joined(kd.predict_profiles(new, chunked, id_col="id", in_parts=True))
    entry = ["row_id", "predicted_class", "predicted_prob", F.explode("class_probs")]
    assert parts.count() > want.count()
    same(parts.select(*entry), want.select(*entry))
    same(joined(kd.predict_profiles(new, whole, id_col="id", in_parts=True)), want)


def test_ties_between_chunks_go_to_the_smallest_class(spark, monkeypatch):
    monkeypatch.setattr(K, "CLASSES_PER_VECTOR", 5)
    df = spark.createDataFrame([("a", f"c{i:02d}") for i in range(30)], "a string, y string")
    structure = kd.learn_structure(df, "y", 0)
    found = kd.predict_classes(df.limit(1), kd.learn_parameters(df, structure), structure).first()
    assert found.predicted_class == "c00" and math.isclose(found.predicted_prob, 1 / 30) and len(found.class_probs) == 30


@pytest.mark.parametrize("torn", ["one class of a cell", "a chunk of a cell", "an unknown class", "a class twice"])
def test_an_unfilled_model_in_chunks_is_an_error(spark, monkeypatch, torn):
    _, structure, _, (model, compiled) = both(spark, monkeypatch, 40, 7)
    cell = (F.col("attr_name") == "a") & (F.col("attr_value") == "a1") & (F.col("level") == 0)
    prior = F.col("attr_name").isNull()
    if torn == "one class of a cell":
        rows = model.filter(prior | ~cell | (F.col("class") != "c0007"))
    elif torn == "a chunk of a cell":
        first = compiled.class_table.orderBy(K.CHUNK).first().classes
        rows = model.filter(prior | ~cell | ~F.col("class").isin(first))
    elif torn == "an unknown class":
        rows = model.filter(~prior | (F.col("class") != "c0007"))
    else:
        rows = model.unionByName(model.filter(cell & (F.col("class") == "c0007")))
    with pytest.raises(Exception, match="no row for some class"):
        kd.compile_model(rows, structure)


def test_counts_of_fills_the_gaps(spark):
    entries = [(0, [(0, 4), (3, 7)], 5), (1, None, 2), (2, [(1, None)], 2), (3, [(4, 9)], 5)]
    df = spark.createDataFrame(entries, "id int, entries array<struct<place:int,n:bigint>>, size int")
    found = dict(df.select("id", K.counts_of("entries", "size")).collect())
    assert found == {0: [4, 0, 0, 7, 0], 1: [0, 0], 2: [0, 0], 3: [0, 0, 0, 0, 9]}
    twice = spark.createDataFrame([([(1, 2), (1, 3)], 4)], "entries array<struct<place:int,n:bigint>>, size int")
    with pytest.raises(Exception, match="counted twice"):
        twice.select(K.counts_of("entries", "size")).collect()


def test_row_groups_of_wide_rows_are_short(spark, tmp_path):
    wide = spark.range(0, 900, 1, 1).select("id", F.array_repeat(F.lit(0), 4096).alias("v"))
    staging.stage(wide, "wide", f"{tmp_path}/wide", width=4096)
    files = [pq.ParquetFile(p).metadata for p in sorted((tmp_path / "wide").glob("*.parquet"))]
    assert sum(f.num_rows for f in files) == 900
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 128
