"""Wide tables are counted tile by tile, with the same counts, and an ended run goes on where it stopped."""

import random

import pytest
from pyspark.sql import functions as F

import kadence as kd
from kadence.operators import counts as C
from kadence.plans import learning as L


def _table(spark, columns, rows, seed=3):
    rng = random.Random(seed)
    values = [tuple(rng.choice(["a", "b", None]) for _ in range(columns)) + (rng.choice("uv"),) for _ in range(rows)]
    return spark.createDataFrame(values, ", ".join(f"c{i} string" for i in range(columns)) + ", y string")


def _sorted(df):
    return sorted(map(str, df.collect()))


def _generated_lines(df):
    """The most lines that a row becomes between the scan and the aggregate."""
    upper, lower = [len(t) for t in df]
    return upper * (upper + 1) // 2 if df[0] == df[1] else upper * lower


@pytest.mark.parametrize("policy", ["category", "drop"])
@pytest.mark.parametrize("width", [1, 2, 3, 7, 50])
def test_tiles_give_the_counts_of_one_pass(spark, width, policy):
    ts = kd.encode_categories(_table(spark, 7, 60), "y", null_policy=policy)
    xy, pairs = L.stage_fused(ts, "tiled", tile_attrs=width)
    whole = C.fused_counts(ts)
    assert _sorted(xy) == _sorted(C.xy_of(whole))
    assert _sorted(pairs) == _sorted(C.pairs_of(whole))


def test_skipped_pairs_are_skipped_in_their_tile(spark):
    ts = kd.encode_categories(_table(spark, 5, 40), "y")
    skip = [("c0", "c4"), ("c3", "c2")]
    _, pairs = L.stage_fused(ts, "tiled", skip_pairs=skip, tile_attrs=2)
    assert _sorted(pairs) == _sorted(C.pairs_of(C.fused_counts(ts, skip_pairs=skip)))
    assert pairs.select("attr_num1", "attr_num2").distinct().count() == 10 - 2


def test_three_hundred_columns(spark):
    df = _table(spark, 300, 12)
    ts = kd.encode_categories(df, "y")
    tiles = C.column_tiles(ts)
    assert len(tiles) == 15 and max(map(_generated_lines, tiles)) <= C.TILE_ATTRS**2
    assert sum(map(_generated_lines, tiles)) == 300 * 301 // 2
    xy, pairs = L.stage_fused(ts, "wide")
    sums = lambda c: c.agg(F.count("*"), F.sum("n"), F.sum(F.xxhash64(*c.columns) % 1_000_003)).first()
    whole = C.fused_counts(ts)
    assert sums(xy.select("attr_num", "attr_value", "class", "n")) == sums(C.xy_of(whole))
    assert sums(pairs) == sums(C.pairs_of(whole))


def test_a_tile_reads_its_own_columns(spark, tmp_path):
    _table(spark, 6, 20).write.parquet(str(tmp_path / "rows"))
    ts = kd.encode_categories(spark.read.parquet(str(tmp_path / "rows")), "y")
    plan = C.tile_counts(ts, (("c4", "c5"), ("c0", "c1")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c0:string,c1:string,c4:string,c5:string,y:string>" in plan


def test_an_ended_run_goes_on_at_its_tile(spark, tmp_path, monkeypatch):
    df = _table(spark, 9, 80)
    want = kd.learn_structure(df, "y", 2)
    path, counted, real = str(tmp_path / "run"), [], C.tile_counts

    def tile_counts(ts, tile, *rest):
        counted.append(tile)
        if len(counted) == 5 and not resumed:
            raise RuntimeError("executors are gone")
        return real(ts, tile, *rest)

    monkeypatch.setattr(C, "tile_counts", tile_counts)
    resumed = False
    with pytest.raises(RuntimeError):
        kd.learn_structure(df, "y", 2, stage_path=path, tile_attrs=3)
    before = set((tmp_path / "run").rglob("part=*/_SUCCESS"))
    stamps = {p: p.stat().st_mtime_ns for p in before}
    assert before
    resumed = True
    got = kd.learn_structure(df, "y", 2, stage_path=path, tile_attrs=3, resume=True)
    assert _sorted(got) == _sorted(want)
    assert {p: p.stat().st_mtime_ns for p in before} == stamps
    assert len(set((tmp_path / "run").rglob("part=*/_SUCCESS"))) == 6
    # Another layout is not taken for the same run, and without resume everything is counted anew.
    other = kd.learn_structure(df.drop("c8"), "y", 2, stage_path=path, tile_attrs=3, resume=True)
    assert _sorted(other) == _sorted(kd.learn_structure(df.drop("c8"), "y", 2))
    again = kd.learn_structure(df.limit(40), "y", 2, stage_path=path, tile_attrs=3)
    assert _sorted(again) == _sorted(kd.learn_structure(df.limit(40), "y", 2))
    with pytest.raises(ValueError, match="path"):
        kd.learn_structure(df, "y", 2, tile_attrs=3, resume=True)


def test_an_empty_wide_table(spark):
    ts = kd.encode_categories(_table(spark, 5, 10).filter("y = 'none'"), "y")
    xy, pairs = L.stage_fused(ts, "tiled", tile_attrs=2)
    assert xy.count() == 0 and pairs.count() == 0
