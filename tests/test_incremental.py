"""Adding and removing rows, in batches and from a stream."""

import pytest

import kadence as kd
from kadence.operators import counts as C
from kadence.operators import params as B
from kadence.operators.network import Network
from kadence.sources.training import encode_categories


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def counter(hand, hand_model):
    net = Network.from_structure(hand_model[1])
    return lambda df: B.conditional_counts(encode_categories(df, "y", keep=["id"]), net)


def test_add_then_remove_is_identity(hand, counter):
    part, rest = hand.filter("id <= 9"), hand.filter("id > 9")
    assert rows(kd.add_rows(counter(part), counter(rest))) == rows(counter(hand))
    assert rows(kd.remove_rows(counter(hand), counter(rest))) == rows(counter(part))


def test_pair_counts_too(hand):
    count = lambda df: C.fused_counts(encode_categories(df, "y", null_policy="drop", keep=["id"]))
    part, rest = hand.filter("id % 2 = 0"), hand.filter("id % 2 = 1")
    assert rows(kd.add_rows(count(part), count(rest))) == rows(count(hand))


def test_removing_unknown_rows_fails(hand, counter):
    with pytest.raises(Exception, match="never counted"):
        kd.remove_rows(counter(hand.filter("id = 1")), counter(hand.filter("id = 11"))).collect()


def test_model_from_updated_counts(hand, hand_model, counter):
    net = Network.from_structure(hand_model[1])
    grown = kd.add_rows(counter(hand.filter("id <= 9")), counter(hand.filter("id > 9")))
    assert rows(B.model_table(grown, net)) == rows(hand_model[0])


def test_stream_of_rows(spark, hand, counter, tmp_path):
    src, log, gone, chk = (str(tmp_path / n) for n in ("src", "log", "gone", "chk"))
    schema = counter(hand).schema
    for i, part in enumerate(("id <= 5", "id > 5 and id <= 9")):
        hand.filter(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(hand.schema).option("maxFilesPerTrigger", 1).parquet(src)
        kd.count_stream(stream, counter, log, f"{chk}/in").awaitTermination()
        if i == 0:
            assert rows(kd.logged_counts(spark, schema, log)) == rows(counter(hand.filter("id <= 5")))
    hand.filter("id <= 5").coalesce(1).write.parquet(f"{src}-out")
    stream = spark.readStream.schema(hand.schema).parquet(f"{src}-out")
    kd.count_stream(stream, counter, gone, f"{chk}/out", remove=True).awaitTermination()
    assert rows(kd.logged_counts(spark, schema, log)) == rows(counter(hand.filter("id <= 9")))
    assert rows(kd.logged_counts(spark, schema, log, gone)) == rows(counter(hand.filter("id > 5 and id <= 9")))
