import random
import re

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from kadence.llm import byte_bpe
from tests.llm.samples import TEXTS, awkward, empty

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return byte_bpe.load_encoding(RANKS, P.PATTERN)


def test_cuts_do_not_change_ids(encoding):
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice(" \n\tab'sé日,.1　") for _ in range(draw.randrange(200)))
        for size in (1, 7, 50):
            assert "".join(byte_bpe.safe_parts(text, size)) == text
            assert byte_bpe.encode_text(encoding, text, size) == encoding.encode_ordinary(text)


#: Long runs of every kind, beside other text.
RUNS = {
    "spaces": " " * 5_000_000,
    "line ends": "\n" * 5_000_000,
    "tabs before a word": "\t" * 5_000_000 + "word",
    "spaces between": "a" + " " * 1_000_000 + "b " + " \n" * 500_000 + "\u00e9",
    "letters": "a" * 5_000_000,
    "digits": "7" * 5_000_000,
    "marks": "-" * 1_000_000,
}


@pytest.mark.parametrize("kind", RUNS)
def test_long_runs(encoding, kind):
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = RUNS[kind]
    assert "".join(part for part, _ in byte_bpe.spaced_parts(text)) == text
    assert byte_bpe.encode_text(encoding, text) == other.encode(text, add_special_tokens=False).ids


def test_runs_are_cut_where_the_pattern_splits(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_RUN", re.compile(byte_bpe._WHITE + "{2,}"))
    draw = random.Random(6)
    for _ in range(500):
        text = "".join(draw.choice(" \n\t\x0b\x1c\x85\u3000ab1.\u2003") for _ in range(draw.randrange(40)))
        monkeypatch.setattr(byte_bpe, "LONG_RUN", 1)
        assert byte_bpe.encode_text(encoding, text) == encoding.encode_ordinary(text)


def test_awkward_rows(spark, encoding):
    ids = byte_bpe.encode(awkward(spark), "text", RANKS, P.PATTERN, keep=("doc_id",))
    rows = byte_bpe.decode(ids, "ids", RANKS, P.PATTERN).collect()
    expected = sorted(((i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in rows), key=repr) == expected


def test_ids_need_not_end_on_a_character(spark, encoding):
    ids = encoding.encode_ordinary("日")
    df = spark.createDataFrame([(ids[:1],), (None,)], "ids array<int>")
    rows = [r.decoded for r in byte_bpe.decode(df, "ids", RANKS, P.PATTERN).collect()]
    assert bytes(rows[0]) == encoding.decode_bytes(ids[:1]) and rows[1] is None


def test_empty_table(spark):
    assert byte_bpe.digest(empty(spark), "doc_id", "text", RANKS, P.PATTERN).count() == 0
