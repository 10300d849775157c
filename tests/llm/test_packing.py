import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from kadence.llm import packing
from tests.llm.samples import TEXTS, awkward, empty, prose

VOCABULARY = P.path("byte_bpe_50k.json")


def brute_place(bins, opened, length, capacity, limit):
    """Best fit over a plain list of (free, number)."""
    fitting = [b for b in bins if b[0] >= length]
    if fitting:
        best = min(f for f, _ in fitting)
        chosen = [b for b in bins if b[0] == best][-1]
        bins.remove(chosen)
    else:
        if len(bins) >= limit and length < capacity:
            fullest = min(f for f, _ in bins)
            bins.remove([b for b in bins if b[0] == fullest][-1])
        chosen, opened = (capacity, opened), opened + 1
    if chosen[0] > length:
        bins.append((chosen[0] - length, chosen[1]))
    return chosen[1], capacity - chosen[0], opened


def test_bitset_agrees_with_a_list():
    draw = random.Random(2)
    for limit in (1, 3, 50):
        fast, bins, opened = packing.OpenBins(64, limit), [], 0
        for _ in range(2000):
            length = draw.randint(1, 64)
            number, offset, opened = brute_place(bins, opened, length, 64, limit)
            assert fast.place(length) == (number, offset)
            assert fast.count == len(bins) <= limit


def test_cut_gives_full_pieces_after_the_first():
    assert packing.cut(5, 8) == [(0, 5)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_ids_are_those_of_the_library():
    whole = Tokenizer.from_file(VOCABULARY)
    whole.encode_special_tokens = True
    ids = packing.text_ids(VOCABULARY)
    draw = random.Random(8)
    texts = [t or "" for _, t in TEXTS] + ["<|endoftext|> x", "it's they'LL", " a  b ", "a\n b\n\nc"]
    texts += ["".join(draw.choice(" \n\tab'sé日,.1　<|") for _ in range(draw.randrange(60))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_sequences_have_no_gaps(spark):
    rows = packing.pack(awkward(spark).repartition(3), "doc_id", "text", VOCABULARY, max_tokens=512, open_bins=4).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 512
    whole = Tokenizer.from_file(VOCABULARY)
    for doc_id in (1, 3, 4, None):
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = [i for r in pieces for i in np.frombuffer(r.ids, "<u4").tolist()]
        text = next(t for i, t in TEXTS if i == doc_id)
        assert ids == whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
    assert len(rows) == sum(len(packing.cut(len(whole.encode(t or "").ids) + 1, 512)) for _, t in TEXTS)


def test_small_partitions_are_packed_together(spark):
    draw = random.Random(3)
    rows = [(i, prose(i, draw.choice([20, 60, 200, 900]))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(50)
    packed = packing.pack(df, "doc_id", "text", VOCABULARY).drop("ids").collect()
    bound = -(-sum(r.length for r in packed) // packing.MAX_TOKENS)
    assert len({r.sequence_id for r in packed}) <= 1.02 * bound + 1


def test_long_runs(spark):
    whole = Tokenizer.from_file(VOCABULARY)
    texts = [" " * 3_000_000, "\n" * 1_000_000 + "end", "é" + "\t" * 1_000_000, "日" + " " * 500_000]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", VOCABULARY).collect()
    for i, text in enumerate(texts):
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids + [0]


def test_empty_table(spark):
    assert packing.pack(empty(spark), "doc_id", "text", VOCABULARY).count() == 0
