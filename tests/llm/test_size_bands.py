import random

import numpy as np
import pytest

from kadence.llm import size_bands as sb
from kadence.llm.bottom_k import shingle_hashes
from tests.llm.samples import TEXTS, awkward, empty, prose


def brute_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(rows):
    """Sorted (id, size, component) of (id, text) rows, by comparing all pairs."""
    sets = sorted({(i, brute_set(t)) for i, t in rows if i is not None}, key=lambda x: x[0])
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (_, x) in enumerate(sets):
        for b in range(a + 1, len(sets)):
            y = sets[b][1]
            both = len(x & y)
            if both and 100 * both >= 90 * (len(x) + len(y) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    least = {s: sets[root(k)][0] for k, s in enumerate(sets)}
    return sorted(((i, len(brute_set(t)), None if i is None else least[i, brute_set(t)]) for i, t in rows), key=repr)


def edited(text, draw, changes):
    words = text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(12)
    texts, passage = [], prose(77, 60)
    for length in (3, 4, 20, 31, 33, 60, 66, 130, 258, 600, 1030, 2100):  # groups around the limit and the bands' ends
        base = prose(draw.randrange(10**6), length)
        texts += [edited(base, draw, draw.randrange(0, 2 + length // 40)) for _ in range(6)]
        texts += [" ".join(base.split()[: length - length // k]) for k in (8, 11, 14)]
    chain = prose(5, 300)
    for _ in range(12):  # each like the one before, the ends unlike
        texts.append(chain)
        chain = edited(chain, draw, 4)
    for _ in range(40):  # a passage that many share does not link them
        texts.append(f"{prose(draw.randrange(10**6), 150)} {passage} {prose(draw.randrange(10**6), 150)}")
    texts += [texts[0]] * 30 + ["A b C", "a B c", "a b", "", "  ", None]
    draw.shuffle(texts)
    return list(enumerate(texts))


def found(rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"TILE": 2, "STAR_ROUNDS": 0, "_BUFFER": 16}, {"TILE": 3, "STAR_ROUNDS": 1, "_BUFFER": 1}])
def test_components_are_those_of_all_pairs(spark, corpus, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(sb, name, value)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert found(sb.similar_components(df, "doc_id", "text").collect()) == brute(corpus)


def test_texts_that_share_an_id(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(7, a), (7, b), (7, b), (3, edited(b, random.Random(1), 1)), (9, a + " more"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(sb.similar_components(df, "doc_id", "text").collect()) == brute(rows)


def test_a_group_of_near_copies_is_not_compared_in_pairs(spark, monkeypatch):
    draw = random.Random(3)
    base = prose(9, 300)
    df = spark.createDataFrame([(i, edited(base, draw, 2)) for i in range(150)], "doc_id long, text string")
    compared = []
    linked = sb._linked

    def counting(pairs, sets):
        compared.append(pairs.count())
        return linked(pairs, sets)

    monkeypatch.setattr(sb, "_linked", counting)
    rows = sb.similar_components(df, "doc_id", "text").collect()
    assert {r.component_id for r in rows} == {0}
    assert sum(compared) < 150 * 10 < 150 * 149 / 2


def test_signatures_bound_the_overlap():
    draw = random.Random(8)
    for _ in range(300):
        n = draw.choice([1, 5, 40, 70, 500, 3000])
        base = [draw.randrange(-(2**63), 2**63) for _ in range(n)]
        other = [v for v in base if draw.random() < 0.97] + [draw.randrange(-(2**63), 2**63) for _ in range(draw.randrange(1 + n // 20))]
        x, y = (np.unique(np.array(v, np.int64)) for v in (base, other or base))
        band = max(sb.band_of(len(x)), sb.band_of(len(y)))
        apart = sb.differing(sb.signature(x, band)[None], sb.signature(y, band)[None])
        common = len(np.intersect1d(x, y))
        assert apart[0] <= len(x) + len(y) - 2 * common
        if 100 * common >= 90 * (len(x) + len(y) - common):
            assert sb.may_link(np.array([len(x)]), np.array([len(y)]), apart)[0]
            assert band in sb.bands_of(len(x)) and band in sb.bands_of(len(y))


def test_samples_of_a_band_have_one_limit():
    values = shingle_hashes(prose(4, 5000, 10**6), 3)
    for band in (sb.band_of(len(values)), sb.band_of(len(values)) + 1):
        mine = sb.sampled(values, band)
        assert 0.5 * sb.SAMPLE < len(mine) < 3 * sb.SAMPLE
        half = np.sort(np.random.default_rng(1).choice(values, len(values) // 2, replace=False))
        assert set(sb.sampled(half, band)) == set(mine) & set(half)
    assert len(sb.sampled(values[:50], 5)) == 50


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = found(sb.similar_components(df, "doc_id", "text").collect())
    assert rows == brute(TEXTS) and len(rows) == len(TEXTS)
    assert sb.similar_components(empty(spark), "doc_id", "text").count() == 0
