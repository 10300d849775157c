import random

import pytest

from kadence.llm import bottom_k
from kadence.llm.components import connected_components
from tests.llm.samples import TEXTS, awkward, empty, prose


def brute_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts):
    sets = {i: brute_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(text, draw, changes):
    words = text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    texts, passage = [], prose(77, 60)
    for _ in range(12):  # groups at every distance around the limit
        base = prose(draw.randrange(10**6), draw.choice([4, 9, 30, 63, 70, 200, 600]))
        texts += [edited(base, draw, draw.randrange(0, 1 + len(base.split()) // 15)) for _ in range(draw.randrange(1, 9))]
    chain = prose(5, 300)
    for _ in range(15):  # each like the one before, the ends unlike
        texts.append(chain)
        chain = edited(chain, draw, 6)
    for _ in range(40):  # a passage that many share does not link them
        texts.append(f"{prose(draw.randrange(10**6), 150)} {passage} {prose(draw.randrange(10**6), 150)}")
    texts += [texts[0]] * 30 + ["A b C", "a B c", "a b", "", "  "]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_components_are_those_of_all_pairs(spark, corpus):
    df = spark.createDataFrame([*corpus, (10**6, None)], "doc_id long, text string")
    rows = bottom_k.near_duplicates(df, "doc_id", "text").collect()
    expected = brute(corpus) | {10**6: (0, 10**6)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = bottom_k.keep_representatives(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in expected.values()})


def test_a_group_of_near_copies_is_not_compared_in_pairs(spark, monkeypatch):
    draw = random.Random(3)
    base = prose(9, 300)
    df = spark.createDataFrame([(i, edited(base, draw, 3)) for i in range(150)], "doc_id long, text string")
    compared = []
    linked = bottom_k._linked

    def counting(pairs, *tables):
        compared.append(pairs.count())
        return linked(pairs, *tables)

    monkeypatch.setattr(bottom_k, "_linked", counting)
    rows = bottom_k.near_duplicates(df, "doc_id", "text").collect()
    assert {r.component_id for r in rows} == {0}
    assert sum(compared) < 150 * 8 < 150 * 149 / 2


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 400), (7, 7), (2, 1)], "a long, b long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {i: 1 for i in range(1, 201)} | {400: 400, 500: 400}


def test_hashes_tell_shingles_apart():
    for text in ["a b c d e f", "f e d c b a", prose(3, 2000, 20), "ab c d e f", "a bc d e f", "x"]:
        assert len(bottom_k.shingle_hashes(text)) == len(brute_set(text))
    assert set(bottom_k.shingle_hashes("ab c d e f")).isdisjoint(bottom_k.shingle_hashes("a bc d e f"))
    assert (bottom_k.shingle_hashes("A  b\tc D e") == bottom_k.shingle_hashes("a b c d e")).all()


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = bottom_k.near_duplicates(df, "doc_id", "text").collect()
    assert len(rows) == len(TEXTS)
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, i) for i in (1, 2, 3, 4, 7, 8, None)} | {(5, 5), (6, 5)}
    kept = bottom_k.keep_representatives(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (1, 2, 3, 4, 5, 7, 8, None)))
    assert bottom_k.near_duplicates(empty(spark), "doc_id", "text").count() == 0
    assert bottom_k.keep_representatives(empty(spark), "doc_id", "text").count() == 0
