import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kadence.llm import ranked_search as rs
from tests.llm.samples import LONG, awkward, empty, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, top=10):
    """(item, rank, doc, score) by plain loops; ids that are null go last."""
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in documents]
    n_docs, length = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    asked = {}
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, found, n in docs:
            score = 0
            for term, times in terms.items():
                if term in found:
                    df = sum(term in f for _, f, _ in docs)
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m = 25 + 75 * n * n_docs // length
                    score += times * weight * (10**9 * found[term] // (1000 * found[term] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    texts = [prose(draw.randrange(10**6), draw.choice([1, 5, 40, 300]), 60) for _ in range(90)]
    texts += [texts[0]] * 25 + [texts[3].upper(), "", None, "!!! ...", "é日 W1 w1-w2", LONG]
    draw.shuffle(texts)
    items = [(k, prose(k, 12, 60)) for k in range(30)] + [(99, "word " * 50), (98, "unknown"), (97, None), (96, "日本 w1 W1 é日")]
    return list(enumerate(texts)), items


@pytest.mark.parametrize("sizes", [{}, {"TILE_ITEMS": 7, "TILE_TERMS": 5}, {"BLOCK_TERMS": 60}, {"_MOST": 3000}])
def test_ranks_are_those_of_plain_loops(spark, corpus, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(rs, name, value)
    documents, items = corpus
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(rs.rank(docs, "doc_id", "text", asked, "item_id", "text")) == brute(documents, items)


def test_products_are_exact_beyond_a_double():
    heavy = 5 * rs._MOST + 12345
    tile = rs.Tile({0: {0: heavy, 2: 7}, 1: {1: rs._MOST, 2: rs._MOST}}, 3)
    rows, ids, impacts = np.array([0, 0, 1, 1]), np.array([0, 2, 1, 2]), np.array([999_999, 3, 999_998, 999_997])
    expected = [[heavy * 999_999 + 21, 3 * rs._MOST], [7 * 999_997, rs._MOST * (999_998 + 999_997)]]
    assert tile.scores(rows, ids, impacts, 2).tolist() == expected
    assert all((w.sum(axis=0) * rs._IMPACT < 2**53).all() for _, w in tile.parts)


def test_ties_across_tiles_go_by_id():
    draw = random.Random(2)
    scores = np.array([[draw.choice([0, 5, 5, 9]) for _ in range(3)] for _ in range(400)])
    ids = np.array(draw.sample(range(1000), 400))
    null = np.array([draw.random() < 0.1 for _ in range(400)]).astype(np.int64)
    best = rs.Best(3, 10)
    for start in range(0, 400, 37):
        best.add(*(x[start : start + 37] for x in (scores, null, ids)))
    for item in range(3):
        expected = sorted((-s, n, i) for s, n, i in zip(scores[:, item], null, ids, strict=True) if s > 0)[:10]
        mine = best.rows[0] == item
        assert [(-s, n, i) for s, n, i in zip(*(r[mine] for r in best.rows[1:]), strict=True)] == expected


def test_awkward_and_empty(spark):
    items = [(1, "same text twice"), (1, "same text twice"), (1, "row"), (None, "words and"), (2, ""), (3, None)]
    asked = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, item_ string, rank int")
    df = awkward(spark)
    documents = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    result = rs.rank(df, "doc_id", "text", asked, "item_id", "text")
    assert found(result) == brute(documents, items)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert rs.rank(empty(spark), "doc_id", "text", asked, "item_id", "text").count() == 0
    assert rs.rank(df, "doc_id", "text", asked.limit(0), "item_id", "text").count() == 0
