import hashlib
import random
import re
import zlib

import pytest

from kadence.llm import prefix_trie as pt
from tests.llm.samples import LONG, prose

SCHEMA = "conv_id long, turn long, role string, text string"


def order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, role, text[:64], hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def sequences(rows):
    convs = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return convs


def borrowed(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Every node by its prefix; subtrees by looking at all pairs of nodes."""
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in below)]
        words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in below}
        saved = sum((len(nodes[p]) - 1) * words[p] for p in below)
        ends = ",".join(str(c) for c in sorted(convs) if tuple(convs[c]) == prefix)
        parent = nodes[prefix[:-1]][0] if prefix else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((members[0], len(prefix), parent, len(members), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def conversations(seed, n):
    """Conversations that share beginnings of every length, some of them copies, in a shuffled table."""
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-60, 400), n):
        style = draw.randrange(4)
        length = draw.choice([1, 2, 3, 5, 9])
        for t in range(length):
            text = f"same {t} words" if style < 3 and t < 4 else draw.choice(["yes it is", "no", prose(draw.randrange(10**6), 5)])
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    draw.shuffle(rows)
    return rows


def long_pair():
    """Two long conversations alike up to near their ends, and a shorter beginning of them."""
    base = [f"turn {k} has words" for k in range(700)]
    return [(c, k, "user", t) for c, end in ((1000, 700), (1001, 690), (1002, 350)) for k, t in enumerate([*base[:end], f"end {c}"])]


AWKWARD = [
    (None, 0, "user", "no conversation"),
    (5, None, None, None),
    (5, 2, "user", "tie"),
    (5, 2, "user", "tie"),
    (5, 2, "assistant", "tie"),
    (6, None, None, ""),
    (7, 0, "user", LONG),
    (8, 0, "user", LONG + "x"),
    (9, 0, "user", LONG),
    (21, 0, "a:b", "日本 é\x0b"),
]


@pytest.mark.parametrize("limits", [{}, {"SHARD_ROWS": 5, "BLOCK": 3}, {"SHARD_CONVS": 2, "BLOCK": 2}])
@pytest.mark.parametrize("rebuild", [False, True])
def test_nodes_are_those_of_plain_dictionaries(spark, monkeypatch, limits, rebuild):
    for name, value in limits.items():
        monkeypatch.setattr(pt, name, value)
    rows = conversations(3, 60) + AWKWARD
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, digest string").repartition(3)
    turns, convs = pt.ordered_turns(df, "conv_id", "turn", "role", "text")
    expected = sequences(rows)
    if rebuild:
        turns, convs, expected = *pt.with_borrowed_openings(turns, convs), borrowed(expected)
    assert found(pt.trie(turns, convs)) == brute(expected)


def test_a_long_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD_ROWS", 100)
    monkeypatch.setattr(pt, "BLOCK", 64)
    rows = long_pair() + [(3000, 0, "user", "other")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, convs = pt.ordered_turns(df, "conv_id", "turn", "role", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = turns.filter("conv = 1000").select("part").distinct().count()
    assert parts > 1  # one conversation stands in several tasks
    got = {(r[0], r[1]): r for r in found(pt.trie(turns, convs))}
    assert len(got) == 1 + 700 + 1 + 1 + 1 + 1  # root, shared and own turns
    assert got[1000, 0][3:7] == (4, 2, 4, sum(4 * (3 - 1) for _ in range(350)) + sum(4 for _ in range(340)))
    assert got[1000, 691][3:7] == (1, 1, 1, 0) and got[1000, 690][3:7] == (2, 2, 2, 4)
    assert got[1001, 691][2] == 1000 and got[1002, 351][2] == 1000


def test_copies_end_in_one_list(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD_CONVS", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 0, -1) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(pt.prefix_trie(df, "conv_id", "turn", "role", "text")) == brute(sequences(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pt.prefix_trie(df, "conv_id", "turn", "role", "text").count() == 0
    turns, convs = pt.ordered_turns(df, "conv_id", "turn", "role", "text")
    assert pt.trie(*pt.with_borrowed_openings(turns, convs)).count() == 0
