import hashlib
import random

from kadence.llm import prefix_hashes as ph
from tests.llm.samples import TEXTS, awkward, empty, prose


def test_spans_and_extensions():
    draw = random.Random(6)
    for _ in range(200):
        a = "".join(draw.choice("abé𝒰") for _ in range(draw.randrange(1, 40)))
        b = "".join(draw.choice("abé𝒰") for _ in range(draw.randrange(1, 40))) + a[draw.randrange(len(a)) :]
        x, y = (ph.PrefixHashes(ph.code_points(t)) for t in (a, b))
        i, j = draw.randrange(len(a)), draw.randrange(len(b))
        same = 0
        while i + same < len(a) and j + same < len(b) and a[i + same] == b[j + same]:
            same += 1
        assert ph.common_extension(x, i, y, j) == same
        n = draw.randrange(min(len(a) - i, len(b) - j) + 1)
        assert ph.equal_spans(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])


def test_likeness():
    base = prose(1, 500)
    near = lambda a, b: ph.likeness(ph.Fingerprint(a), ph.Fingerprint(b))
    assert near(base, base) == 1 and near("", "") == 1 and near("", "a") == 0
    assert near(base, prose(2, 500)) < 0.1
    assert 0.65 < near(base, ph.edit(base, prose(3, 500))) < 0.8
    assert near(base, "a few words before " + base) > 0.7  # spans are found wherever they stand
    assert near(base, base + " and a tail") > 0.9
    assert ph.Fingerprint(base).text == ph.Fingerprint(base).text != ph.Fingerprint(base + " ").text


def brute(texts):
    """Rows by id, nulls first, equal ids by text; each with the next one, the last with the first."""
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t == edited))
    return out


def test_next_rows_across_ranges(spark):
    draw = random.Random(12)
    texts = [(draw.randrange(-5000, 5000), prose(i, draw.randrange(60))) for i in range(300)] + [(7, "tie b"), (7, "tie a"), (7, "tie a")]
    rows = ph.fingerprint(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), "doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    assert got == sorted(b[:3] for b in brute(texts))
    for r in rows:
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
        assert 0 <= r.near_next <= 1


def test_awkward_empty_and_single(spark):
    rows = ph.fingerprint(awkward(spark), "doc_id", "text").collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=key) == sorted((b[:3] for b in brute(TEXTS)), key=key)
    twins = [r.fingerprint for r in rows if r.doc_id in (5, 6)]
    assert len(twins) == 3 and len(set(twins)) == 1
    assert ph.fingerprint(empty(spark), "doc_id", "text").count() == 0
    one = ph.fingerprint(awkward(spark, [(3, "alone here")]), "doc_id", "text").first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alone heal").hexdigest() or one.n_chars == 10
