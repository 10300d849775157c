from pyspark.sql import functions as F

from kadence.llm import warc_fixity as wf
from tests.llm.samples import LONG

SCHEMA = "page_id long, url string, html string, segment string, offset long, sha256 string, node long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


ROWS = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 700)) for i in range(0, 40_000, 37)]
ROWS += [(None, None, None), (5, "u", ""), (5, "u", ""), (6, "u", LONG)]


def archive(spark, rows):
    return wf.archive(pages(spark, rows), "page_id", "url", "html")


def test_offsets_and_record_bytes(spark):
    rows = sorted(archive(spark, ROWS).collect(), key=lambda r: (r.segment, r.offset))
    assert len(rows) == len(ROWS)
    for a, b in zip(rows, rows[1:], strict=False):
        assert b.offset == (a.offset + a.length if a.segment == b.segment else 0)
    one = pages(spark, [(1, "u", "é")]).select(wf.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).first().r
    assert bytes(one).endswith(b"Content-Length: 2\r\n\r\n\xc3\xa9\r\n\r\n")


def test_corrupt_records_are_located(spark):
    bad = {37 * 3, 37 * 500, 37 * 1000}
    other = [(i, u, "X" + h[1:] if i in bad else h) for i, u, h in ROWS]
    found = wf.compare(archive(spark, ROWS), archive(spark, other)).collect()
    assert {(r.record_id, r.status) for r in found} == {(i, "corrupt") for i in bad}


def test_missing_and_extra_records(spark):
    last = max(i for i, _, _ in ROWS if i is not None)
    shorter = [r for r in ROWS if r[0] != last]
    found = wf.compare(archive(spark, ROWS), archive(spark, shorter)).collect()
    assert [(r.record_id, r.status) for r in found] == [(last, "missing")]
    found = wf.compare(archive(spark, shorter), archive(spark, ROWS)).collect()
    assert [(r.record_id, r.status) for r in found] == [(last, "extra")]
    found = wf.compare(archive(spark, ROWS[:1]), archive(spark, [])).collect()
    assert [(r.record_id, r.status) for r in found] == [(0, "missing")]


def test_equal_replicas_have_equal_roots(spark):
    a, b = archive(spark, ROWS), archive(spark, ROWS[::-1])
    heights = wf.shared_heights(a, b)
    x, y = wf.build_tree(a, heights), wf.build_tree(b, heights)
    assert wf.audit(x, y).count() == 0
    assert sorted(r.hash for r in wf.root_hash(x).collect()) == sorted(r.hash for r in wf.root_hash(y).collect())
    assert len(x.levels) > 3


def test_ids_far_apart(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in (0, 3, 10**6, 10**12, 10**15)]
    other = [(i, u, "X" + h[1:] if i == 10**12 else h) for i, u, h in rows if i != 3] + [(10**15 + 1, "u", "new")]
    found = wf.compare(archive(spark, rows), archive(spark, other)).collect()
    assert {(r.record_id, r.status) for r in found} == {(3, "missing"), (10**12, "corrupt"), (10**15 + 1, "extra")}


def test_plans_do_not_grow_with_the_height(spark):
    def joins(ids):
        a, b = (archive(spark, [(i, "u", h) for i in ids]) for h in ("x", "y"))
        return wf.compare(a, b)._jdf.queryExecution().optimizedPlan().toString().count("Join")

    assert joins([0, 10**4]) == joins([0, 10**15]) < 10


def test_empty_archives(spark):
    assert wf.compare(archive(spark, []), archive(spark, [])).count() == 0
