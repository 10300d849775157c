import re

from kadence.llm import host_rules
from tests.llm.samples import TEXTS, awkward, empty, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {i + d for i, w in enumerate(windows) if times[w] > 1 for d in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(spark):
    texts = [*TEXTS, (20, "a b a b a b\na b a\n\na b a\n \n"), (21, "x\n" * 5), (22, "# <b> $5 & | x"), (23, prose(1, 400, 9)), (24, "a a a a")]
    rows = host_rules.document_measures(awkward(spark, texts), "doc_id", "text", "source").collect()
    assert sorted((str(r.id_), *(r[m] for m in MEASURES)) for r in rows) == sorted((str(i), *brute(t)) for i, t in texts)


def hosts(spark):
    good, bad = prose(1, 60), "too short"
    rows = [(i, bad if i % 20 else good, "spam") for i in range(200)]
    rows += [(1000 + i, good if i % 20 else bad, "news") for i in range(200)]
    rows += [(2000, bad, "small"), (2001, good, None), (2002, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_hosts_that_fail_lose_their_documents(spark):
    rows = {r.doc_id: r for r in host_rules.apply_rules(hosts(spark), "doc_id", "text", "source").collect()}
    assert len(rows) == 403
    assert rows[0].host_failed and not rows[0].base_failed and not rows[0].kept
    assert rows[1001].kept and rows[2001].kept
    assert not rows[1000].kept and rows[1000].base_failed and not rows[1000].host_failed
    kept = {r.doc_id for r in host_rules.keep_documents(hosts(spark), "doc_id", "text", "source").collect()}
    assert kept == {i for i, r in rows.items() if r.kept}


def test_hosts_that_fail_in_part(spark):
    """Hosts of 40 to 80 per cent are rejected among twenty good ones; few documents or a lower rate are no proof."""
    good, bad = prose(1, 60), "too short"
    lined = prose(2, 60) + "\n" + "same line again\n" * 9
    rows, planted = [], {"h40": (40, bad), "h60": (60, bad), "h80": (80, bad), "lines": (50, lined), "h15": (15, bad)}
    for k in range(20):
        rows += [(len(rows) + i, bad if i % 16 == 0 else good, f"good{k}") for i in range(100)]
    for host, (failing, text) in planted.items():
        rows += [(len(rows) + i, text if i < failing else good, host) for i in range(100)]
    rows += [(len(rows) + i, bad if i < 2 else good, "few") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measures = host_rules.document_measures(df, "doc_id", "text", "source")
    failed = {r.host_: r.host_failed_rules for r in host_rules.host_verdicts(measures).collect() if r.host_failed}
    assert failed == {"h40": ["short"], "h60": ["short"], "h80": ["short"], "lines": ["dup_lines"]}


def test_rates_are_shrunk_towards_the_common_rate(spark):
    measures = host_rules.document_measures(hosts(spark), "doc_id", "text", "source")
    rates = {r.host_: r.short_rate for r in host_rules.host_rates(measures).collect()}
    assert 0.9 < rates["spam"] < 0.96 and 0.04 < rates["news"] < 0.1
    assert 0.5 < rates["small"] < 1.0  # one failure of one is no certainty


def test_awkward_and_empty(spark):
    df = awkward(spark)
    assert host_rules.apply_rules(df, "doc_id", "text", "source").count() == len(TEXTS)
    kept = host_rules.keep_documents(df, "doc_id", "text", "source")
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == []
    assert host_rules.apply_rules(empty(spark), "doc_id", "text", "source").count() == 0
    assert host_rules.keep_documents(empty(spark), "doc_id", "text", "source").count() == 0


def test_no_python_in_the_plan(spark):
    plan = host_rules.apply_rules(hosts(spark), "doc_id", "text", "source")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
