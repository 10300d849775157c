import random
import re

from kadence.llm import pii_bootstrap as pii
from tests.llm.samples import TEXTS, awkward, empty, prose

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    spans = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((kind, m.start(), m.end()))
    return spans


def test_base_spans_are_those_of_the_forms():
    draw = random.Random(4)
    known = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b@c-d.example.org", "x@y@z.co", "@a.b", "+1 (988) 555-2485", "1.2.3.4.5", "300.1.1.1"]
    for _ in range(4000):
        parts = [draw.choice([*known, "".join(draw.choice("a1@.+- ()é\n") for _ in range(draw.randrange(12)))]) for _ in range(3)]
        text = draw.choice(["", " "]).join(parts)
        assert pii.base_spans(text) == brute(text), text


def corpus():
    """Seeds that stand after telling words, strings of no known form after the same, and common words before both."""
    rows = []
    for i in range(40):
        rows.append(f"{prose(i, 30)} reach me at someone{i}@mail.example.com and the {prose(i + 100, 20)}")
        rows.append(f"{prose(i, 25)} the account tel:+1 (555) 010-{1000 + i} of the {prose(i + 200, 20)}")
    rows.append(f"{prose(7, 30)} reach me at 555-0134-77 today")
    rows.append(f"{prose(8, 30)} the account tel:0171/55512 of the year")
    rows.append(f"{prose(9, 30)} of the 20191231 year and the 123456 things, password=ab1234567")
    return list(enumerate(rows))


def test_patterns_discover_unseen_identifiers(spark):
    texts = corpus()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.extract(df, "doc_id", "text").collect()}
    found = {i: [texts[i][1][s.start : s.end] for s in r.found] for i, r in rows.items() if r.found}
    assert found == {80: ["555-0134-77"], 81: ["0171/55512"]}
    assert all([tuple(s) for s in rows[i].base] == brute(t) for i, t in texts)
    redacted = {r.doc_id: r.text for r in pii.redact(df, "text").collect()}
    assert "reach me at [ID] today" in redacted[80] and "tel:[ID] of" in redacted[81]
    assert "tel:[PHONE] of the" in redacted[1] and "at [EMAIL] and" in redacted[0]
    assert redacted[82] == texts[82][1]


def half_unseen():
    """Labels with 50% and 80% strings of no known form, and clean ones: no seeds, or seeds among many bare words."""
    rows = []
    for i in range(40):
        mixed = f"+1 (555) 010-{1000 + i}" if i % 2 else f"0171/5{5000 + 7 * i}"
        mostly = f"cust{i}@mail.example.com" if i % 5 == 0 else f"DE{4400000 + 31 * i}X{i}"
        rows.append(f"{prose(i, 12, 900)} tel: {mixed} {prose(i + 300, 9, 900)}")
        rows.append(f"{prose(i + 50, 12, 900)} account no {mostly} {prose(i + 400, 9, 900)}")
        rows.append(f"{prose(i + 100, 12, 900)} founded: {1900 + i} {prose(i + 500, 9, 900)}")
        plain = [f"+1 (555) 020-{1000 + i}", f"{7000 + i}", "tomorrow", "nobody"][i % 4]
        rows.append(f"{prose(i + 150, 12, 900)} note: {plain} {prose(i + 600, 9, 900)}")
    return list(enumerate(rows))


def test_labels_with_many_unseen_identifiers(spark):
    texts = half_unseen()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][1][s.start : s.end] for s in r.found] for r in pii.extract(df, "doc_id", "text").collect() if r.found}
    tel = {4 * i: [f"0171/5{5000 + 7 * i}"] for i in range(0, 40, 2)}
    account = {4 * i + 1: [f"DE{4400000 + 31 * i}X{i}"] for i in range(40) if i % 5}
    assert found == tel | account


#: After the mark: what follows the label, and the string in it that must be found.
BRACKETED = [
    ("tel: ", "(555) 123-4567", "(555) 123-4567"),
    ("tel: ", "((555) 123 4568).", "(555) 123 4568"),
    ("tel: ", '"0171/55512"', "0171/55512"),
    ("tel: ", "“0171 555 13”", "0171 555 13"),
    ("tel: ", "01719 555 +1 (555) 010-7777", "01719 555"),
    ("mail: ", "<4455667>", "4455667"),
    ("mail: ", "[(4455668)]", "4455668"),
    ("ip:", "(host-1234)", "host-1234"),
    ('"phone":', '"0171-55514"', "0171-55514"),
]


def test_identifiers_in_brackets_and_quotes(spark):
    """Seeds in such places teach, and strings of unknown form in them are found, whole."""
    rows = []
    for i in range(12):
        seeds = (f"tel: (+1 (555) 010-{1000 + i})", f"mail: <bob{i}@x.example.com>", f"ip:10.0.0.{i}:8080", f'"phone":"+1 555 010 {2000 + i}"')
        rows += [f"{prose(40 * i + k, 8, 900)} {seed} {prose(40 * i + k + 20, 6, 900)}" for k, seed in enumerate(seeds)]
    planted = {len(rows) + k: [gold] for k, (_, _, gold) in enumerate(BRACKETED)}
    rows += [f"{prose(900 + k, 8, 900)} {label}{form} {prose(950 + k, 6, 900)}" for k, (label, form, _) in enumerate(BRACKETED)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [rows[r.doc_id][s.start : s.end] for s in r.found] for r in pii.extract(df, "doc_id", "text").collect() if r.found}
    assert found == planted
    redacted = {r.doc_id: r.text for r in pii.redact(df, "text").collect()}
    assert all(redacted[i] == rows[i].replace("+1 (555) 010-7777", "[PHONE]").replace(gold, "[ID]") for i, (gold,) in planted.items())


def test_labels_are_counted_wherever_they_lead():
    """What patterns_before reads is what _contexts_of counts, also in words of many marks and beyond REACH."""
    for text in ("a ip:10.0.0.1:8080 b", 'x {"tel":("12345") y', "q=" + "z" * 400 + "=12345 b", "no: <12345> b", "say to me ((12345)) b"):
        start = text.index("12345") if "12345" in text else text.index("10.0")
        led = pii.patterns_before(text, start)
        assert led and set(led) <= set(pii._contexts_of(text, None)), text


def test_rounds_go_on_until_no_pattern_is_added(spark):
    """Each pattern knows the next one by three strings only, so every round adds one."""
    rows = [("p0", f"seed{i}", True, 1) for i in range(400)]
    for k in range(7):
        rows += [(f"p{k}", f"s{k}-{i}", False, 1) for i in range(3)] + [(f"p{k + 1}", f"s{k}-{i}", False, 200) for i in range(3)]
    edges = spark.createDataFrame(rows, "pattern string, instance string, seed boolean, times int")
    contexts = edges.selectExpr("pattern", "instance", "seed", "explode(sequence(1, times)) as k").drop("k")
    trusted = pii.confident_patterns(contexts, contexts.groupBy("pattern").count().withColumnRenamed("count", "total"))
    assert sorted(r.pattern for r in trusted.collect()) == [f"p{k}" for k in range(8)]


def test_redaction_is_the_same_when_patterns_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([*corpus(), (900, None), (901, "")], "doc_id long, text string")
    held = sorted((r.doc_id, r.text) for r in pii.redact(df, "text").collect() if r.text)
    monkeypatch.setattr(pii, "HELD_PATTERNS", -1)
    assert sorted((r.doc_id, r.text) for r in pii.redact(df, "text").collect() if r.text) == held


def test_overlapping_spans_are_replaced_as_one():
    assert pii.redact_text("ab 12345 cd", [("ip", 3, 6), ("card", 5, 8)]) == "ab [IP] cd"
    assert pii.redact_text("abc", []) == "abc"


def test_awkward_and_empty(spark):
    df = awkward(spark, [*TEXTS, (9, "a@b.co"), (9, "a@b.co")])
    rows = pii.digest(df, "doc_id", "text").collect()
    assert len(rows) == len(TEXTS) + 2 and sum(r.n_email for r in rows) == 2
    assert {r.spans for r in rows} == {"", "email:0:6"}
    assert pii.redact(df, "text").columns == df.columns
    assert sorted(str(r.text) for r in pii.redact(df, "text").collect())[:1] == ["", ]
    assert pii.digest(empty(spark), "doc_id", "text").count() == 0
    assert pii.redact(empty(spark), "text").count() == 0


def test_long_numbers_and_runs(spark):
    texts = ["1.2.3." + "5" * 6000, "0001.2.03." + "0" * 5000 + "9 x", "7" * 5_000_000, " " * 5_000_000, "\n" * 5_000_000 + "a@b.cd", "1.2.3.256"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digest(df, "doc_id", "text").collect()}
    assert [rows[i].n_ip for i in range(6)] == [0, 1, 0, 0, 0, 0] and rows[4].n_email == 1
    assert pii.redact(df, "text").count() == len(texts)
