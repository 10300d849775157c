import glob
import os
import time

import numpy as np
import pytest

from kadence.llm import boosted_trees, dom_boost as dom
from tests.llm.samples import prose

DATA = "/root/testdata/sf0.001/pages.parquet"


def page(seed, paragraphs=4, wrap="article"):
    body = "".join(f"<p>{prose(seed * 50 + k, 40)}." for k in range(paragraphs))
    return (
        f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul>"
        f"{''.join(f'<li><a href=/{k}>{prose(seed + k, 1)}</a></li>' for k in range(5))}</ul></nav><!-- x <p> -->"
        f"<div class='ad'>{prose(seed + 9, 6)}</div><{wrap}><h1>{prose(seed, 6)}</h1>{body}</{wrap}>"
        f"<footer>&copy; {prose(seed + 3, 5)}</footer></body></html>"
    )


def gold(seed, paragraphs=4):
    return "\n".join([prose(seed, 6), *(prose(seed * 50 + k, 40) + "." for k in range(paragraphs))])


@pytest.fixture(scope="module")
def model():
    return dom.train_on([page(s, 1 + s % 6) for s in range(60)])


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 5)).astype(np.float32)
    x[:, 4] = x[:, 4] > 0.5
    y = ((x[:, 0] > 0.5) ^ (x[:, 4] > 0)).astype(float)
    trees = boosted_trees.fit(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_parser_puts_up_with_markup():
    parsed = dom.parse("<p>a<b>b<p>c &amp; d</b><ul><li>x<li>y</ul><script>if (1<2) '</p>'</script>e < f<br>g<div>h")
    assert [n.tag for n in parsed.nodes] == ["#root", "p", "p", "ul", "li", "li", "script", "div"]
    keep = np.ones(len(parsed.nodes), bool)
    assert dom.text_of(parsed, keep) == "ab\nc & d\nx\ny\ne < f g\nh"
    for cut in range(0, 300, 7):
        dom.parse(page(1)[:cut])
    for broken in ("<", "<p", "</", "<!--", "<script>", "<a href='x", "</p></p>", "<p/>a", "&#x110000; &bogus;", "<td>a<tr>b"):
        dom.parse(broken)


def test_no_child_is_kept_under_a_dropped_parent(model):
    parsed = dom.parse(page(400))
    draw = np.random.default_rng(1)
    for _ in range(50):
        keep = dom.decode(parsed, draw.normal(size=len(parsed.nodes)))
        assert all(keep[n.parent] or not k for n, k in zip(parsed.nodes[1:], keep[1:], strict=True))


def test_unseen_pages(model):
    seeds = range(1000, 1060)
    got = model.extract([page(s, 1 + s % 5) for s in seeds])
    assert np.mean([g == gold(s, 1 + s % 5) for g, s in zip(got, seeds, strict=True)]) > 0.95


def test_pages_without_telling_elements(model):
    scores = []
    for s in range(2000, 2060):
        parsed = dom.parse(page(s))
        dom.label_nodes(parsed)
        other = dom._labelled_variant(parsed, s)
        keep = dom.decode(other, model.trees.margin(dom.node_features(other, model.vocabulary)))
        weight = np.array([n.chars for n in other.nodes])
        label = np.array([n.label for n in other.nodes], bool)
        scores.append(2 * weight[keep & label].sum() / max(1, weight[keep].sum() + weight[label].sum()))
    assert np.mean(scores) > 0.9


def test_rare_labelled_pages_are_drawn(spark, monkeypatch):
    """Six of 3000 pages label themselves, one of them in a third of all rows; comments and scripts label nothing."""
    plain = [page(s, 1, "div").replace("var a='", f"var a='<article>{s}<!-- <main> -->") for s in range(200)] * 10
    rare = [page(s, 1 + s) for s in range(5)] + [page(5, 2)] * 1000
    df = spark.createDataFrame([(h,) for h in plain + rare], "html string")
    drawn = []
    whole = dom.train_on
    monkeypatch.setattr(dom, "train_on", lambda htmls: drawn.append(htmls) or whole(htmls))
    model = dom.train(df, "html", sample=40)
    assert drawn[-1] == sorted(set(rare)) and len(model.trees.leaves)


def test_without_labelled_pages_made_ones_teach(spark):
    df = spark.createDataFrame([(s, page(s, 4, "div")) for s in range(30)], "page_id long, html string")
    rows = dom.extract(df, "html", dom.train(df, "html", sample=60), keep=("page_id",)).collect()
    shares = []
    for r in rows:
        wanted, got = set(gold(r.page_id).split()), set(r.text.split())
        shares.append(len(wanted & got) / len(wanted | got))
    assert np.mean(shares) > 0.7


def whole(html):
    parsed = dom.parse(html)
    return dom.text_of(parsed, np.ones(len(parsed.nodes), bool))


def test_quotes_open_strings_after_an_equals_sign_only():
    assert whole("<p title=don't>first words</p><p title=it's>second words</p>") == "first words\nsecond words"
    assert whole("""<p title="a>b" class='c>d' x = "e>f" y>one</p><a href=x=y>two</a>""") == "one\ntwo"
    assert whole("<p title='never closed>three</p>four") == "three\nfour"


def test_many_unclosed_elements_take_linear_time():
    n = 100_000
    for html in (
        "<i>" * n + "x" + "</b>" * n,
        "<i>" * n + "<div>x</div>" * n,
        "<h1>" * n + "<p>x</p>" * n,
        "<p><i>x" * n,
        "<ul><li>" * n + "x<li></li>" * n,
        "<div>" * n + "<td>x</td>" * n,
        "<p a='x" * n,
    ):
        start = time.perf_counter()
        dom.parse(html)
        assert time.perf_counter() - start < 20


def small_trees(n):
    """Parents of every tree of n nodes whose numbers go in page order."""
    if n == 1:
        yield [-1]
        return
    for parents in small_trees(n - 1):
        at = n - 2
        while at >= 0:
            yield [*parents, at]
            at = parents[at]


def test_decoding_finds_the_best_closed_choice():
    draw = np.random.default_rng(4)
    for parents in [p for n in range(1, 7) for p in small_trees(n)]:
        n = len(parents)
        nodes = [dom.Node("div", (), p, 0, chars=int(draw.integers(0, 50))) for p in parents]
        margins = draw.normal(size=n)
        gain = margins * np.array([1 + np.sqrt(x.chars) for x in nodes])
        best = max(
            sum(gain[i] for i in range(n) if bits >> i & 1)
            for bits in range(1, 1 << n, 2)
            if all(not bits >> i & 1 or bits >> parents[i] & 1 for i in range(1, n))
        )
        keep = dom.decode(dom.Page(nodes, []), margins)
        assert keep[0] and all(keep[parents[i]] for i in range(1, n) if keep[i])
        assert abs(gain[keep].sum() - best) < 1e-9


def test_given_pages(spark):
    df = spark.read.parquet(DATA)
    rows = dom.extract(df, "html", dom.train(df, "html", sample=40), keep=("page_id", "html")).collect()
    right = 0
    for r in rows:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        pieces = inner.replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        for tag in ("<h1>", "</h1>", "</p>"):
            pieces = pieces.replace(tag, "<p>")
        right += r.text == "\n".join(" ".join(dom.entities.unescape(p).split()) for p in pieces.split("<p>") if p.split())
    assert right >= 0.95 * len(rows) and os.path.exists(DATA) and glob.glob(DATA)


def test_awkward_and_empty(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (3, "no markup at all", "c"), (3, "no markup at all", "c"), (None, page(1), None), (5, page(2, 400), "e")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = dom.extract(df, "html", model, keep=("page_id",)).collect()
    assert len(got) == 6 and all(r.text == "" for r in got if r.page_id in (1, 2))
    assert [r.text for r in got if r.page_id is None] == [gold(1)]
    assert dom.extract(df.limit(0), "html", model, keep=("page_id",)).count() == 0
    untrained = dom.train(df.limit(0), "html")
    assert len(dom.extract(df, "html", untrained, keep=("page_id",)).collect()) == 6
