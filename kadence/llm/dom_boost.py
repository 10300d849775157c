"""Main text of web pages by boosted trees over DOM nodes.

A page is parsed into block elements. Each has features of its own: depth, place
among its siblings and in the page, text and link density of its subtree, its tag,
and the words of its class, id and role. A gradient-boosted model gives each node
the odds of belonging to the article. Decoding is hierarchical: a node is kept only
under kept ancestors, and of all such choices the one with the highest total odds
is taken, from the leaves up.

No page comes with labels. A bounded sample of pages is labelled by its own
semantic elements (``article`` or ``main`` against ``nav``, ``aside``, ``footer``
and the like) and varied: the elements lose their telling names, or get others that
sites use, and the parts that pages carry around an article are added with the
page's own words. Each sampled page so teaches both with and without the markup.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadence.llm.batches import slices
from kadence.llm.boosted_trees import BoostedTrees, fit
from kadence.llm.shipping import ship

#: Pages the model is fitted on (about that many), the longest of them in characters, and variants made of each.
SAMPLE, SAMPLE_CHARS, VARIANTS = 200, 200_000, 4
ATTRIBUTE_WORDS, MIN_PAGES = 96, 3

INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("head script style template noscript iframe svg math canvas object textarea select button title".split())
_RAW = {tag: re.compile(rf"</{tag}[\s>/]|</{tag}\Z", re.I) for tag in ("script", "style", "textarea", "title")}
#: An opening tag ends open elements of these kinds, up to the given fences.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: A quote opens a string only after an equals sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Kinds of tags that features tell apart.
TAGS = (
    "article main section div p h1 h2 h3 h4 ul ol li dl dt dd table tr td blockquote pre figure figcaption"
    " nav header footer aside form fieldset address details"
).split()
_TAG_AT = {tag: i for i, tag in enumerate(TAGS)}
NUMBERS = (
    "depth siblings sibling_index same_tag_share children own_chars subtree_chars link_density density"
    " start end words_per_block sentence_marks parent_share parent_link_density subtree_nodes tag_repeats_above"
).split()


@dataclass
class Node:
    tag: str
    words: tuple[str, ...]
    parent: int
    depth: int
    end: int = 0  # one past the last node of the subtree, in page order
    chars: int = 0
    links: int = 0
    marks: int = 0
    label: int | None = None
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    #: (node, block, text) in page order; a block ends where a block element begins or ends.
    texts: list[tuple[int, int, str]]


def _attribute_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    values = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
    return tuple(dict.fromkeys(w.lower() for w in _WORD.findall(values)))


def parse(html: str) -> Page:
    """Block elements and texts of a page. Unclosed, crossing and cut-off tags are put up with."""
    nodes = [Node("#root", (), -1, 0)]
    texts: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: tag and their block node
    opened = Counter()  # how many of each tag are open
    blocks = [0]  # places of the open block elements in the stack
    runs = [Counter()]  # open inline elements after each of them
    skipping, links, block, at = 0, 0, 0, 0

    def close(to: int) -> None:
        nonlocal block, skipping, links
        while len(stack) > to:
            tag, node = stack.pop()
            opened[tag] -= 1
            skipping -= tag in SKIPPED
            links -= tag == "a"
            if tag in INLINE:
                runs[-1][tag] -= 1
            else:
                nodes[node].end = len(nodes)
                block += 1
                blocks.pop()
                runs.pop()

    def text(raw: str) -> None:
        if not raw or skipping:
            return
        value = entities.unescape(raw) if "&" in raw else raw
        node = stack[-1][1]
        texts.append((node, block, value))
        n = len(value) - value.count(" ") if value.strip() else 0
        nodes[node].chars += n
        if links:
            nodes[node].links += n
        nodes[node].marks += value.count(".") + value.count(",")

    position = 0
    while True:
        found = _TOKEN.search(html, position)
        if not found:
            text(html[position:])
            break
        text(html[position : found.start()])
        position = found.end()
        closing, tag, attributes = found[1], found[2], found[3] or ""
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            # An inline end does not reach over a block. The walk ends what it passes, so no element is passed twice.
            if runs[-1][tag] if tag in INLINE else opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag == "br":
            text(" ")
        if tag in VOID:
            block += tag == "hr"
            continue
        if tag not in INLINE and opened["p"]:
            _end_paragraph(stack, blocks, close)
        if tag in _CLOSES and any(opened[t] for t in _CLOSES[tag][0]):
            ends, fences = _CLOSES[tag]
            to = len(stack)
            for i in reversed(blocks):
                if stack[i][0] in fences:
                    break
                if stack[i][0] in ends:
                    to = i
            close(to)
        at = stack[-1][1]
        if tag not in INLINE:
            nodes[at].children.append(len(nodes))
            nodes.append(Node(tag, _attribute_words(attributes), at, nodes[at].depth + 1))
            at = len(nodes) - 1
            block += 1
            blocks.append(len(stack))
            runs.append(Counter())
        else:
            runs[-1][tag] += 1
        opened[tag] += 1
        stack.append((tag, at))
        skipping += tag in SKIPPED
        links += tag == "a"
        if tag in _RAW:
            ended = _RAW[tag].search(html, position)
            inner_end = ended.start() if ended else len(html)
            position = inner_end
    close(0)
    nodes[0].end = len(nodes)
    return Page(nodes, texts)


def _end_paragraph(stack: list[tuple[str, int]], blocks: list[int], close) -> None:
    """A block element ends an open paragraph, and the inline elements in it."""
    for i in reversed(blocks):
        tag = stack[i][0]
        if tag == "p":
            close(i)
            return
        if tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return


def node_features(page: Page, vocabulary: dict[str, int]) -> np.ndarray:
    """One row per node: numbers, tag, words of its attributes, tags and words of its ancestors, tag of its parent."""
    nodes = page.nodes
    n = len(nodes)
    chars, links = np.zeros(n), np.zeros(n)
    marks, blocks = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        chars[i], links[i], marks[i], blocks[i] = node.chars, node.links, node.marks, node.chars > 0
    own = chars.copy()
    for i in range(n - 1, 0, -1):
        parent = nodes[i].parent
        chars[parent] += chars[i]
        links[parent] += links[i]
        marks[parent] += marks[i]
        blocks[parent] += blocks[i]
    before = np.concatenate([[0.0], np.cumsum(own)])
    total = max(1.0, before[-1])
    v = len(vocabulary)
    x = np.zeros((n, len(NUMBERS) + 3 * len(TAGS) + 2 * v), np.float32)
    tags_at = len(NUMBERS)
    words_at = tags_at + len(TAGS)
    above_at = words_at + v
    parent_at = above_at + len(TAGS) + v
    for i, node in enumerate(nodes):
        parent = nodes[node.parent] if i else node
        siblings = parent.children if i else [0]
        size = node.end - i
        link_density = links[i] / chars[i] if chars[i] else 0.0
        above = node.parent if i else 0
        x[i, :tags_at] = (
            node.depth,
            len(siblings),
            x[i, 2],
            x[i, 3],
            len(node.children),
            np.log1p(own[i]),
            np.log1p(chars[i]),
            link_density,
            chars[i] / size,
            before[i] / total,
            before[node.end] / total,
            chars[i] / max(1.0, blocks[i]),
            100 * marks[i] / max(1.0, chars[i]),
            chars[i] / max(1.0, chars[above]),
            links[above] / max(1.0, chars[above]),
            np.log1p(size),
            node.tag == parent.tag,
        )
        if node.children:
            kinds = Counter(nodes[c].tag for c in node.children)
            for k, c in enumerate(node.children):
                x[c, 2] = k / len(node.children)
                x[c, 3] = kinds[nodes[c].tag] / len(node.children)
        if node.tag in _TAG_AT:
            x[i, tags_at + _TAG_AT[node.tag]] = 1
        for word in node.words:
            if word in vocabulary:
                x[i, words_at + vocabulary[word]] = 1
        if i:
            x[i, above_at:parent_at] = np.maximum(x[above, above_at:parent_at], x[above, tags_at:above_at])
            x[i, parent_at:] = x[above, tags_at:words_at]
    return x


def decode(page: Page, margins: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the closed set with the highest sum of log odds, weighted by the nodes' own text."""
    nodes = page.nodes
    gain = margins * np.array([1 + np.sqrt(node.chars) for node in nodes])
    best = gain.copy()
    for i in range(len(nodes) - 1, 0, -1):
        best[nodes[i].parent] += max(0.0, best[i])
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
    return keep


def text_of(page: Page, keep: np.ndarray) -> str:
    """Kept text: a line per block, white space within it as one space."""
    lines: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if keep[node]:
            lines.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in lines.values())
    return "\n".join(line for line in joined if line)


# Names that sites give to parts of a page.
ARTICLE_NAMES = "article post entry content main story body text page detail single prose column".split()
OTHER_NAMES = {
    "menu": "nav navigation navbar menu topbar toolbar breadcrumb breadcrumbs pagination pager".split(),
    "header": "header masthead branding logo top banner".split(),
    "footer": "footer copyright legal bottom colophon imprint".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending tags archive".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay message disclaimer".split(),
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion".split(),
    "form": "form search login signup newsletter subscribe contact".split(),
    "comments": "comment comments reply replies discussion respond disqus thread".split(),
    "share": "share social follow".split(),
}
_SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
_BOILERPLATE_TAGS = frozenset("nav aside footer form".split())


def label_nodes(page: Page) -> bool:
    """Labels by semantic elements or by the names of this module; False if the page has no article."""
    nodes = page.nodes
    roots = [i for i, node in enumerate(nodes) if node.tag in ("article", "main")]
    if not roots:
        return False
    other = frozenset(w for names in OTHER_NAMES.values() for w in names)
    for i, node in enumerate(nodes):
        inside = any(r <= i < nodes[r].end for r in roots)
        above = any(i < r < node.end for r in roots)
        bad = node.tag in _BOILERPLATE_TAGS or bool(other.intersection(node.words)) and node.tag not in ("article", "main", "body", "html")
        under_bad = i > 0 and nodes[node.parent].label == 0 and not above
        node.label = int((inside or above) and not (bad or under_bad))
    return True


def _names(draw: random.Random, names: list[str]) -> str:
    kind = draw.random()
    if kind < 0.15:
        return ""
    word = draw.choice(names)
    if kind < 0.5:
        return f' class="{word}"'
    if kind < 0.7:
        return f' id="{word}"'
    return f' class="{word}-{draw.choice(["box", "wrap", "inner", "block", "area", "list", "left", "item"])}"'


def variant(page: Page, seed: int) -> str | None:
    """A page of the same article with other markup and other surroundings; labelled by ``data-part``."""
    draw = random.Random(seed)
    article = [(n, b, t) for n, b, t in page.texts if page.nodes[n].label == 1]
    words = " ".join(t for _, _, t in page.texts).split()
    if not article or len(words) < 5:
        return None
    blocks: dict[int, tuple[str, list[str]]] = {}
    for node, block, text in article:
        blocks.setdefault(block, (page.nodes[node].tag, []))[1].append(text)
    paragraphs = []
    for tag, parts in blocks.values():
        inner = entities.escape(" ".join("".join(parts).split()), quote=False)
        if inner:
            tag = tag if tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre") else draw.choice(["p", "p", "div"])
            paragraphs.append(f"<{tag}>{inner}</{tag}>" if tag != "li" else f"<ul><li>{inner}</li></ul>")

    def phrase(low: int, high: int) -> str:
        start = draw.randrange(len(words))
        return entities.escape(" ".join(words[start : start + draw.randint(low, high)]) or words[0], quote=False)

    def linked(n: int) -> str:
        return "".join(f'<li><a href="#">{phrase(1, 5)}</a></li>' for _ in range(n))

    def part(kind: str) -> str:
        if kind in ("menu", "share"):
            inner = f"<ul>{linked(draw.randint(2, 9))}</ul>"
        elif kind == "sidebar":
            inner = f"<h3>{phrase(1, 4)}</h3>" + draw.choice([f"<ul>{linked(draw.randint(2, 8))}</ul>", f"<p>{phrase(4, 40)}</p>"])
        elif kind == "form":
            inner = f"<label>{phrase(1, 4)}</label><input type=text><p>{phrase(1, 12)}</p>"
        elif kind == "comments":
            one = lambda: f"<div{_names(draw, OTHER_NAMES[kind])}><h4>{phrase(1, 3)}</h4><p>{phrase(5, 50)}</p></div>"
            inner = f"<h3>{phrase(1, 3)}</h3>" + "".join(one() for _ in range(draw.randint(1, 4)))
        else:
            inner = draw.choice([f"<p>{phrase(2, 30)}</p>", phrase(2, 20), f'{phrase(2, 10)} <a href="#">{phrase(1, 3)}</a>'])
        tag = _SEMANTIC.get(kind, "div") if draw.random() < 0.5 else draw.choice(["div", "section", "div"])
        names = _names(draw, OTHER_NAMES[kind])
        if tag in ("div", "section") and not names and kind not in ("menu", "share"):
            names = f' class="{draw.choice(OTHER_NAMES[kind])}"'
        return f'<{tag}{names} data-part="0">{inner}</{tag}>'

    def some(kinds: list[str], chance: float) -> str:
        return "".join(part(k) for k in kinds if draw.random() < chance)

    if len(paragraphs) > 2 and draw.random() < 0.5:
        paragraphs.insert(draw.randrange(1, len(paragraphs)), part(draw.choice(["advert", "share", "sidebar", "notice", "form"])))
    if draw.random() < 0.4:
        paragraphs.append(part(draw.choice(["comments", "share", "sidebar", "footer"])))
    tag = draw.choice(["article", "main", "section", "div", "div", "div", "td"])
    core = f'<{tag}{_names(draw, ARTICLE_NAMES)} data-part="1">{"".join(paragraphs)}</{tag}>'
    if tag == "td":
        core = f"<table><tr>{core}</tr></table>"
    if draw.random() < 0.4:
        core = f"<div{_names(draw, ARTICLE_NAMES)}>{core}</div>"
    before = some(["notice", "header", "menu", "advert", "form"], 0.5)
    after = some(["share", "comments", "sidebar", "advert", "notice", "footer"], 0.5)
    if draw.random() < 0.3:
        core = f'<div class="{draw.choice(["row", "container", "wrapper", "layout"])}">{some(["sidebar"], 0.7)}{core}</div>'
    return f"<html><body>{before}{core}{after}</body></html>"


_PART = re.compile(r'<(\w+)([^>]*) data-part="([01])">')


def _labelled_variant(page: Page, seed: int) -> Page | None:
    made = variant(page, seed)
    if not made:
        return None
    # Marks become attribute words for one parse, then labels.
    marked = parse(_PART.sub(lambda m: f'<{m[1]}{m[2]} role="part{"zero one".split()[int(m[3])]}">', made))
    for i, node in enumerate(marked.nodes):
        above = marked.nodes[node.parent].label if i else None
        if "partzero" in node.words or above == 0:
            node.label = 0
        elif "partone" in node.words or above == 1:
            node.label = 1
        node.words = tuple(w for w in node.words if w not in ("partzero", "partone"))
    for i in range(len(marked.nodes) - 1, 0, -1):
        node = marked.nodes[i]
        parent = marked.nodes[node.parent]
        if node.label == 1 and parent.label is None:
            parent.label = 1
    for node in marked.nodes:
        node.label = node.label or 0
    return marked


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    trees: BoostedTrees

    def extract(self, htmls: Iterable[str]) -> list[str]:
        """Main text of each page."""
        pages = [parse(h) for h in htmls]
        if not pages:
            return []
        margins = self.trees.margin(np.concatenate([node_features(p, self.vocabulary) for p in pages]))
        ends = np.cumsum([len(p.nodes) for p in pages])
        parts = np.split(margins, ends[:-1])
        return [text_of(p, decode(p, m)) for p, m in zip(pages, parts, strict=True)]


def train_on(htmls: list[str], seed: int = 0) -> Model:
    """A model from raw pages; pages without semantic elements teach nothing."""
    pages = []
    for k, html in enumerate(htmls):
        page = parse(html)
        if label_nodes(page):
            pages.append(page)
            pages += filter(None, (_labelled_variant(page, seed + k * VARIANTS + v) for v in range(VARIANTS)))
    seen = Counter(w for page in pages for w in {w for node in page.nodes for w in node.words})
    common = sorted((w for w, n in seen.items() if n >= MIN_PAGES), key=lambda w: (-seen[w], w))[:ATTRIBUTE_WORDS]
    vocabulary = {w: i for i, w in enumerate(common)}
    if not pages:
        return Model({}, BoostedTrees(1.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2))))
    x = np.concatenate([node_features(p, vocabulary) for p in pages])
    y = np.array([node.label for p in pages for node in p.nodes], float)
    weight = np.array([1 + np.log1p(node.chars) for p in pages for node in p.nodes])
    return Model(vocabulary, fit(x, y, weight))


def made_pages(n: int, seed: int = 0) -> list[str]:
    """Pages of invented words with an article among a menu, notes and a footer, for want of pages to learn from."""
    draw = random.Random(seed)

    def words(low: int, high: int) -> str:
        one = lambda: "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
        return " ".join(one() for _ in range(draw.randint(low, high)))

    pages = []
    for _ in range(n):
        menu = "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(draw.randint(3, 9)))
        body = "".join(f"<p>{words(15, 80)}, {words(5, 40)}. {words(8, 30)}.</p>" for _ in range(draw.randint(1, 9)))
        pages.append(
            f"<html><body><nav><ul>{menu}</ul></nav><article><h1>{words(2, 8)}</h1>{body}</article>"
            f"<aside><h3>{words(1, 4)}</h3><p>{words(4, 20)}</p></aside><footer>{words(3, 12)}</footer></body></html>"
        )
    return pages


#: Fixed: what may name an element without being one, and the elements that label a page.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1"
_LABELS = r"(?i)<(article|main)[\s/>]"


def train(df: DataFrame, html_col: str, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` different pages that label themselves, drawn by content among all such pages.

    Tasks send the drawn pages only, each once. A table that has pages, but none with an article or main element
    to learn from, gets a model fitted on made pages; without any page there is nothing to learn or to extract.
    """
    ship(df.sparkSession)
    pages = df.select(F.col(f"`{html_col}`").alias("html_")).filter(F.length("html_") > 0)
    labelled = pages.filter((F.length("html_") <= SAMPLE_CHARS) & F.col("html_").rlike(_LABELS))
    labelled = labelled.filter(F.regexp_replace("html_", _HIDDEN, " ").rlike(_LABELS))
    spot = F.xxhash64("html_", F.lit(7))
    n = labelled.select(spot.alias("spot_")).distinct().count()
    model, wanted = train_on([]), sample
    # A draw can come out empty by chance, or hold elements that the parser does not see: draw more, within bounds.
    while n and not len(model.trees.leaves) and wanted < 32 * sample:
        share = int((1 << 30) * min(1.0, wanted / n))
        drawn = labelled.filter(F.pmod(spot, F.lit(1 << 30)) < share).distinct()
        model = train_on(sorted(r.html_ for r in drawn.collect()))
        wanted = 2 * wanted if wanted < n else 32 * sample
    if not len(model.trees.leaves) and not pages.isEmpty():
        model = train_on(made_pages(sample))
    return model


def extract(df: DataFrame, html_col: str, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and the page's main text as ``text``.

    A null or empty page has the empty text; repeated rows give equal texts; an empty table gives no rows.
    """
    ship(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html_in_"))
    schema = type(rows.schema)([*rows.schema.fields[:-1]]).add("text", "string")
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by ATTRIBUTE_WORDS and TREES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = shared.value.extract(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
