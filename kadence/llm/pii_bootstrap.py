"""Personal data: fixed formats first, then formats learned from where they stand.

Four kinds are found by their form (email, ip, card, phone). Their spans are the
seeds. A lexical pattern is what stands before an identifier: the two words there,
or a label such as ``tel:`` that ends in a mark or touches it. Patterns and the
identifier-like strings after them form a graph, which Spark scores by turns until
no pattern is added: a pattern by its occurrences in the whole corpus that lead to
known identifiers, against those that no such string follows; a string by its best
patterns. Strings of unknown status say little about a pattern that leads to seeds.
Strings that are no seed but follow patterns of high confidence are found in the end.
Common words are no danger: they occur far more often than identifiers follow them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadence.llm.batches import slices
from kadence.llm.shipping import ship
from kadence.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans that patterns discover.
FOUND = "id"
#: Distinct strings a pattern must lead to, and the score from which it is trusted.
MIN_SUPPORT, CONFIDENT = 3, 0.7
#: Weight against a pattern of a string that may or may not be an identifier; 1 for patterns of too few seeds.
UNKNOWN = 0.02
#: Digits of an identifier-like string.
MIN_DIGITS = 4
#: Patterns that tasks hold while they count occurrences; beyond it all contexts are counted and joined.
HELD_PATTERNS = 200_000
#: Characters before an identifier in which its two words are sought.
REACH = 200

# Fixed: the forms of the four kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where its digits do; saying so keeps a long number from being tried at each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGES = ".,;:!?()[]{}<>\"'“”«»"
_QUOTES = "[{<\"'“”«»"
_OPENING = "(" + _QUOTES
_NUMERIC = re.compile(r"[0-9+(][0-9().+/-]*\Z")
_LABEL_MARKS = ":=#"
_MARK = re.compile(f"[{_LABEL_MARKS}]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs: a local part reaches back as far as its letters go."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; ends exclusive, in code points."""
    spans = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(_is_byte(part) for part in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def patterns_before(text: str, start: int) -> list[str]:
    """The patterns that lead to ``start``: a label that touches or precedes it, and the two words before.

    Brackets and quotes that open before it are stepped over.
    """
    while start and text[start - 1] in _OPENING:
        start -= 1
    before = text[max(0, start - REACH) : start].lower()
    words = before.split()
    touching = bool(before) and not before[-1].isspace()
    if touching:
        return [f"touching {words[-1]}"] if words[-1][-1] in _LABEL_MARKS else []
    found = []
    if words and words[-1][-1] in _LABEL_MARKS:
        found.append(f"label {words[-1]}")
    if len(words) > 1 and (start <= REACH or len(words) > 2):
        found.append(f"words {words[-2]} {words[-1]}")
    return found


def identifier_like(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Strings with enough digits outside the spans already taken; numbers in groups are one string."""
    busy = sorted((s, e) for _, s, e in taken)
    end, i = 0, 0
    for m in _DIGIT.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _token_end(text, m.start())
        inner = max(text.rfind(c, start, m.start()) for c in "=:#") + 1
        start = max(start, inner)
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        group = text[start:end].lstrip(_QUOTES)
        while _NUMERIC.match(group) and text[end : end + 1] == " ":
            following = _token_end(text, end + 1)
            group = text[end + 1 : following]
            # A span that is taken is no further group of this number.
            if not _NUMERIC.match(group.rstrip(_EDGES) or "x") or any(s < following for s, _ in busy[i : i + 1]):
                break
            end = following
        a, b = _inside_edges(text, start, end)
        free = i == len(busy) or busy[i][0] >= b
        if free and sum("0" <= c <= "9" for c in text[a:b]) >= MIN_DIGITS:
            yield a, b


def _inside_edges(text: str, a: int, b: int) -> tuple[int, int]:
    """The range without marks at its edges; a round bracket stays where its partner lies inside."""
    opened: list[int] = []
    partner: dict[int, int] = {}
    for k in range(a, b) if text.find("(", a, b) >= 0 else ():
        if text[k] == "(":
            opened.append(k)
        elif text[k] == ")" and opened:
            partner[k] = opened.pop()
            partner[partner[k]] = k
    while a < b and (text[a] in _EDGES or text[b - 1] in _EDGES):
        if text[b - 1] in _EDGES and partner.get(b - 1, a) <= a:
            b -= 1
        elif text[a] in _EDGES and partner.get(a, b) >= b:
            a += 1
        else:
            break
    return a, b


def _token_end(text: str, at: int) -> int:
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CONTEXT = pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_, id_, spans, contexts) per row; ``row_`` is unique to the row."""
    ship(df.sparkSession)
    rows = df.select(F.monotonically_increasing_id().alias("row_"), F.col(f"`{id_col}`").alias("id_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, contexts = [], []
            for text in batch.column(2).to_pylist():
                base = base_spans(text)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                held = [(s, e, True) for _, s, e in base]
                if _DIGIT.search(text):
                    held += [(s, e, False) for s, e in identifier_like(text, base)]
                contexts.append(
                    [
                        {"pattern": p, "instance": text[s:e], "seed": seed, "start": s, "end": e}
                        for s, e, seed in held
                        for p in patterns_before(text, s)
                    ]
                )
            columns = [*batch.columns[:2], pa.array(spans, pa.list_(_SPAN)), pa.array(contexts, pa.list_(_CONTEXT))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_", "id_", "spans", "contexts"])

    span = "array<struct<kind:string,start:long,end:long>>"
    context = "array<struct<pattern:string,instance:string,seed:boolean,start:long,end:long>>"
    id_type = rows.schema["id_"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_ long, id_ {id_type}, spans {span}, contexts {context}")


def _contexts_of(text: str, seconds: frozenset[str] | None) -> Iterator[str]:
    """Every pattern that the text's words form, whatever follows; ``seconds`` are the last words of wanted ones."""
    words = text.lower().split()
    marked = any(mark in text for mark in _LABEL_MARKS)
    for i in range(len(words) - 1):
        if seconds is None or words[i] in seconds:
            if i:
                yield f"words {words[i - 1]} {words[i]}"
            if words[i][-1] in _LABEL_MARKS:
                yield f"label {words[i]}"
    if marked:
        for word in words:
            for m in _MARK.finditer(word, 0, len(word) - 1):
                yield f"touching {word[max(0, m.end() - REACH) : m.end()]}"


def occurrences(df: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total) of the given patterns over all texts, counted within tasks before the shuffle."""
    texts = df.select(F.col(f"`{text_col}`").alias("text_")).filter("text_ is not null")
    wanted = None
    if patterns.count() <= HELD_PATTERNS:
        wanted = frozenset(r.pattern for r in patterns.select("pattern").collect())
    seconds = None if wanted is None else frozenset(p.rsplit(" ", 1)[1] for p in wanted)
    held = df.sparkSession.sparkContext.broadcast((wanted, seconds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, last_words = held.value
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if keep is None:
                    seen.update(_contexts_of(text, None))
                elif keep:
                    seen.update(p for p in _contexts_of(text, last_words) if p in keep)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    counted = texts.mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted if wanted is not None else counted.join(patterns, "pattern", "left_semi")


def confident_patterns(contexts: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, score) of the trusted patterns, from contexts (pattern, instance, seed) and corpus totals.

    Seeds have belief 1, other strings one minus the product of their patterns' doubts, where patterns below the
    mark have no say. A pattern's score is the sum of its strings' beliefs, each as often as it occurs, over that
    sum, the occurrences that no identifier-like string follows, the strings' doubts and one more. Where at least
    ``MIN_SUPPORT`` different seeds vouch for the pattern, a doubt weighs ``UNKNOWN``: whether the strings beside
    them are identifiers is what is asked. Elsewhere it weighs 1, so that belief handed on from pattern to pattern
    must cover nearly all of the next one. Beliefs and scores never fall from round to round; the rounds end when
    one adds no pattern and the scores rise by no thousandth.
    """
    edges = contexts.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = stage(edges.join(totals, "pattern", "left"), "edges")
    strings = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("believed"))
    reached = (-1, -1)
    while True:
        led = edges.join(strings, "instance").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("believed")).alias("mass"),
            F.sum("n").alias("n"),
            F.max("total").alias("total"),
            F.count_if(F.col("believed") >= CONFIDENT).alias("support"),
            F.count_if("seed").alias("seeds"),
        )
        bare = F.greatest(F.coalesce("total", "n") - F.col("n"), F.lit(0))
        doubts = (F.col("n") - F.col("mass")) * F.when(F.col("seeds") >= MIN_SUPPORT, F.lit(UNKNOWN)).otherwise(F.lit(1.0))
        score = F.round(F.col("mass") / (F.col("mass") + bare + doubts + 1), 9)
        trusted = led.select("pattern", "support", score.alias("score")).filter((F.col("score") >= CONFIDENT) & (F.col("support") >= MIN_SUPPORT))
        trusted = stage(trusted.select("pattern", "score"), "patterns")
        steps = F.coalesce(F.sum(F.floor(F.col("score") * 1000)), F.lit(0))
        now = tuple(trusted.agg(F.count(F.lit(1)), steps).first())
        if now <= reached:
            return trusted
        reached = now
        doubt = F.sum(F.log(F.greatest(1 - F.coalesce("score", F.lit(0.0)), F.lit(1e-9))))
        strings = edges.join(trusted, "pattern", "left").groupBy("instance").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - F.exp(doubt)).alias("believed")
        )


def learn(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned rows, their contexts (row_, pattern, instance, seed, start, end), and the trusted patterns."""
    scanned = stage(scan(df, id_col, text_col), "scanned")
    contexts = scanned.select("row_", F.explode("contexts").alias("c")).select("row_", "c.*")
    support = contexts.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).groupBy("pattern")
    wanted = support.agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= MIN_SUPPORT).select("pattern")
    wanted = stage(wanted, "wanted")
    totals = stage(occurrences(df, text_col, wanted), "totals")
    trusted = confident_patterns(contexts.join(wanted, "pattern", "left_semi"), totals)
    return scanned, contexts, stage(trusted, "trusted")


def extract(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: (row_, id, base, found), spans in order with ends exclusive, in code points.

    ``base`` holds the four fixed kinds; ``found`` the spans of kind ``FOUND``, which meet no base span. A null or
    empty text has none; repeated rows are scanned and counted as often as they occur; an empty table gives no
    rows; other columns are not read.
    """
    scanned, contexts, trusted = learn(df, id_col, text_col)
    found = contexts.filter(~F.col("seed")).join(trusted, "pattern").select("row_", "start", "end").distinct()
    spans = found.groupBy("row_").agg(
        F.array_sort(F.collect_list(F.struct(F.lit(FOUND).alias("kind"), "start", "end"))).alias("found")
    )
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return scanned.join(spans.withColumnRenamed("row_", "span_row_"), F.col("row_") == F.col("span_row_"), "left").select(
        "row_", F.col("id_").alias(id_col), F.col("spans").alias("base"), F.coalesce("found", none).alias("found")
    )


def joined(spans):
    """kind:start:end of each span, by commas."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def digest(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    rows = extract(df, id_col, text_col)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        id_col,
        *counts,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "found")).alias("spans"),
    )


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that meet are replaced as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join((*out, text[at:]))


def spans_under(text: str, trusted: frozenset[str]) -> list[tuple[str, int, int]]:
    """Base spans and those that trusted patterns lead to."""
    base = base_spans(text)
    if not trusted or not _DIGIT.search(text):
        return base
    led = identifier_like(text, base)
    return base + [(FOUND, s, e) for s, e in led if not trusted.isdisjoint(patterns_before(text, s))]


def redact(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the personal data in its texts replaced by their kinds; null texts stay null.

    Trusted patterns go to the tasks while they are few (``HELD_PATTERNS``); otherwise spans are joined to the
    texts by the texts' digest.
    """
    _, _, trusted = learn(df.select(F.lit(0).alias("no_id_"), text_col), "no_id_", text_col)
    at = df.columns.index(text_col)
    spark = df.sparkSession
    if trusted.count() <= HELD_PATTERNS:
        held = spark.sparkContext.broadcast(frozenset(r.pattern for r in trusted.select("pattern").collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = [t if t is None else redact_text(t, spans_under(t, held.value)) for t in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

        return df.mapInArrow(run, df.schema)
    keyed = df.withColumn("key_", F.sha2(F.col(f"`{text_col}`").cast("binary"), 256))
    led = scan(keyed, "key_", text_col).select("id_", F.explode("contexts").alias("c")).select("id_", "c.*").filter("not seed")
    spans = led.join(trusted, "pattern").groupBy("id_").agg(F.collect_set(F.struct("start", "end")).alias("found_"))
    joined_rows = keyed.join(spans, F.col("key_") == F.col("id_"), "left").select(*[F.col(f"`{c}`") for c in df.columns], "found_")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                led_to = [(FOUND, f["start"], f["end"]) for f in found or ()]
                texts.append(text if text is None else redact_text(text, base_spans(text) + led_to))
            kept = batch.select(batch.schema.names[:-1])
            yield kept.set_column(at, kept.schema.field(at), pa.array(texts, pa.string()))

    return joined_rows.mapInArrow(run_joined, df.schema)
