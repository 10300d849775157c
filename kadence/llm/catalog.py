"""The registered queries of this package and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.llm import (
    bottom_k,
    byte_bpe,
    chat_windows,
    dom_boost,
    host_rules,
    packing,
    pii_bootstrap,
    positive_unlabelled,
    prefix_hashes,
    prefix_trie,
    ranked_search,
    size_bands,
    warc_fixity,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = positive_unlabelled.learn_toxicity(documents, table(spark, sf_dir, "labels"))
    scored = positive_unlabelled.score(documents, "doc_id", "text", model)
    return scored.select(
        "doc_id",
        positive_unlabelled.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op2_prefix_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hashes.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")


_WARC_SQL = """
with records as (
  select page_id, page_id // 1000 as segment,
         strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10))
           + strlen(coalesce(html, '')) + 4 as length,
         html
  from pages),
placed as (
  select *, sum(length) over (partition by segment order by page_id) - length as start_
  from records)
select page_id, segment, start_::bigint as "offset", length, 'corrupt' as status
from placed where page_id % 97 = 5 and length(html) > 0
"""


@query("op3_warc_fixity", _WARC_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica in which one byte of every page of one residue class has flipped, audited against the original."""
    pages = table(spark, sf_dir, "pages")
    flipped = F.concat(F.lit("?"), F.substring("html", 2, 2_147_483_647))
    damaged = pages.withColumn("html", F.when((F.col("page_id") % 97 == 5) & (F.length("html") > 0), flipped).otherwise(F.col("html")))
    replicas = [warc_fixity.archive(p, "page_id", "url", "html") for p in (pages, damaged)]
    found = warc_fixity.compare(*replicas)
    return found.select(F.col("record_id").alias("page_id"), "segment", "offset", "length", "status")


@query("op4_chat_windows")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    windows = chat_windows.format_windows(
        conversations.unionByName(extra), "conv_id", "turn", "role", "text", RANKS, public_tokenizers.PATTERN
    )
    return chat_windows.read_back(windows, "conv_id")


def _surely(rule: str) -> str:
    """DuckDB: whether a host's failure rate of a rule surely exceeds the limits, from hosts, totals and spreads."""
    chance = f"({rule}_mean * (1 - {rule}_mean))"
    alike = f"({rule}_spread - {chance} * (k - 1)) / nullif({chance} * (n - nn / n - (k - 1)), 0)"
    alike = f"least(greatest(coalesce({alike}, 0), 1e-6), 1 - 1e-6)"
    strength = f"((1 - {alike}) / {alike})"
    rate = f"(({rule}_failed + {rule}_mean * {strength}) / (n_docs + {strength}))"
    return f"{rate} - 1.645 * sqrt({rate} * (1 - {rate}) / (n_docs + {strength} + 1)) > greatest(0.3, 1.5 * {rule}_mean)"


_RULE_SQL = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "symbols": "100 * n_symbols > 100 * n_words",
}
_HOST_SQL = rf"""
with texts as (
  select doc_id, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) as lines
  from documents),
rows as (select *, row_number() over () as row_id from texts),
windows as (
  select row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as window_
  from (select row_id, words, unnest(range(1, len(words) - 1)) as i from rows)),
counted as (select row_id, i, count(*) over (partition by row_id, window_) as times from windows),
covered as (
  select row_id, count(distinct i + d) as n_repeat_words
  from counted, (values (0), (1), (2)) as shift(d) where times > 1 group by row_id),
measures as (
  select row_id, doc_id, source, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words
  from rows left join covered using (row_id)),
hosts as (
  select source, count(*) as n_docs,
         {", ".join(f"count(*) filter ({c}) as {r}_failed" for r, c in _RULE_SQL.items())}
  from measures where source is not null group by source),
totals as (
  select sum(n_docs)::double as n, sum(n_docs * n_docs)::double as nn, count(*) as k,
         {", ".join(f"sum({r}_failed) / sum(n_docs) as {r}_mean" for r in _RULE_SQL)}
  from hosts),
spreads as (
  select {", ".join(f"sum(n_docs * pow({r}_failed / n_docs - {r}_mean, 2)) as {r}_spread" for r in _RULE_SQL)}
  from hosts, totals),
verdicts as (
  select source, {" or ".join(_surely(r) for r in _RULE_SQL)} as host_failed
  from hosts, totals, spreads)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(host_failed, false) as kept
from measures left join verdicts using (source)
"""


@query("op5_host_rules", _HOST_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rules.apply_rules(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

def _near_sql(words: int, percent: int, last: str) -> str:
    """Components of documents whose sets of shingles are alike, and a column more."""
    return rf"""
with recursive texts as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \t\n\x0B\f\r]'), lambda w: w <> '') as words
  from documents),
shingles as (
  select distinct doc_id, array_to_string(words[i:i + {words - 1}], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - {words - 2}, 2))) as i from texts where len(words) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reach(doc_id, other) as (
  select doc_id, doc_id from texts union select reach.doc_id, links.b from reach join links on reach.other = links.a),
components as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id{last}
from components left join sizes using (doc_id)
"""


@query("op6_bottom_k", _near_sql(5, 75, ", doc_id = component_id as kept"))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op7_dom_boost")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = dom_boost.extract(pages, "html", dom_boost.train(pages, "html"), keep=("page_id", "url"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op9_pii_bootstrap")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digest(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return byte_bpe.digest(documents, "doc_id", "text", RANKS, public_tokenizers.PATTERN)


_TRIE_SQL = r"""
with recursive steps as (  -- the crc32 of each number's decimal, a bit at a time; 3988292384 is the reversed polynomial
  select conv_id, conv_id::varchar as c, 0 as i, 4294967295::bigint as r
  from (select distinct conv_id from conversations where conv_id is not null)
  union all
  select conv_id, c, i + 1, xor(x // 2, (x % 2) * 3988292384)
  from (select *, case when i % 8 = 0 then xor(r, ascii(substr(c, i // 8 + 1, 1))::bigint) else r end as x
        from steps where i < 8 * length(c))),
shares as (select conv_id, conv_id - conv_id % 20 as base, xor(r, 4294967295) % 4 as h from steps where i = 8 * length(c)),
said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
turns as (
  select conv_id, md5(length(role) || ':' || role || text) as digest,
         len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]'), lambda w: w <> '')) as words,
         row_number() over (partition by conv_id order by turn nulls first, role, left(text, 64),
                            md5(length(role) || ':' || role || text)) as pos
  from said),
lengths as (select conv_id, count(*) as given from turns group by conv_id),
kept as (
  select s.*, least(h, coalesce(given, 0)) as k from shares s left join lengths l on l.conv_id = s.base),
rebuilt as (
  select kept.conv_id, pos, digest, words from kept join turns on turns.conv_id = base and pos <= h
  union all
  select conv_id, pos - h + k, digest, words from kept join turns using (conv_id) where pos > h),
paths as (
  select conv_id, pos as depth, words, string_agg(digest, ',') over (partition by conv_id order by pos) as key from rebuilt
  union all
  select conv_id, 0, 0, '' from shares),
placed as (
  select *, lag(key) over (partition by conv_id order by depth) as parent_key,
         lead(key) over (partition by conv_id order by depth) is null as ends
  from paths),
nodes as (
  select key, any_value(depth) as depth, any_value(parent_key) as parent_key, any_value(words) as words,
         min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from placed group by key),
children as (select parent_key as key, count(*) as n_children from nodes where depth > 0 group by parent_key),
counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (key)),
subtrees as (
  select p.key, count(*) filter (u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.words)::bigint as saved_tokens
  from counted u join paths p on p.conv_id = u.conv_id and p.depth <= u.depth group by p.key)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
from counted n join subtrees using (key) left join nodes up on up.key = n.parent_key and n.depth > 0
"""


@query("op11_prefix_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return prefix_trie.trie(*prefix_trie.with_borrowed_openings(turns, convs))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RANKED_SQL = rf"""
with docs as (
  select row_number() over () as row_id, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') as terms from documents),
totals as (select count(*) as n_docs, sum(len(terms)) as n_terms from docs where len(terms) > 0),
asked as (
  select item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term
  from (select distinct item_id, coalesce(text, '') as text from benchmark)),
times as (select item_id, term, count(*) as times from asked group by item_id, term),
spread as (select row_id, doc_id, len(terms) as n, unnest(terms) as term from docs),
found as (
  select row_id, doc_id, n, term, count(*) as tf from spread semi join times using (term)
  group by row_id, doc_id, n, term),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from found, totals group by term),
impacts as (
  select row_id, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) as impact
  from found, totals),
scores as (
  select item_id, row_id, doc_id, sum(times * w * impact)::bigint as score
  from times join weights using (term) join impacts using (term) group by item_id, row_id, doc_id),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


@query("op12_ranked_search", _RANKED_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return ranked_search.rank(documents, "doc_id", "text", items, "item_id", "text")


@query("op13_size_bands", _near_sql(3, 90, ""))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_bands.similar_components(table(spark, sf_dir, "documents"), "doc_id", "text")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
