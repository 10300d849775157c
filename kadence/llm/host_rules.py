"""Quality rules of documents, aggregated by host.

A document fails on its own when it is too short or repeats itself. A host is
judged by how often each rule fails over all its documents: the rate is shrunk
towards the rate of all hosts by a beta prior that is fitted to the hosts
themselves, so that a host with few documents is not judged by chance. A host is
rejected where its posterior leaves little doubt (one in twenty, by the normal
approximation) that its rate exceeds both a stated share and a multiple of the
common rate. Documents of a rejected host are not kept.

Everything is built-in column functions. The measures are one row of a few
numbers per document and are written once; hosts are then one aggregate with
partial sums, and a join of those rows with the hosts, which adaptive execution
broadcasts or splits by its measured size, so that a host with a third of all
documents is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.sources.staging import stage

#: A document needs this many words.
MIN_WORDS = 50
#: Percent of words that may lie in repeated three-word windows.
MAX_REPEATED = 50
#: Percent of lines with words that may repeat an earlier one.
MAX_DUP_LINES = 50
#: Symbols allowed per hundred words.
MAX_SYMBOLS = 100
#: A host is rejected if its failure rate of a rule surely exceeds this share, and so many times the common rate.
HOST_SHARE, TIMES_COMMON = 0.3, 1.5
#: Standard deviations of the posterior that its mean must lie above the limit: one chance in twenty.
DEVIATIONS = 1.645
SYMBOLS = "[#*$%&|<>]"
_SPACE = "[ \\t\\n\\x0B\\f\\r]"

RULES = ("short", "repetitive", "dup_lines", "symbols")


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in text order."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(x: Column, i: Column, rows: Column) -> Column:
        return (F.get(rows, i - 1)["h"] == x["h"]) | (F.get(rows, i + 1)["h"] == x["h"])

    # The sorted array is bound to a lambda variable, so that it is built once per row.
    repeated = F.transform(
        F.array(placed),
        lambda rows: F.array_sort(
            F.transform(F.filter(rows, lambda x, i: F.coalesce(twice(x, i, rows), F.lit(False))), lambda x: x["i"])
        ),
    )[0]
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        repeated,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("long"))


def document_measures(df: DataFrame, id_col: str, text_col: str, host_col: str, *carried: Column) -> DataFrame:
    """Per row: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, and what is carried.

    Windows of three words are compared by a 64-bit hash. A null text has no words.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id_"),
        F.col(f"`{host_col}`").alias("host_"),
        text.alias("text_"),
        F.array_remove(F.split(text, _SPACE, -1), "").alias("words_"),
        *carried,
    )
    carried_names = rows.columns[4:]
    lines = F.filter(F.split("text_", "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    after = F.slice("words_", 1, F.greatest(F.size("words_") - 2, F.lit(0)))
    windows = F.transform(after, lambda x, i: F.xxhash64(x, F.get("words_", i + 1), F.get("words_", i + 2)))
    return rows.select(
        "id_",
        "host_",
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        F.regexp_count("text_", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines_"),
        windows.alias("windows_"),
        *carried_names,
    ).select(
        "id_",
        "host_",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.size("lines_").cast("long").alias("n_lines"),
        _repeated_words(F.col("windows_")).alias("n_repeat_words"),
        *carried_names,
    )


def rule_failures() -> dict[str, Column]:
    """Each rule as a condition on the measures."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"),
    }


def host_rates(measures: DataFrame) -> DataFrame:
    """One row per host: documents and, per rule, failures, shrunk rate, its lower bound and the common rate.

    Rows without a host form none.

    The beta prior of a rule comes from moments weighted by the hosts' sizes (Kleinman 1973): from the spread
    of the hosts' rates beyond what chance alone gives. Where there is no such spread the prior is as strong
    as a million documents, and hosts take nearly the common rate; where hosts are all or nothing it vanishes.
    """
    failures = rule_failures()
    hosts = measures.filter("host_ is not null").groupBy("host_").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(failures[r]).alias(f"{r}_failed") for r in RULES]
    )
    hosts = stage(hosts, "hosts")
    n = F.col("n_docs")
    means = [(F.sum(f"{r}_failed") / F.sum(n)).alias(f"{r}_mean") for r in RULES]
    totals = hosts.agg(F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("k"), *means)
    spread = [F.sum(n * F.pow(F.col(f"{r}_failed") / n - F.col(f"t_.{r}_mean"), F.lit(2))).alias(f"{r}_spread") for r in RULES]
    spreads = hosts.withColumn("t_", totals.select(F.struct("*")).scalar()).agg(F.first("t_").alias("t_"), *spread)
    prior = spreads.select("t_.*", *[f"{r}_spread" for r in RULES]).select(
        F.struct(*[c for r in RULES for c in (F.col(f"{r}_mean"), _strength(r).alias(f"{r}_strength"))])
    )
    shrunk = [
        (
            (F.col(f"{r}_failed") + F.col(f"p_.{r}_mean") * F.col(f"p_.{r}_strength")) / (n + F.col(f"p_.{r}_strength"))
        ).alias(f"{r}_rate")
        for r in RULES
    ]
    rates = hosts.withColumn("p_", prior.scalar()).select(*hosts.columns, "p_", *shrunk)
    lows = []
    for r in RULES:
        rate = F.col(f"{r}_rate")
        spread = F.sqrt(rate * (1 - rate) / (n + F.col(f"p_.{r}_strength") + 1))
        lows += [(rate - DEVIATIONS * spread).alias(f"{r}_low"), F.col(f"p_.{r}_mean").alias(f"{r}_common")]
    return rates.select("*", *lows).drop("p_")


def _strength(rule: str) -> Column:
    """The prior's weight in documents."""
    p, s = F.col(f"{rule}_mean"), F.col(f"{rule}_spread")
    chance = p * (1 - p)
    # Undefined for a single host, or a rule that fails always or never: there is no spread then.
    alike = F.try_divide(s - chance * (F.col("k") - 1), chance * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)))
    alike = F.least(F.greatest(F.coalesce(alike, F.lit(0.0)), F.lit(1e-6)), F.lit(1 - 1e-6))
    return (1 - alike) / alike


def host_verdicts(measures: DataFrame, share: float = HOST_SHARE) -> DataFrame:
    """Each host with its rates, whether it is rejected, and the rules it failed."""

    def surely(rule: str) -> Column:
        return F.col(f"{rule}_low") > F.greatest(F.lit(share), TIMES_COMMON * F.col(f"{rule}_common"))

    failed = F.filter(F.array(*[F.when(surely(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return host_rates(measures).withColumn("host_failed_rules", failed).withColumn("host_failed", F.size(failed) > 0)


def apply_rules(
    df: DataFrame, id_col: str, text_col: str, host_col: str, share: float = HOST_SHARE
) -> DataFrame:
    """One row per row of ``df``: id, host, measures, base_failed, host_failed and kept.

    Rows without a host, and rows of an unknown one, are judged by themselves. Repeated rows count as often
    as they occur. An empty table gives no rows. Other columns are not read.
    """
    measures = stage(document_measures(df, id_col, text_col, host_col), "measures")
    failures = rule_failures()
    verdicts = host_verdicts(measures, share).select(F.col("host_").alias("judged_"), "host_failed")
    joined = measures.join(verdicts, F.col("host_") == F.col("judged_"), "left")
    base = failures["short"] | failures["repetitive"]
    return joined.select(
        F.col("id_").alias(id_col),
        F.col("host_").alias(host_col),
        *measures.columns[2:],
        base.alias("base_failed"),
        F.coalesce("host_failed", F.lit(False)).alias("host_failed"),
        (~base & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
    )


def keep_documents(
    df: DataFrame, id_col: str, text_col: str, host_col: str, share: float = HOST_SHARE
) -> DataFrame:
    """The rows of ``df`` that ``apply_rules`` keeps, with all their columns.

    Rows are measured twice, once for the hosts and once for themselves, so that texts need not meet their
    measures by a shuffle; only hosts that are rejected are joined.
    """
    measures = stage(document_measures(df, id_col, text_col, host_col), "measures")
    rejected = stage(host_verdicts(measures, share).filter("host_failed").select(F.col("host_").alias("rejected_")), "rejected")
    failures = rule_failures()
    own = document_measures(df, id_col, text_col, host_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"))
    # The row number keeps the filter above the measures; pushed below, it would measure anew for every rule.
    own = own.withColumn("measured_", F.monotonically_increasing_id())
    own = own.filter((F.col("measured_") >= 0) & ~(failures["short"] | failures["repetitive"]))
    return own.join(rejected, F.col("host_") == F.col("rejected_"), "left_anti").select("row_.*")
