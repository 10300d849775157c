"""Leave-one-out scores, pruning and model size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.conventions import parent_columns
from kadence.functions.probability import m_estimate
from kadence.operators.compiled import BROADCAST_BYTES, CompiledModel
from kadence.operators.params import num_values_of, path_columns
from kadence.operators.predict import ROW_ID, ROW_KEY, chunk_rows, match_with_backoff, rows_to_evidence


# Sums of one aggregate: classes times the values of k.
LOOCV_SUMS = 64


def _left_out_prior(own: Column, n: Column, model: CompiledModel) -> Column:
    """P(class) from the counts without the row; ``own`` is one for the row's own class."""
    return m_estimate(n - own, F.lit(float(model.num_rows) - 1.0), float(model.num_classes))


def loocv_class_prior(rows: DataFrame, model: CompiledModel, label: str) -> DataFrame:
    """P(class) without the row itself, for every row and class."""
    entries = F.arrays_zip(model.class_names().alias("class"), model.class_totals().alias("n"))
    each = rows.select(ROW_ID, label, F.explode(entries).alias("e"))
    own = F.coalesce((F.col(label) == F.col("e.class")).cast("bigint"), F.lit(0))
    return each.select(ROW_ID, label, F.col("e.class").alias("class"), _left_out_prior(own, F.col("e.n"), model).alias("prob"))


def loocv_scores(
    rows: DataFrame,
    model: CompiledModel,
    label: str,
    *,
    joint: bool = False,
    include_prior: bool = True,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Leave-one-out log score of every training row, class and k = 0..K.

    For each attribute, k uses the deepest level up to k whose chain from level
    0 is unbroken: every level holds the value at least twice, since the row
    itself is left out. ``joint`` divides by the class total in place of the
    parent-path total. ``rows`` are ``scoring_rows`` that carry the label; their ids
    may repeat. An attribute whose value the model does not know gives no term; a
    known value that was never counted with the row's class is an error.
    """
    net, k, classes = model.net, model.k, model.num_classes
    rows = rows.filter(F.col(label).isNotNull()).withColumn(ROW_KEY, F.monotonically_increasing_id())
    evidence = rows_to_evidence(rows, net, [ROW_KEY, label], drop_null=False)
    lines = match_with_backoff(evidence, model, ["n", "parents_count", "support"], limit)
    # The chain of levels, and with it the counts that each k uses.
    used = {"n": [F.col("n_0")], "t": [F.col("parents_count_0")]}
    chain = F.lit(True)
    for i in range(1, k + 1):
        chain = chain & F.coalesce(F.col(f"support_{i}") >= 2, F.lit(False))
        used["n"].append(F.when(chain, F.col(f"n_{i}")).otherwise(used["n"][-1]))
        used["t"].append(F.when(chain, F.col(f"parents_count_{i}")).otherwise(used["t"][-1]))
    names = [f"{c}_used_{i}" for i in range(k + 1) for c in ("n", "t")]
    lines = lines.select(
        ROW_KEY,
        ROW_ID,
        label,
        F.array_position(model.class_names(), F.col(label)).alias("own"),
        num_values_of(net, F.col("attr_num")).alias("values"),
        *[used[c][i].alias(f"{c}_used_{i}") for i in range(k + 1) for c in ("n", "t")],
        *([model.class_totals().alias("class_n")] if joint else []),
    )
    width = max(1, LOOCV_SUMS // (k + 1))
    lines = chunk_rows(lines, [*names, *(["class_n"] if joint else [])], classes, width)
    width = min(width, classes)
    sums = []
    for i in range(k + 1):
        for c in range(width):
            own = (F.col("own") == F.col("chunk") * width + (c + 1)).cast("bigint")
            n, total = F.get(f"n_used_{i}", F.lit(c)), F.get("class_n" if joint else f"t_used_{i}", F.lit(c))
            # What has no logarithm is null; it must not vanish in a sum.
            estimate = F.try_divide(n - own + 1.0 / F.col("values"), total - own + F.lit(1.0))
            term = F.coalesce(F.log(estimate), F.lit(float("nan")))
            sums.append(F.sum(F.when(n.isNull(), F.lit(0.0)).otherwise(term)).alias(f"s_{i}_{c}"))
    totals = lines.groupBy(ROW_KEY, ROW_ID, label, "own", "chunk").agg(*sums)
    totals = totals.withColumns({"names": model.class_names(), "counts": model.class_totals()})
    at = F.col("chunk") * width
    entries = [
        F.struct(F.lit(i).alias("k"), (at + c).alias("at"), F.col(f"s_{i}_{c}").alias("sum")) for i in range(k + 1) for c in range(width)
    ]
    each = totals.select(ROW_ID, label, "own", "names", "counts", F.explode(F.array(*entries)).alias("e")).filter(F.col("e.at") < classes)
    never = F.raise_error(F.lit("a left-out row was never counted by this model")).cast("double")
    score = F.when(F.isnan("e.sum"), never).otherwise(F.col("e.sum"))
    if include_prior:
        own = (F.col("own") == F.col("e.at") + 1).cast("bigint")
        score = score + F.log(_left_out_prior(own, F.get("counts", F.col("e.at")), model))
    return each.select(ROW_ID, label, F.col("e.k").alias("k"), F.get("names", F.col("e.at")).alias("class"), score.alias("log_score"))


def prune_structure(structure: DataFrame, best_attrs: int, best_k: int) -> DataFrame:
    """Keep the first attributes by rank and at most ``best_k`` parents of each.

    An attribute that loses all its parents stays as a parentless row; the
    label row and key rows stay.
    """
    kept = structure.filter(F.col("mi_rank").isNull() | (F.col("mi_rank") <= best_attrs))
    if best_k == 0:
        ranked = F.col("mi_rank").isNotNull()
        kept = kept.filter(F.coalesce(F.col("cmi_rank"), F.lit(1)) <= 1).withColumns(
            {
                "parent": F.when(~ranked, F.col("parent")),
                "cmi_rank": F.when(~ranked, F.col("cmi_rank")),
            }
        )
        return kept
    return kept.filter(F.col("cmi_rank").isNull() | (F.col("cmi_rank") <= best_k))


def prune_model(model: DataFrame, structure: DataFrame, best_attrs: int, best_k: int) -> DataFrame:
    """Model rows of the kept attributes up to level ``best_k``, and the prior rows.

    The structure has a row per attribute and parent, so its ranks fit a plan.
    """
    names = [
        r["attr_name"]
        for r in structure.filter(F.col("mi_rank") <= best_attrs).select("attr_name").distinct().collect()
    ]
    kept = F.col("attr_name").isin(names) & (F.col("level") <= best_k)
    spare = [c for c in model.columns if c.startswith("parent") and c[6:].isdigit() and int(c[6:]) > best_k]
    return model.filter(F.col("attr_name").isNull() | kept).drop(*spare)


def model_size(model: DataFrame, k: int) -> DataFrame:
    """Leaf nodes and parameters per attribute, with the model's total.

    A leaf is a parent path that no longer path extends. Each path marks its own
    prefix, so one aggregate finds the leaves without a join.
    """
    paths = model.filter(F.col("attr_name").isNotNull()).select(*path_columns(k), "attr_name", "num_values").distinct()
    parents = parent_columns(k)
    cut = [F.when(F.col("level") - 1 > i, F.col(c)).alias(c) for i, c in enumerate(parents)]
    prefixes = paths.filter(F.col("level") > 0).select(
        "attr_num", (F.col("level") - 1).alias("level"), *cut, "attr_name", "num_values", F.lit(True).alias("extended")
    )
    leaves = (
        paths.withColumn("extended", F.lit(False))
        .unionByName(prefixes)
        .groupBy(*path_columns(k), "attr_name", "num_values")
        .agg(F.max("extended").alias("extended"))
        .filter(~F.col("extended"))
    )
    classes = model.filter(F.col("attr_name").isNull()).agg(F.count(F.lit(1))).scalar()
    sizes = leaves.groupBy("attr_num", "attr_name", "num_values").agg(F.count(F.lit(1)).alias("leaf_nodes"))
    sizes = sizes.withColumn("parameters", F.col("leaf_nodes") * F.col("num_values") * classes)
    total = sizes.agg(F.sum("parameters")).scalar() + classes
    return sizes.select("attr_num", "attr_name", "num_values", "leaf_nodes", "parameters", total.alias("total_parameters"))
