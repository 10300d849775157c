"""Saving and loading structures, models and predictions; the model summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.conventions import parent_columns
from kadence.functions.probability import m_estimate
from kadence.operators.evaluate import model_size
from kadence.operators.params import model_columns
from kadence.operators.structure import STRUCTURE_COLUMNS


def _is_path(target: str) -> bool:
    return "/" in target or ":" in target


def _write(df: DataFrame, target: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    writer = df.write.format(fmt).mode("overwrite").partitionBy(*partition_by)
    if _is_path(target):
        writer.save(target)
    else:
        writer.saveAsTable(target)


def _read(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.parquet(source) if _is_path(source) else spark.table(source)


def save_structure(structure: DataFrame, target: str) -> None:
    """Write a structure table to a path or a catalog table, replacing it."""
    _write(structure.coalesce(1), target)


def load_structure(spark: SparkSession, source: str) -> DataFrame:
    """Read a structure in rank order, with each parent's number and the parent count."""
    table = _read(spark, source)
    extra = [c for c in table.columns if c not in STRUCTURE_COLUMNS]
    widths = table.groupBy("attr_num").agg(F.count("cmi_rank").cast("int").alias("num_parents"))
    numbers = table.groupBy(F.col("attr_name").alias("parent")).agg(F.any_value("attr_num").alias("parent_num"))
    ranked = table.join(widths, "attr_num").join(numbers, "parent", "left")
    return ranked.select(*STRUCTURE_COLUMNS, *extra, "parent_num", "num_parents").orderBy(
        F.asc_nulls_first("mi_rank"), F.asc_nulls_first("cmi_rank")
    )


def save_model(model: DataFrame, target: str) -> None:
    """Write a model table partitioned by level, so a reader of few levels skips the rest."""
    _write(model, target, partition_by=("level",))


def load_model(spark: SparkSession, source: str, k: int) -> DataFrame:
    """Read a model table with its columns in their usual order."""
    table = _read(spark, source)
    missing = set(parent_columns(k)) - set(table.columns)
    if missing:
        raise ValueError(f"the model has no {sorted(missing)}; it was built with a smaller k")
    return table.select(*model_columns(k))


def write_predictions(predictions: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Write predictions to a path or a catalog table, replacing it."""
    _write(predictions, target, fmt=fmt)


def model_summary(model: DataFrame, structure: DataFrame, k: int) -> DataFrame:
    """One row: size of the training set, attributes, order, classes, priors, leaves.

    Lists hold one entry per column or class.
    """
    attrs = structure.filter(F.col("mi_rank").isNotNull()).select("attr_num", "attr_name", "mi_rank").distinct()
    label = structure.filter(F.col("mi_rank").isNull() & F.col("parent").isNotNull())

    def names(rows: DataFrame, order: str, name: str):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("v"))))
        return rows.agg(pairs.alias("pairs")).select("pairs.v").scalar()

    priors = model.filter(F.col("attr_name").isNull()).select(
        "class", m_estimate(F.col("n"), F.col("parents_count"), F.col("num_values")).alias("prior"), "parents_count"
    )
    sizes = model_size(model, k)
    ranked = sizes.join(attrs.select("attr_num", "mi_rank"), "attr_num")
    return priors.agg(F.max("parents_count").alias("n_rows")).select(
        "n_rows",
        names(attrs, "attr_num", "attr_name").alias("attributes"),
        names(attrs, "mi_rank", "attr_name").alias("predictors"),
        label.select("attr_name").scalar().alias("label"),
        label.select("attr_num").scalar().alias("label_index"),
        names(priors, "class", "class").alias("classes"),
        names(priors, "class", "prior").alias("class_probs"),
        names(ranked, "mi_rank", "leaf_nodes").alias("leaf_nodes"),
        sizes.agg(F.max("total_parameters")).scalar().alias("parameters"),
    )
