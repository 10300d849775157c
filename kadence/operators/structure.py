"""Choosing the network: ranks, parents and the structure table.

Everything here works on tables whose size depends on the number of attributes
alone, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadence.conventions import CLASS_PARENT, RANK_DIGITS, parent_columns
from kadence.functions.measures import both_directions
from kadence.operators.counts import name_of

STRUCTURE_COLUMNS = ["attr_num", "attr_name", "parent", "mi_rank", "cmi_rank", "num_values"]


def rank_attributes(mi: DataFrame) -> DataFrame:
    """mi_rank 1.. by mutual information, ties to the smaller attribute number."""
    order = Window.orderBy(F.round("mi", RANK_DIGITS).desc(), F.col("attr_num"))
    return mi.withColumn("mi_rank", F.row_number().over(order))


def select_parents(ranked: DataFrame, cmi: DataFrame, k: int) -> DataFrame:
    """The min(rank-1, k) higher-ranked attributes of largest CMI for each attribute.

    Candidates are generated as ranks 1..rank-1 and joined by equality. A pair
    without a CMI row (its values never met) is a candidate with CMI 0.
    """
    children = ranked.filter(F.col("mi_rank") > 1).select(
        "attr_num", "mi_rank", F.explode(F.sequence(F.lit(1), F.col("mi_rank") - 1)).alias("parent_rank")
    )
    parents = ranked.select(F.col("attr_num").alias("parent_num"), F.col("mi_rank").alias("parent_rank"))
    measured = both_directions(cmi).select(
        F.col("attr_num1").alias("attr_num"), F.col("attr_num2").alias("parent_num"), "cmi"
    )
    order = Window.partitionBy("attr_num").orderBy(F.round("cmi", RANK_DIGITS).desc(), F.col("parent_rank"))
    return (
        children.join(parents, "parent_rank")
        .join(measured, ["attr_num", "parent_num"], "left")
        .withColumn("cmi", F.coalesce("cmi", F.lit(0.0)))
        .withColumn("cmi_rank", F.row_number().over(order))
        .filter(F.col("cmi_rank") <= k)
        .select("attr_num", "mi_rank", "parent_num", "parent_rank", "cmi", "cmi_rank")
    )


def assemble_structure(
    ranked: DataFrame,
    parents: DataFrame | None,
    sizes: DataFrame,
    y: DataFrame,
    names: Mapping[int, str],
    label: str,
    label_num: int,
) -> DataFrame:
    """Parent rows, parentless rows and the label row in one table."""
    attrs = ranked.select("attr_num", "mi_rank").join(sizes, "attr_num")
    if parents is None:
        body = attrs.withColumn("parent_num", F.lit(None).cast("int")).withColumn("cmi_rank", F.lit(None).cast("int"))
    else:
        body = attrs.join(parents.select("attr_num", "parent_num", "cmi_rank"), "attr_num", "left")
    body = body.select(
        "attr_num",
        name_of(names, F.col("attr_num")).alias("attr_name"),
        name_of(names, F.col("parent_num")).alias("parent"),
        "mi_rank",
        "cmi_rank",
        "num_values",
    )
    label_row = y.filter(F.col("class").isNotNull()).agg(F.count(F.lit(1)).alias("num_values")).select(
        F.lit(label_num).alias("attr_num"),
        F.lit(label).alias("attr_name"),
        F.lit(CLASS_PARENT).alias("parent"),
        F.lit(None).cast("int").alias("mi_rank"),
        F.lit(None).cast("int").alias("cmi_rank"),
        "num_values",
    )
    return body.unionByName(label_row)


def naive_structure(
    ranked: DataFrame,
    sizes: DataFrame,
    y: DataFrame,
    names: Mapping[int, str],
    label: str,
    label_num: int,
) -> DataFrame:
    """k = 0: every attribute depends on the class alone."""
    return assemble_structure(ranked, None, sizes, y, names, label, label_num)


def structure_from_parents(
    sizes: DataFrame,
    num_classes: int,
    names: Mapping[int, str],
    label: str,
    label_num: int,
    parents: Mapping[str, Sequence[str]],
) -> DataFrame:
    """A structure the caller states: attributes in rank order with their parents."""
    nums = {a: n for n, a in names.items()}
    rows = []
    for rank, (attr, its_parents) in enumerate(parents.items(), start=1):
        if not its_parents:
            rows.append((nums[attr], attr, None, rank, None))
        rows += [(nums[attr], attr, p, rank, i) for i, p in enumerate(its_parents, start=1)]
    spark = sizes.sparkSession
    schema = "attr_num int, attr_name string, parent string, mi_rank int, cmi_rank int"
    body = spark.createDataFrame(rows, schema).join(sizes, "attr_num")
    label_row = spark.createDataFrame(
        [(label_num, label, CLASS_PARENT, None, None, num_classes)], schema + ", num_values bigint"
    )
    return body.select(*STRUCTURE_COLUMNS).unionByName(label_row)


def parents_wide(structure: DataFrame, k: int) -> DataFrame:
    """One row per attribute with its parents in cmi_rank order."""
    keys = ["attr_num", "attr_name", "mi_rank", "num_values"]
    attrs = structure.filter(F.col("mi_rank").isNotNull())
    if k == 0:
        return attrs.select(*keys).distinct()
    wide = attrs.groupBy(*keys).pivot("cmi_rank", list(range(1, k + 1))).agg(F.max("parent"))
    return wide.select(*keys, *[F.col(str(i)).alias(c) for i, c in enumerate(parent_columns(k), start=1)])
