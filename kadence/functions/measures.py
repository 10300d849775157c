"""Mutual information and conditional mutual information from count tables.

Two equivalent plans, neither of which joins the large pair table. The general one
leaves null values and classes out and meets the margins of a pair's two values
after the pair cells are summed over the other value. When the counts are complete
(no nulls, no orphan keys) the margins cancel into sums of n*log2(n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n_log_n(n: Column) -> Column:
    return n * F.log2(n)


def total(y: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return y.agg(F.sum("n").cast("double")).scalar()


def mutual_information(xy: DataFrame, y: DataFrame) -> DataFrame:
    """MI(attribute; class) in bits over observed cells.

    One value's rows in the window are at most one per class.
    """
    by_value = Window.partitionBy("attr_num", "attr_value")
    cells = xy.withColumn("n_value", F.sum("n").over(by_value)).filter(F.col("attr_value").isNotNull())
    classes = y.select("class", F.col("n").alias("n_class"))
    n, n_total = F.col("n"), F.col("n_total")
    ratio = (n / F.col("n_value")) * (n_total / F.col("n_class"))
    return (
        cells.join(classes, "class")
        .withColumn("n_total", total(y))
        .groupBy("attr_num")
        .agg(F.sum(n / n_total * F.log2(ratio)).alias("mi"))
    )


def attribute_terms(xy: DataFrame) -> DataFrame:
    """Per attribute: sums of n*log2(n) over its cells and its values, and num_values.

    One pass over the attribute counts feeds MI, CMI and the domain sizes.
    """
    return (
        xy.groupBy("attr_num", "attr_value")
        .agg(F.sum("n").alias("n_value"), F.sum(_n_log_n(F.col("n"))).alias("cell_term"))
        .groupBy("attr_num")
        .agg(
            F.sum("cell_term").alias("cell_term"),
            F.sum(_n_log_n(F.col("n_value"))).alias("value_term"),
            F.count(F.lit(1)).alias("num_values"),
        )
    )


def class_terms(y: DataFrame) -> Column:
    """(rows, sum of n*log2(n)) over the classes, as one scalar subquery."""
    n = F.col("n")
    return y.agg(F.struct(F.sum("n").cast("double").alias("rows"), F.sum(_n_log_n(n)).alias("term"))).scalar()


def mutual_information_complete(terms: DataFrame, y: DataFrame) -> DataFrame:
    """MI for counts without nulls, from ``attribute_terms``: no join at all."""
    classes = class_terms(y)
    rows, term = classes["rows"], classes["term"]
    given_value = F.col("cell_term") - F.col("value_term")
    return terms.select("attr_num", ((given_value + _n_log_n(rows) - term) / rows).alias("mi"))


def conditional_mutual_information(pairs: DataFrame, xy: DataFrame, y: DataFrame) -> DataFrame:
    """CMI(a1; a2 | class) in bits, one row per unordered pair.

    The logarithm of each cell's ratio is a sum: the cell's own term and the class's, less those of its two
    values. A value's term is the same in all cells that hold it, so these are summed first, into a table of
    (attribute, value, class, other attribute); only that one meets the margins.
    """
    known = F.col("attr_value1").isNotNull() & F.col("attr_value2").isNotNull() & F.col("class").isNotNull()
    cells = pairs.filter(known)
    pair = ["attr_num1", "attr_num2"]
    joint = cells.groupBy(*pair).agg(F.sum(_n_log_n(F.col("n"))).alias("term"))
    by_class = cells.groupBy(*pair, "class").agg(F.sum("n").alias("n"))
    by_class = by_class.join(y.select("class", F.col("n").alias("n_class")), "class")
    given = by_class.groupBy(*pair).agg(F.sum(F.col("n") * F.log2("n_class")).alias("term"))
    sides = F.array(
        *[F.struct(F.lit(i).alias("side"), F.col(f"attr_num{i}").alias("attr_num"), F.col(f"attr_value{i}").alias("attr_value")) for i in (1, 2)]
    )
    keys = ["side", "attr_num", "attr_value", "class", *pair]
    values = cells.select(*pair, "class", "n", F.explode(sides).alias("s")).select(*pair, "class", "n", "s.*").groupBy(*keys).agg(F.sum("n").alias("n"))
    margins = xy.select("attr_num", "attr_value", "class", F.col("n").alias("n_value"))
    values = values.join(margins, ["attr_num", "attr_value", "class"])
    values = values.groupBy(*pair).agg((-F.sum(F.col("n") * F.log2("n_value"))).alias("term"))
    terms = joint.unionByName(given).unionByName(values).groupBy(*pair).agg(F.sum("term").alias("term"))
    return terms.withColumn("n_total", total(y)).select(*pair, (F.col("term") / F.col("n_total")).alias("cmi"))


def conditional_mutual_information_complete(pairs: DataFrame, terms: DataFrame, y: DataFrame) -> DataFrame:
    """CMI for counts without nulls: the pair table is only aggregated.

    The joins are between tables of one row per attribute or attribute pair.
    """
    classes = class_terms(y)
    joint = pairs.groupBy("attr_num1", "attr_num2").agg(F.sum(_n_log_n(F.col("n"))).alias("joint_term"))
    first = terms.select(F.col("attr_num").alias("attr_num1"), F.col("cell_term").alias("term1"))
    second = terms.select(F.col("attr_num").alias("attr_num2"), F.col("cell_term").alias("term2"))
    gain = (F.col("joint_term") - F.col("term1")) + (classes["term"] - F.col("term2"))
    return (
        joint.join(first, "attr_num1")
        .join(second, "attr_num2")
        .select("attr_num1", "attr_num2", (gain / classes["rows"]).alias("cmi"))
    )


def both_directions(cmi: DataFrame) -> DataFrame:
    """CMI is symmetric: mirror the small result, not the counts."""
    a, b = F.col("attr_num1"), F.col("attr_num2")
    orders = F.array(
        F.struct(a.alias("attr_num1"), b.alias("attr_num2")), F.struct(b.alias("attr_num1"), a.alias("attr_num2"))
    )
    return cmi.select(F.explode(orders).alias("o"), "cmi").select("o.*", "cmi")
