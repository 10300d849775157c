"""Inputs of the registered queries, as Spark frames and as DuckDB SQL.

Each fixture is defined twice, side by side. Doubles become whole numbers before
they are turned into text, so both engines spell them alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.operators.star import Dim


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Fixture:
    """SQL side of a fixture: a query for CTE ``f`` and its attribute numbers.

    ``base`` yields the attributes as text, the label as ``y`` and any id.
    """

    base: str
    attrs: dict[str, int]
    label: str
    label_num: int


def _percent(name: str):
    return F.round(F.col(name) * 100).cast("int").alias(name)


# --- F1: flat lineitem -------------------------------------------------------

F1_ATTRS = ["l_linestatus", "l_linenumber", "l_tax", "l_discount", "l_quantity"]


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        "l_linenumber",
        _percent("l_tax"),
        _percent("l_discount"),
        F.col("l_quantity").cast("int").alias("l_quantity"),
        "l_returnflag",
    )


def _f1_sql(linenumber: str) -> str:
    return f"""
      select l_linestatus, {linenumber} as l_linenumber,
             cast(cast(round(l_tax * 100) as integer) as varchar) as l_tax,
             cast(cast(round(l_discount * 100) as integer) as varchar) as l_discount,
             cast(cast(l_quantity as integer) as varchar) as l_quantity,
             l_returnflag as y
      from lineitem"""


F1 = Fixture(_f1_sql("cast(l_linenumber as varchar)"), {a: i for i, a in enumerate(F1_ATTRS)}, "l_returnflag", 5)


# --- F4: F1 with nulls -------------------------------------------------------


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f1(spark, sf_dir).withColumn("l_linenumber", F.nullif(F.col("l_linenumber"), F.lit(7)))


F4_CATEGORY = Fixture(
    _f1_sql("coalesce(cast(nullif(l_linenumber, 7) as varchar), '~')"), F1.attrs, F1.label, F1.label_num
)
F4_DROP = Fixture(_f1_sql("cast(nullif(l_linenumber, 7) as varchar)"), F1.attrs, F1.label, F1.label_num)


# --- F2: star with two dimensions --------------------------------------------


def f2_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_linenumber", _percent("l_tax"), "l_partkey", "l_suppkey", "l_returnflag"
    )


def f2_dims(spark: SparkSession, sf_dir: str, supplier_key_is_attr: bool = False) -> list[Dim]:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return [
        Dim("part", part, "p_partkey", "l_partkey"),
        Dim("supplier", supplier, "s_suppkey", "l_suppkey", supplier_key_is_attr),
    ]


F2_BASE = """
      select l_linestatus, cast(l_linenumber as varchar) as l_linenumber,
             cast(cast(round(l_tax * 100) as integer) as varchar) as l_tax,
             cast(l_suppkey as varchar) as l_suppkey,
             p_brand, p_type, cast(p_size as varchar) as p_size,
             cast(s_nationkey as varchar) as s_nationkey, l_returnflag as y
      from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey"""
F2_NUMS = {"l_linestatus": 0, "l_linenumber": 1, "l_tax": 2, "p_brand": 7, "p_type": 8, "p_size": 9, "s_nationkey": 11}
F2 = Fixture(F2_BASE, F2_NUMS, "l_returnflag", 5)
F2_KEY = Fixture(F2_BASE, {**F2_NUMS, "l_suppkey": 4}, "l_returnflag", 5)


# --- F3: star with one dimension, and a row id -------------------------------


def f3_fact(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    columns = ["o_orderstatus", "o_custkey", "o_orderpriority"] + (["o_orderkey"] if with_id else [])
    return table(spark, sf_dir, "orders").select(*columns)


def f3_dims(spark: SparkSession, sf_dir: str) -> list[Dim]:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return [Dim("customer", customer, "c_custkey", "o_custkey")]


F3 = Fixture(
    """
      select o_orderstatus, cast(c_nationkey as varchar) as c_nationkey, c_mktsegment, o_orderpriority as y,
             o_orderkey as row_id
      from orders join customer on o_custkey = c_custkey""",
    {"o_orderstatus": 0, "c_nationkey": 4, "c_mktsegment": 5},
    "o_orderpriority",
    2,
)

# A flat orders table with a stated network, for parameters and scoring.
ORDER_PARENTS = {
    "o_day": [],
    "c_nationkey": ["o_day"],
    "c_mktsegment": ["c_nationkey", "o_day"],
    "o_orderstatus": ["c_nationkey", "c_mktsegment"],
}
ORDER_NUMS = {"o_orderstatus": 0, "o_day": 1, "c_nationkey": 2, "c_mktsegment": 3}
ORDER_LABEL = "o_orderpriority"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: all orders with their customer."""
    return _orders(spark, sf_dir).select(
        "o_orderstatus",
        F.dayofmonth("o_orderdate").alias("o_day"),
        "c_nationkey",
        "c_mktsegment",
        ORDER_LABEL,
        "o_orderkey",
    )


def shifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rows: every order as if placed a day later, some without a segment.

    Day 32, the null segment and many (day, nation, segment) paths were never seen.
    """
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return _orders(spark, sf_dir).select(
        segment.alias("c_mktsegment"),
        "c_nationkey",
        (F.dayofmonth("o_orderdate") + 1).alias("o_day"),
        "o_orderstatus",
        ORDER_LABEL,
        "o_orderkey",
    )


ORDERS = Fixture(
    """
      select o_orderstatus, cast(day(o_orderdate) as varchar) as o_day, cast(c_nationkey as varchar) as c_nationkey,
             c_mktsegment, o_orderpriority as y, o_orderkey as row_id
      from orders join customer on o_custkey = c_custkey""",
    ORDER_NUMS,
    ORDER_LABEL,
    4,
)
SHIFTED_SQL = """
      select o_orderstatus, cast(day(o_orderdate) + 1 as varchar) as o_day, cast(c_nationkey as varchar) as c_nationkey,
             coalesce(case when c_acctbal >= 0 then c_mktsegment end, '~') as c_mktsegment,
             o_orderpriority as y, o_orderkey as row_id
      from orders join customer on o_custkey = c_custkey"""


# --- F7: a label with a class per customer -----------------------------------

BUYER_PARENTS = {"c_mktsegment": [], "c_nationkey": ["c_mktsegment"]}


def buyer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("c_mktsegment", "c_nationkey", "o_custkey")


BUYERS = Fixture(
    """
      select c_mktsegment, cast(c_nationkey as varchar) as c_nationkey, cast(o_custkey as varchar) as y, o_orderkey as row_id
      from orders join customer on o_custkey = c_custkey""",
    {"c_mktsegment": 0, "c_nationkey": 1},
    "o_custkey",
    2,
)
CUSTOMERS_SQL = "select c_mktsegment, cast(c_nationkey as varchar) as c_nationkey, c_custkey as row_id from customer"


# --- F6: a star whose dimension lacks many keys ------------------------------


def f6_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("int")
    return table(spark, sf_dir, "documents").select("source", size.alias("size"), "doc_id", "lang")


def f6_dims(spark: SparkSession, sf_dir: str) -> list[Dim]:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled_id"), "quality", "toxic")
    return [Dim("labels", labels, "labelled_id", "doc_id")]


F6 = Fixture(
    """
      select source, cast(least(n_chars // 1000, 9) as varchar) as size, cast(quality as varchar) as quality,
             cast(toxic as varchar) as toxic, lang as y
      from documents left join labels using (doc_id)""",
    {"source": 0, "size": 1, "quality": 5, "toxic": 6},
    "lang",
    3,
)


# --- F5: event batches -------------------------------------------------------


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.hour("ts").alias("event_hour"), (F.col("user_id") % 7).alias("user_group"), "event_type", "value"
    )


F5 = Fixture(
    """
      select cast(hour(ts) as varchar) as event_hour, cast(user_id % 7 as varchar) as user_group,
             event_type as y, value
      from events""",
    {"event_hour": 0, "user_group": 1},
    "event_type",
    2,
)
