"""Reading training rows and turning every attribute into a string category."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.conventions import NULL_TOKEN

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


@dataclass(frozen=True)
class TrainingSet:
    """Encoded rows plus what the counting operators need to know about them.

    ``df`` holds the label, the attributes (all strings) and any carried
    columns. ``attr_nums`` are 0-based column positions that count the label.
    """

    df: DataFrame
    label: str
    label_num: int
    attrs: tuple[str, ...]
    attr_nums: tuple[int, ...]
    null_policy: str = "category"

    @property
    def names(self) -> dict[int, str]:
        return dict(zip(self.attr_nums, self.attrs))

    @property
    def complete(self) -> bool:
        """True when no attribute or label value can be null."""
        return self.null_policy == "category"

    def num_of(self, attr: str) -> int:
        return self.attr_nums[self.attrs.index(attr)]


def read_training(
    spark: SparkSession,
    *,
    query: str | None = None,
    table: str | None = None,
    path: str | None = None,
    fmt: str = "parquet",
    view: str | None = None,
) -> DataFrame:
    """Training rows from exactly one of a SQL query, a table or files.

    ``view`` also registers the rows as a temporary view of that name.
    """
    if sum(x is not None for x in (query, table, path)) != 1:
        raise ValueError("give exactly one of query, table and path")
    if query is not None:
        df = spark.sql(query)
    elif table is not None:
        df = spark.table(table)
    else:
        df = spark.read.format(fmt).load(path)
    if view is not None:
        df.createOrReplaceTempView(view)
    return df


def resolve_column(columns: Sequence[str], name: str) -> str:
    """Exact match first, then a unique case-insensitive one."""
    if name in columns:
        return name
    close = [c for c in columns if c.lower() == name.lower()]
    if len(close) != 1:
        raise ValueError(f"no column {name!r} among {list(columns)}")
    return close[0]


def category(
    df: DataFrame,
    name: str,
    null_policy: str = "category",
    null_token: str = NULL_TOKEN,
    empty_as_null: bool = False,
) -> Column:
    """One column as a string category under the chosen null policy."""
    if null_policy not in ("category", "drop"):
        raise ValueError(f"unknown null_policy {null_policy!r}")
    if isinstance(df.schema[name].dataType, _NESTED):
        raise ValueError(f"column {name!r} is nested; attributes must be atomic")
    text = F.col(f"`{name}`").cast("string")
    if empty_as_null:
        text = F.nullif(text, F.lit(""))
    if null_policy == "category":
        text = F.coalesce(text, F.lit(null_token))
    return text.alias(name)


def encode_categories(
    df: DataFrame,
    label: str,
    *,
    null_policy: str = "category",
    null_token: str = NULL_TOKEN,
    empty_as_null: bool = False,
    keep: Sequence[str] = (),
) -> TrainingSet:
    """Cast the label and all attributes to string categories in one ``select``.

    ``category`` turns nulls into their own category; ``drop`` leaves them null
    so that they add nothing to the measures. Columns in ``keep`` (row ids and
    the like) are carried along unchanged and are not attributes.
    """
    keep = [resolve_column(df.columns, c) for c in keep]
    label = resolve_column(df.columns, label)
    columns = [c for c in df.columns if c not in keep]
    if len(set(c.lower() for c in columns)) != len(columns):
        raise ValueError(f"attribute names are not unique: {columns}")
    encoded = [category(df, c, null_policy, null_token, empty_as_null) for c in columns]
    attrs = tuple((i, c) for i, c in enumerate(columns) if c != label)
    return TrainingSet(
        df=df.select(*encoded, *[F.col(f"`{c}`") for c in keep]),
        label=label,
        label_num=columns.index(label),
        attrs=tuple(c for _, c in attrs),
        attr_nums=tuple(i for i, _ in attrs),
        null_policy=null_policy,
    )


def attribute_catalog(ts: TrainingSet) -> DataFrame:
    """Ordered columns of a training set: position, name, label flag.

    The rows come from the schema alone, so their number is the table width.
    """
    rows = [(n, a, False) for n, a in ts.names.items()]
    rows.append((ts.label_num, ts.label, True))
    return ts.df.sparkSession.createDataFrame(
        sorted(rows), "attr_num int, attr_name string, is_label boolean"
    )


def token_clashes(df: DataFrame, label: str, null_token: str = NULL_TOKEN) -> DataFrame:
    """Per column, how many rows are null and how many really hold the token."""
    ts = encode_categories(df, label, null_policy="drop")
    columns = [ts.label, *ts.attrs]
    return (
        ts.df.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("pos", "value"))
        .groupBy("pos")
        .agg(
            F.count_if(F.col("value").isNull()).alias("n_null"),
            F.count_if(F.col("value") == null_token).alias("n_token"),
        )
        .select(
            F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("pos") + 1).alias("attr_name"),
            "n_null",
            "n_token",
        )
    )
