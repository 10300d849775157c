"""Intermediate tables in shared storage.

Counts are read several times after one expensive scan. They are written to the
folder the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a
re-read and the written size lets Spark choose its joins on real statistics.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# Rows that a reader of parquet takes at once at most, and numbers in arrays that it should hold at once.
READER_ROWS, READER_VALUES = 4096, 1 << 19

# Row groups of a file of wide rows. Their arrays may take hardly any bytes, and tasks are dealt out by files and bytes.
GROUPS_PER_FILE = 4

_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("staging_run", default=None)


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``, else the folder given to
    ``setCheckpointDir``. Without either a private folder is made where driver
    and executors are one process; anywhere else that is an error, since
    executors could not see it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _private_root(sc.applicationId)
    return root.rstrip("/")


@functools.cache
def _private_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"kadence-{application}-")


def new_stage_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, within the current ``staging_run`` if there is one."""
    root = _run.get() or f"{staging_root(spark)}/kadence"
    return f"{root}/{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def staging_run(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go to one folder, which is removed at the end.

    Results must be written or collected before it ends. Paths that the caller
    names are not touched.
    """
    root = f"{staging_root(spark)}/kadence/run-{uuid.uuid4().hex}"
    token = _run.set(root)
    try:
        yield root
    finally:
        _run.reset(token)
        _remove(spark, root)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has come to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stage(
    df: DataFrame,
    name: str,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
    width: int = 1,
) -> DataFrame:
    """Write ``df`` once and return it read back.

    A given ``path`` is overwritten, which is the reset before a new run;
    without one the table goes to a fresh folder. ``rebalance`` suits tables of
    many folders: each gets few files, and a large one is still split. ``width``
    tells how many numbers the longest array of a row holds: a reader takes
    thousands of rows of a row group at once, so one of wide rows gets few.
    """
    spark = df.sparkSession
    path = path or new_stage_path(spark, name)
    rows = df.hint("rebalance", *partition_by) if rebalance else df
    writer = rows.write.mode("overwrite").partitionBy(*partition_by)
    most = max(1, READER_VALUES // max(1, width))
    if most < READER_ROWS:
        writer = writer.option("parquet.block.row.count.limit", most).option("maxRecordsPerFile", GROUPS_PER_FILE * most)
    writer.parquet(path)
    partitions = {c: df.schema[c] for c in partition_by}
    fields = [f for f in df.schema if f.name not in partitions] + list(partitions.values())
    schema = type(df.schema)(fields)
    return spark.read.schema(schema).parquet(path).select(*df.columns)


def stage_parts(
    parts: Sequence[Callable[[], DataFrame]],
    name: str,
    path: str,
    layout: str,
    partition_by: Sequence[str] = (),
    resume: bool = False,
) -> DataFrame:
    """One table written part by part, a folder each, and read back with the part's number as ``part``.

    With ``resume`` the parts that an earlier run of the same ``layout`` completed are kept, so a run that was
    ended goes on where it stopped; the caller answers for the rows being the same. Otherwise ``path`` is cleared.
    """
    schema = parts[0]().schema
    spark = parts[0]().sparkSession
    if not resume:
        _remove(spark, path)
    root = f"{path}/layout={layout}"
    for number, part in enumerate(parts):
        if not is_complete(spark, f"{root}/part={number}"):
            stage(part(), name, f"{root}/part={number}", partition_by)
    partitions = {c: schema[c] for c in partition_by}
    fields = [f for f in schema if f.name not in partitions]
    read_as = type(schema)([*fields, T.StructField("part", T.IntegerType()), *partitions.values()])
    return spark.read.schema(read_as).parquet(root).select(*schema.names, "part")
