"""Adding and removing training rows from existing count tables.

Counts are sums, so learning from more rows adds a delta and unlearning
subtracts one. The same functions serve batches and micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _merge(counts: DataFrame, delta: DataFrame, sign: int) -> DataFrame:
    keys = [c for c in counts.columns if c != "n"]
    signed = delta.select(*keys, (F.col("n") * sign).alias("n"))
    merged = counts.select(*keys, "n").unionByName(signed).groupBy(*keys).agg(F.sum("n").alias("n"))
    return _counted(merged)


def _counted(cells: DataFrame) -> DataFrame:
    """Cells above zero; one below is an error."""
    below = F.raise_error(F.lit("a removed row was never counted")).cast("bigint")
    return cells.filter(F.when(F.col("n") < 0, below).otherwise(F.col("n")) > 0)


def add_rows(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts after learning the rows that ``delta`` counts."""
    return _merge(counts, delta, 1)


def remove_rows(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts after unlearning the rows that ``delta`` counts.

    Cells that reach zero disappear; going below zero is an error.
    """
    return _merge(counts, delta, -1)


def count_stream(
    rows: DataFrame, counter: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, remove: bool = False
) -> StreamingQuery:
    """Count a stream of training rows into a log of deltas, one folder per batch.

    A replayed batch overwrites its own folder, so a restart never counts a row
    twice. ``counter`` turns a batch of rows into a count table. Adding and
    removing streams use different paths.
    """
    sign = -1 if remove else 1

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = counter(batch).withColumn("n", F.col("n") * sign)
        delta.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def logged_counts(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """Current counts: the sum of all logged deltas; a cell below zero is an error.

    A compacted log gives its snapshot and the batches that came after it.
    """
    keys = [f.name for f in schema if f.name != "n"]
    deltas = [spark.read.schema(schema).parquet(*folders).select(*keys, "n") for p in paths if (folders := _live_folders(spark, p))]
    union = deltas[0] if deltas else spark.createDataFrame([], schema).select(*keys, "n")
    for d in deltas[1:]:
        union = union.unionByName(d)
    return _counted(union.groupBy(*keys).agg(F.sum("n").alias("n")))


def compact_log(spark: SparkSession, schema: T.StructType, path: str) -> int:
    """Sum a log's batches into a new snapshot; returns the number of the last batch it covers, -1 for none.

    The snapshot is written beside the batches and counts once its manifest is renamed into place, so readers see
    the log before or after, and a run that dies leaves it as it was. A covered batch that is replayed is not
    counted again. Folders that a snapshot replaces stay for readers that began earlier, until ``drop_covered``.
    One compaction runs at a time, and none while a batch is being written.
    """
    batches, covered = _batches(spark, path), _covered(spark, path)
    last = max(batches, default=-1)
    if last <= covered:
        return covered
    keys = [f.name for f in schema if f.name != "n"]
    rows = spark.read.schema(schema).parquet(*_live_folders(spark, path)).groupBy(*keys).agg(F.sum("n").alias("n"))
    rows.write.mode("overwrite").parquet(f"{path}/snapshot={last}")
    files, folder = _file_system(spark, path)
    draft, manifest = (folder(f"{path}/manifest/{n}") for n in (f".covered-{last}", f"covered-{last}"))
    files.create(draft, True).close()
    files.rename(draft, manifest)
    return last


def drop_covered(spark: SparkSession, path: str) -> None:
    """Remove the batches and snapshots that the current snapshot replaces."""
    files, folder = _file_system(spark, path)
    covered = _covered(spark, path)
    for number in _numbers(spark, path, "batch="):
        if number <= covered:
            files.delete(folder(f"{path}/batch={number}"), True)
    for number in _numbers(spark, path, "snapshot="):
        if number < covered:
            files.delete(folder(f"{path}/snapshot={number}"), True)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path
    return folder(path).getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    files, folder = _file_system(spark, path)
    if not files.exists(folder(path)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder(path))]
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]


def _covered(spark: SparkSession, path: str) -> int:
    """The last batch of the current snapshot, -1 without one."""
    return max(_numbers(spark, f"{path}/manifest", "covered-"), default=-1)


def _batches(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, path, "batch=")


def _live_folders(spark: SparkSession, path: str) -> list[str]:
    covered = _covered(spark, path)
    snapshot = [f"{path}/snapshot={covered}"] if covered >= 0 else []
    return snapshot + [f"{path}/batch={b}" for b in sorted(_batches(spark, path)) if b > covered]
