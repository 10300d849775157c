"""A model table in the shapes scoring reads: a row per cell, and cells nested by value, classes as vectors.

A nested row answers every level of a value at once: it holds the value's own cell and those of the parent
paths whose first parent falls into its bucket. An attribute has as many buckets as its cells ask for, so a
row holds few paths, and a line of evidence knows its row from its own values. With more classes than a
vector holds, every row of these tables is there once per chunk of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.conventions import parent_columns
from kadence.functions.probability import log_m_estimate
from kadence.operators.chunks import CHUNK, CLASSES_PER_VECTOR, ClassChunks, class_chunks, entries_by_chunk, read_chunks, whole_vectors
from kadence.operators.network import Network
from kadence.operators.params import cell_columns, join_on_key, path_columns
from kadence.sources.staging import stage

# Largest lookup table, in estimated bytes, that is copied to every executor.
# Beyond it the join is left to Spark, which shuffles both sides by key.
BROADCAST_BYTES = 256 * 1024 * 1024

SLICE = ["level", "attr_num"]

# Paths that a nested row holds on average.
PATHS_PER_ROW = 16

# Classes that are written into a plan; more are read from the model.
LITERAL_CLASSES = 64

# Memory of a cell or path besides its text and its vectors.
ENTRY_BYTES = 96

NOT_FILLED = "a model cell has no row for some class; fill the model before compiling it"


@dataclass(frozen=True)
class CompiledModel:
    """Staged lookup tables and the small facts needed to plan with them.

    ``cells``: level, attr_num, attr_value, parents, class vectors ``n``,
    ``parents_count`` and ``log_prob``, and ``support`` (rows over all classes).
    ``paths``: level, attr_num, parents and ``zero_log_prob``, the vector of a
    value that was never seen under that path. Both are partitioned by level and
    attribute. ``nested`` and ``nested_paths`` hold the same by attribute, value and
    bucket: ``path``, an array of parent paths, the empty one first, and an array
    of each vector beside it. ``class_table`` is one row: all classes, their counts.

    With ``chunks``, every table has a row per chunk, ``class_table`` too, and ``nested`` holds ``log_prob`` alone.
    """

    net: Network
    cells: DataFrame
    paths: DataFrame
    nested: DataFrame
    nested_paths: DataFrame
    class_table: DataFrame
    num_classes: int
    #: Rows that the model was learned from: the sum of the classes' counts.
    num_rows: int
    #: (attribute, level) -> rows and bytes of text of the cells, and of the paths.
    cell_sizes: dict[tuple[int, int], tuple[int, int]]
    path_sizes: dict[tuple[int, int], tuple[int, int]]
    chunks: ClassChunks | None = None

    @cached_property
    def _known(self):
        return self._whole_class_table().first()

    @property
    def classes(self) -> tuple[str, ...]:
        return tuple(self._known.classes)

    @property
    def class_counts(self) -> tuple[int, ...]:
        return tuple(self._known.counts)

    def _whole_class_table(self) -> DataFrame:
        return whole_vectors(self.class_table, [], ["classes", "counts"]) if self.chunks else self.class_table

    @property
    def k(self) -> int:
        return self.net.k

    @property
    def cell_rows(self) -> dict[int, int]:
        return _by_level(self.cell_sizes)

    @property
    def path_rows(self) -> dict[int, int]:
        return _by_level(self.path_sizes)

    def class_names(self) -> Column:
        """All classes in order, as an array."""
        if self.num_classes <= LITERAL_CLASSES:
            return F.array(*[F.lit(c) for c in self.classes]).cast("array<string>")
        return self._whole_class_table().select("classes").scalar()

    def class_totals(self) -> Column:
        """The classes' counts, in the same order."""
        if self.num_classes <= LITERAL_CLASSES:
            return F.array(*[F.lit(n) for n in self.class_counts]).cast("array<bigint>")
        return self._whole_class_table().select("counts").scalar()

    def whole_nested(self) -> DataFrame:
        """``nested`` with vectors of all classes, built anew if the model is in chunks."""
        if not self.chunks:
            return self.nested
        vectors = ["n", "parents_count", "log_prob"]
        cells = whole_vectors(self.cells, [*cell_columns(self.k), "support"], vectors)
        return _nested(cells, self.cell_sizes, self.k, [*vectors, "support"], [])

    def nested_bytes(self, vectors: int = 1) -> int:
        """Measured text and the vectors of all nested cells, each value's own cell once per bucket."""
        buckets = cell_buckets(self.cell_sizes)
        return sum(
            (text + rows * (ENTRY_BYTES + 8 * self.num_classes * vectors)) * (1 if level else buckets[num])
            for (num, level), (rows, text) in self.cell_sizes.items()
        )

    def path_bytes(self) -> int:
        each = ENTRY_BYTES + 8 * self.num_classes
        return sum(text + rows * each for (_, level), (rows, text) in self.path_sizes.items() if level)


def _by_level(sizes: dict[tuple[int, int], tuple[int, int]]) -> dict[int, int]:
    rows: dict[int, int] = {}
    for (_, level), (n, _) in sizes.items():
        rows[level] = rows.get(level, 0) + n
    return rows


def cell_buckets(sizes: dict[tuple[int, int], tuple[int, int]]) -> dict[int, int]:
    """Buckets of each attribute's values: so many that a nested row holds ``PATHS_PER_ROW`` paths on average."""
    deep, values = _deep(sizes), {num: n for (num, level), (n, _) in sizes.items() if level == 0}
    return {num: max(1, -(-deep.get(num, 0) // (PATHS_PER_ROW * n))) for num, n in values.items()}


def path_buckets(sizes: dict[tuple[int, int], tuple[int, int]]) -> dict[int, int]:
    return {num: max(1, -(-n // PATHS_PER_ROW)) for num, n in _deep(sizes).items()}


def _deep(sizes: dict[tuple[int, int], tuple[int, int]]) -> dict[int, int]:
    deep: dict[int, int] = {}
    for (num, level), (n, _) in sizes.items():
        if level:
            deep[num] = deep.get(num, 0) + n
    return deep


def bucket_count(buckets: dict[int, int], num: Column) -> Column:
    width = max(buckets, default=0) + 1
    return F.get(F.array(*[F.lit(buckets.get(i, 1)) for i in range(width)]), num)


def bucket_of(count: Column, k: int) -> Column:
    """A line's bucket by its first parent; the first one without a parent."""
    if not k:
        return F.lit(0)
    return F.when(F.col("parent1").isNotNull(), F.pmod(F.xxhash64("parent1"), count)).otherwise(F.lit(0)).cast("int")


def path_of(k: int, level: int | None = None) -> Column:
    """The bound parents as an array: all up to ``level``, or those that are not null."""
    if level is not None:
        return F.array(*[F.col(c) for c in parent_columns(level)]).cast("array<string>")
    return F.filter(F.array(*[F.col(c) for c in parent_columns(k)]).cast("array<string>"), lambda p: p.isNotNull())


def _nest(rows: DataFrame, keys: list[str], k: int, vectors: list[str]) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(path_of(k).alias("path"), *vectors)))
    nested = rows.groupBy(*keys).agg(entries.alias("entries"))
    return nested.select(*keys, *[F.col(f"entries.{c}").alias(c) for c in ("path", *vectors)])


def _class_vectors(df: DataFrame, keys: list[str], columns: list[str], classes: Column) -> DataFrame:
    """The rows of each key as vectors in the order of ``classes``; a key without a row for each is an error."""
    entries = F.sort_array(F.collect_list(F.struct("class", *columns)))
    whole = F.col("entries.class") == classes
    vectors = [F.when(whole, F.col(f"entries.{c}")).otherwise(F.raise_error(F.lit(NOT_FILLED))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(entries.alias("entries")).select(*keys, *vectors)


def _nested(cells: DataFrame, sizes: dict[tuple[int, int], tuple[int, int]], k: int, vectors: list[str], more: list[str]) -> DataFrame:
    """Cells by attribute, value and bucket; a value's own cell is in each of its buckets."""
    count = bucket_count(cell_buckets(sizes), F.col("attr_num"))
    places = F.when(F.col("level") == 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array(bucket_of(count, k)))
    return _nest(cells.withColumn("bucket", F.explode(places)), ["attr_num", "attr_value", "bucket", *more], k, vectors)


def _nested_paths(paths: DataFrame, sizes: dict[tuple[int, int], tuple[int, int]], k: int, more: list[str]) -> DataFrame:
    bucket = bucket_of(bucket_count(path_buckets(sizes), F.col("attr_num")), k)
    return _nest(paths.filter("level > 0").withColumn("bucket", bucket), ["attr_num", "bucket", *more], k, ["zero_log_prob"])


def keep_cells(model: DataFrame, cells: DataFrame, chunks: ClassChunks) -> DataFrame:
    """``model`` with its ``chunked_cells`` known, so that compiling it does not gather them from its rows again.

    They belong to this table alone: what is selected or filtered from it has rows only.
    """
    model.kept_cells = (cells, chunks)
    return model


def compile_model(model: DataFrame, structure: DataFrame, path: str | None = None) -> CompiledModel:
    """Turn a model table into staged lookup tables, written once.

    The class list, the class counts and the size of each attribute's levels
    come back to the driver: they depend on classes, attributes and k only. With
    more classes than a vector holds, the classes stay in a staged table.
    """
    net = Network.from_structure(structure)
    at = lambda name: f"{path}/{name}" if path else None
    known = vars(model).get("kept_cells")
    if known:
        compiled = _compile_chunks(net, *known, at)
    elif chunks := class_chunks(model.filter(F.col("attr_name").isNull()).select("class", "n"), at("class_table")):
        compiled = _compile_chunks(net, _chunked_rows(model, net.k, chunks), chunks, at)
    else:
        compiled = _compile_whole(model, net, at)
    if path:
        if known:
            stage(known[1].table, "class_table", at("class_table"))
        stage(structure.coalesce(1), "structure", at("structure"))
    return compiled


def _compile_whole(model: DataFrame, net: Network, at) -> CompiledModel:
    k = net.k
    n, total, values = F.col("n"), F.col("parents_count"), F.col("num_values")
    rows = model.filter(F.col("attr_name").isNotNull()).withColumn("log_prob", log_m_estimate(n, total, values))
    priors = F.sort_array(F.collect_list(F.struct("class", "n")))
    class_table = model.filter(F.col("attr_name").isNull()).agg(priors.alias("priors"))
    class_table = class_table.select(F.col("priors.class").alias("classes"), F.col("priors.n").alias("counts"))
    class_table = stage(class_table, "class_table", at("class_table"))
    width = class_table.select(F.size("classes").alias("size")).first()["size"]
    support = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b)
    vectors = ["n", "parents_count", "log_prob"]
    cells = _class_vectors(rows, [*cell_columns(k), "num_values"], vectors, class_table.select("classes").scalar())
    cells = stage(cells.withColumn("support", support), "cells", at("cells"), SLICE, rebalance=True, width=width)
    zero = F.transform("parents_count", lambda t: log_m_estimate(F.lit(0), t, F.col("num_values")))
    paths = (
        cells.groupBy(*path_columns(k), "num_values")
        .agg(F.any_value("parents_count").alias("parents_count"))
        .select(*path_columns(k), zero.alias("zero_log_prob"))
    )
    paths = stage(paths, "paths", at("paths"), SLICE, rebalance=True, width=width)
    sizes = _sizes(cells, k), _sizes(paths, k)
    nested = _nested(cells, sizes[0], k, ["log_prob", "n", "parents_count", "support"], [])
    nested_paths = _nested_paths(paths, sizes[1], k, [])
    nested, nested_paths = (
        stage(t, name, at(name), ["attr_num"], rebalance=True, width=PATHS_PER_ROW * width) for t, name in ((nested, "nested"), (nested_paths, "nested_paths"))
    )
    return _compiled(net, cells, paths, nested, nested_paths, class_table, *sizes)


def _chunked_rows(model: DataFrame, k: int, chunks: ClassChunks) -> DataFrame:
    """The rows of each cell as vectors by chunk; a chunk without a row for each of its classes is an error."""
    rows = model.filter(F.col("attr_name").isNotNull())
    keys = [*cell_columns(k), "num_values"]
    found = entries_by_chunk(rows, keys, chunks, ["n", "parents_count"], "entries")
    sizes = F.broadcast(chunks.sizes().withColumnRenamed(CHUNK, "__chunk"))
    found = found.join(sizes, F.col(CHUNK) == F.col("__chunk"), "left")
    whole = F.col("entries.place") == F.sequence(F.lit(0), F.col("size") - 1)
    vectors = [F.when(whole, F.col(f"entries.{c}")).otherwise(F.raise_error(F.lit(NOT_FILLED))).alias(c) for c in ("n", "parents_count")]
    return stage(found.select(*keys, CHUNK, *vectors), "model_cells", width=CLASSES_PER_VECTOR)


def _compile_chunks(net: Network, rows: DataFrame, chunks: ClassChunks, at) -> CompiledModel:
    """The same tables with a row per chunk. What a cell has over all chunks comes from one row per cell."""
    k = net.k
    keys = cell_columns(k)
    own = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b)
    known = rows.select(*keys, own.alias("own")).groupBy(*keys).agg(F.sum("own").alias("support"), F.count(F.lit(1)).alias("held"))
    filled = F.when(F.col("held") == len(chunks.ids), F.col("support")).otherwise(F.raise_error(F.lit(NOT_FILLED)))
    # Staged, so that its written size lets it be sent to the vectors.
    known = stage(known.select(*keys, filled.alias("support")), "supports")
    log_prob = F.zip_with("n", "parents_count", lambda n, t: log_m_estimate(n, t, F.col("num_values")))
    cells = join_on_key(rows.withColumn("log_prob", log_prob), known, keys)
    cells = stage(cells, "cells", at("cells"), SLICE, width=CLASSES_PER_VECTOR)
    zero = F.transform("parents_count", lambda t: log_m_estimate(F.lit(0), t, F.col("num_values")))
    firsts = known.groupBy(*path_columns(k)).agg(F.min("attr_value").alias("attr_value"))
    paths = join_on_key(cells, firsts, keys).select(*path_columns(k), CHUNK, zero.alias("zero_log_prob"))
    paths = stage(paths, "paths", at("paths"), SLICE, width=CLASSES_PER_VECTOR)
    sizes = _sizes(cells, k, chunks), _sizes(paths, k, chunks)
    nested, nested_paths = _nested(cells, sizes[0], k, ["log_prob"], [CHUNK]), _nested_paths(paths, sizes[1], k, [CHUNK])
    nested, nested_paths = (
        stage(t, name, at(name), ["attr_num"], width=PATHS_PER_ROW * CLASSES_PER_VECTOR) for t, name in ((nested, "nested"), (nested_paths, "nested_paths"))
    )
    return _compiled(net, cells, paths, nested, nested_paths, chunks.table, *sizes, chunks)


def load_compiled(spark: SparkSession, path: str) -> CompiledModel:
    """A model that ``compile_model`` wrote to ``path``, without compiling it again."""
    net = Network.from_structure(spark.read.parquet(f"{path}/structure"))
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("cells", "paths", "nested", "class_table")]
    chunks = read_chunks(tables[3]) if CHUNK in tables[3].columns else None
    # Without parents there are no paths, so no files to read a schema from.
    ddl = f"bucket int, {f'{CHUNK} int, ' if chunks else ''}path array<array<string>>, zero_log_prob array<array<double>>, attr_num int"
    tables.insert(3, spark.read.schema(ddl).parquet(f"{path}/nested_paths"))
    return _compiled(net, *tables, _sizes(tables[0], net.k, chunks), _sizes(tables[1], net.k, chunks), chunks)


def _compiled(net: Network, cells, paths, nested, nested_paths, class_table: DataFrame, cell_sizes, path_sizes, chunks=None) -> CompiledModel:
    known = None if chunks else class_table.select(F.size("classes").alias("size"), "counts").first()
    return CompiledModel(
        net=net,
        cells=cells,
        paths=paths,
        nested=nested,
        nested_paths=nested_paths,
        class_table=class_table,
        num_classes=chunks.num_classes if chunks else known["size"],
        num_rows=chunks.num_rows if chunks else sum(known.counts),
        cell_sizes=cell_sizes,
        path_sizes=path_sizes,
        chunks=chunks,
    )


def _sizes(table: DataFrame, k: int, chunks: ClassChunks | None = None) -> dict[tuple[int, int], tuple[int, int]]:
    """(attribute, level) -> rows, bytes of the values and parents."""
    columns = [c for c in ("attr_value", *parent_columns(k)) if c in table.columns]
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    # Every cell has a row in each chunk.
    table = table.filter(F.col(CHUNK) == chunks.ids[0]) if chunks else table
    sizes = table.groupBy("attr_num", "level").agg(F.count(F.lit(1)).alias("rows"), F.sum(text).alias("text"))
    return {(r.attr_num, r.level): (r.rows, r.text) for r in sizes.collect()}
