"""Conditional counts, the model table and its smoothed probabilities.

A cell is (attribute, level, value, parent values); level is the number of
bound parents, the rest of the parent columns are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.conventions import PRIOR_NUM, parent_columns
from kadence.functions.probability import log_m_estimate, m_estimate
from kadence.operators.chunks import CHUNK, ClassChunks, counts_of, entries_by_chunk
from kadence.operators.counts import name_of, weighted_rows
from kadence.operators.network import Network, Node
from kadence.sources.training import TrainingSet

# Parent paths and domain values that meet in one block of the dense fill: a block gives
# at most about as many rows as their product, whatever the numbers of paths and values.
PATHS_PER_BLOCK, VALUES_PER_BLOCK = 20_000, 256

# Columns that a grouping id has room for.
GROUPING_COLUMNS = 64


def path_columns(k: int) -> list[str]:
    return ["attr_num", "level", *parent_columns(k)]


def cell_columns(k: int) -> list[str]:
    return ["attr_num", "level", "attr_value", *parent_columns(k)]


def bound_level(parents: Sequence[Column]) -> Column:
    """Number of leading parents that are not null."""
    level = F.lit(len(parents))
    for i in range(len(parents) - 1, -1, -1):
        level = F.when(parents[i].isNull(), F.lit(i)).otherwise(level)
    return level


def evidence_struct(node: Node, k: int, column, complete: bool) -> Column:
    """(attr_num, level, attr_value, parent1..k) of one attribute of a row.

    ``column`` maps an attribute name to the expression that holds its value.
    A null parent ends the parent prefix.
    """
    parents = [column(p) for p in node.parents]
    level = F.lit(len(parents)) if complete else bound_level(parents)
    fields = [
        F.lit(node.attr_num).alias("attr_num"),
        level.alias("level"),
        column(node.name).alias("attr_value"),
    ]
    for i, name in enumerate(parent_columns(k)):
        if i >= len(parents):
            value = F.lit(None).cast("string")
        elif complete:
            value = parents[i]
        else:
            value = F.when(level > i, parents[i])
        fields.append(value.alias(name))
    return F.struct(*fields)


def _prior_struct(k: int) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(PRIOR_NUM).alias("attr_num"),
        F.lit(0).alias("level"),
        null.alias("attr_value"),
        *[null.alias(c) for c in parent_columns(k)],
    )


def _roll_up(deepest: DataFrame, k: int) -> DataFrame:
    """Sum the deepest cells into every shorter parent prefix."""
    levels = deepest.select("*", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("to"))
    parents = [F.when(F.col("to") > i, F.col(c)).alias(c) for i, c in enumerate(parent_columns(k))]
    keys = [*cell_columns(k), "class"]
    return (
        levels.select("attr_num", F.col("to").alias("level"), "attr_value", *parents, "class", "n")
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"))
    )


def conditional_counts(ts: TrainingSet, net: Network, pregroup: bool | str = False) -> DataFrame:
    """n(value, parents[1..g], class) for every attribute and level g, in one scan.

    The scan counts only the deepest level (plus the class itself); shorter
    prefixes are summed from those cells. Rows without a class are left out, as
    is a null value of an attribute.
    """
    k = net.k
    column = lambda name: F.col(f"`{name}`")
    structs = [evidence_struct(n, k, column, ts.complete) for n in net.nodes]
    cells = (
        weighted_rows(ts, pregroup)
        .select(F.col(f"`{ts.label}`").alias("class"), "n", F.explode(F.array(_prior_struct(k), *structs)).alias("e"))
        .select("e.*", "class", "n")
    )
    if not ts.complete:
        keep = F.col("attr_value").isNotNull() | (F.col("attr_num") == PRIOR_NUM)
        cells = cells.filter(keep & F.col("class").isNotNull())
    deepest = cells.groupBy(*cell_columns(k), "class").agg(F.sum("n").alias("n"))
    return _roll_up(deepest, k) if k else deepest


def _blocks(net: Network, width: int) -> list[list[Node]]:
    """The attributes in runs whose columns, parents included, number ``width`` at most."""
    blocks: list[list[Node]] = []
    columns: set[str] = set()
    for node in net.nodes:
        more = columns | {node.name, *node.parents}
        if not blocks or len(more) > width:
            blocks.append([])
            more = {node.name, *node.parents}
        blocks[-1].append(node)
        columns = more
    return blocks or [[]]


def conditional_counts_grouping_sets(ts: TrainingSet, net: Network) -> DataFrame:
    """The same counts by GROUPING SETS, one set per attribute with all its parents.

    Shorter prefixes are summed from those cells. A grouping id has room for 64
    columns, so a wider table is counted in blocks of attributes, a scan each.
    Needs complete rows, where a null in the result can only mean "not in this set".
    """
    if not ts.complete:
        raise ValueError("grouping sets need the 'category' null policy")
    k = net.k
    if k + 2 > GROUPING_COLUMNS:
        raise ValueError("an attribute with its parents is wider than a grouping id")
    parts = [_grouped(ts, nodes, k, i == 0) for i, nodes in enumerate(_blocks(net, GROUPING_COLUMNS - 1))]
    deepest = parts[0]
    for part in parts[1:]:
        deepest = deepest.unionByName(part)
    return _roll_up(deepest, k) if k else deepest


def _grouped(ts: TrainingSet, nodes: Sequence[Node], k: int, with_prior: bool) -> DataFrame:
    """Deepest cells of some attributes, and n(class) if asked, from one pass with grouping sets."""
    used = list(dict.fromkeys([ts.label, *[c for n in nodes for c in (n.name, *n.parents)]]))
    cells = [(PRIOR_NUM, None, ())] if with_prior else []
    cells += [(n.attr_num, n.name, tuple(n.parents)) for n in nodes]
    sets = [[ts.label, *([name] if name else []), *its] for _, name, its in cells]
    bits = {c: 1 << (len(used) - 1 - i) for i, c in enumerate(used)}
    ids = [sum(b for c, b in bits.items() if c not in s) for s in sets]
    # Two attributes can have one set of columns, each the other's parent; the sets are then told apart by place.
    col = lambda name: F.col(f"`{name}`")
    own = {}
    for gid, cell in zip(ids, cells):
        own.setdefault(gid, []).append(cell)

    def struct(cell) -> Column:
        num, name, its = cell
        null = F.lit(None).cast("string")
        values = [col(its[i]) if i < len(its) else null for i in range(k)]
        return F.struct(
            F.lit(num).alias("attr_num"),
            F.lit(len(its)).alias("level"),
            (col(name) if name else null).alias("attr_value"),
            *[v.alias(p) for v, p in zip(values, parent_columns(k))],
        )

    chosen = None
    for gid, same in own.items():
        found = F.array(*[struct(c) for c in same])
        chosen = F.when(F.col("gid") == gid, found) if chosen is None else chosen.when(F.col("gid") == gid, found)
    distinct = list({gid: [col(c) for c in s] for gid, s in zip(ids, sets)}.values())
    return (
        weighted_rows(ts)
        .groupingSets(distinct, *[col(c) for c in used])
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
        .select(col(ts.label).alias("class"), "n", F.explode(chosen).alias("e"))
        .select("e.*", "class", "n")
    )


def prior_counts(counts: DataFrame) -> DataFrame:
    """n(class) out of conditional counts."""
    return counts.filter(F.col("attr_num") == PRIOR_NUM).groupBy("class").agg(F.sum("n").alias("n"))


def attribute_cells(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("attr_num") != PRIOR_NUM)


def class_list(y: DataFrame) -> Column:
    """All classes in order, as a scalar subquery (one entry per class)."""
    return y.agg(F.sort_array(F.collect_set("class"))).scalar()


def class_vectors(counts: DataFrame, keys: Sequence[str], classes: Column, name: str) -> DataFrame:
    """One row per key with the counts of all classes in class order.

    A group holds at most one entry per class; another is an error. A zero for every class and the entries are sorted
    together, so each zero has its class's entry beside it: no class is searched for in a list.
    """
    entry = F.struct("class", F.lit(1).alias("counted"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    zeros = F.transform("classes", lambda c: F.struct(c.alias("class"), F.lit(0).alias("counted"), F.lit(0).cast("bigint").alias("n")))
    sides = F.zip_with("all", F.slice("all", F.lit(2), F.size("all")), _count_beside)
    return (
        counts.groupBy(*keys)
        .agg(F.collect_list(entry).alias("entries"))
        .withColumn("classes", classes)
        .select(*keys, F.sort_array(F.concat(zeros, "entries")).alias("all"))
        .select(*keys, F.filter(sides, lambda n: n.isNotNull()).alias(name))
    )


def _count_beside(a: Column, b: Column) -> Column:
    """The count of a class, told by its zero ``a`` and what follows; null where ``a`` is an entry."""
    same = a["class"] == b["class"]
    twice = F.raise_error(F.lit("a cell is counted twice for one class")).cast("bigint")
    return F.when(a["counted"] == 0, F.when(same, b["n"]).otherwise(a["n"])).when(same, twice)


def _explode_classes(vectors: DataFrame, keys: Sequence[str], classes: Column, columns: Sequence[str]) -> DataFrame:
    zipped = F.arrays_zip(classes.alias("class"), *[F.col(c) for c in columns])
    return vectors.select(*keys, F.explode(zipped).alias("z")).select(*keys, "z.class", *[f"z.{c}" for c in columns])


def zero_fill(counts: DataFrame, y: DataFrame, k: int) -> DataFrame:
    """Add count-0 rows so that every observed cell has all classes (sparse fill)."""
    classes = class_list(y)
    keys = cell_columns(k)
    return _explode_classes(class_vectors(attribute_cells(counts), keys, classes, "n"), keys, classes, ["n"])


def path_counts(counts: DataFrame, k: int) -> DataFrame:
    """n(parents, class) per attribute and level: the sum over the attribute's values."""
    return attribute_cells(counts).groupBy(*path_columns(k), "class").agg(F.sum("n").alias("n"))


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Equality on keys where unbound (null) parents are equal."""
    return [left[c].eqNullSafe(right[f"__{c}"]) if c.startswith("parent") else left[c] == right[f"__{c}"] for c in keys]


def join_on_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({c: f"__{c}" for c in keys})
    return left.join(right, _same_key(left, right, keys), how).drop(*[f"__{c}" for c in keys])


def with_parents_count(cells: DataFrame, counts: DataFrame, y: DataFrame, k: int) -> DataFrame:
    """Attach the class vector of parent-path totals to class-vector cells.

    Totals come from an aggregate joined back rather than a window. Level 0 has
    one total per attribute, under which all its values would meet; these few
    rows are broadcast, as many as the table has columns. Deeper totals are
    joined by their path.
    """
    keys = path_columns(k)
    totals = class_vectors(path_counts(counts, k), keys, class_list(y), "parents_count")
    flat = totals.filter(F.col("level") == 0).select("attr_num", "parents_count")
    top = cells.filter(F.col("level") == 0).join(F.broadcast(flat), "attr_num").select(*cells.columns, "parents_count")
    if not k:
        return top
    deeper = join_on_key(cells.filter(F.col("level") > 0), totals.filter(F.col("level") > 0), keys)
    return top.unionByName(deeper.select(*cells.columns, "parents_count"))


def sparse_cells(counts: DataFrame, y: DataFrame, k: int) -> DataFrame:
    """Every observed cell once, with n and parents_count as class vectors."""
    cells = class_vectors(attribute_cells(counts), cell_columns(k), class_list(y), "n")
    return with_parents_count(cells, counts, y, k)


def dense_cells(counts: DataFrame, y: DataFrame, k: int, domains: DataFrame | None = None) -> DataFrame:
    """Every domain value under every observed parent path, with class vectors.

    Paths and domain values of an attribute meet in a grid of blocks, as many as their
    counted numbers ask for, so neither many paths nor a wide domain lands in few tasks.
    """
    classes = class_list(y)
    if domains is None:
        level0 = attribute_cells(counts).filter(F.col("level") == 0)
        domains = level0.select("attr_num", "attr_value").distinct()
    paths = class_vectors(path_counts(counts, k), path_columns(k), classes, "parents_count")
    grid = _grid(paths, domains, k)
    seen = class_vectors(attribute_cells(counts), cell_columns(k), classes, "n")
    zeros = F.transform(F.col("parents_count"), lambda _: F.lit(0).cast("bigint"))
    return join_on_key(grid, seen, cell_columns(k), "left").select(
        *cell_columns(k), F.coalesce("n", zeros).alias("n"), "parents_count"
    )


def _grid(paths: DataFrame, domains: DataFrame, k: int) -> DataFrame:
    """Every path of an attribute with every value of its domain, by blocks of both."""
    some = lambda rows, per, name: rows.groupBy("attr_num").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    # A row per attribute, so safe to broadcast.
    shape = some(paths, PATHS_PER_BLOCK, "path_blocks").join(some(domains, VALUES_PER_BLOCK, "value_blocks"), "attr_num")
    shape = F.broadcast(shape)
    own = lambda columns, blocks: F.pmod(F.xxhash64(*columns), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = paths.join(shape, "attr_num").withColumn("path_block", own([F.col(c) for c in path_columns(k)], "path_blocks"))
    left = left.withColumn("value_block", every("value_blocks")).drop("path_blocks", "value_blocks")
    right = domains.select("attr_num", "attr_value").join(shape, "attr_num").withColumn("value_block", own([F.col("attr_value")], "value_blocks"))
    right = right.withColumn("path_block", every("path_blocks")).drop("path_blocks", "value_blocks")
    return left.join(right, ["attr_num", "path_block", "value_block"]).drop("path_block", "value_block")


def chunked_cells(counts: DataFrame, net: Network, chunks: ClassChunks, fill: str = "sparse") -> DataFrame:
    """The cells of ``sparse_cells`` or ``dense_cells`` with a row per chunk of the classes, and their ``num_values``.

    Only the entries that were counted are moved; zeros are filled in where the vectors are made.
    """
    k = net.k
    keys, paths = cell_columns(k), path_columns(k)
    sizes = F.broadcast(chunks.sizes())
    seen = entries_by_chunk(attribute_cells(counts), keys, chunks, ["n"], "entries")
    totals = entries_by_chunk(path_counts(counts, k), paths, chunks, ["n"], "path_entries")
    if _known_fill(fill) == "sparse":
        grid = attribute_cells(counts).select(*keys).distinct().crossJoin(sizes)
    else:
        level0 = attribute_cells(counts).filter(F.col("level") == 0)
        every = attribute_cells(counts).select(*paths).distinct().crossJoin(sizes)
        grid = _grid(every, level0.select("attr_num", "attr_value").distinct(), k)
    # The path's entries come last: joined earlier, they would be moved once for each of its values.
    rows = join_on_key(join_on_key(grid, seen, [*keys, CHUNK], "left"), totals, [*paths, CHUNK], "left")
    return rows.select(
        *keys,
        CHUNK,
        counts_of("entries", "size").alias("n"),
        counts_of("path_entries", "size").alias("parents_count"),
        num_values_of(net, F.col("attr_num")).alias("num_values"),
    )


def chunked_model_table(cells: DataFrame, net: Network, chunks: ClassChunks, limit: int) -> DataFrame:
    """The model table out of ``chunked_cells``: a row per cell and class, and the prior rows."""
    k = net.k
    names = chunks.table.select(F.col(CHUNK).alias("__chunk"), "classes")
    names = F.broadcast(names) if chunks.text <= limit else names
    rows = cells.join(names, F.col(CHUNK) == F.col("__chunk"))
    rows = _explode_classes(rows, [*cell_columns(k), "num_values"], F.col("classes"), ["n", "parents_count"])
    rows = rows.withColumn("attr_name", name_of(net.names, F.col("attr_num")))
    y = chunks.table.select(F.inline(F.arrays_zip(F.col("classes").alias("class"), F.col("counts").alias("n"))))
    return rows.select(*model_columns(k)).unionByName(class_prior_rows(y, k))


def num_values_of(net: Network, num: Column) -> Column:
    """Domain size for an attribute number, from the structure."""
    sizes = {n.attr_num: n.num_values for n in net.nodes}
    width = max(sizes, default=0) + 1
    return F.get(F.array(*[F.lit(sizes.get(i)).cast("bigint") for i in range(width)]), num)


def class_prior_rows(y: DataFrame, k: int) -> DataFrame:
    """Model rows with a null attribute: n(class) of all rows."""
    null = F.lit(None).cast("string")
    return y.select(
        F.lit(None).cast("int").alias("attr_num"),
        null.alias("attr_name"),
        null.alias("attr_value"),
        *[null.alias(c) for c in parent_columns(k)],
        "class",
        "n",
        F.lit(0).alias("level"),
        y.agg(F.count(F.lit(1))).scalar().alias("num_values"),
        y.agg(F.sum("n")).scalar().alias("parents_count"),
    )


def model_columns(k: int) -> list[str]:
    return [
        "attr_num",
        "attr_name",
        "attr_value",
        *parent_columns(k),
        "class",
        "n",
        "level",
        "num_values",
        "parents_count",
    ]


def _known_fill(fill: str) -> str:
    if fill not in ("sparse", "dense"):
        raise ValueError(f"unknown fill {fill!r}")
    return fill


def model_table(
    counts: DataFrame,
    net: Network,
    fill: str = "sparse",
    domains: DataFrame | None = None,
    sizes_from_counts: bool = False,
) -> DataFrame:
    """The model table: filled cells with their totals, and the prior rows.

    Domain sizes are the structure's. With ``sizes_from_counts`` they are the
    values that the counts hold, which suits counts that rows were added to or
    removed from since the structure was learned.
    """
    k = net.k
    y = prior_counts(counts)
    cells = sparse_cells(counts, y, k) if _known_fill(fill) == "sparse" else dense_cells(counts, y, k, domains)
    rows = _explode_classes(cells, cell_columns(k), class_list(y), ["n", "parents_count"])
    rows = rows.withColumns(
        {
            "attr_name": name_of(net.names, F.col("attr_num")),
            "num_values": num_values_of(net, F.col("attr_num")),
        }
    )
    if sizes_from_counts:
        level0 = attribute_cells(counts).filter((F.col("level") == 0) & (F.col("n") > 0))
        sizes = level0.groupBy("attr_num").agg(F.countDistinct("attr_value").alias("counted"))
        rows = rows.drop("num_values").join(F.broadcast(sizes), "attr_num").withColumnRenamed("counted", "num_values")
    return rows.select(*model_columns(k)).unionByName(class_prior_rows(y, k))


def smoothed_log_probs(model: DataFrame) -> DataFrame:
    """log P(value | parents, class) on every attribute row of a model table."""
    lp = log_m_estimate(F.col("n"), F.col("parents_count"), F.col("num_values"))
    return model.filter(F.col("attr_name").isNotNull()).withColumn("log_prob", lp)


def class_priors(y: DataFrame) -> DataFrame:
    """Smoothed and raw P(class)."""
    total = y.agg(F.sum("n").cast("double")).scalar()
    classes = y.agg(F.count(F.lit(1)).cast("double")).scalar()
    return y.select(
        "class", "n", m_estimate(F.col("n"), total, classes).alias("prior"), (F.col("n") / total).alias("raw_prior")
    )
