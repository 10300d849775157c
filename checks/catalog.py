"""Registered queries with their SQL statements, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import kadence as kd
from checks import fixtures as X
from checks import oracle as O
from kadence.functions import measures as M
from kadence.functions.probability import log_m_estimate
from kadence.operators import counts as C
from kadence.operators import evaluate as E
from kadence.operators import params as B
from kadence.operators import predict as P
from kadence.operators import star as S
from kadence.operators import structure as T
from kadence.operators.compiled import CompiledModel, compile_model
from kadence.operators.network import Network
from kadence.plans import learning as L
from kadence.plans import scoring
from kadence.sources import staging, tables, training

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K = 2
DIGITS = 8


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        SQL[name] = sql
        return fn

    return register


def rounded(column: str, name: str | None = None):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return (F.round(F.col(column), DIGITS) + 0.0).alias(name or column)


def sql_rounded(column: str, name: str | None = None) -> str:
    return f"round({column}, {DIGITS}) + 0.0 as {name or column.split('.')[-1]}"


def named(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Attribute names beside attribute numbers."""
    extra = {c.replace("num", "name"): C.name_of(names, F.col(c)) for c in df.columns if c in ("attr_num", "attr_num1", "attr_num2")}
    return df.withColumns(extra)


def f1_set(spark: SparkSession, sf: str) -> training.TrainingSet:
    return training.encode_categories(X.f1(spark, sf), "l_returnflag")


def f4_set(spark: SparkSession, sf: str, policy: str) -> training.TrainingSet:
    return training.encode_categories(X.f4(spark, sf), "l_returnflag", null_policy=policy)


# --- sources -----------------------------------------------------------------


@query(
    "s1_read_training",
    """select l_linestatus, l_linenumber, cast(l_quantity as integer) as l_quantity, l_returnflag from lineitem""",
)
def s1(spark, sf):
    return training.read_training(
        spark,
        query=f"select l_linestatus, l_linenumber, cast(l_quantity as int) as l_quantity, l_returnflag "
        f"from parquet.`{sf}/lineitem.parquet`",
        view="training_rows",
    )


@query(
    "s2_attribute_catalog",
    O.with_ctes(
        O.count_ctes(X.F1),
        "select attr_num, attr_name, false as is_label, num_values from sizes union all "
        "select 5, 'l_returnflag', true, (select count(*) from yc)",
    ),
)
def s2(spark, sf):
    ts = f1_set(spark, sf)
    xy = C.attr_class_counts(ts)
    classes = C.class_counts(ts).agg(F.count(F.lit(1)).alias("num_values")).withColumn("attr_num", F.lit(ts.label_num))
    sizes = C.domain_sizes(xy).unionByName(classes)
    return training.attribute_catalog(ts).join(sizes, "attr_num")


@query("s3_encode_categories", X.F4_CATEGORY.base.replace("as y", "as l_returnflag"))
def s3(spark, sf):
    return f4_set(spark, sf, "category").df


@query(
    "s3_encode_categories_drop",
    X.F4_DROP.base.replace("as y", "as l_returnflag"),
)
def s3_drop(spark, sf):
    return f4_set(spark, sf, "drop").df


@query(
    "s3_token_clashes",
    " union all ".join(
        f"select '{a}' as attr_name, count(*) filter (where {e} is null) as n_null, count(*) filter (where {e} = '~') as n_token from lineitem"
        for a, e in {
            "l_returnflag": "l_returnflag",
            "l_linestatus": "l_linestatus",
            "l_linenumber": "cast(nullif(l_linenumber, 7) as varchar)",
            "l_tax": "cast(l_tax as varchar)",
            "l_discount": "cast(l_discount as varchar)",
            "l_quantity": "cast(l_quantity as varchar)",
        }.items()
    ),
)
def s3_clash(spark, sf):
    return training.token_clashes(X.f4(spark, sf), "l_returnflag")


@query(
    "s4_stage_counts",
    O.with_ctes(
        O.count_ctes(X.F1),
        "select attr_num as attr_num1, attr_value as attr_value1, attr_num as attr_num2, attr_value as attr_value2, class, n from xy "
        "union all select * from pairs",
    ),
)
def s4(spark, sf):
    xy, pairs, _ = L.stage_counts(f1_set(spark, sf))
    diagonal = xy.select(
        F.col("attr_num").alias("attr_num1"),
        F.col("attr_value").alias("attr_value1"),
        F.col("attr_num").alias("attr_num2"),
        F.col("attr_value").alias("attr_value2"),
        "class",
        "n",
    )
    return diagonal.unionByName(pairs)


def order_structure(spark: SparkSession, sf: str) -> DataFrame:
    """The stated network over the orders, with domain sizes from the rows."""
    ts = order_set(spark, sf)
    sizes = C.domain_sizes(C.attr_class_counts(ts))
    classes = C.class_counts(ts).count()
    return T.structure_from_parents(sizes, classes, ts.names, ts.label, ts.label_num, X.ORDER_PARENTS)


def order_set(spark: SparkSession, sf: str) -> training.TrainingSet:
    return training.encode_categories(X.order_rows(spark, sf), X.ORDER_LABEL, keep=["o_orderkey"])


def order_model(spark: SparkSession, sf: str, fill: str = "sparse") -> tuple[DataFrame, DataFrame]:
    structure = order_structure(spark, sf)
    return kd.learn_parameters(X.order_rows(spark, sf), structure, fill=fill), structure


def order_compiled(spark: SparkSession, sf: str) -> CompiledModel:
    return compile_model(*order_model(spark, sf))


def order_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, Network]:
    net = Network.from_structure(order_structure(spark, sf))
    return staging.stage(B.conditional_counts(order_set(spark, sf), net), "conditional"), net


ORDER_STRUCTURE_SQL = (
    " union all ".join(
        f"select {X.ORDER_NUMS[a]} as attr_num, '{a}' as attr_name, {repr(p) if p else 'cast(null as varchar)'} as parent, "
        f"{rank} as mi_rank, {i if p else 'cast(null as integer)'} as cmi_rank, "
        f"(select count(distinct {a}) from f) as num_values"
        for rank, (a, ps) in enumerate(X.ORDER_PARENTS.items(), start=1)
        for i, p in (enumerate(ps, start=1) if ps else [(0, None)])
    )
    + f" union all select 4, '{X.ORDER_LABEL}', 'KDB$CLASS', null, null, (select count(distinct y) from f)"
)


@query(
    "s5_save_load_structure",
    O.with_ctes(
        [
            *O.base(X.ORDERS),
            ("st", ORDER_STRUCTURE_SQL),
            ("widths", "select attr_num as a, count(cmi_rank)::int as num_parents from st group by attr_num"),
            ("numbers", "select attr_name as named, any_value(attr_num) as parent_num from st group by attr_name"),
        ],
        """select st.*, numbers.parent_num, widths.num_parents
           from widths join st on st.attr_num = widths.a left join numbers on numbers.named = st.parent""",
    ),
)
def s5(spark, sf):
    path = staging.new_stage_path(spark, "structure")
    tables.save_structure(order_structure(spark, sf), path)
    return tables.load_structure(spark, path)


MODEL_COLUMNS = "attr_num, attr_name, attr_value, parent1, parent2, class, n, level, num_values, parents_count"


def model_sql(fill: str = "sparse") -> str:
    return O.with_ctes(
        O.model_ctes(X.ORDERS, X.ORDER_PARENTS, fill), f"select {MODEL_COLUMNS} from model union all {O.prior_rows(K)}"
    )


@query("s6_save_load_model", model_sql())
def s6(spark, sf):
    path = staging.new_stage_path(spark, "model")
    tables.save_model(order_model(spark, sf)[0], path)
    return tables.load_model(spark, path, K)


@query(
    "s7_write_predictions",
    O.with_ctes(
        O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL), f"select row_id, class, {sql_rounded('prob')} from probs"
    ),
)
def s7(spark, sf):
    probs = kd.predict_proba(X.shifted_rows(spark, sf), order_compiled(spark, sf), id_col="o_orderkey")
    path = staging.new_stage_path(spark, "predictions")
    tables.write_predictions(probs, path)
    return spark.read.parquet(path).select("row_id", "class", rounded("prob"))


SIZE_CTES = [
    *O.model_ctes(X.ORDERS, X.ORDER_PARENTS),
    (
        "leaves",
        " union all ".join(
            f"select {X.ORDER_NUMS[a]} as attr_num, '{a}' as attr_name, {rank} as mi_rank, "
            + (f"(select count(*) from (select distinct {', '.join(ps)} from f))" if ps else "cast(1 as bigint)")
            + " as leaf_nodes"
            for rank, (a, ps) in enumerate(X.ORDER_PARENTS.items(), start=1)
        ),
    ),
    (
        "sized",
        """select l.*, nv.num_values, l.leaf_nodes * nv.num_values * (select count(*) from yc) as parameters
           from leaves l join nv on nv.attr_num = l.attr_num""",
    ),
]


@query(
    "s8_model_summary",
    O.with_ctes(
        SIZE_CTES,
        """select (select cast(sum(n) as bigint) from yc) as n_rows, 'o_orderstatus,o_day,c_nationkey,c_mktsegment' as attributes,
                  'o_day,c_nationkey,c_mktsegment,o_orderstatus' as predictors, 'o_orderpriority' as label, 4 as label_index,
                  (select string_agg(class, ',' order by class) from yc) as classes,
                  (select string_agg(cast(cast(round((n + 1e0 / (select count(*) from yc)) / ((select sum(n) from yc) + 1e0) * 1000000) as bigint) as varchar), ',' order by class) from yc) as class_ppm,
                  (select string_agg(cast(leaf_nodes as varchar), ',' order by mi_rank) from sized) as leaf_nodes,
                  (select cast(sum(parameters) as bigint) from sized) + (select count(*) from yc) as parameters""",
    ),
)
def s8(spark, sf):
    model, structure = order_model(spark, sf)
    summary = tables.model_summary(model, structure, K)
    ppm = F.transform("class_probs", lambda p: F.round(p * 1000000).cast("bigint").cast("string"))
    leaves = F.transform("leaf_nodes", lambda n: n.cast("string"))
    return summary.select(
        "n_rows",
        F.array_join("attributes", ",").alias("attributes"),
        F.array_join("predictors", ",").alias("predictors"),
        "label",
        "label_index",
        F.array_join("classes", ",").alias("classes"),
        F.array_join(ppm, ",").alias("class_ppm"),
        F.array_join(leaves, ",").alias("leaf_nodes"),
        "parameters",
    )


# --- counts ------------------------------------------------------------------


@query(
    "a1_attribute_domains",
    O.with_ctes(
        O.count_ctes(X.F4_CATEGORY),
        """select d.attr_num, d.attr_name, d.attr_value, s.num_values, (select count(*) from f) as n_rows,
                  (select count(*) from yc) as n_classes
           from (select distinct attr_num, attr_name, attr_value from xy) d join sizes s on s.attr_num = d.attr_num""",
    ),
)
def a1(spark, sf):
    ts = f4_set(spark, sf, "category")
    xy = staging.stage(C.attr_class_counts(ts), "xy")
    y = C.class_counts_of(xy, ts.attr_nums[0])
    return named(C.attribute_domains(xy).join(C.domain_sizes(xy), "attr_num"), ts.names).select(
        "attr_num",
        "attr_name",
        "attr_value",
        "num_values",
        y.agg(F.sum("n")).scalar().alias("n_rows"),
        y.agg(F.count(F.lit(1))).scalar().alias("n_classes"),
    )


@query("a2_class_counts", "select l_returnflag as class, count(*) as n, cast(sum(count(*)) over () as bigint) as total from lineitem group by 1")
def a2(spark, sf):
    y = C.class_counts(f1_set(spark, sf))
    return y.withColumn("total", y.agg(F.sum("n")).scalar())


def _xy_sql(fix: X.Fixture) -> str:
    return O.with_ctes(
        O.count_ctes(fix),
        "select x.attr_num, x.attr_name, x.attr_value, x.class, x.n, s.num_values from xy x join sizes s on s.attr_num = x.attr_num",
    )


@query("a3_attr_class_counts", _xy_sql(X.F1))
def a3(spark, sf):
    ts = f1_set(spark, sf)
    return named(C.with_num_values(C.attr_class_counts(ts)), ts.names)


@query("a3_attr_class_counts_nulls", _xy_sql(X.F4_DROP))
def a3_nulls(spark, sf):
    ts = f4_set(spark, sf, "drop")
    return named(C.with_num_values(C.attr_class_counts(ts)), ts.names)


PAIRS_BODY = "select * from pairs"


@query("a4_pair_class_counts", O.with_ctes(O.count_ctes(X.F1), PAIRS_BODY))
def a4(spark, sf):
    return C.pair_class_counts(f1_set(spark, sf))


@query("a4_pair_class_counts_pregrouped", O.with_ctes(O.count_ctes(X.F4_CATEGORY), PAIRS_BODY))
def a4_pre(spark, sf):
    return C.pair_class_counts(f4_set(spark, sf, "category"), pregroup=True)


FUSED_BODY = """select attr_num as attr_num1, attr_value as attr_value1, attr_num as attr_num2, attr_value as attr_value2, class, n from xy
  union all select * from pairs"""


@query("a5_fused_counts", O.with_ctes(O.count_ctes(X.F4_DROP), FUSED_BODY))
def a5(spark, sf):
    return C.fused_counts(f4_set(spark, sf, "drop"))


@query("a5_fused_counts_tiled", O.with_ctes(O.count_ctes(X.F4_DROP), FUSED_BODY))
def a5_tiled(spark, sf):
    xy, pairs = L.stage_fused(f4_set(spark, sf, "drop"), "tiled", tile_attrs=2)
    on_diagonal = [F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in ("attr_num", "attr_value")]
    return xy.select(*on_diagonal, "class", "n").unionByName(pairs)


@query(
    "a6_ordered_pair_counts",
    O.with_ctes(
        O.count_ctes(X.F1),
        "select * from pairs union all select attr_num2, attr_value2, attr_num1, attr_value1, class, n from pairs",
    ),
)
def a6(spark, sf):
    return C.ordered_pair_counts(C.pair_class_counts(f1_set(spark, sf)))


@query(
    "a7_value_marginals",
    O.with_ctes(O.count_ctes(X.F1), "select attr_num, attr_value, cast(sum(n) as bigint) as n from xy group by attr_num, attr_value"),
)
def a7(spark, sf):
    return C.value_marginals(C.attr_class_counts(f1_set(spark, sf)))


@query(
    "a7_pair_marginals",
    O.with_ctes(
        O.count_ctes(X.F1),
        """select attr_num1, attr_value1, attr_num2, attr_value2, cast(sum(n) as bigint) as n from pairs
           group by attr_num1, attr_value1, attr_num2, attr_value2""",
    ),
)
def a7_pairs(spark, sf):
    return C.pair_marginals(C.pair_class_counts(f1_set(spark, sf)))


def f2_star(spark: SparkSession, sf: str, supplier_key: bool = False) -> S.StarSet:
    return S.encode_star(
        X.f2_fact(spark, sf), "l_returnflag", X.f2_dims(spark, sf, supplier_key), fact_name="lineitem"
    )


@query(
    "a8_star_attr_counts",
    O.with_ctes(O.count_ctes(X.F2), "select attr_num, attr_value, class, n from xy where attr_num > 5"),
)
def a8(spark, sf):
    star = f2_star(spark, sf)
    return S.star_attr_counts(star, C.attr_class_counts(star.fact))


def _star_pairs(star: S.StarSet, flat_pairs=frozenset()) -> DataFrame:
    if not S.keys_repeat(star):
        return C.pairs_of(S.star_fused_counts(star, within_fact=False))
    fused = staging.stage(C.fused_counts(star.fact), "fact")
    return S.star_pair_counts(star, C.xy_of(fused), C.pairs_of(fused), flat_pairs)


STAR_PAIRS = "select * from pairs where attr_num1 > 5"


@query("a9_star_pair_counts", O.with_ctes(O.count_ctes(X.F2_KEY), STAR_PAIRS))
def a9(spark, sf):
    return _star_pairs(f2_star(spark, sf, supplier_key=True))


@query("a9_star_pair_counts_flat_cross", O.with_ctes(O.count_ctes(X.F2), STAR_PAIRS))
def a9_flat(spark, sf):
    return _star_pairs(f2_star(spark, sf), {(0, 1)})


@query("a10_drop_key_attributes", O.with_ctes(O.count_ctes(X.F2), FUSED_BODY))
def a10(spark, sf):
    star = f2_star(spark, sf)
    if not S.keys_repeat(star):
        return C.drop_key_attributes(S.star_fused_counts(star), star.dropped_keys)
    fused = staging.stage(C.fused_counts(star.fact), "fact")
    xy, pairs = C.xy_of(fused), C.pairs_of(fused)
    xy = C.drop_key_attributes(xy.unionByName(S.star_attr_counts(star, xy)), star.dropped_keys)
    pairs = C.drop_key_attributes(pairs.unionByName(S.star_pair_counts(star, C.xy_of(fused), pairs)), star.dropped_keys)
    diagonal = xy.select(
        F.col("attr_num").alias("attr_num1"),
        F.col("attr_value").alias("attr_value1"),
        F.col("attr_num").alias("attr_num2"),
        F.col("attr_value").alias("attr_value2"),
        "class",
        "n",
    )
    return diagonal.unionByName(pairs)


EVENT_PARENTS = {"event_hour": [], "user_group": ["event_hour"]}


def event_counts(spark: SparkSession, sf: str, batch) -> DataFrame:
    """Parameter counts of one batch of events under a stated network."""
    rows = X.f5(spark, sf)
    ts = training.encode_categories(rows.filter(batch).drop("value"), "event_type")
    net = Network("event_type", 2, 5, _event_nodes())
    return B.attribute_cells(B.conditional_counts(ts, net))


def _event_nodes():
    from kadence.operators.network import Node

    return (Node(0, "event_hour", 1, (), 24), Node(1, "user_group", 2, ("event_hour",), 7))


EVENT_COLUMNS = "attr_num, level, attr_value, parent1, class, n"


@query(
    "a11_add_rows",
    O.with_ctes([*O.base(X.F5), ("cond", O.conditional(X.F5, EVENT_PARENTS))], f"select {EVENT_COLUMNS} from cond"),
)
def a11_add(spark, sf):
    cheap = F.col("value") < 20
    return kd.add_rows(event_counts(spark, sf, cheap), event_counts(spark, sf, ~cheap))


@query(
    "a11_remove_rows",
    O.with_ctes(
        [*O.base(X.F5), ("cheap", "select * from f where value < 20"), ("cond", O.conditional(X.F5, EVENT_PARENTS, "cheap"))],
        f"select {EVENT_COLUMNS} from cond",
    ),
)
def a11_remove(spark, sf):
    dear = event_counts(spark, sf, F.col("value") >= 20)
    return kd.remove_rows(event_counts(spark, sf, F.lit(True)), dear)


@query("a11_update_to_model", model_sql())
def a11_update(spark, sf):
    """Learn the orders of the first half of each month, add the others, build the model from the counts.

    The later days are values that only the added rows have.
    """
    net = Network.from_structure(order_structure(spark, sf))
    early = F.col("o_day") <= 15
    counts = [
        staging.stage(
            B.conditional_counts(training.encode_categories(X.order_rows(spark, sf).filter(part), X.ORDER_LABEL, keep=["o_orderkey"]), net),
            "conditional",
        )
        for part in (early, ~early)
    ]
    return kd.model_table(kd.add_rows(*counts), net, sizes_from_counts=True)


@query(
    "a11_compacted_log",
    O.with_ctes([*O.base(X.F5), ("cond", O.conditional(X.F5, EVENT_PARENTS))], f"select {EVENT_COLUMNS} from cond"),
)
def a11_compacted_log(spark, sf):
    """A log of three deltas, the first two compacted and removed, the second then replayed."""
    value = F.col("value")
    deltas = [event_counts(spark, sf, part) for part in (value < 20, (value >= 20) & (value < 60), value >= 60)]
    log, schema = staging.new_stage_path(spark, "log"), deltas[0].schema
    for number, delta in enumerate(deltas):
        delta.write.parquet(f"{log}/batch={number}")
        if number == 1:
            kd.compact_log(spark, schema, log)
            kd.drop_covered(spark, log)
    deltas[1].write.parquet(f"{log}/batch=1")
    return kd.logged_counts(spark, schema, log)


# --- measures ----------------------------------------------------------------


def _staged(ts: training.TrainingSet) -> tuple[DataFrame, DataFrame, DataFrame]:
    return L.stage_counts(ts)


MI_BODY = f"select attr_num, attr_name, {sql_rounded('mi')} from mi"
CMI_BODY = f"""select attr_num1, attr_num2, {sql_rounded('cmi')} from cmi
  union all select attr_num2, attr_num1, {sql_rounded('cmi')} from cmi"""


@query("m1_mutual_information", O.with_ctes(O.measure_ctes(X.F1), MI_BODY))
def m1(spark, sf):
    ts = f1_set(spark, sf)
    xy = staging.stage(C.attr_class_counts(ts), "xy")
    mi = M.mutual_information_complete(M.attribute_terms(xy), C.class_counts_of(xy, ts.attr_nums[0]))
    return named(mi.select("attr_num", rounded("mi")), ts.names)


@query("m1_mutual_information_drop_nulls", O.with_ctes(O.measure_ctes(X.F4_DROP), MI_BODY))
def m1_drop(spark, sf):
    ts = f4_set(spark, sf, "drop")
    xy = staging.stage(C.attr_class_counts(ts), "xy")
    mi = M.mutual_information(xy, C.class_counts_of(xy, ts.attr_nums[0]))
    return named(mi.select("attr_num", rounded("mi")), ts.names)


@query("m2_conditional_mutual_information", O.with_ctes(O.measure_ctes(X.F1), CMI_BODY))
def m2(spark, sf):
    xy, pairs, y = _staged(f1_set(spark, sf))
    cmi = M.both_directions(M.conditional_mutual_information_complete(pairs, M.attribute_terms(xy), y))
    return cmi.select("attr_num1", "attr_num2", rounded("cmi"))


@query("m2_conditional_mutual_information_drop_nulls", O.with_ctes(O.measure_ctes(X.F4_DROP), CMI_BODY))
def m2_drop(spark, sf):
    xy, pairs, y = _staged(f4_set(spark, sf, "drop"))
    cmi = M.both_directions(M.conditional_mutual_information(pairs, xy, y))
    return cmi.select("attr_num1", "attr_num2", rounded("cmi"))


# --- structure ---------------------------------------------------------------


@query("t1_rank_attributes", O.with_ctes(O.measure_ctes(X.F1), f"select attr_num, attr_name, {sql_rounded('mi')}, mi_rank from ranked"))
def t1(spark, sf):
    ts = f1_set(spark, sf)
    xy = staging.stage(C.attr_class_counts(ts), "xy")
    ranked = T.rank_attributes(M.mutual_information_complete(M.attribute_terms(xy), C.class_counts_of(xy, ts.attr_nums[0])))
    return named(ranked.select("attr_num", rounded("mi"), "mi_rank"), ts.names)


@query(
    "t2_select_parents",
    O.with_ctes(
        O.structure_ctes(X.F2, K), f"select attr_num, mi_rank, parent_num, parent_rank, {sql_rounded('cmi')}, cmi_rank from parents"
    ),
)
def t2(spark, sf):
    xy, pairs, y = L.stage_star_counts(f2_star(spark, sf))
    ranked = T.rank_attributes(M.mutual_information(xy, y))
    parents = T.select_parents(ranked, M.conditional_mutual_information(pairs, xy, y), K)
    return parents.withColumn("cmi", rounded("cmi"))


STRUCTURE_BODY = "select attr_num, attr_name, parent, mi_rank, cmi_rank, num_values from structure"


@query("t3_assemble_structure", O.with_ctes(O.structure_ctes(X.F1, K), STRUCTURE_BODY))
def t3(spark, sf):
    return kd.learn_structure(X.f1(spark, sf), "l_returnflag", K)


@query("t3_structure_null_category", O.with_ctes(O.structure_ctes(X.F4_CATEGORY, K), STRUCTURE_BODY))
def t3_category(spark, sf):
    return kd.learn_structure(X.f4(spark, sf), "l_returnflag", K)


@query("t3_structure_drop_nulls", O.with_ctes(O.structure_ctes(X.F4_DROP, K), STRUCTURE_BODY))
def t3_drop(spark, sf):
    return kd.learn_structure(X.f4(spark, sf), "l_returnflag", K, null_policy="drop")


@query("t4_naive_structure", O.with_ctes(O.structure_ctes(X.F1, 0), STRUCTURE_BODY))
def t4(spark, sf):
    return kd.learn_structure(X.f1(spark, sf), "l_returnflag", 0)


@query(
    "t5_star_structure",
    O.with_ctes(
        O.structure_ctes(X.F2, K),
        """select case when attr_num <= 5 then 'lineitem' when attr_num <= 9 then 'part' else 'supplier' end as table_name, *
           from structure
           union all
           select * from (values ('part', 6, 'p_partkey', null, null, null, null), ('supplier', 10, 's_suppkey', null, null, null, null),
                                 ('lineitem', 3, 'l_partkey', null, null, null, null), ('lineitem', 4, 'l_suppkey', null, null, null, null)) k""",
    ),
)
def t5(spark, sf):
    return kd.learn_structure_star(
        X.f2_fact(spark, sf), "l_returnflag", X.f2_dims(spark, sf), K, fact_name="lineitem", check_keys=True
    )


@query(
    "t5_star_structure_factorised",
    SQL["t5_star_structure"],
)
def t5_factorised(spark, sf):
    return kd.learn_structure_star(
        X.f2_fact(spark, sf), "l_returnflag", X.f2_dims(spark, sf), K, fact_name="lineitem", plan="factorised"
    )


@query("t5_star_structure_sketched", SQL["t5_star_structure"])
def t5_sketched(spark, sf):
    """The plan comes from sketches that two parts of the fact gave."""
    fact, dims = X.f2_fact(spark, sf), X.f2_dims(spark, sf)
    open_lines = F.col("l_linestatus") == "O"
    parts = [S.key_sketches(S.encode_star(fact.filter(c), "l_returnflag", dims)) for c in (open_lines, ~open_lines)]
    sketches = staging.stage(parts[0].unionByName(parts[1]), "sketches")
    return kd.learn_structure_star(fact, "l_returnflag", dims, K, fact_name="lineitem", sketches=sketches)


@query(
    "t5_star_structure_one_dim",
    O.with_ctes(
        O.structure_ctes(X.F3, K),
        """select case when attr_num <= 2 then 'orders' else 'customer' end as table_name, * from structure
           union all
           select * from (values ('customer', 3, 'c_custkey', null, null, null, null), ('orders', 1, 'o_custkey', null, null, null, null)) k""",
    ),
)
def t5_one(spark, sf):
    return kd.learn_structure_star(X.f3_fact(spark, sf), "o_orderpriority", X.f3_dims(spark, sf), K, fact_name="orders")


ORPHAN_SQL = O.with_ctes(
    O.structure_ctes(X.F6, K),
    # A null there is a missing dimension row and no value of the domain.
    """select case when attr_num <= 3 then 'documents' else 'labels' end as table_name,
              * replace (case when attr_num in (5, 6) then num_values - 1 else num_values end as num_values)
       from structure
       union all
       select * from (values ('labels', 4, 'labelled_id', null, null, null, null), ('documents', 2, 'doc_id', null, null, null, null)) k""",
)


@query("t5_star_structure_orphans", ORPHAN_SQL)
def t5_orphans(spark, sf):
    return kd.learn_structure_star(X.f6_fact(spark, sf), "lang", X.f6_dims(spark, sf), K, fact_name="documents")


@query("t5_star_structure_orphans_factorised", ORPHAN_SQL)
def t5_orphans_factorised(spark, sf):
    return kd.learn_structure_star(
        X.f6_fact(spark, sf), "lang", X.f6_dims(spark, sf), K, fact_name="documents", plan="factorised"
    )


@query(
    "t5_orphan_report",
    """select 'labels' as table_name, 'doc_id' as fk, count(*) as orphan_rows
       from documents where doc_id not in (select doc_id from labels)""",
)
def t5_orphan_report(spark, sf):
    star = S.encode_star(X.f6_fact(spark, sf), "lang", X.f6_dims(spark, sf), fact_name="documents")
    xy, _, y = L.stage_star_counts(star, with_pairs=False)
    return S.lost_rows(star, xy, y)


@query(
    "t6_parents_wide",
    O.with_ctes(
        O.structure_ctes(X.F1, K),
        """select attr_num, attr_name, mi_rank, num_values, max(case when cmi_rank = 1 then parent end) as parent1,
                  max(case when cmi_rank = 2 then parent end) as parent2
           from structure where mi_rank is not null group by all""",
    ),
)
def t6(spark, sf):
    return T.parents_wide(kd.learn_structure(X.f1(spark, sf), "l_returnflag", K), K)


# --- parameters --------------------------------------------------------------


@query(
    "b1_star_join",
    """select l_linestatus, cast(l_linenumber as varchar) as l_linenumber,
              cast(cast(round(l_tax * 100) as integer) as varchar) as l_tax, p_brand, p_type,
              cast(p_size as varchar) as p_size, cast(s_nationkey as varchar) as s_nationkey, l_returnflag
       from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""",
)
def b1(spark, sf):
    return S.star_join(f2_star(spark, sf))


COND_CTES = [*O.base(X.ORDERS), ("yc", "select y as class, count(*) as n from f group by y"), ("cond", O.conditional(X.ORDERS, X.ORDER_PARENTS))]
COND_BODY = f"""select attr_num, level, attr_value, parent1, parent2, class, n from cond
  union all select -1, 0, {O.NULL_TEXT}, {O.NULL_TEXT}, {O.NULL_TEXT}, class, n from yc"""


@query("b2_conditional_counts", O.with_ctes(COND_CTES, COND_BODY))
def b2(spark, sf):
    net = Network.from_structure(order_structure(spark, sf))
    return B.conditional_counts(order_set(spark, sf), net)


@query("b3_conditional_counts_grouping_sets", O.with_ctes(COND_CTES, COND_BODY))
def b3(spark, sf):
    net = Network.from_structure(order_structure(spark, sf))
    return B.conditional_counts_grouping_sets(order_set(spark, sf), net)


@query(
    "b4_zero_fill",
    O.with_ctes(
        O.model_ctes(X.ORDERS, X.ORDER_PARENTS), "select attr_num, level, attr_value, parent1, parent2, class, n from model"
    ),
)
def b4(spark, sf):
    counts, net = order_counts(spark, sf)
    return B.zero_fill(counts, B.prior_counts(counts), net.k)


@query("b5_dense_fill", model_sql("dense"))
def b5(spark, sf):
    return order_model(spark, sf, "dense")[0]


@query(
    "b6_parents_count",
    O.with_ctes(COND_CTES, """select attr_num, level, parent1, parent2, class, cast(sum(n) as bigint) as n from cond
                              group by attr_num, level, parent1, parent2, class"""),
)
def b6(spark, sf):
    counts, net = order_counts(spark, sf)
    return B.path_counts(counts, net.k)


@query("b7_num_values", O.with_ctes(O.model_ctes(X.ORDERS, X.ORDER_PARENTS), """select distinct m.attr_num, m.attr_name, m.level, m.attr_value, m.num_values from model m"""))
def b7(spark, sf):
    model = order_model(spark, sf)[0]
    attrs = model.filter(F.col("attr_name").isNotNull())
    return attrs.select("attr_num", "attr_name", "level", "attr_value", "num_values").distinct()


@query("b8_class_prior_rows", O.with_ctes(COND_CTES, O.prior_rows(K)))
def b8(spark, sf):
    counts, net = order_counts(spark, sf)
    return B.class_prior_rows(B.prior_counts(counts), net.k)


@query(
    "b9_smoothed_log_probs",
    O.with_ctes(
        O.model_ctes(X.ORDERS, X.ORDER_PARENTS), f"select {MODEL_COLUMNS}, {sql_rounded(O.LOG_PROB, 'log_prob')} from model"
    ),
)
def b9(spark, sf):
    probs = B.smoothed_log_probs(order_model(spark, sf)[0])
    return probs.withColumn("log_prob", rounded("log_prob"))


@query(
    "b10_class_priors",
    O.with_ctes(
        COND_CTES,
        f"""select class, n, {sql_rounded('(n + 1e0 / (select count(*) from yc)) / ((select sum(n) from yc) + 1e0)', 'prior')},
                   {sql_rounded('n / cast((select sum(n) from yc) as double)', 'raw_prior')} from yc""",
    ),
)
def b10(spark, sf):
    counts, _ = order_counts(spark, sf)
    return B.class_priors(B.prior_counts(counts)).select("class", "n", rounded("prior"), rounded("raw_prior"))


# --- scoring -----------------------------------------------------------------


def shifted(spark: SparkSession, sf: str, model: CompiledModel, keep=()) -> DataFrame:
    return P.scoring_rows(X.shifted_rows(spark, sf), model.net, "o_orderkey", keep)


@query("r1_with_row_id", "select o_orderkey as row_id, o_orderstatus, o_orderpriority from orders")
def r1(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.with_row_id(orders, "o_orderkey").select("row_id", "o_orderstatus", "o_orderpriority")


@query("r1_with_generated_row_id", "select count(*) as n_rows, count(*) as n_ids from orders")
def r1_generated(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderstatus")
    ids = P.with_row_id(orders)
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_id").alias("n_ids"))


@query(
    "r2_rows_to_evidence",
    O.with_ctes(
        [("s", X.SHIFTED_SQL)],
        " union all ".join(
            f"select row_id, {X.ORDER_NUMS[a]} as attr_num, {len(ps)} as level, {a} as attr_value, {O._parent_select(ps, K)} from s"
            for a, ps in X.ORDER_PARENTS.items()
        ),
    ),
)
def r2(spark, sf):
    net = Network.from_structure(order_structure(spark, sf))
    rows = P.scoring_rows(X.shifted_rows(spark, sf), net, "o_orderkey")
    return P.rows_to_evidence(rows, net)


MATCH_CTES = O.match_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL)
MATCH_COLUMNS = """row_id, attr_num, level, cast(sum(n) as bigint) as n, cast(sum(parents_count) as bigint) as parents_count"""


def _totals(matches: DataFrame) -> DataFrame:
    """Class vectors summed, to compare one number per match."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, b: a + b).alias(c)
    return matches.select("row_id", "attr_num", "level", total("n"), total("parents_count"))


VECTORS = ("n", "parents_count")


@query("r3_match_with_backoff", O.with_ctes(MATCH_CTES, f"select {MATCH_COLUMNS} from matches group by row_id, attr_num, level"))
def r3(spark, sf):
    model = order_compiled(spark, sf)
    evidence = P.rows_to_evidence(shifted(spark, sf, model), model.net)
    return _totals(P.matched_levels(P.match_with_backoff(evidence, model, VECTORS), model.k, VECTORS))


@query("r4_deepest_match", O.with_ctes(MATCH_CTES, f"select {MATCH_COLUMNS} from deepest group by row_id, attr_num, level"))
def r4(spark, sf):
    model = order_compiled(spark, sf)
    evidence = P.rows_to_evidence(shifted(spark, sf, model), model.net)
    return _totals(P.deepest_match(P.match_with_backoff(evidence, model, VECTORS), model.k, VECTORS))


CLASS_COLUMNS = """attr_num, level, class, count(*) as lines, cast(sum(n * (row_id % 1009)) as bigint) as n,
                  cast(sum(parents_count * (row_id % 1009)) as bigint) as parents_count"""


def _by_class(matches: DataFrame, model: CompiledModel) -> DataFrame:
    """Every class's own numbers, weighted by the row so that no two rows can be mixed up."""
    entries = F.arrays_zip(model.class_names().alias("class"), "n", "parents_count")
    each = matches.select("row_id", "attr_num", "level", F.inline(entries))
    weighed = lambda c: F.sum(F.col(c) * (F.col("row_id") % 1009)).alias(c)
    return each.groupBy("attr_num", "level", "class").agg(F.count(F.lit(1)).alias("lines"), weighed("n"), weighed("parents_count"))


@query("r3_match_per_class", O.with_ctes(MATCH_CTES, f"select {CLASS_COLUMNS} from matches group by attr_num, level, class"))
def r3_per_class(spark, sf):
    """At limit 0, where the lookup shuffles."""
    model = order_compiled(spark, sf)
    evidence = P.rows_to_evidence(shifted(spark, sf, model), model.net)
    return _by_class(P.matched_levels(P.match_with_backoff(evidence, model, VECTORS, limit=0), model.k, VECTORS), model)


@query("r4_deepest_per_class", O.with_ctes(MATCH_CTES, f"select {CLASS_COLUMNS} from deepest group by attr_num, level, class"))
def r4_per_class(spark, sf):
    model = order_compiled(spark, sf)
    evidence = P.rows_to_evidence(shifted(spark, sf, model), model.net)
    return _by_class(P.deepest_match(P.match_with_backoff(evidence, model, VECTORS), model.k, VECTORS), model)


PROB_BODY = f"select row_id, class, {sql_rounded('prob')} from probs"


def _proba(spark, sf, **options) -> DataFrame:
    probs = kd.predict_proba(X.shifted_rows(spark, sf), order_compiled(spark, sf), id_col="o_orderkey", **options)
    return probs.select("row_id", "class", rounded("prob"))


@query(
    "r5_path_backoff",
    O.with_ctes(O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL, backoff="path"), PROB_BODY),
)
def r5(spark, sf):
    return _proba(spark, sf, backoff="path")


@query(
    "r5_path_backoff_evidence_plan",
    O.with_ctes(O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL, backoff="path"), PROB_BODY),
)
def r5_evidence(spark, sf):
    return _proba(spark, sf, backoff="path", plan="evidence")


def _scores(spark, sf, **options) -> DataFrame:
    model = order_compiled(spark, sf)
    scores = P.class_log_scores(shifted(spark, sf, model), model, **options)
    return P.by_class(scores, model, "scores", "log_score").select("row_id", "class", rounded("log_score"))


SCORE_BODY = f"select row_id, class, {sql_rounded('log_score')} from scores"


@query("r6_class_log_scores", O.with_ctes(O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL), SCORE_BODY))
def r6(spark, sf):
    return _scores(spark, sf)


@query(
    "r6_class_log_scores_without_prior",
    O.with_ctes(O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL, include_prior=False), SCORE_BODY),
)
def r6_without(spark, sf):
    return _scores(spark, sf, include_prior=False, plan="evidence")


REPEATED_SQL = O.with_ctes(
    O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL),
    f"""select o_custkey as row_id, class, {sql_rounded('log_score')}
        from scores join orders on o_orderkey = scores.row_id""",
)


def _scores_by_customer(spark, sf, plan: str) -> DataFrame:
    """Scores under an id that many rows share; each row keeps its own result."""
    model = order_compiled(spark, sf)
    customers = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = P.scoring_rows(X.shifted_rows(spark, sf).join(customers, "o_orderkey"), model.net, "o_custkey")
    scores = P.class_log_scores(rows, model, plan=plan)
    return P.by_class(scores, model, "scores", "log_score").select("row_id", "class", rounded("log_score"))


@query("r6_repeated_ids_rowwise", REPEATED_SQL)
def r6_repeated_rowwise(spark, sf):
    return _scores_by_customer(spark, sf, "rowwise")


@query("r6_repeated_ids_evidence", REPEATED_SQL)
def r6_repeated_evidence(spark, sf):
    return _scores_by_customer(spark, sf, "evidence")


@query(
    "r6_many_classes",
    O.with_ctes(
        O.score_ctes(X.BUYERS, X.BUYER_PARENTS, X.CUSTOMERS_SQL),
        f"""select row_id, arg_min(class, (-round(prob, 12), class)) as predicted_class, {sql_rounded('max(prob)', 'predicted_prob')},
                   count(*) as n_classes, {sql_rounded('sum(prob * prob)', 'squared')}
            from probs group by row_id""",
    ),
)
def r6_many_classes(spark, sf):
    """Every customer scored by a model whose classes are the customers with orders."""
    ts = training.encode_categories(X.buyer_rows(spark, sf), X.BUYERS.label)
    sizes = C.domain_sizes(C.attr_class_counts(ts))
    structure = T.structure_from_parents(sizes, C.class_counts(ts).count(), ts.names, ts.label, ts.label_num, X.BUYER_PARENTS)
    model = kd.learn_parameters(X.buyer_rows(spark, sf), structure)
    customers = X.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # Customers of one segment and nation have the same probabilities: these are worked out once per profile.
    out, members = kd.predict_profiles(customers, model, structure, id_col="c_custkey", plan="evidence", in_parts=True)
    probs = F.map_values("class_probs")
    squared = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p * p).alias("squared")
    parts = out.select("profile_id", "predicted_class", rounded("predicted_prob"), F.size(probs).cast("bigint").alias("n_classes"), squared)
    found = parts.groupBy("profile_id", "predicted_class", "predicted_prob").agg(F.sum("n_classes").alias("n_classes"), F.sum("squared").alias("squared"))
    return members.join(found.withColumn("squared", rounded("squared")), "profile_id").drop("profile_id")


@query("r7_normalise_log_scores", O.with_ctes(O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL), PROB_BODY))
def r7(spark, sf):
    return _proba(spark, sf)


@query(
    "r7_normalise_without_prior",
    O.with_ctes(O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL, include_prior=False), PROB_BODY),
)
def r7_without(spark, sf):
    return _proba(spark, sf, include_prior=False)


@query(
    "r8_predict_class",
    O.with_ctes(
        O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL),
        f"""select row_id, arg_min(class, (-round(prob, 12), class)) as predicted_class, {sql_rounded('max(prob)', 'predicted_prob')},
                   string_agg(class || '=' || cast(cast(round(prob * 1000000) as bigint) as varchar), ';' order by class) as class_ppm
            from probs group by row_id""",
    ),
)
def r8(spark, sf):
    out = kd.predict_classes(X.shifted_rows(spark, sf), order_compiled(spark, sf), id_col="o_orderkey")
    entries = F.transform(
        F.array_sort(F.map_entries("class_probs")),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000000).cast("bigint").cast("string")),
    )
    return out.select("row_id", "predicted_class", rounded("predicted_prob"), F.array_join(entries, ";").alias("class_ppm"))


@query(
    "r8_exact_ties",
    O.with_ctes(
        O.score_ctes(
            replace(
                X.ORDERS,
                base=f"select o_orderstatus, o_day, c_nationkey, c_mktsegment, t.y, row_id from ({X.ORDERS.base}) o, (values ('u'), ('v')) t(y)",
            ),
            X.ORDER_PARENTS,
            X.SHIFTED_SQL,
        ),
        f"""select row_id, arg_min(class, (-round(prob, 12), class)) as predicted_class, {sql_rounded('max(prob)', 'predicted_prob')}
            from probs group by row_id""",
    ),
)
def r8_ties(spark, sf):
    """Every order is learned once as u and once as v, so each row is an exact tie."""
    twice = X.order_rows(spark, sf).withColumn(X.ORDER_LABEL, F.explode(F.array(F.lit("v"), F.lit("u"))))
    structure = order_structure(spark, sf)
    model = kd.learn_parameters(twice, structure)
    out = kd.predict_classes(X.shifted_rows(spark, sf), model, structure, id_col="o_orderkey")
    return out.select("row_id", "predicted_class", rounded("predicted_prob"))


@query(
    "r9_predict_sample",
    O.with_ctes(
        O.score_ctes(
            X.ORDERS, X.ORDER_PARENTS, f"select * from ({X.ORDERS.base}) t order by row_id limit 100"
        ),
        f"select p.row_id, s.y as o_orderpriority, p.class, {sql_rounded('p.prob', 'prob')} from probs p join s on s.row_id = p.row_id",
    ),
)
def r9(spark, sf):
    sample = kd.predict_sample(X.order_rows(spark, sf), order_compiled(spark, sf), order_by="o_orderkey", n=100)
    return sample.select("row_id", "o_orderpriority", "class", rounded("prob"))


@query(
    "r10_predict_missing_columns",
    O.with_ctes(O.score_ctes(X.ORDERS, X.ORDER_PARENTS, X.SHIFTED_SQL, missing=("c_nationkey",)), PROB_BODY),
)
def r10(spark, sf):
    rows = X.shifted_rows(spark, sf).drop("c_nationkey")
    probs = kd.predict_proba(rows, order_compiled(spark, sf), id_col="o_orderkey")
    return probs.select("row_id", "class", rounded("prob"))


@query("learn_and_predict_star", O.with_ctes(O.learned_score_ctes(X.F3, K), PROB_BODY))
def learn_and_predict_star(spark, sf):
    """Structure and parameters learned over the star, then every order scored."""
    fact, dims = X.f3_fact(spark, sf), X.f3_dims(spark, sf)
    structure = kd.learn_structure_star(fact, "o_orderpriority", dims, K, fact_name="orders")
    model = kd.learn_parameters_star(fact, "o_orderpriority", dims, structure)
    star = S.encode_star(X.f3_fact(spark, sf, with_id=True), "o_orderpriority", dims, keep=["o_orderkey"])
    rows = S.star_join(star, Network.from_structure(structure), keep=["o_orderkey"])
    probs = kd.predict_proba(rows, model, structure, id_col="o_orderkey")
    return probs.select("row_id", "class", rounded("prob"))


@query("learn_and_predict_flat", O.with_ctes(O.learned_score_ctes(X.ORDERS, K), PROB_BODY))
def learn_and_predict_flat(spark, sf):
    """Structure and parameters learned over flat orders, then every order scored."""
    rows = X.order_rows(spark, sf)
    structure = kd.learn_structure(rows, X.ORDER_LABEL, K, exclude=["o_orderkey"])
    model = kd.learn_parameters(rows, structure)
    probs = kd.predict_proba(rows, model, structure, id_col="o_orderkey", plan="evidence")
    return probs.select("row_id", "class", rounded("prob"))


# --- evaluation --------------------------------------------------------------


def _training_rows(spark: SparkSession, sf: str, model: CompiledModel) -> DataFrame:
    return P.scoring_rows(X.order_rows(spark, sf), model.net, "o_orderkey", [X.ORDER_LABEL])


@query(
    "e1_loocv_class_prior",
    O.with_ctes(
        COND_CTES,
        f"""select f.row_id, f.y as o_orderpriority, yc.class,
                   {sql_rounded('(yc.n - (f.y = yc.class)::int + 1e0 / (select count(*) from yc)) / (select sum(n) from yc)', 'prob')}
            from f cross join yc""",
    ),
)
def e1(spark, sf):
    model = order_compiled(spark, sf)
    out = E.loocv_class_prior(_training_rows(spark, sf, model), model, X.ORDER_LABEL)
    return out.select("row_id", X.ORDER_LABEL, "class", rounded("prob"))


LOOCV_BODY = f"select row_id, o_orderpriority, k, class, {sql_rounded('log_score')} from loocv"


@query("e2_loocv_scores", O.with_ctes(O.loocv_ctes(X.ORDERS, X.ORDER_PARENTS, joint=False), LOOCV_BODY))
def e2(spark, sf):
    out = kd.loocv(X.order_rows(spark, sf), order_compiled(spark, sf), id_col="o_orderkey")
    return out.select("row_id", X.ORDER_LABEL, "k", "class", rounded("log_score"))


@query("e3_loocv_scores_joint", O.with_ctes(O.loocv_ctes(X.ORDERS, X.ORDER_PARENTS, joint=True), LOOCV_BODY))
def e3(spark, sf):
    out = kd.loocv(X.order_rows(spark, sf), order_compiled(spark, sf), id_col="o_orderkey", joint=True)
    return out.select("row_id", X.ORDER_LABEL, "k", "class", rounded("log_score"))


@query(
    "e4_prune_model",
    O.with_ctes(
        O.model_ctes(X.ORDERS, X.ORDER_PARENTS),
        f"""select attr_num, attr_name, attr_value, parent1, class, n, level, num_values, parents_count from model
            where attr_name in ('o_day', 'c_nationkey', 'c_mktsegment') and level <= 1
            union all select attr_num, attr_name, attr_value, parent1, class, n, level, num_values, parents_count
            from ({O.prior_rows(K)}) p""",
    ),
)
def e4(spark, sf):
    model, structure = order_model(spark, sf)
    return kd.prune_model(model, structure, best_attrs=3, best_k=1)


@query(
    "e4_prune_structure",
    O.with_ctes(
        [*O.base(X.ORDERS), ("st", ORDER_STRUCTURE_SQL)],
        "select * from st where (mi_rank is null or mi_rank <= 3) and (cmi_rank is null or cmi_rank <= 1)",
    ),
)
def e4_structure(spark, sf):
    return kd.prune_structure(order_structure(spark, sf), best_attrs=3, best_k=1)


@query(
    "e5_model_size",
    O.with_ctes(
        SIZE_CTES,
        """select attr_num, attr_name, num_values, leaf_nodes, parameters,
                  cast((sum(parameters) over ()) as bigint) + (select count(*) from yc) as total_parameters from sized""",
    ),
)
def e5(spark, sf):
    return kd.model_size(order_model(spark, sf)[0], K)
