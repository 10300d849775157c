"""Headline timings; prints one JSON line.

Learning runs over lineitem, scoring over orders. Every figure is a complete
run from the parquet files, apart from the scoring figures, which start from a
compiled model. Results go to Spark's ``noop`` sink or the staged tables. Each
run is timed twice and the faster time counts, so that JVM warm-up does not.
"""

from __future__ import annotations

import json
import os
import tempfile
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

import kadence as kd  # noqa: E402
from checks import catalog  # noqa: E402
from checks import fixtures as X  # noqa: E402


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # Small data on one machine: keep partitions small enough to use all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # One process, so a folder of its own serves as the shared one.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="kadence-bench-"))
        .getOrCreate()
    )


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def orders_star(spark: SparkSession, sf: str):
    """A star whose keys repeat often: line items by supplier."""
    fact = X.f2_fact(spark, sf).drop("l_partkey")
    return fact, "l_returnflag", X.f2_dims(spark, sf)[1:]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run):
        for _ in range(2):
            start = time.perf_counter()
            result = run()
            times[name] = min(times.get(name, float("inf")), round(time.perf_counter() - start, 3))
        return result

    def structure(df: DataFrame) -> DataFrame:
        return spark.createDataFrame(df.collect(), df.schema)

    learned = timed("pass1_flat_k2", lambda: structure(kd.learn_structure(X.f1(spark, sf), "l_returnflag", 2)))
    timed("pass1_flat_k0", lambda: structure(kd.learn_structure(X.f1(spark, sf), "l_returnflag", 0)))
    timed("pass2_flat_k2", lambda: drain(kd.learn_parameters(X.f1(spark, sf), learned)))
    fact, dims = X.f2_fact(spark, sf), X.f2_dims(spark, sf)
    star = timed("pass1_star_k2", lambda: structure(kd.learn_structure_star(fact, "l_returnflag", dims, 2)))
    for plan in ("factorised", "joined"):
        run = lambda: structure(kd.learn_structure_star(fact, "l_returnflag", dims, 2, plan=plan))
        timed(f"pass1_star_{plan}_k2", run)
    stores = orders_star(spark, sf)
    for plan in ("factorised", "joined"):
        run = lambda: structure(kd.learn_structure_star(*stores, 2, plan=plan))
        timed(f"pass1_star_few_keys_{plan}_k2", run)
    timed("pass2_star_k2", lambda: drain(kd.learn_parameters_star(fact, "l_returnflag", dims, star)))
    timed("grouping_sets", lambda: drain(catalog.QUERIES["b3_conditional_counts_grouping_sets"](spark, sf)))

    model = timed("pass2_and_compile", lambda: catalog.order_compiled(spark, sf))
    rows = X.shifted_rows(spark, sf)
    for plan in ("rowwise", "evidence"):
        for backoff in ("pair", "path"):
            run = lambda: drain(
                kd.predict_proba(rows, model, id_col="o_orderkey", plan=plan, backoff=backoff)
            )
            timed(f"predict_{plan}_{backoff}", run)
    timed("predict_classes", lambda: drain(kd.predict_classes(rows, model, id_col="o_orderkey")))
    timed("loocv", lambda: drain(kd.loocv(X.order_rows(spark, sf), model, id_col="o_orderkey")))

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
