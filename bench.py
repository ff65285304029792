"""Times of the headline queries, as one JSON line.

Each query runs twice and the second run counts.  Results are computed in full and thrown
away.  ``rates`` gives cells, texts or queries per second.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import gridsieve as g  # noqa: E402
from checks.cell_checks import LINE_KEY  # noqa: E402
from checks.search_checks import FLAGSHIP, queries as small_queries  # noqa: E402
from checks.sheets import clean_cells, sheet_cells, table  # noqa: E402
from gridsieve.plans.sizing import settled  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LINE_COLS = "l_returnflag l_linestatus l_quantity l_extendedprice l_discount l_tax l_shipdate".split()
SHEETS = ["part", "customer", "supplier", "orders"]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    lines = table(spark, SF_DIR, "lineitem")

    def line_cells(**options) -> DataFrame:
        return g.table_to_cells(lines, "lines.xlsx", "lineitem", key_cols=LINE_KEY, cols=LINE_COLS, **options)

    # sheets as they would lie on disk: numbered once, then read by every query
    cells = g.clean_values(line_cells(neighbours=True))
    n_cells = lines.count() * len(LINE_COLS)
    raw = sheet_cells(spark, SF_DIR, *SHEETS)
    columns, sheets, books = map(settled, g.profile(raw))
    postings = settled(g.build_header_postings(columns))
    searched = clean_cells(spark, SF_DIR, *SHEETS)
    names = table(spark, SF_DIR, "customer").select(
        F.col("c_custkey").alias("query_id"), F.substring("c_name", 10, 100).alias("query")
    )
    asked = table(spark, SF_DIR, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.concat(F.lit("find the "), F.lower("p_type"), F.lit(" price column of "), "p_brand").alias("query"),
    )
    routed = table(spark, SF_DIR, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("find the name column of "), "p_brand"))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("how many rows of "), "p_name"))
        .otherwise(F.col("p_brand"))
        .alias("query"),
    )
    docs = table(spark, SF_DIR, "documents")
    n_docs, n_names, n_asked = docs.count(), names.count(), asked.count()

    benches = {
        "number_rows_to_cells": (n_cells, lambda: run(line_cells())),
        "search_cells": (n_cells, lambda: run(g.search_cells(small_queries(spark, FLAGSHIP), cells, k=100))),
        "search_cells_hot": (n_cells, lambda: run(g.search_cells(small_queries(spark, [(1, "1"), (2, "R")]), cells, k=100))),
        "match_many_queries": (n_names, lambda: run(g.match_cells(names, searched))),
        "profile_columns": (n_cells, lambda: run(g.profile_columns(cells, sample=1000))),
        "profile_columns_all_rows": (n_cells, lambda: run(g.profile_columns(cells))),
        "search_columns": (n_asked, lambda: run(g.search_columns(asked, postings, k=100))),
        "route_queries": (
            n_asked,
            lambda: run(g.route_queries(routed, searched, postings, sheets, books, k=20)[1]),
        ),
        "tokenize_content": (n_docs, lambda: run(g.tokenize_content(docs, "text").select("doc_id", "tokens"))),
        "tokenize_queries": (n_docs, lambda: run(g.tokenize_queries(docs, "text").select("doc_id", "tokens"))),
        "extract_entities": (n_docs, lambda: run(g.extract_entities(docs, "text").select("doc_id", "entities"))),
        "cell_lines": (n_cells, lambda: run(g.cell_lines(cells))),
    }
    only = sys.argv[1:]
    seconds, rates = {}, {}
    for name, (count, job) in benches.items():
        if only and name not in only:
            continue
        for _ in range(2):
            start = time.perf_counter()
            job()
            took = time.perf_counter() - start
        seconds[name] = round(took, 3)
        rates[name] = round(count / took)
        print(name, seconds[name], rates[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of warm headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates_per_sec": rates,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
