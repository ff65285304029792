"""The test tables as sheets of workbooks, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

import gridsieve as g
from gridsieve.functions.patterns import SPACES

# sheet: workbook, dense zero-based key, columns
SHEETS = {
    "part": ("goods.xlsx", "p_partkey", "p_name p_brand p_type p_size p_retailprice"),
    "supplier": ("people.xlsx", "s_suppkey", "s_name s_nationkey s_acctbal"),
    "customer": ("people.xlsx", "c_custkey", "c_name c_mktsegment c_nationkey c_acctbal"),
    "orders": ("sales.xlsx", "o_orderkey", "o_orderstatus o_orderpriority o_totalprice o_orderdate"),
    "events": ("log.xlsx", "event_id", "event_type value props ts"),
    "nation": ("places.xlsx", "n_nationkey", "n_name n_regionkey"),
    "region": ("places.xlsx", "r_regionkey", "r_name"),
}
LONG = ["lineitem", "orders", "events", "documents", "pages", "conversations"]
MANY = 50_000  # rows from which other tables are dealt out too
DATES = ["o_orderdate", "ts"]
NUMBERS = "p_size p_retailprice s_nationkey s_acctbal c_nationkey c_acctbal o_totalprice value n_regionkey".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to the idle cores where its one small file would keep only one busy."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and (name in LONG or df.count() >= MANY) else df


def sheet_cells(spark: SparkSession, sf_dir: str, *names: str, neighbours: bool = False) -> DataFrame:
    """Cells of some sheets, as their sources hold them."""

    def cells(name: str) -> DataFrame:
        book, key, cols = SHEETS[name]
        df = table(spark, sf_dir, name)
        row = F.col(key) + 2
        return g.table_to_cells(df, book, name, cols=cols.split(), row=row, neighbours=neighbours)

    return reduce(DataFrame.unionByName, [cells(n) for n in names])


def clean_cells(spark: SparkSession, sf_dir: str, *names: str, neighbours: bool = True) -> DataFrame:
    return g.clean_values(sheet_cells(spark, sf_dir, *names, neighbours=neighbours))


# --- the same in SQL ---------------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_sql(column: str) -> str:
    if column in DATES:
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({column} AS VARCHAR)"


def cells_sql(*names: str) -> str:
    """A SELECT of source, sheet, row, col, cell_ref, value, value_type."""
    selects = []
    for name in names:
        book, key, cols = SHEETS[name]
        for i, c in enumerate(cols.split()):
            kind = "date" if c in DATES else "number" if c in NUMBERS else "text"
            letter = chr(65 + i)
            where = f"SELECT '{book}' AS source, '{name}' AS sheet"
            selects.append(
                f"{where}, CAST({key} + 2 AS BIGINT) AS row, {i + 1} AS col, "
                f"'{letter}' || ({key} + 2) AS cell_ref, {text_sql(c)} AS value, "
                f"CASE WHEN {c} IS NOT NULL THEN '{kind}' END AS value_type FROM {name}"
            )
            selects.append(f"{where}, 1, {i + 1}, '{letter}1', '{c}', 'text'")
    return "\nUNION ALL ".join(selects)


def clean_sql(value: str, kind: str = "value_type") -> str:
    thorough = f"translate(trim({value}, {quote(SPACES)}), chr(124) || chr(9) || chr(10) || chr(13), '¦   ')"
    return f"coalesce(CASE WHEN {kind} = 'text' THEN {thorough} ELSE {value} END, '')"


def clean_cells_sql(*names: str) -> str:
    return f"SELECT * REPLACE ({clean_sql('value')} AS value) FROM ({cells_sql(*names)})"


# Character classes and word edges for RE2, which knows no lookaround.
W = r"\p{L}\p{N}_"
S = r"\t-\r\x1c-\x1f\x85\p{Z}"


def ascii_words(text: str) -> str:
    """Letters beyond ASCII as ``z`` and other signs beyond it as blanks: then ``\\b`` is right."""
    signs = f"regexp_replace({text}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g')"
    return f"regexp_replace({signs}, '[^\\x00-\\x7F]', 'z', 'g')"


def whole_word_sql(text: str, word: str) -> str:
    before = f"CASE WHEN regexp_matches({word}, '^[{W}]') THEN '(^|[^{W}])' ELSE '[{W}]' END"
    after = f"CASE WHEN regexp_matches({word}, '[{W}]$') THEN '($|[^{W}])' ELSE '[{W}]' END"
    return f"regexp_matches({text}, ({before}) || regexp_escape({word}) || ({after}))"


def cell_confidence_sql(matched: str, value: str) -> str:
    return f"""round(CASE WHEN coalesce({value}, '') = '' THEN 0.0
      WHEN lower({matched}) = lower({value}) THEN 1.0
      WHEN {whole_word_sql(f'lower({value})', f'lower({matched})')} THEN 0.9
      ELSE least(0.8, 0.5 + length({matched})::DOUBLE / length({value}) * 0.3) END::DOUBLE, 6)"""
