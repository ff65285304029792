"""Token indexes, saved tables and workbook files."""

from __future__ import annotations

import io
import sys
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

import gridsieve as g
from gridsieve.sources.workbooks import open_workbooks

from . import check
from .cell_checks import scratch
from .profile_checks import edged_cells, profile_sql
from .sheets import cells_sql, clean_sql, quote, sheet_cells, table
from .token_checks import content_sql, header_sql, joined

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TITLED = f"SELECT *, header AS raw FROM ({profile_sql()}) WHERE header IS NOT NULL"
HEADER_POSTINGS = f"""WITH h AS ({TITLED}), t AS ({header_sql('SELECT DISTINCT raw FROM h')})
    SELECT unnest(t.tokens) AS token, source, sheet_name, column_index, column_letter, header, data_type FROM h JOIN t USING (raw)"""
SAMPLED = f"SELECT source, sheet_name, column_letter, unnest(string_split(sample_values, chr(10))) AS raw FROM ({profile_sql()}) WHERE sample_values <> ''"
CONTENT_POSTINGS = f"""WITH v AS ({SAMPLED}), t AS ({content_sql('SELECT DISTINCT raw FROM v')})
    SELECT unnest(t.tokens) AS token, source, sheet_name, column_letter, raw AS value FROM v JOIN t USING (raw)"""


FIRST_TOKENS = CONTENT_POSTINGS.replace("unnest(t.tokens)", "unnest(t.tokens[1:2])").replace("raw AS value", "substr(raw, 1, 7) AS value")
CELL_POSTINGS = f"""WITH c AS (SELECT source, sheet AS sheet_name, CAST(row AS BIGINT) AS row, col AS column_index, value AS raw FROM ({cells_sql('part', 'supplier', 'customer', 'events')}) WHERE row > 1 AND value <> ''),
    t AS ({content_sql('SELECT DISTINCT raw FROM c')})
    SELECT unnest(t.tokens) AS token, source, sheet_name, row, column_index FROM c JOIN t USING (raw)"""


def column_profile(spark, d):
    return g.profile_columns(edged_cells(spark, d))


@check(HEADER_POSTINGS)
def build_header_postings(spark, d):
    return g.build_header_postings(column_profile(spark, d))


@check(CONTENT_POSTINGS)
def build_content_postings(spark, d):
    return g.build_content_postings(column_profile(spark, d))


@check(FIRST_TOKENS)
def build_content_postings_capped(spark, d):
    """The first two tokens of a value and its first seven characters."""
    return g.build_content_postings(column_profile(spark, d), per_value=2, max_length=7)


def cell_postings(spark, d):
    return g.build_cell_postings(sheet_cells(spark, d, "part", "supplier", "customer", "events"))


@check(CELL_POSTINGS)
def build_cell_postings(spark, d):
    return cell_postings(spark, d).select("token", "source", "sheet_name", "row", "column_index")


@check(
    f"SELECT token, p_partkey, source, sheet_name, row, column_index FROM ({CELL_POSTINGS}) "
    "JOIN (SELECT p_partkey, lower(p_type) AS token FROM part) USING (token)"
)
def lookup_cells(spark, d):
    tokens = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("token"))
    found = g.lookup_content(tokens, cell_postings(spark, d))
    return found.select("token", "p_partkey", "source", "sheet_name", "row", "column_index")


@check(
    f"SELECT token, p_partkey, source, sheet_name, column_letter, value FROM ({CONTENT_POSTINGS}) "
    "JOIN (SELECT p_partkey, lower(p_type) AS token FROM part) USING (token)"
)
def lookup_content(spark, d):
    tokens = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("token"))
    return g.lookup_content(tokens, g.build_content_postings(column_profile(spark, d)))


@check(f"SELECT token, count(*) AS n_postings FROM ({CONTENT_POSTINGS}) GROUP BY token")
def token_stats(spark, d):
    return g.token_stats(g.build_content_postings(column_profile(spark, d)))


@check(f"SELECT count(DISTINCT token) AS n_tokens, count(*) AS n_postings FROM ({HEADER_POSTINGS})")
def index_size(spark, d):
    return g.index_size(g.build_header_postings(column_profile(spark, d)))


@check(f"{HEADER_POSTINGS}", name="save_and_load_index")
def save_and_load_index(spark, d):
    path = scratch(spark)
    columns = column_profile(spark, d)
    g.save_index({"column_profile": columns, "header_postings": g.build_header_postings(columns)}, path)
    return g.load_index(spark, path)["header_postings"]


@check(
    f"SELECT * FROM ({HEADER_POSTINGS}) WHERE source NOT IN ('people.xlsx', 'goods.xlsx') "
    "OR (source = 'people.xlsx' AND sheet_name = 'customer' AND column_index = 1)"
)
def save_index_again(spark, d):
    """Saved twice, the second time with fewer columns of one workbook and no tokens of another, then compacted."""
    path = scratch(spark)
    columns = column_profile(spark, d)
    g.save_index({"column_profile": columns, "header_postings": g.build_header_postings(columns)}, path)
    fewer = columns.where("source = 'goods.xlsx' OR (source = 'people.xlsx' AND sheet_name = 'customer' AND column_index = 1)")
    tokens = g.build_header_postings(fewer.where("source = 'people.xlsx'"))
    g.save_index({"column_profile": fewer, "header_postings": tokens}, path)
    g.compact_index(spark, path)
    return g.load_index(spark, path)["header_postings"]


@check(f"SELECT * FROM ({HEADER_POSTINGS}) WHERE source <> 'people.xlsx' AND token IN ('name', 'price', 'nationkey')")
def drop_sources(spark, d):
    path = scratch(spark)
    g.save_index({"header_postings": g.build_header_postings(column_profile(spark, d))}, path)
    g.drop_sources(spark, path, ["people.xlsx", "nowhere.xlsx"])
    return g.load_index(spark, path, tokens=["name", "price", "nationkey"])["header_postings"]


@check(
    f"SELECT source, sheet_name, column_index, header FROM ({profile_sql()}) "
    "WHERE source NOT IN (SELECT replace(lower(n_name), 'nation_0', 'sales.xlsx') FROM nation)"
)
def invalidate(spark, d):
    gone = F.replace(F.lower("n_name"), F.lit("nation_0"), F.lit("sales.xlsx")).alias("source")
    sources = table(spark, d, "nation").select(gone)
    kept = g.invalidate(column_profile(spark, d), sources)
    return kept.select("source", "sheet_name", "column_index", "header")


EVENT_FILES = "SELECT 'events/' || event_type || '/' || (event_id // 10) AS path, max(ts) AS modificationTime, count(*) AS length FROM events GROUP BY 1"


@check(
    f"""WITH f AS ({EVENT_FILES}) SELECT * FROM f WHERE length % 3 <> 1"""
)
def changed_files(spark, d):
    """Files named after events; the manifest lacks some and has an older time for others."""
    events = table(spark, d, "events")
    path = F.concat(F.lit("events/"), "event_type", F.lit("/"), F.expr("event_id div 10"))
    files = events.groupBy(path.alias("path")).agg(F.max("ts").alias("modificationTime"), F.count(F.lit(1)).alias("length"))
    older = F.timestamp_add("DAY", F.lit(-1), "modificationTime")
    time = F.when(F.col("length") % 3 == 1, F.col("modificationTime")).otherwise(older)
    manifest = files.where("length % 3 > 0").select("path", time.alias("modificationTime"))
    return g.changed_files(files, manifest)


# --- workbooks: part rows as .xlsx files of up to 500 rows each, two sheets per file --------


def pack_workbook(rows: list[tuple[str, str, float]]) -> bytes:
    """A workbook with the rows on a sheet ``parts`` and a summary on a sheet ``sums``."""
    lines = ['<row r="1"><c r="A1" t="inlineStr"><is><t>p_name</t></is></c><c r="B1" t="inlineStr"><is><t>p_size</t></is></c><c r="C1" t="inlineStr"><is><t>p_retailprice</t></is></c></row>']
    for i, (name, size, price) in enumerate(rows, start=2):
        lines.append(
            f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{escape(name)}</t></is></c>'
            f'<c r="B{i}"><v>{size}</v></c><c r="C{i}"><v>{price!r}</v></c></row>'
        )
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    total = f'<row r="1"><c r="B1" t="str"><f>COUNTA(parts!A2:A{len(rows) + 1})</f><v>{len(rows)} rows</v></c></row>'

    def sheet(body: str, size: str) -> str:
        return f'<worksheet {ns}><dimension ref="A1:{size}"/><sheetData>{body}</sheetData></worksheet>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="parts" sheetId="1" r:id="a"/>'
            '<sheet name="sums" sheetId="2" r:id="b"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="a" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="b" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", sheet("".join(lines), f"C{len(rows) + 1}"))
        book.writestr("xl/worksheets/sheet2.xml", sheet(total, "C1"))
    return out.getvalue()


def packed_parts(spark, d):
    """``path, content``: one workbook per 500 part keys."""
    parts = table(spark, d, "part").withColumn("book", F.expr("p_partkey div 500"))
    rows = parts.groupBy("book").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size", "p_retailprice"))).alias("rows")
    )

    def pack(batches):
        for batch in batches:
            books = batch.column(0).to_pylist()
            packed = [
                pack_workbook([(r["p_name"], r["p_size"], r["p_retailprice"]) for r in rows])
                for rows in batch.column(1).to_pylist()
            ]
            paths = [f"parts{b}.xlsx" for b in books]
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(packed, pa.binary())], names=["path", "content"]
            )

    return rows.select("book", "rows").mapInArrow(pack, "path string, content binary")


PLACED = "SELECT *, 'parts' || (p_partkey // 500) || '.xlsx' AS source, CAST(p_partkey % 500 + 2 AS BIGINT) AS row FROM part"


@check(
    f"""SELECT source, 'parts' AS sheet, row, 1 AS col, p_name AS value, 'text' AS value_type, NULL AS formula FROM ({PLACED})
    UNION ALL SELECT source, 'parts', row, 2, CAST(p_size AS VARCHAR), 'number', NULL FROM ({PLACED})
    UNION ALL SELECT source, 'parts', row, 3, CAST(p_retailprice AS VARCHAR), 'number', NULL FROM ({PLACED})
    UNION ALL SELECT DISTINCT source, 'parts', 1, i, v, 'text', NULL FROM ({PLACED}), (VALUES (1, 'p_name'), (2, 'p_size'), (3, 'p_retailprice')) h(i, v)
    UNION ALL SELECT source, 'sums', 1, 2, count(*) || ' rows', 'text', '=COUNTA(parts!A2:A' || (count(*) + 1) || ')' FROM ({PLACED}) GROUP BY source
    UNION ALL SELECT DISTINCT source, 'sums', 1, 3, NULL, NULL, NULL FROM ({PLACED})"""
)
def open_workbooks_of_parts(spark, d):
    cells, _ = g.split_rejects(open_workbooks(packed_parts(spark, d)))
    return cells.select("source", "sheet", "row", "col", "value", "value_type", "formula")


@check(
    """SELECT 'parts' || b || '.xlsx' AS source, 'BadZipFile' AS error FROM (SELECT DISTINCT p_partkey // 500 AS b FROM part) WHERE b % 2 = 1"""
)
def rejects(spark, d):
    """Every other workbook is cut short: it is reported, the rest is read."""
    packed = packed_parts(spark, d)
    odd = F.regexp_extract("path", "([0-9]+)", 1).cast("int") % 2 == 1
    broken = packed.withColumn("content", F.when(odd, F.substring("content", 1, 100)).otherwise(F.col("content")))
    _, failed = g.split_rejects(open_workbooks(broken))
    return failed.select("source", F.substring_index("error", ":", 1).alias("error"))
