import re
import zipfile

import pytest
from pyspark.sql import functions as F

import gridsieve as g
from checks.index_checks import pack_workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(path, sheets, strings=(), styles="", date1904=False):
    """A workbook from the sheet XML of each name."""
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        flag = '<workbookPr date1904="1"/>' if date1904 else ""
        book.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}">{flag}<sheets>{listed}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="r{i}" Type="{REL}/worksheet" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))
        )
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, body in enumerate(sheets.values()):
            book.writestr(f"xl/worksheets/s{i}.xml", body)
        if strings:
            items = "".join(f"<si>{s}</si>" for s in strings)
            book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
        if styles:
            book.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")


def sheet(rows, dimension="A1:C3"):
    return f'<worksheet {NS}><dimension ref="{dimension}"/><sheetData>{rows}</sheetData></worksheet>'


STYLES = (
    '<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>'
    '<numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs>'
)


def test_read_workbooks(spark, tmp_path):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>When</t></is></c></row>'
        '<row r="2"><c r="A2"><v>5</v></c><c r="B2" s="1"><v>45306.5</v></c><c r="C2" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="A4" s="2"><v>1.50</v></c><c r="B4" t="e"><v>#DIV/0!</v></c>'
        '<c r="C4"><f>A2*2</f><v>10</v></c></row><row><c s="3"><v>0.25</v></c><c><v>1E-3</v></c></row>'
    )
    strings = ["<r><t>Qty </t></r><r><t>sold</t></r><rPh><t>x</t></rPh>"]
    write_workbook(tmp_path / "one.xlsx", {"data": sheet(rows, "A1:D9"), "none": sheet("", "A1")}, strings, STYLES)
    cells, rejects = g.split_rejects(g.read_workbooks(spark, str(tmp_path)))
    got = {
        (r["row"], r["col"]): (r["cell_ref"], r["value"], r["value_type"], r["formula"])
        for r in cells.where("sheet = 'data'").collect()
    }
    assert got == {
        (1, 1): ("A1", "Qty sold", "text", None),
        (1, 2): ("B1", "When", "text", None),
        (2, 1): ("A2", "5", "number", None),
        (2, 2): ("B2", "2024-01-15 12:00:00", "date", None),
        (2, 3): ("C2", "TRUE", "boolean", None),
        (4, 1): ("A4", "1.5", "number", None),
        (4, 2): ("B4", "#DIV/0!", "text", None),
        (4, 3): ("C4", "10", "number", "=A2*2"),
        (5, 1): ("A5", "06:00:00", "text", None),
        (5, 2): ("B5", "0.001", "number", None),
        (9, 4): ("D9", None, None, None),  # stands for the declared size
    }
    assert rejects.count() == 0
    middle = cells.where("cell_ref = 'B2'").first()
    assert (middle["left_value"], middle["right_value"]) == ("5", "TRUE")
    first, last = cells.where("cell_ref = 'A1'").first(), cells.where("cell_ref = 'B1'").first()
    assert first["left_value"] is None and last["right_value"] == ""


def test_dates_from_1904(spark, tmp_path):
    rows = '<row r="1"><c r="A1" s="1"><v>0</v></c><c r="B1" s="1"><v>366</v></c></row>'
    write_workbook(tmp_path / "mac.xlsm", {"d": sheet(rows, "A1:B1")}, styles=STYLES, date1904=True)
    cells, _ = g.split_rejects(g.read_workbooks(spark, str(tmp_path)))
    assert cells.where("cell_ref = 'B1'").first()["value"] == "1905-01-01 00:00:00"


def test_bad_files_and_sheets_are_rejected_alone(spark, tmp_path):
    good = sheet('<row r="1"><c r="A1"><v>1</v></c></row>', "A1")
    broken = good.replace("</sheetData>", '<row r="2"><c r="A2"><v>x</v></c></row></sheetData>')
    write_workbook(tmp_path / "mixed.xlsx", {"good": good, "broken": broken})
    (tmp_path / "cut.xlsx").write_bytes(b"PK not a workbook")
    (tmp_path / "notes.txt").write_text("not read")
    cells, rejects = g.split_rejects(g.read_workbooks(spark, str(tmp_path)))
    assert [(r["sheet"], r["value"]) for r in cells.collect()] == [("good", "1")]
    failed = {(r["source"].rsplit("/", 1)[-1], r["sheet"]): r["error"] for r in rejects.collect()}
    assert set(failed) == {("mixed.xlsx", "broken"), ("cut.xlsx", None)}
    assert failed[("cut.xlsx", None)].startswith("BadZipFile")


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        g.read_workbooks(spark, str(tmp_path / "nowhere"))


def test_only_changed_files_are_read(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.xlsx").write_bytes(pack_workbook([(name, 1, 2.5)]))
    files = g.list_workbooks(spark, str(tmp_path))
    manifest = spark.createDataFrame(files.collect(), files.schema)
    assert g.changed_files(files, manifest).count() == 0
    assert g.changed_files(files, manifest, force=True).count() == 2
    assert g.changed_files(files, None).count() == 2
    late = manifest.withColumn(
        "modificationTime",
        F.when(F.col("path").endswith("b.xlsx"), F.timestamp_add("DAY", F.lit(-1), "modificationTime")).otherwise(
            F.col("modificationTime")
        ),
    )
    changed = g.changed_files(files, late)
    assert [r["path"].rsplit("/", 1)[-1] for r in changed.collect()] == ["b.xlsx"]
    cells, _ = g.split_rejects(g.read_workbooks(spark, str(tmp_path), only=changed))
    assert {r["value"] for r in cells.where("sheet = 'parts' AND cell_ref = 'A2'").collect()} == {"b"}


def index_of(make_cells, *sources):
    def cells(s):
        rows = [(1, 1, f"Head {s}"), (2, 1, "one"), (3, 1, "two words")]
        return make_cells(rows, source=s, sheet="2024")

    from functools import reduce

    all_cells = reduce(lambda a, b: a.unionByName(b), [cells(s) for s in sources])
    columns, sheets, books = g.profile(all_cells)
    return {
        "column_profile": columns,
        "sheet_profile": sheets,
        "workbook_profile": books,
        "header_postings": g.build_header_postings(columns),
        "content_postings": g.build_content_postings(columns),
    }


def test_index_is_saved_loaded_replaced_and_dropped(spark, make_cells, tmp_path):
    path = str(tmp_path / "index")
    saved = index_of(make_cells, "2023", "file:/x/b 1.xlsx")
    g.save_index(saved, path)
    loaded = g.load_index(spark, path)
    assert set(loaded) == set(saved)
    for name, df in saved.items():
        back = loaded[name].select(df.columns)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0, name
    narrowed = g.load_index(spark, path, tokens=["head"])["header_postings"]
    assert {r["token"] for r in narrowed.collect()} == {"head"}
    assert "In(token" in narrowed._jdf.queryExecution().toString() or "EqualTo(token" in narrowed._jdf.queryExecution().toString()

    # one token reads one folder of each saving
    read = narrowed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(bucket#[0-9]+ = [0-9]+\)", read)

    # saving one source again leaves the other alone
    g.save_index(index_of(make_cells, "2023"), path)
    assert {r["source"] for r in g.load_index(spark, path)["sheet_profile"].collect()} == {"2023", "file:/x/b 1.xlsx"}
    assert g.load_index(spark, path)["sheet_profile"].count() == 2

    gone = spark.createDataFrame([("2023",)], "source string")
    assert {r["source"] for r in g.invalidate(g.load_index(spark, path)["sheet_profile"], gone).collect()} == {"file:/x/b 1.xlsx"}
    g.drop_sources(spark, path, ["file:/x/b 1.xlsx", "nowhere"])
    assert {r["source"] for r in g.load_index(spark, path)["content_postings"].collect()} == {"2023"}


def sources_of(spark, path):
    return {name: sorted({r["source"] for r in df.collect()}) for name, df in g.load_index(spark, path).items()}


def test_a_source_that_lost_all_rows_of_a_table(spark, make_cells, tmp_path):
    path = str(tmp_path / "index")
    g.save_index(index_of(make_cells, "a", "b"), path)
    again = index_of(make_cells, "a")
    again["header_postings"] = again["header_postings"].where("false")
    g.save_index(again, path)
    found = sources_of(spark, path)
    assert found["header_postings"] == ["b"] and found["column_profile"] == ["a", "b"]
    g.save_index(index_of(make_cells, "c"), path, sources=spark.createDataFrame([("b",)], "source string"))
    assert sources_of(spark, path) == {n: ["c"] if n == "header_postings" else ["a", "c"] for n in again}


def test_compaction(spark, make_cells, tmp_path, monkeypatch):
    from gridsieve.sources import index

    path = str(tmp_path / "index")
    monkeypatch.setattr(index, "BUCKETS", 2)
    g.compact_index(spark, path)  # nothing there yet
    for names in (["a", "b"], ["c", "b"]):
        g.save_index({n: df for n, df in index_of(make_cells, *names).items() if n in ("sheet_profile", "header_postings")}, path)
    g.drop_sources(spark, path, ["b"])

    def rows():
        return {n: sorted(map(str, df.collect())) for n, df in g.load_index(spark, path).items()}

    def files():
        return {str(f.relative_to(path)).split("/")[1] for f in (tmp_path / "index").rglob("part-*") if f.relative_to(path).parts[0] != "live"}

    before = rows()
    with monkeypatch.context() as m:  # broken off before the new generation counts, and between the emptied ones
        m.setattr(index, "_write_live", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            g.compact_index(spark, path)
    assert rows() == before
    write, calls = index._write, []

    def breaks(df, path, name, generation):
        calls.append(name)
        if len(calls) > len(before) + 2:
            raise ZeroDivisionError
        write(df, path, name, generation)

    with monkeypatch.context() as m:
        m.setattr(index, "_write", breaks)
        with pytest.raises(ZeroDivisionError):
            g.compact_index(spark, path)
    assert rows() == before
    g.compact_index(spark, path)
    assert rows() == before and len(files()) == 1
    g.save_index({"sheet_profile": index_of(make_cells, "b")["sheet_profile"]}, path)
    assert sources_of(spark, path) == {"sheet_profile": ["a", "b", "c"], "header_postings": ["a", "c"]}
