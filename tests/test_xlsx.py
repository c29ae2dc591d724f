"""Workbooks made in memory: scan, edit, revisions, and the journal as file and stream."""

import io
import json
import zipfile

import pytest

from cellgrid.sinks.revisions import Revisions
from cellgrid.sinks.xlsx import edited_book
from cellgrid.sources import journal as journal_source
from cellgrid.sources import xlsx

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" state="hidden" r:id="rId2"/></sheets><definedNames><definedName name="Rate">One!$A$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {_NS}><dimension ref="A1:B3"/><sheetData><row r="1"><c r="A1" s="3"><v>1.5</v></c><c t="s"><v>0</v></c></row><row r="2"><c r="A2"><f t="shared" ref="A2:A3" si="0">A1*$A$1</f><v>2.25</v></c><c r="B2" t="b"><v>1</v></c></row><row r="3"><c r="A3"><f t="shared" si="0"/><v>3.375</v></c><c r="B3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {_NS}><sheetData/></worksheet>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.xlsx").write_bytes(book())
    return str(tmp_path)


def test_scan(spark, folder):
    got = {(r.row, r.col): r for r in xlsx.cells(spark, folder).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)}
    assert got[1, 2].str == "hello" and got[2, 2].bool is True and got[3, 2].err == "#N/A" and got[1, 1].num == 1.5
    assert got[2, 1].formula == "=A1*$A$1" and got[3, 1].formula == "=A2*$A$1"
    assert {r.book for r in got.values()} == {"b.xlsx"}
    assert [(r.sheet, r.state) for r in xlsx.sheets(spark, folder).orderBy("sheet_idx").collect()] == [("One", "visible"), ("Two", "hidden")]
    assert [tuple(r) for r in xlsx.defined_names(spark, folder).collect()] == [("b.xlsx", "Rate", "One!$A$1")]
    assert xlsx.parts(spark, folder).filter("sha256 is not null and size > 0").count() == 6


def test_edits_touch_only_their_sheet():
    before = book()
    after = edited_book(before, {("one", 1, 1): (9.0, None), ("One", 5, 3): (" a<b ", None), ("One", 2, 1): (4.0, "=A1*2"), ("One", 6, 1): (float("inf"), None)})
    old, new = xlsx.read_parts(before), xlsx.read_parts(after)
    assert {k for k in old if old[k] != new.get(k)} == {"xl/worksheets/sheet1.xml"}
    cells = {(c[2], c[3]): c for c in xlsx.cells_of(new)}
    assert cells[1, 1][5] == 9.0 and cells[5, 3][6] == " a<b " and cells[2, 1][9] == "=A1*2" and cells[6, 1][8] == "#NUM!" and cells[2, 2][7] is True
    assert b's="3"' in new["xl/worksheets/sheet1.xml"] and b'ref="A1:C6"' in new["xl/worksheets/sheet1.xml"]
    with pytest.raises(ValueError, match="no sheet"):
        edited_book(before, {("Three", 1, 1): (1, None)})


def test_unpacking_is_bounded(monkeypatch):
    monkeypatch.setenv("CELLGRID_MAX_PART_BYTES", "100")
    with pytest.raises(ValueError, match="unpacks to more"):
        xlsx.read_parts(book())


def test_revisions(spark, tmp_path):
    store = Revisions(spark, f"file://{tmp_path}/revs")
    assert store.commit("b", spark.range(3)) == 1 and store.commit("b", spark.range(4)) == 2
    with pytest.raises(ValueError, match="is at"):
        store.commit("b", spark.range(9), base_hash="zz")
    assert store.undo("b") == 3 and store.read("b", 3).count() == 3


def test_journal_with_a_torn_tail(spark, tmp_path):
    good = [json.dumps({"rev": i, "base_hash": f"h{i - 1}", "result_hash": f"h{i}", "kind": "apply"}) for i in (1, 2)]
    (tmp_path / "b.jsonl").write_text("\n".join([*good, '{"rev": 3, "ba']))
    assert [r.rev for r in journal_source.receipts(spark, str(tmp_path)).orderBy("line_no").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text("\n".join([good[0], "broken", good[1]]) + "\n")
    with pytest.raises(Exception, match="bad journal line"):
        journal_source.receipts(spark, str(tmp_path)).collect()


def test_chain_as_a_stream(spark, tmp_path):
    from cellgrid.streaming.journal import chain_breaks

    rows = [("b", 1, 1, "x", "h1"), ("b", 2, 2, "h1", "h2"), ("b", 3, 3, "zz", "h3"), ("c", 1, 1, "", "k1")]
    schema = "book string, line_no long, rev long, base_hash string, result_hash string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = chain_breaks(stream).writeStream.format("memory").queryName("breaks").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("breaks").collect()] == [("b", 3, "h2", "zz")]
