import zipfile

import pytest

from sparkloom.sources import excel

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    """sheets: name to rows of (type, value, style) cells."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml" Type="x"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>depot</t></si><si><r><t>pal</t></r><r><t>lets</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 3}">' + "".join(f'<c r="{chr(66 + k)}{r + 3}" t="{t}" s="{s}">' + (f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>") + "</c>" for k, (t, v, s) in enumerate(cells) if v != "") + "</row>" for r, cells in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


ROWS = [
    [("inlineStr", "Stock list", 0)],
    [("s", "0", 0), ("s", "1", 0), ("inlineStr", "since", 0), ("inlineStr", "open", 0)],
    [("str", "north", 0), ("n", "4.0", 0), ("n", "45056", 1), ("b", "1", 0)],
    [("str", "", 0), ("n", "2.5", 3), ("n", "45056.5", 2), ("b", "0", 0)],
    [("str", "Total", 0), ("n", "7", 0)],
]


def test_workbook(spark, tmp_path):
    f = tmp_path / "stock.xlsx"
    workbook(f, {"cover": [[("inlineStr", "hello", 0)]], "data": ROWS, "empty": []})
    df = excel.read_workbook(spark, str(f))
    assert df.columns == ["depot", "pallets", "since", "open"]
    assert [tuple(r) for r in df.collect()] == [("north", "4", "2023-05-10", "True"), (None, "2.5", "2023-05-10 12:00:00", "False"), ("Total", "7", None, None)]
    got = excel.ingest_workbook(spark, str(f), str(tmp_path / "out"))
    assert dict(got.dtypes)["open"] == "boolean" and got.count() == 2
    workbook(tmp_path / "none.xlsx", {"a": []})
    assert excel.read_workbook(spark, str(tmp_path / "none.xlsx")).count() == 0
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="no workbook"):
        excel.read_workbooks(spark, str(tmp_path / "bad.xlsx")).collect()
