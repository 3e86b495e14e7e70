"""Workbooks made by hand: cells of all kinds, merged ranges, comparative statements and groups of works."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from worksight.operators import scope as S
from worksight.sources import plans as L
from worksight.sources import sheets as X

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letters(i):
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def workbook(path, rows, merged=()):
    """Texts go to the shared strings, those with '!' in front into their cell; numbers stay."""
    shared, out = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            at = f"{letters(i)}{n}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif v.startswith("!"):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v[1:])}</t></is></c>')
            else:
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
        out.append(f'<row r="{n}">{"".join(cells)}</row>')
    merge = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet {NS}><sheetData>{"".join(out)}</sheetData>{f"<mergeCells>{merge}</mergeCells>" if merge else ""}</worksheet>')
        if shared:
            text = lambda s: f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>" if s.startswith("rich") else f'<si><t xml:space="preserve">{escape(s)}</t></si>'
            z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0" encoding="UTF-8"?><sst {NS}>{"".join(map(text, shared))}</sst>')


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sheets")
    gap = [None] * 10
    workbook(at / "statement.xlsx", [["Statement"], gap + ["Quoted by"], gap + ["RAVI & CO", None, "!B FIRM", None, "LATE"], ["Total Bid Amount"] + [None] * 10 + ["95000.50 (L1)", "99000 (L2)"]])
    workbook(at / "parks.xlsx", [["Sl", "Zone", "Ward", "Group", "Park"], [1, "S", 151, "rich Parks", "A park", 3, "1,00,000", 90000, "024046 SOME FIRM, town"], [None, None, None, None, "B park"], [2, "S", 9, "Other", "C park"]], ["A2:A3", "C2:C3", "D2:D3", "E1:F1"])
    workbook(at / "empty.xlsx", [])
    (at / "broken.xlsx").write_bytes(b"no archive")
    return str(at)


def test_cells(spark, folder):
    got = {(r.file, r.n): r.cells for r in X.read_sheets(spark, folder).collect()}
    assert got["parks.xlsx", 2] == ["1", "S", "151", "rich Parks", "A park", "3", "1,00,000", "90000", "024046 SOME FIRM, town"] and got["parks.xlsx", 3] == [None, None, None, None, "B park"]
    assert got["statement.xlsx", 3][10:] == ["RAVI & CO", None, "B FIRM", None, "LATE"] and {f for f, _ in got} == {"parks.xlsx", "statement.xlsx"}


def test_merged_ranges_are_filled(spark, folder):
    got = {r.n: r.cells for r in X.read_sheets(spark, folder, fill=True).filter("file = 'parks.xlsx'").collect()}
    assert got[3] == ["1", None, "151", "rich Parks", "B park"] and got[4][0] == "2" and got[1][:5] == ["Sl", "Zone", "Ward", "Group", "Park"]


def test_comparative_statements(spark, folder):
    got = sorted(tuple(r) for r in X.comparative_statements(X.read_sheets(spark, folder)).collect())
    assert got == [("statement.xlsx", 10, "RAVI & CO", 95000.5, "L1"), ("statement.xlsx", 12, "B FIRM", 99000.0, "L2")]


def test_groups_of_works(spark, folder):
    area = S.Area("Greenfield", "greenfield", "green field", {"198": ["151"]})
    rows = L.sheet_groups(X.read_sheets(spark, folder), L.Place(area, own_ward="151")).collect()
    assert [(r.description, r.ward, r.ecv, r.contract_value, r.contractor, r.row) for r in rows] == [("rich Parks (A park, B park)", "151", 100000.0, 90000.0, "SOME FIRM", 2)]
