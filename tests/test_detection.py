import pytest
from sheets import HEADER, ROW_1, ROW_2, Sheets, raw

from rosterkit.operators import content, sheets
from rosterkit.operators.profile import header_report

BLANK = ["", None, " ", ""]
PEOPLE = [[f"{a} Mara", "F", "1990-01-15", f"P00000{i}"] for i, a in enumerate(["Ada", "Ben", "Cleo", "Dan", "Eve"])]
SIDE_BY_SIDE = [["Name", "Born", None, "Product", "Rate"], ["Ada Mara", "1990-01-15", None, "Term", "1.5"]]
OWN_ALIAS = [["Assured", "Born"], ["Ada Mara", "1990-01-15"]]
CASES = {
    "basic": {"rows": [HEADER, ROW_1, ROW_2]},
    "late": {"rows": [["Delivery"], ["Unit 7"], BLANK, BLANK, BLANK, HEADER, ROW_1]},
    "very late": {"rows": [["A"], ["B"], ["C"], *[BLANK] * 8, HEADER, ROW_1]},
    "too late": {"rows": [*[["x"]] * 50, HEADER, ROW_1]},
    "side by side": {"rows": SIDE_BY_SIDE},
    "similar": {"rows": [["Membr Nam", "Gender", "Born", "Contract No"], ROW_1]},
    "headerless": {"rows": PEOPLE},
    "name pair": {"rows": [[f"Mara {a}", f"{b} Lee", f"Kay {a}{b}"] for a, b in zip("ABCDE", "FGHIJ")]},
    "labels": {"rows": [["Premium", "Amount"], *[["Term plan", "10"]] * 5]},
    "no anchor": {"rows": [["Gender", "Born"], ["F", "1990-01-15"]]},
    "own alias": {"rows": OWN_ALIAS, "company": "CO3"},
    "other company": {"rows": OWN_ALIAS, "company": "CO1"},
}


@pytest.fixture(scope="module")
def found(spark, alias):
    return Sheets(spark, alias, CASES)


def test_basic_header(found):
    (m,) = found.tables("basic")
    assert (m.header_row_idx, m.name, m.sex, m.dob, m.policynum, m.method) == (0, [0], [1], [2], [3], "exact")
    assert m.identified_headers == "Name, Gender, Born, Contract No"


def test_header_below_banner_and_blank_rows(found):
    assert found.tables("late")[0].header_row_idx == 5
    (m,) = found.tables("very late")
    assert (m.header_row_idx, m.policynum) == (11, [3])


def test_header_beyond_the_search_depth_is_not_found(found):
    assert found.tables("too late") == []


def test_side_by_side_tables(spark, found):
    (m,) = found.tables("side by side")
    assert (m.col_start, m.col_end) == (0, 1)
    blocks = sheets.column_blocks(sheets.head_cells(raw(spark, *SIDE_BY_SIDE))).collect()
    assert sorted((b.table_idx, b.col_start, b.col_end) for b in blocks) == [(1, 0, 1), (2, 3, 4)]


def test_similar_header(found):
    (m,) = found.tables("similar")
    assert (m.method, m.name, m.sex) == ("fuzzy", [0], [1])


def test_headerless_sheet_by_content(found):
    (m,) = found.tables("headerless")
    assert (m.header_row_idx, m.content_based, m.name, m.sex, m.dob, m.policynum) == (-1, True, [0], [1], [2], [3])


def test_two_name_columns_by_content_make_a_pair(found):
    (m,) = found.tables("name pair")
    assert (m.firstlastname, m.name) == ([0, 1], [2])


def test_no_names_no_match(found):
    assert found.tables("labels") == [] and found.tables("no anchor") == []


def test_own_alias_applies_to_its_company_only(found):
    assert found.tables("own alias")[0].name == [0]
    assert found.tables("other company") == []


def test_densest_row(spark):
    cells = lambda *rows: sheets.block_cells(sheets.head_cells(raw(spark, *rows)))
    best = sheets.densest_rows(cells(["Banner"], [None], ["a", "b", "c", "d"], ["e", "f", "g", "h"])).collect()
    assert min((r.row_idx, r.n_cells) for r in best) == (2, 4)
    assert sheets.densest_rows(cells([None, " "], ["", None])).isEmpty()


def test_categories(spark):
    columns = {
        "Sex": ["M", "F", "male", "Female"], "DOB": ["1990-01-15", "01/15/1990", "15 Jan 1990"], "Numeric": ["101", "102", "103"],
        "PolicyNumber": ["123456", "234567"], "Identifier": ["ABC_1234", "DEF_5678"], "Text": ["Basic share"] * 6, "Unknown": ["a?", "b!"],
        "Empty": ["", None],
    }
    rows = [[v[i] if i < len(v) else None for v in columns.values()] for i in range(6)]
    found = content.categorise_columns(sheets.head_cells(raw(spark, *rows))).collect()
    named = {list(columns)[r.col_idx]: r.category for r in found}
    assert named == {c: c for c in columns if c != "Empty"}  # a column without values has no cells at all


def test_header_report(spark):
    rows = header_report(raw(spark, ["Member Name", "Gender", "Born", "Contract No"], *PEOPLE)).collect()
    assert [(r.header, r.column_index, r.row_index, r.category, r.table) for r in rows] == [
        ("Member Name", 0, 0, "Name", "Table 1"), ("Gender", 1, 0, "Sex", "Table 1"),
        ("Born", 2, 0, "DOB", "Table 1"), ("Contract No", 3, 0, "PolicyNumber", "Table 1"),
    ]
    rows = header_report(raw(spark, ["Premium", "Claim ID", "Notes"], ["100", "A?", "x y z!"], ["250", "B?", "q!"])).collect()
    assert rows[0].category == "Numeric"


def test_empty_header_report_keeps_its_schema(spark):
    empty = header_report(raw(spark, ["x"]).filter("false"))
    assert empty.columns == ["header", "file_path", "sheet_name", "table", "column_index", "row_index", "category"]
    assert empty.isEmpty()
