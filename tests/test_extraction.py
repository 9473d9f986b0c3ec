import pytest
from sheets import HEADER, ROW_1, ROW_2, Sheets, raw

from rosterkit.operators import extract, runlog
from rosterkit.schema import ROSTER_COLUMNS

TWO_NAMES = [["Name", "Name", "Contract No"], ["Ada Mara", "Ben Okto", "P1"], ["Cy Solo", "", "P2"]]
CASES = {
    "standard": [HEADER, ROW_1, ROW_2],
    "names": TWO_NAMES,
    "single names": [["Name", "Name", "Contract No"], ["Ada Mara", "", "P1"], ["", "Ben Okto", "P2"]],
    "pairs": [
        ["FamilyName", "GivenName", "FamilyName", "GivenName", "Contract No"],
        ["Mara", "Ada", "Okto", "Ben", "P1"], ["Lee", "Kay", "", None, "P2"],
    ],
    "odd pair": [["FamilyName", "GivenName", "Family Name", "Contract No"], ["Mara", "Ada", "Okto", "P1"]],
    "null part": [["FamilyName", "GivenName", "Contract No"], ["Mara", None, "P1"], ["Okto", " ", "P2"]],
    "digits": [["Name", "FamilyName", "GivenName", "Contract No"], ["P123456", "Mara", "Ada", "P1"], ["Ben Okto", "Mara", "Ada", "P2"]],
    "digits only": [["Name", "Contract No"], ["Ada 7", "P1"]],
    "numbers": [["Name", "ContractNo"], *[[f"12345678{i}", f"P{i}"] for i in range(5)]],
    "marker": [HEADER, ["O'Neal-Mara DECEASED", "F", "", "P1"], ROW_1, ROW_1, ["", "M", "", "P3"]],
    "two tables": [["Name", "Contract No", None, "Whole Name", "Gender"], ["Ada Mara", "P1", None, "Ben Okto", "m"]],
}


@pytest.fixture(scope="module")
def found(spark, alias):
    return Sheets(spark, alias, {name: {"rows": rows} for name, rows in CASES.items()})


def names(found, case):
    return [r.COMPLETE_NAME for r in found.roster(case)]


def test_standard_rows(found):
    a, b = found.roster("standard")
    assert tuple(a) == ("", "", "ADA MARA", "F", "01/15/1990", "CO1", "P000001", "standard", "S1")
    assert (b.SEX, b.DATE_OF_BIRTH) == ("M", "02/15/1985")


def test_several_full_names(found):
    assert [(r.COMPLETE_NAME, r.SEX, r.DATE_OF_BIRTH, r.SURNAME) for r in found.roster("names")] == [
        ("ADA MARA", "U", "", None), ("BEN OKTO", "U", "", None),
    ]


def test_no_row_with_two_names_reads_the_first_column(found):
    assert names(found, "single names") == ["ADA MARA"]


def test_pairs(found):
    assert [(r.COMPLETE_NAME, r.SURNAME, r.SEX) for r in found.roster("pairs")] == [
        ("LEE KAY", "LEE", "U"), ("MARA ADA", "MARA", "U"), ("OKTO BEN", "OKTO", "U"),
    ]
    assert names(found, "odd pair") == ["MARA ADA"]


def test_null_part_drops_the_row_and_blank_part_does_not(found):
    assert names(found, "null part") == ["OKTO"]


def test_digit_in_the_name_falls_back_to_the_parts(found):
    assert names(found, "digits") == ["BEN OKTO", "MARA ADA"]
    assert names(found, "digits only") == []


def test_numeric_name_column_is_no_name(found):
    assert names(found, "numbers") == []


def test_marker_duplicates_and_missing_names(found):
    assert names(found, "marker") == ["ADA MARA", "O NEAL MARA"]


def test_two_tables_on_a_sheet(found):
    assert [(r.SHEET, r.COMPLETE_NAME, r.POLICY_NUMBER, r.SEX) for r in found.roster("two tables")] == [
        ("S1_table1", "ADA MARA", "P1", ""), ("S1_table2", "BEN OKTO", None, "M"),
    ]


def test_single_names_can_be_kept(found):
    kept = extract.extract_roster(found.raw, found.matches, keep_single_names=True)
    assert kept.filter("FILE_PATH = 'names'").count() == 3


def test_nothing_found_keeps_the_schema(found):
    out = extract.extract_roster(found.raw, found.matches.filter("false"))
    assert out.columns == ROSTER_COLUMNS and out.isEmpty()


def test_file_log_and_outcome(spark, alias):
    from rosterkit.operators.headers import detect_headers

    sheet = raw(spark, HEADER, ROW_1, ROW_1, ROW_2, ["", "M", "", "P9"]).unionByName(
        raw(spark, ["Premium", "Amount"], ["10", "1.5"], path="/in/b.csv")
    )
    tables = extract.plan_tables(sheet, detect_headers(sheet, alias))
    people = extract.distinct_people(extract.extract_people(sheet, tables))
    log = {r.file_name: r for r in runlog.file_log(sheet, tables, people).collect()}
    good, bad = log["a.csv"], log["b.csv"]
    assert (good.row_count, good.output_row_count, good.remarks, good.full_name_header) == (5, 2, "missing_name_count=1", "Name")
    assert bad.error_msg == runlog.NO_TABLE and bad.output_row_count is None


def test_hot_table_is_read_whole(spark, alias):
    """One file far larger than the others, joined by salts instead of a broadcast."""
    from pyspark.sql import functions as F

    from rosterkit.operators import joins
    from rosterkit.operators.headers import detect_headers

    body = spark.range(1, 20001).select(
        F.lit("CO1").alias("company_code"), F.lit("/in/hot.csv").alias("file_path"), F.lit("").alias("sheet"),
        F.col("id").alias("row_idx"),
        F.array(F.concat(F.lit("Ada "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")), F.lit("F"), F.lit(""), F.col("id").cast("string")).alias("cells"),
    )
    sheet = raw(spark, HEADER, path="/in/hot.csv", sheet="").unionByName(body).unionByName(raw(spark, HEADER, ROW_1))
    matches = detect_headers(sheet, alias)
    broadcast = extract.extract_roster(sheet, matches).count()
    limit, joins.join_small.__defaults__ = joins.join_small.__defaults__, ("inner", None, 0)
    try:
        salted = extract.extract_roster(sheet, matches).count()
    finally:
        joins.join_small.__defaults__ = limit
    assert broadcast == salted == 20001
