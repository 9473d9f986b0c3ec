"""Extraction: bind every data row to its table's mapping and turn it into clean person rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterkit.functions import clean_name, complete_name, full_name, is_bare_number, normalize_sex, parse_date
from rosterkit.operators.joins import join_small
from rosterkit.schema import (
    HEADER_SEARCH_ROWS, NUMERIC_COLUMN_SHARE, NUMERIC_SAMPLE_ROWS, ROSTER_COLUMNS, SHEET_KEY, TABLE_KEY,
)
from rosterkit.session import stage

# What the several-people paths write where a value cannot be tied to one person.
UNKNOWN_SEX = "U"
UNKNOWN_DATE = ""


def _null() -> Column:
    return F.lit(None).cast("string")


def _cell_at(index: Column) -> Column:
    """Cell at a column position; an empty text cell is null, a missing position too."""
    return F.nullif(F.get(F.col("cells"), index), F.lit(""))


def _first(columns: Column) -> Column:
    return F.get(columns, 0)


def data_rows(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows below the header of each table (all rows when there is none)."""
    return join_small(raw, tables, SHEET_KEY, salt_by=["row_idx"]).filter(F.col("row_idx") > F.col("header_row_idx"))


def numeric_columns(raw: DataFrame, matches: DataFrame) -> DataFrame:
    """Name columns that hold bare numbers in most of the first data rows: one row per table and column.

    Only rows near the top can be in the sample, so the scan is cut by ``row_idx`` before the join.
    """
    top = raw.filter(F.col("row_idx") < HEADER_SEARCH_ROWS + NUMERIC_SAMPLE_ROWS)
    names = matches.select(
        *TABLE_KEY, "header_row_idx", F.array_distinct(F.concat("name", "firstlastname")).alias("_columns")
    )
    return (
        top.join(names, SHEET_KEY)
        .filter(F.col("row_idx") > F.col("header_row_idx"))
        .filter(F.col("row_idx") <= F.col("header_row_idx") + NUMERIC_SAMPLE_ROWS)
        .select(*TABLE_KEY, "cells", F.explode("_columns").alias("col_idx"))
        .withColumn("value", _cell_at(F.col("col_idx")))
        .filter(F.col("value").isNotNull())
        .groupBy(*TABLE_KEY, "col_idx")
        .agg(F.avg(F.when(is_bare_number(F.col("value")), 1.0).otherwise(0.0)).alias("number_share"))
        .filter(F.col("number_share") >= NUMERIC_COLUMN_SHARE)
    )


def without_numeric_columns(raw: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches whose name lists no longer hold numeric columns; decided once per table."""
    dropped = numeric_columns(raw, matches).groupBy(*TABLE_KEY).agg(F.collect_set("col_idx").alias("_numeric"))
    none = F.array().cast("array<int>")
    return (
        matches.join(dropped, TABLE_KEY, "left")
        .withColumn("_numeric", F.coalesce("_numeric", none))
        .withColumn("name_columns", F.array_except("name", "_numeric"))
        .withColumn("pair_columns", F.array_except("firstlastname", "_numeric"))
        .drop("_numeric")
    )


def table_labels(matches: DataFrame) -> DataFrame:
    """Number the matched tables of each sheet and label them when there is more than one."""
    sheet = Window.partitionBy(*SHEET_KEY)
    return (
        matches.withColumn("table_no", F.row_number().over(sheet.orderBy("col_start")))
        .withColumn("n_tables", F.count("*").over(sheet))
        .withColumn(
            "sheet_label",
            F.when(F.col("n_tables") > 1, F.format_string("%s_table%d", F.col("sheet"), F.col("table_no")))
            .otherwise(F.col("sheet")),
        )
    )


def cleaned_names() -> Column:
    """Non-empty cleaned full names of a row, one per name column."""
    return F.filter(
        F.transform(F.col("name_columns"), lambda i: clean_name(_cell_at(i))), lambda n: n != ""
    )


def cleaned_pairs() -> Column:
    """Surname and first name of every two neighbouring pair columns; an odd last column is ignored.

    A pair counts when at least one part is non-empty (a null part alone decides nothing).
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("pair_columns") - 2, F.lit(0)), F.lit(2))
    pairs = F.transform(
        starts,
        lambda i: F.struct(
            clean_name(_cell_at(F.get(F.col("pair_columns"), i))).alias("surname"),
            clean_name(_cell_at(F.get(F.col("pair_columns"), i + 1))).alias("first_name"),
        ),
    )
    return F.when(
        F.size("pair_columns") >= 2,
        F.filter(pairs, lambda p: (p["surname"] != "") | (p["first_name"] != "")),
    )


def plan_tables(raw: DataFrame, matches: DataFrame) -> DataFrame:
    """Decide how each table is read: ``names``, ``pairs`` or ``standard``.

    ``names`` needs at least two name columns and some row with two names; otherwise ``pairs`` needs more than two
    pair columns and some row with a pair. Only tables that could take these paths are scanned for it, as one
    aggregation that combines map-side, so a table of any size is fine. The result is staged: it is one row per
    table and every later step joins it.
    """
    several = (F.size("name") >= 2) | (F.size("firstlastname") > 2)
    labelled = table_labels(without_numeric_columns(raw, matches))
    if matches.filter(several).isEmpty():
        return stage(labelled.withColumn("path", F.lit("standard")), "planned")
    tables = stage(labelled, "tables")
    candidates = tables.filter((F.size("name_columns") >= 2) | (F.size("pair_columns") > 2)).select(
        *TABLE_KEY, "header_row_idx", "name_columns", "pair_columns"
    )
    seen = (
        data_rows(raw, candidates)
        .groupBy(*TABLE_KEY)
        .agg(
            F.max((F.size("name_columns") >= 2) & (F.size(cleaned_names()) > 1)).alias("_names"),
            F.max((F.size("pair_columns") > 2) & (F.size(cleaned_pairs()) > 0)).alias("_pairs"),
        )
    )
    path = F.when(F.col("_names"), "names").when(F.col("_pairs"), "pairs").otherwise("standard")
    planned = tables.join(seen, TABLE_KEY, "left").withColumn("path", path).drop("_names", "_pairs")
    return stage(planned, "planned")


def _person(surname: Column, first_name: Column, complete: Column, sex: Column, dob: Column) -> Column:
    return F.struct(
        surname.alias("SURNAME"), first_name.alias("FIRST_NAME"), complete.alias("COMPLETE_NAME"),
        sex.alias("SEX"), dob.alias("DATE_OF_BIRTH"),
    )


def standard_person() -> Column:
    """One person per row: first name column, first two pair columns, first sex and date column."""
    raw_name = _cell_at(_first(F.col("name_columns")))
    part = lambda i: F.when(F.size("pair_columns") > i, clean_name(_cell_at(F.get(F.col("pair_columns"), i)))).otherwise("")
    surname, first_name = part(0), part(1)
    cleaned = F.when(F.size("name_columns") > 0, clean_name(raw_name)).otherwise("")
    return _person(
        surname, first_name, complete_name(cleaned, surname, first_name, raw_name),
        normalize_sex(_cell_at(_first(F.col("sex")))), parse_date(_cell_at(_first(F.col("dob")))),
    )


def named_people(keep_single_names: bool = False) -> Column:
    """One person per full name of a row; a row with fewer than two names gives nobody by default."""
    people = F.transform(
        cleaned_names(),
        lambda n: _person(_null(), _null(), n, F.lit(UNKNOWN_SEX), F.lit(UNKNOWN_DATE)),
    )
    return people if keep_single_names else F.when(F.size(people) > 1, people)


def paired_people() -> Column:
    """One person per surname and first-name pair of a row."""
    return F.transform(
        cleaned_pairs(),
        lambda p: _person(
            p["surname"], p["first_name"], full_name(p["surname"], p["first_name"]),
            F.lit(UNKNOWN_SEX), F.lit(UNKNOWN_DATE),
        ),
    )


def extract_people(raw: DataFrame, tables: DataFrame, keep_single_names: bool = False) -> DataFrame:
    """Person rows of every table, before rows without a name are dropped.

    One scan: each row is bound to its table's mapping and explodes into the people its path finds. The columns are
    the roster's plus ``col_start``; company, path, sheet label and ``col_start`` identify the table.
    """
    nobody = F.array().cast("array<struct<SURNAME:string,FIRST_NAME:string,COMPLETE_NAME:string,SEX:string,DATE_OF_BIRTH:string>>")
    people = F.coalesce(
        F.when(F.col("path") == "names", named_people(keep_single_names))
        .when(F.col("path") == "pairs", paired_people())
        .otherwise(F.array(standard_person())),
        nobody,
    )
    mapping = tables.select(
        *TABLE_KEY, "header_row_idx", "name_columns", "pair_columns", "sex", "dob", "policynum", "sheet_label", "path"
    )
    return data_rows(raw, mapping).select(
        "col_start",
        F.explode(people).alias("_person"),
        F.col("company_code").alias("CMPY_NO"),
        _cell_at(_first(F.col("policynum"))).alias("POLICY_NUMBER"),
        F.col("file_path").alias("FILE_PATH"),
        F.col("sheet_label").alias("SHEET"),
    ).select("*", "_person.*").drop("_person")


def has_name() -> Column:
    return F.col("COMPLETE_NAME").isNotNull() & (F.col("COMPLETE_NAME") != "")


def to_roster(people: DataFrame) -> DataFrame:
    """Rows with a usable name, nine columns, exact duplicates removed.

    The distinct aggregates map-side first, so many copies of one row shrink before the shuffle.
    """
    return people.filter(has_name()).select(*ROSTER_COLUMNS).dropDuplicates()


def distinct_people(people: DataFrame) -> DataFrame:
    """Distinct person rows with their number of copies, rows without a name included.

    One grouping, combined map-side, gives both the roster and the counts of the run log.
    """
    return people.groupBy(*ROSTER_COLUMNS).agg(F.count("*").alias("copies"))


def extract_roster(raw: DataFrame, matches: DataFrame, keep_single_names: bool = False) -> DataFrame:
    """Roster of all tables of all sheets."""
    return to_roster(extract_people(raw, plan_tables(raw, matches), keep_single_names))
