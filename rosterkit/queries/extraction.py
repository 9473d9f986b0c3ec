"""Queries of roster extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterkit.operators import extract, headers
from rosterkit.queries import sql, views
from rosterkit.schema import TABLE_KEY
from rosterkit.session import stage


def _roster(*families):
    def query(spark, sf_dir):
        raw = stage(views.raw_sheets(spark, sf_dir, list(families) or None), "raw")
        return extract.extract_roster(raw, headers.detect_headers(raw, views.aliases(spark)))

    return query


def _tables(spark, sf_dir, *families):
    raw = stage(views.raw_sheets(spark, sf_dir, list(families) or None), "raw")
    return raw, extract.plan_tables(raw, headers.detect_headers(raw, views.aliases(spark)))


def drop_missing_name(spark, sf_dir):
    """Rows read and rows without a usable name, per table."""
    people = extract.extract_people(*_tables(spark, sf_dir, "std", "digits", "numname"))
    return people.groupBy("CMPY_NO", "FILE_PATH", "SHEET").agg(
        F.count("*").alias("n_people"), F.count_if(~extract.has_name()).alias("n_missing")
    )


def dedup_rows(spark, sf_dir):
    """Exact distinct over person rows that repeat often: one row per order, keyed by its customer's name."""
    orders = views.table(spark, sf_dir, "orders")
    people = orders.select(
        F.lit("").alias("SURNAME"), F.lit("").alias("FIRST_NAME"),
        F.concat(F.lit("PERSON "), F.translate((F.col("o_custkey") % 97).cast("string"), "0123456789", "ABCDEFGHIJ")).alias("COMPLETE_NAME"),
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("M").alias("SEX"), F.lit("").alias("DATE_OF_BIRTH"),
        F.concat(F.lit("CO"), (F.col("o_custkey") % 3).cast("string")).alias("CMPY_NO"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("P1")).alias("POLICY_NUMBER"),
        F.lit("/in/orders.csv").alias("FILE_PATH"), F.col("o_orderpriority").alias("SHEET"),
    )
    return extract.to_roster(people)


def extract_paths(spark, sf_dir):
    """How each table is read."""
    _, tables = _tables(spark, sf_dir)
    return tables.select(*TABLE_KEY, "sheet_label", "path")


QUERIES = {
    "extract_roster": _roster(),
    "extract_standard": _roster("std"),
    "explode_names": _roster("multi"),
    "explode_pairs": _roster("pair"),
    "digit_name_rows": _roster("digits"),
    "extract_by_content": _roster("bare"),
    "multi_table": _roster("two"),
    "extract_fuzzy": _roster("typo"),
    "extract_paths": extract_paths,
    "drop_missing_name": drop_missing_name,
    "dedup_rows": dedup_rows,
}

ORACLES = {
    "extract_roster": sql.roster(),
    "extract_standard": sql.roster("std"),
    "explode_names": sql.roster("multi"),
    "explode_pairs": sql.roster("pair"),
    "digit_name_rows": sql.roster("digits"),
    "extract_by_content": sql.roster("bare"),
    "multi_table": sql.roster("two"),
    "extract_fuzzy": sql.roster("typo"),
    "extract_paths": f"""WITH {sql.PERSONS}, f AS (SELECT DISTINCT company_code, file_no FROM persons),
        m(fam, col_start, sheet_label, path) AS (VALUES ('std', 0, 'S1', 'standard'), ('multi', 0, 'S1', 'names'),
          ('pair', 0, 'S1', 'pairs'), ('digits', 0, 'S1', 'standard'), ('bare', 0, 'S1', 'standard'),
          ('two', 0, 'S1_table1', 'standard'), ('two', 3, 'S1_table2', 'standard'), ('typo', 0, 'S1', 'standard'),
          ('numname', 0, 'S1', 'standard'))
        SELECT company_code, '/in/' || fam || '_' || CAST(file_no AS VARCHAR) || '.csv' AS file_path, 'S1' AS sheet,
          col_start, sheet_label, path FROM f CROSS JOIN m""",
    "drop_missing_name": f"""WITH {sql.PERSONS}, m(fam) AS (VALUES ('std'), ('digits'), ('numname'))
        SELECT company_code AS "CMPY_NO", '/in/' || fam || '_' || CAST(file_no AS VARCHAR) || '.csv' AS "FILE_PATH", 'S1' AS "SHEET",
          count(*) AS n_people, count_if(fam = 'numname' OR (fam = 'std' AND k % 11 = 0)) AS n_missing
        FROM persons CROSS JOIN m GROUP BY ALL""",
    "dedup_rows": """SELECT DISTINCT '' AS "SURNAME", '' AS "FIRST_NAME",
        'PERSON ' || translate(CAST(o_custkey % 97 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS "COMPLETE_NAME",
        CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'M' END AS "SEX", '' AS "DATE_OF_BIRTH",
        'CO' || CAST(o_custkey % 3 AS VARCHAR) AS "CMPY_NO", CASE WHEN o_custkey % 2 = 0 THEN 'P1' END AS "POLICY_NUMBER",
        '/in/orders.csv' AS "FILE_PATH", o_orderpriority AS "SHEET" FROM orders""",
}

ORACLES["drop_missing_name"] = sql.typed(ORACLES["drop_missing_name"], n_missing="BIGINT")
