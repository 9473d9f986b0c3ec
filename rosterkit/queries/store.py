"""Queries of the report store: runs of orders deliver the parts of their lines, and reports follow them run by run."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterkit.operators import compile as comp, runlog
from rosterkit.plans import delivery, reports
from rosterkit.queries import render, views
from rosterkit.schema import FILE_LOGS, OUTPUT_INDEX, ROSTER_COLUMNS, RUNS
from rosterkit.session import stage
from rosterkit.sources import sinks

ROWS_PER_FILE = 400
ROWS_PER_PART = 300


def _delivered(spark, sf_dir):
    """Roster rows of every run: six companies and dates with four runs each, two files a run."""
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    order = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = views.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").join(part, "l_partkey").join(order, "l_orderkey")
    key, turn = F.col("o_custkey") % 6, F.floor(F.col("l_orderkey") / 3) % 4
    company = F.concat(F.lit("C/"), (key % 3).cast("string"))
    return lines.select(
        F.lit("").alias("SURNAME"), F.lit("").alias("FIRST_NAME"), F.upper("p_name").alias("COMPLETE_NAME"),
        F.when(F.col("l_partkey") % 2 == 0, "M").otherwise("F").alias("SEX"), F.lit("").alias("DATE_OF_BIRTH"), company.alias("CMPY_NO"),
        F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("0"), (F.col("l_partkey") % 40).cast("string"))).alias("POLICY_NUMBER"),
        F.concat(F.lit("/in/f "), (F.col("l_suppkey") % 2).cast("string"), F.lit(".csv")).alias("FILE_PATH"), F.lit("2601").alias("SHEET"),
        company.alias("company_code"), F.when(key < 3, "2024-01-31").otherwise("2024-02-29").alias("email_received_date"),
        (key * 10 + turn).cast("long").alias("run_id"), turn.alias("turn"),
    )


def _deliver(spark, store, rows):
    """Write the rows of some runs, their index, logs and outcome."""
    index = sinks.write_rosters(rows, f"{store}/rosters", ROWS_PER_FILE)
    sinks.write_output_index(index, f"{store}/output_index")
    logs = index.select("run_id", "file_path", F.col("sheet").alias("sheet_name"), "part_number", F.col("row_count").alias("output_row_count"))
    logs = delivery.numbered_logs(delivery.as_file_logs(delivery.with_output_paths(logs, index)))
    sinks.overwrite_partitions(logs, f"{store}/file_logs", "run_id")
    runs = index.select(*sinks.RUN_KEY).distinct().withColumn("status", F.lit("completed"))
    fields = [(F.col(f.name) if f.name in runs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RUNS.fields]
    sinks.overwrite_partitions(runs.select(*fields), f"{store}/runs", *sinks.RUN_KEY)
    return index.select(*comp.REPORT_KEY).distinct()


def _store(spark, sf_dir):
    """A store whose reports were compiled after two runs of every key and again after two more."""
    store = render.folder(spark, "reports")
    rows = stage(_delivered(spark, sf_dir), "delivered")
    for turns in ((0, 1), (2, 3)):
        keys = _deliver(spark, store, rows.filter(F.col("turn").isin(*turns)).drop("turn"))
        reports.compile_reports(spark, store, keys, ROWS_PER_PART)
    return store


def incremental_reports(spark, sf_dir):
    """Rows and parts of reports that grew by their new rows twice."""
    return reports.read_reports(spark, _store(spark, sf_dir))


def output_index(spark, sf_dir):
    """Every part that the logs name, in the order of the logs, with the rows found in its folder."""
    store = render.folder(spark, "reports")
    _deliver(spark, store, _delivered(spark, sf_dir).drop("turn"))
    logs = runlog.logs_in_order(sinks.read_table(spark, f"{store}/file_logs", FILE_LOGS))
    found = sinks.reread_rosters(spark, f"{store}/rosters").groupBy("output_path").agg(F.count("*").alias("found_rows"))
    return logs.join(found, "output_path").select("run_id", "log_id", "file_path", "sheet_name", "output_row_count", "found_rows")


def _shrunken(spark, sf_dir):
    """All outputs of one company and the last outputs of another are lost."""
    store = _store(spark, sf_dir)
    index = sinks.read_table(spark, f"{store}/output_index", OUTPUT_INDEX)
    lost = index.filter("company_code = 'C/0' OR (company_code = 'C/1' AND run_id % 10 = 3)").select("output_path")
    sinks.remove_files(sinks.stored_outputs(spark, f"{store}/rosters").join(lost, "output_path", "left_semi"))
    keys = stage(index.select(*comp.REPORT_KEY).distinct(), "keys")
    reports.refresh_index(spark, store, keys)
    reports.compile_reports(spark, store, keys, ROWS_PER_PART)
    return store


def shrunken_reports(spark, sf_dir):
    """Totals of all reports after outputs were lost; one without rows has no parts."""
    manifests = reports.latest_manifests(spark, _shrunken(spark, sf_dir))
    sizes = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["part_number"].cast("string"), p["row_count"].cast("string"))), ",")
    return manifests.select(*comp.REPORT_KEY, "total_rows", "part_count", "source_run_count", "skipped_files", sizes.alias("parts"))


def store_diagnosis(spark, sf_dir):
    """Every log of the store with whether its output is there, from the index; no roster rows are read."""
    store = _shrunken(spark, sf_dir)
    found = comp.compile_diagnosis(
        sinks.read_table(spark, f"{store}/runs", RUNS), sinks.read_table(spark, f"{store}/file_logs", FILE_LOGS),
        sinks.read_table(spark, f"{store}/output_index", OUTPUT_INDEX))
    return found.select("run_id", "log_id", *comp.REPORT_KEY, "sheet_name", "output_row_count", "eligible", "exists")


QUERIES = {q.__name__: q for q in (incremental_reports, output_index, shrunken_reports, store_diagnosis)}

_KEY = "(o_custkey % 6)"
_ROWS = f"""delivered AS (SELECT '' AS "SURNAME", '' AS "FIRST_NAME", upper(p_name) AS "COMPLETE_NAME", CASE WHEN l_partkey % 2 = 0 THEN 'M' ELSE 'F' END AS "SEX",
  '' AS "DATE_OF_BIRTH", 'C/' || CAST({_KEY} % 3 AS VARCHAR) AS "CMPY_NO", CASE WHEN l_partkey % 9 <> 0 THEN '0' || CAST(l_partkey % 40 AS VARCHAR) END AS "POLICY_NUMBER",
  '/in/f ' || CAST(l_suppkey % 2 AS VARCHAR) || '.csv' AS "FILE_PATH", '2601' AS "SHEET", 'C/' || CAST({_KEY} % 3 AS VARCHAR) AS company_code,
  CASE WHEN {_KEY} < 3 THEN '2024-01-31' ELSE '2024-02-29' END AS email_received_date, {_KEY} * 10 + (l_orderkey // 3) % 4 AS run_id, (l_orderkey // 3) % 4 AS turn
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R')"""
_COLS = ", ".join(f'"{c}"' for c in ROSTER_COLUMNS)
_ORDER = ", ".join(f'"{c}" NULLS FIRST' for c in ROSTER_COLUMNS)
_CUT = f"""sizes AS (SELECT run_id, company_code, email_received_date, "FILE_PATH" AS file_path, count(*) AS n FROM delivered GROUP BY ALL),
  cut AS (SELECT *, unnest(range(1, (n + {ROWS_PER_FILE - 1}) // {ROWS_PER_FILE} + 1)) AS part FROM sizes),
  logs AS (SELECT run_id, company_code, email_received_date, file_path, row_number() OVER (PARTITION BY run_id ORDER BY file_path, part) AS log_id,
    least({ROWS_PER_FILE}, n - (part - 1) * {ROWS_PER_FILE}) AS output_row_count FROM cut)"""
_LOST = "(company_code = 'C/0' OR (company_code = 'C/1' AND run_id % 10 = 3))"

ORACLES = {
    "incremental_reports": f"""WITH {_ROWS}, d AS (SELECT company_code, email_received_date, {_COLS}, min(turn // 2) AS age FROM delivered GROUP BY ALL)
        SELECT company_code, email_received_date, {_COLS},
          (row_number() OVER (PARTITION BY company_code, email_received_date ORDER BY age, {_ORDER}) - 1) // {ROWS_PER_PART} + 1 AS part_number FROM d""",
    "output_index": f"""WITH {_ROWS}, {_CUT} SELECT run_id, log_id, file_path, '2601' AS sheet_name, CAST(output_row_count AS BIGINT) AS output_row_count,
        CAST(output_row_count AS BIGINT) AS found_rows FROM logs""",
    "shrunken_reports": f"""WITH {_ROWS}, {_CUT}, k AS (SELECT company_code, email_received_date, count(DISTINCT run_id) AS source_run_count FROM delivered GROUP BY ALL),
        t AS (SELECT company_code, email_received_date, count(*) AS total FROM (SELECT DISTINCT company_code, email_received_date, {_COLS} FROM delivered WHERE NOT {_LOST}) GROUP BY ALL),
        s AS (SELECT company_code, email_received_date, count(*) AS skipped FROM logs WHERE {_LOST} GROUP BY ALL)
        SELECT company_code, email_received_date, coalesce(total, 0) AS total_rows, (coalesce(total, 0) + {ROWS_PER_PART - 1}) // {ROWS_PER_PART} AS part_count, source_run_count,
          coalesce(skipped, 0) AS skipped_files, array_to_string(list_transform(range(1, (coalesce(total, 0) + {ROWS_PER_PART - 1}) // {ROWS_PER_PART} + 1),
            lambda i: i::VARCHAR || ':' || least({ROWS_PER_PART}, total - (i - 1) * {ROWS_PER_PART})::VARCHAR), ',') AS parts
        FROM k LEFT JOIN t USING (company_code, email_received_date) LEFT JOIN s USING (company_code, email_received_date)""",
    "store_diagnosis": f"""WITH {_ROWS}, {_CUT} SELECT run_id, log_id, company_code, email_received_date, '2601' AS sheet_name, CAST(output_row_count AS BIGINT) AS output_row_count,
        true AS eligible, NOT {_LOST} AS "exists" FROM logs""",
}
