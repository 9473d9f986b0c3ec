"""Queries of compilation, the run log, requests and the header report."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterkit.operators import compile as comp
from rosterkit.operators import extract, headers, profile, requests as req, runlog
from rosterkit.operators.numbering import number_parts
from rosterkit.queries import render, sql, views
from rosterkit.schema import ROSTER_COLUMNS
from rosterkit.session import stage
from rosterkit.sources import sinks

ROWS_PER_PART = 20


def _eligible(spark, sf_dir):
    return comp.eligible_outputs(views.file_logs(spark, sf_dir), views.runs(spark, sf_dir))


def compile_eligible(spark, sf_dir):
    return _eligible(spark, sf_dir).select("log_id", "run_id", *comp.REPORT_KEY, "output_path")


def source_run_count(spark, sf_dir):
    return comp.source_run_count(views.runs(spark, sf_dir))


def _outputs(spark, sf_dir):
    return views.stored_rosters(spark, sf_dir).select("output_path").distinct()


def skipped_outputs(spark, sf_dir):
    return comp.skipped_outputs(_eligible(spark, sf_dir), _outputs(spark, sf_dir))


def _rows(spark, sf_dir):
    return comp.compile_rows(views.stored_rosters(spark, sf_dir), _eligible(spark, sf_dir))


def compile_roster(spark, sf_dir):
    return _rows(spark, sf_dir)


def _parts(spark, sf_dir):
    return comp.compile_parts(_rows(spark, sf_dir), ROWS_PER_PART)


def compile_parts(spark, sf_dir):
    return _parts(spark, sf_dir)


def part_summary(spark, sf_dir):
    return comp.part_summary(_parts(spark, sf_dir), views.runs(spark, sf_dir))


def report_summary(spark, sf_dir):
    runs = views.runs(spark, sf_dir)
    return comp.report_summary(comp.part_summary(_parts(spark, sf_dir), runs), runs, skipped_outputs(spark, sf_dir))


def _tracked(spark, sf_dir):
    """Tracking rows of earlier, larger compilations: five parts per key."""
    return (
        views.runs(spark, sf_dir).groupBy(*comp.REPORT_KEY).agg(F.count("*").alias("source_run_count"), F.max("started_at").alias("last_updated_at"))
        .withColumn("part_number", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
        .withColumn("row_count", F.lit(ROWS_PER_PART).cast("long"))
        .withColumn("output_path", F.format_string("/out/%s_%s_%d", "company_code", "email_received_date", "part_number"))
    )


def stale_parts(spark, sf_dir):
    eligible = stage(_eligible(spark, sf_dir), "eligible")
    rosters = views.stored_rosters(spark, sf_dir)
    rows = comp.compile_rows(rosters, eligible)
    summary = comp.part_summary(comp.compile_parts(rows, ROWS_PER_PART), views.runs(spark, sf_dir))
    read = eligible.join(rosters.select("output_path").distinct(), "output_path", "left_semi")
    return comp.stale_parts(_tracked(spark, sf_dir), comp.rebuilt_reports(read, summary)).select(*comp.PART_KEY, "output_path")


def upsert_compiled(spark, sf_dir):
    """Every run writes tracking rows of its key; the newest of each part stays."""
    fresh = views.runs(spark, sf_dir).select(
        *comp.REPORT_KEY, (F.col("run_id") % 3 + 1).alias("part_number"),
        F.format_string("/out/run_%d", "run_id").alias("output_path"),
        (F.col("run_id") * 7).alias("row_count"), F.lit(1).cast("long").alias("source_run_count"),
        F.concat("started_at", F.lit("#"), F.lpad(F.col("run_id").cast("string"), 10, "0")).alias("last_updated_at"),
    )
    return comp.upsert_compiled(_tracked(spark, sf_dir).select(*fresh.columns), fresh)


def compile_diagnosis(spark, sf_dir):
    return comp.compile_diagnosis(
        views.runs(spark, sf_dir), views.file_logs(spark, sf_dir), _outputs(spark, sf_dir)
    ).orderBy("started_at", "run_id", "log_id")


def parted_output(spark, sf_dir):
    """Output parts per file and sheet over all stored roster rows."""
    rosters = views.stored_rosters(spark, sf_dir)
    order = [c for c in ROSTER_COLUMNS if c not in ("FILE_PATH", "SHEET")] + ["output_path"]
    parts = number_parts(rosters, ["FILE_PATH", "SHEET"], order, 500)
    return parts.groupBy("FILE_PATH", "SHEET", "part_number").agg(
        F.count("*").alias("n_rows"), F.min("CMPY_NO").alias("first_company"), F.max("CMPY_NO").alias("last_company")
    )


def run_outcome(spark, sf_dir):
    stopped = views.runs(spark, sf_dir).filter(F.col("triggered_user") == "5-LOW")
    return runlog.run_outcome(views.file_logs(spark, sf_dir), stopped)


def recent_runs(spark, sf_dir):
    return runlog.recent_runs(views.runs(spark, sf_dir))


def run_log_export(spark, sf_dir):
    return runlog.run_log_records(views.file_logs(spark, sf_dir), views.runs(spark, sf_dir))


def file_log(spark, sf_dir):
    """File logs of all rendered sheets, with output parts of 60 rows."""
    raw = stage(views.raw_sheets(spark, sf_dir), "raw")
    tables = extract.plan_tables(raw, headers.detect_headers(raw, views.aliases(spark)))
    people = stage(extract.distinct_people(extract.extract_people(raw, tables)), "people")
    return runlog.file_log(raw, tables, people, rows_per_part=60).drop("part_number")


def header_report(spark, sf_dir):
    return profile.header_report(views.raw_sheets(spark, sf_dir))


def report_sink(spark, sf_dir):
    """The header report as written: every row with its place in the files."""
    path = render.folder(spark, "header-report")
    sinks.write_sorted(profile.header_report(views.raw_sheets(spark, sf_dir)), path, profile.REPORT_ORDER)
    return sinks.read_sorted(spark, path).select("position", "header", "file_path", "sheet_name", "table", "column_index")


def validate_requests(spark, sf_dir):
    checked = req.validate_requests(views.requests(spark, sf_dir))
    return checked.select("request_id", F.array_join("problems", "; ").alias("problems"))


def admit_runs(spark, sf_dir):
    valid = req.validate_requests(views.requests(spark, sf_dir)).filter(F.size("problems") == 0)
    busy = views.runs(spark, sf_dir).withColumn("email_received_date", F.regexp_replace("email_received_date", r"^\d{4}-\d{2}", "2024-01"))
    return req.admit(valid, busy).select("request_id", *comp.REPORT_KEY, "admitted")


def request_files(spark, sf_dir):
    catalog = views.file_logs(spark, sf_dir).filter("output_path is not null").select("file_name")
    return req.requested_files(views.requests(spark, sf_dir), catalog)


QUERIES = {
    q.__name__: q
    for q in (
        compile_eligible, source_run_count, skipped_outputs, compile_roster, compile_parts, part_summary, report_summary,
        stale_parts, upsert_compiled, compile_diagnosis, parted_output, run_outcome, recent_runs, run_log_export,
        file_log, header_report, report_sink, validate_requests, admit_runs, request_files,
    )
}

_RUNS = """runs AS (SELECT o_orderkey AS run_id, 'C' || CAST(o_custkey % 10 AS VARCHAR) AS company_code,
  strftime(o_orderdate, '%Y-%m-01') AS email_received_date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  o_orderpriority AS triggered_user FROM orders)"""
_OUT = "'/out/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR)"
_LOGS = f"""file_logs AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS log_id, l_orderkey AS run_id,
  'f_' || CAST(l_suppkey AS VARCHAR) || '.csv' AS file_name, '/in/f_' || CAST(l_suppkey AS VARCHAR) || '.csv' AS file_path,
  'S' || CAST(l_linenumber AS VARCHAR) AS sheet_name, CASE WHEN l_returnflag <> 'R' THEN {_OUT} END AS output_path,
  CASE WHEN l_returnflag = 'R' THEN 'ValueError: unreadable' END AS error_msg,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) END AS output_row_count FROM lineitem)"""
_STORED = f"""stored AS (SELECT {_OUT} AS output_path, '' AS "SURNAME", '' AS "FIRST_NAME", upper(p_name) AS "COMPLETE_NAME",
  CASE WHEN l_partkey % 2 = 0 THEN 'M' ELSE 'F' END AS "SEX", '' AS "DATE_OF_BIRTH", 'C' || CAST(o_custkey % 10 AS VARCHAR) AS "CMPY_NO",
  CASE WHEN l_partkey % 9 <> 0 THEN '0' || CAST(l_partkey % 40 AS VARCHAR) END AS "POLICY_NUMBER",
  '/in/f_' || CAST(l_suppkey % 5 AS VARCHAR) || '.csv' AS "FILE_PATH", '260' || CAST(l_linenumber % 2 AS VARCHAR) AS "SHEET"
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND l_suppkey % 37 <> 0)"""
_ELIGIBLE = f"""{_RUNS}, {_LOGS}, eligible AS (SELECT log_id, run_id, company_code, email_received_date, output_path
  FROM file_logs JOIN runs USING (run_id) WHERE status <> 'running' AND output_path IS NOT NULL)"""
_COLS = ", ".join(f'"{c}"' for c in ROSTER_COLUMNS)
_ORDER = ", ".join(f'"{c}" NULLS FIRST' for c in ROSTER_COLUMNS)
_COMPILED = f"""{_ELIGIBLE}, {_STORED},
  rows_ AS (SELECT DISTINCT company_code, email_received_date, {_COLS} FROM stored JOIN
    (SELECT DISTINCT output_path, company_code, email_received_date FROM eligible) USING (output_path)),
  parts AS (SELECT *, (row_number() OVER (PARTITION BY company_code, email_received_date ORDER BY {_ORDER}) - 1) // {ROWS_PER_PART} + 1 AS part_number FROM rows_),
  source AS (SELECT company_code, email_received_date, count(*) AS source_run_count FROM runs WHERE status <> 'running' GROUP BY ALL),
  summary AS (SELECT company_code, email_received_date, part_number, count(*) AS row_count, any_value(source_run_count) AS source_run_count
    FROM parts LEFT JOIN source USING (company_code, email_received_date) GROUP BY ALL),
  skipped AS (SELECT DISTINCT company_code, email_received_date, output_path FROM eligible WHERE output_path NOT IN (SELECT output_path FROM stored))"""
_TRACKED = f"""tracked AS (SELECT company_code, email_received_date, CAST(part_number AS BIGINT) AS part_number,
  '/out/' || company_code || '_' || email_received_date || '_' || CAST(part_number AS VARCHAR) AS output_path,
  CAST({ROWS_PER_PART} AS BIGINT) AS row_count, source_run_count, last_updated_at FROM
  (SELECT company_code, email_received_date, count(*) AS source_run_count, max(started_at) AS last_updated_at FROM runs GROUP BY ALL)
  CROSS JOIN (SELECT unnest(range(1, 6)) AS part_number))"""
_REQUESTS = """requests AS (SELECT event_id AS request_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS arrival,
  CASE WHEN event_type <> 'error' THEN 'C' || CAST(user_id % 10 AS VARCHAR) END AS company_code,
  CASE WHEN user_id % 7 = 0 THEN strftime(ts, '%m/%d/%Y') ELSE strftime(ts, '%Y-%m-%d') END AS email_received_date,
  event_type = 'error' AS no_company, event_id % 17 = 0 AS no_files, event_id % 17 <> 0 AND event_id % 13 = 0 AS bad_files,
  event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 11 = 0 AS empty_files, user_id % 7 = 0 AS bad_date, event_id, user_id FROM events)"""
_FILES_OK = "NOT no_files AND NOT bad_files AND NOT empty_files"

ORACLES = {
    "compile_eligible": f"WITH {_ELIGIBLE} SELECT * FROM eligible",
    "source_run_count": f"WITH {_RUNS} SELECT company_code, email_received_date, count(*) AS source_run_count FROM runs WHERE status <> 'running' GROUP BY ALL",
    "skipped_outputs": f"WITH {_COMPILED} SELECT * FROM skipped",
    "compile_roster": f"WITH {_COMPILED} SELECT * FROM rows_",
    "compile_parts": f"WITH {_COMPILED} SELECT * FROM parts",
    "part_summary": f"WITH {_COMPILED} SELECT * FROM summary",
    "report_summary": f"""WITH {_COMPILED} SELECT company_code, email_received_date, source_run_count,
        CAST(coalesce(total_rows, 0) AS BIGINT) AS total_rows, coalesce(part_count, 0) AS part_count, coalesce(skipped_files, 0) AS skipped_files
        FROM source LEFT JOIN (SELECT company_code, email_received_date, sum(row_count) AS total_rows, max(part_number) AS part_count FROM summary GROUP BY ALL)
        USING (company_code, email_received_date) LEFT JOIN (SELECT company_code, email_received_date, count(*) AS skipped_files FROM skipped GROUP BY ALL)
        USING (company_code, email_received_date)""",
    "stale_parts": f"""WITH {_COMPILED}, {_TRACKED} SELECT company_code, email_received_date, part_number, output_path FROM tracked
        JOIN (SELECT company_code, email_received_date, max(part_number) AS n FROM parts GROUP BY ALL) USING (company_code, email_received_date) WHERE part_number > n""",
    "upsert_compiled": f"""WITH {_RUNS}, {_TRACKED}, u AS (SELECT company_code, email_received_date, part_number, output_path, row_count, source_run_count, last_updated_at FROM tracked
        UNION ALL SELECT company_code, email_received_date, run_id % 3 + 1, '/out/run_' || CAST(run_id AS VARCHAR), run_id * 7, 1,
          started_at || '#' || lpad(CAST(run_id AS VARCHAR), 10, '0') FROM runs)
        SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY company_code, email_received_date, part_number ORDER BY last_updated_at DESC) = 1""",
    "compile_diagnosis": f"""WITH {_RUNS}, {_LOGS}, {_STORED} SELECT run_id, log_id, file_name, sheet_name, output_path, output_row_count, error_msg,
        company_code, email_received_date, started_at, status, output_path IS NOT NULL AND status <> 'running' AS eligible,
        coalesce(output_path IN (SELECT output_path FROM stored), false) AS "exists" FROM runs LEFT JOIN file_logs USING (run_id)""",
    "parted_output": f"""WITH {_STORED}, n AS (SELECT *, (row_number() OVER (PARTITION BY "FILE_PATH", "SHEET" ORDER BY "SURNAME", "FIRST_NAME", "COMPLETE_NAME", "SEX",
        "DATE_OF_BIRTH", "CMPY_NO", "POLICY_NUMBER" NULLS FIRST, output_path) - 1) // 500 + 1 AS part_number FROM stored)
        SELECT "FILE_PATH", "SHEET", part_number, count(*) AS n_rows, min("CMPY_NO") AS first_company, max("CMPY_NO") AS last_company FROM n GROUP BY ALL""",
    "run_outcome": f"""WITH {_RUNS}, {_LOGS}, f AS (SELECT run_id, file_path, max(error_msg) IS NOT NULL AS failed FROM file_logs GROUP BY ALL),
        o AS (SELECT run_id, count_if(NOT failed) AS files_processed, count_if(failed) AS files_failed FROM f GROUP BY ALL)
        SELECT run_id, files_processed, files_failed, CASE WHEN triggered_user = '5-LOW' THEN 'stopped' WHEN files_failed = 0 THEN 'completed' ELSE 'failed' END AS status
        FROM o LEFT JOIN runs USING (run_id)""",
    "recent_runs": f"WITH {_RUNS} SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 200",
    "run_log_export": f"""WITH {_RUNS}, {_LOGS} SELECT run_id, 'Log_' || replace(any_value(email_received_date), '-', '') || '_' || any_value(company_code) || '_run' || CAST(run_id AS VARCHAR) AS output_path,
        'csv' AS format, count(log_id) AS logged_rows FROM runs LEFT JOIN file_logs USING (run_id) GROUP BY run_id""",
    "validate_requests": f"""WITH {_REQUESTS} SELECT request_id, array_to_string(list_filter([CASE WHEN no_company THEN 'missing required field: company_code' END,
        CASE WHEN no_files THEN 'missing required field: files' END, CASE WHEN bad_files THEN '''files'' must be a list' END,
        CASE WHEN empty_files THEN '''files'' is empty -- nothing to process' END,
        CASE WHEN bad_date THEN '''email_received_date'' must be YYYY-MM-DD' END], lambda x: x IS NOT NULL), '; ') AS problems FROM requests""",
    "admit_runs": f"""WITH {_REQUESTS}, {_RUNS}, v AS (SELECT * FROM requests WHERE NOT no_company AND {_FILES_OK} AND NOT bad_date),
        busy AS (SELECT DISTINCT company_code, regexp_replace(email_received_date, '^[0-9]{{4}}-[0-9]{{2}}', '2024-01') AS email_received_date
          FROM runs WHERE status = 'running')
        SELECT request_id, company_code, email_received_date, row_number() OVER (PARTITION BY company_code, email_received_date ORDER BY arrival, request_id) = 1
          AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.company_code = v.company_code AND b.email_received_date = v.email_received_date) AS admitted FROM v""",
    "request_files": f"""WITH {_REQUESTS}, {_LOGS}, w AS (SELECT request_id, unnest(['f_' || CAST(user_id % 40 AS VARCHAR) || '.csv', 'f_' || CAST(event_id % 50 AS VARCHAR) || '.csv']) AS file_name
          FROM requests WHERE {_FILES_OK})
        SELECT request_id, file_name, file_name IN (SELECT file_name FROM file_logs WHERE output_path IS NOT NULL) AS present FROM w""",
    "header_report": f"""WITH {sql.sheets()},{sql.CELLS},{sql.BLOCKS},
        n AS (SELECT company_code, file_path, sheet, col_start, row_idx, count(*) AS n_cells FROM bcells GROUP BY ALL),
        d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY company_code, file_path, sheet, col_start ORDER BY n_cells DESC, row_idx) = 1),
        h AS (SELECT b.company_code, b.file_path, b.sheet, b.col_start, b.table_idx, b.col_idx, b.row_idx, trim(b.value) AS header FROM bcells b
          JOIN d USING (company_code, file_path, sheet, col_start, row_idx)),
        s AS (SELECT h.company_code, h.file_path, h.sheet, h.col_idx, a.value FROM h JOIN all_cells a USING (company_code, file_path, sheet, col_idx)
          WHERE a.row_idx > h.row_idx AND a.row_idx <= h.row_idx + 200 AND NOT (a.value IS NULL OR trim(a.value) = '')),
        c AS (SELECT company_code, file_path, sheet, col_idx, {sql.SHARES} FROM s GROUP BY ALL)
        SELECT header, file_path, sheet AS sheet_name, 'Table ' || CAST(table_idx AS VARCHAR) AS "table", CAST(h.col_idx AS INTEGER) AS column_index, row_idx AS row_index,
          {sql.CATEGORY} AS category FROM h LEFT JOIN c USING (company_code, file_path, sheet, col_idx)""",
}


def _file_log_oracle() -> str:
    # Per layout and file: output rows, missing names, header texts, straight from the persons.
    tables = {
        "std": ("S1", 1, "count(*) FILTER (k % 11 <> 0)", "count(*) FILTER (k % 11 = 0)", "3",
                "CASE WHEN company_code = 'CO3' THEN 'Assured' ELSE 'Member Name' END || ', Gender, Born, Contract No'", "false", "NULL",
                "CASE WHEN company_code = 'CO3' THEN 'Assured' ELSE 'Member Name' END", "'Contract No'", "'Born'", "'Gender'"),
        "multi": ("S1", 1, "2 * count(*) FILTER (k % 3 <> 0)", "0", "1", "'Name, Name, Contract No'", "true", "NULL", "'Name, Name'", "'Contract No'", "NULL", "NULL"),
        "pair": ("S1", 1, "count(*) + count(*) FILTER (k % 4 <> 0)", "0", "1", "'FamilyName, GivenName, FamilyName, GivenName, Contract No'", "true",
                 "'FamilyName, GivenName, FamilyName, GivenName'", "NULL", "'Contract No'", "NULL", "NULL"),
        "digits": ("S1", 1, "count(*)", "0", "1", "'Name, FamilyName, GivenName, Contract No'", "false", "'FamilyName, GivenName'", "'Name'", "'Contract No'", "NULL", "NULL"),
        "bare": ("S1", 1, "count(*)", "0", "0", "''", "false", "NULL", "'column_1'", "'column_4'", "'column_3'", "'column_2'"),
        "two1": ("S1_table1", 1, "count(DISTINCT (p_name, policy))", "0", "1", "'Name, Contract No'", "false", "NULL", "'Name'", "'Contract No'", "NULL", "NULL"),
        "two2": ("S1_table2", 2, "count(DISTINCT (w1, w2, sex_code))", "0", "1", "'Whole Name, Gender'", "false", "NULL", "'Whole Name'", "NULL", "NULL", "'Gender'"),
        "typo": ("S1", 1, "count(*)", "0", "1", "'Membr Nam, Gendr, Brth Date, Contract Nmber'", "false", "NULL", "'Membr Nam'", "'Contract Nmber'", "'Brth Date'", "'Gendr'"),
        "numname": ("S1", 1, "0", "count(*)", "1", "'Name, ContractNo'", "false", "NULL", "'Name'", "'ContractNo'", "NULL", "NULL"),
    }
    selects = []
    for key, (label, no, out, missing, above, ids, multi, pair, name, pol, dob, sex) in tables.items():
        fam = key.rstrip("12")
        selects.append(f"""SELECT company_code, '/in/{fam}_' || CAST(file_no AS VARCHAR) || '.csv' AS file_path, '{fam}_' || CAST(file_no AS VARCHAR) || '.csv' AS file_name,
          'csv' AS extension, '{label}' AS sheet_name, {no} AS table_index, CAST(NULL AS VARCHAR) AS error_msg, {ids} AS identified_headers, {multi} AS multiple_name,
          count(*) + {above} AS row_count, {out} AS n_out, {missing} AS n_missing, CAST({pair} AS VARCHAR) AS first_last_name_header, CAST({name} AS VARCHAR) AS full_name_header,
          CAST({pol} AS VARCHAR) AS policy_number_header, CAST({dob} AS VARCHAR) AS dob_header, CAST({sex} AS VARCHAR) AS sex_header FROM persons GROUP BY company_code, file_no""")
    union = "\nUNION ALL\n".join(selects)
    return f"""WITH {sql.PERSONS}, t AS ({union}),
      p AS (SELECT *, greatest(CAST(ceil(n_out / 60.0) AS BIGINT), 1) AS parts FROM t),
      e AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM p)
      SELECT company_code, file_path, file_name, extension, sheet_name, table_index, error_msg, identified_headers, multiple_name, row_count,
        least(60, n_out - (part - 1) * 60) AS output_row_count, first_last_name_header, full_name_header, policy_number_header, dob_header, sex_header,
        CASE WHEN n_out = 0 THEN 'No output rows (missing_name_count=' || CAST(n_missing AS VARCHAR) || ')'
             WHEN parts > 1 THEN 'missing_name_count=' || CAST(n_missing AS VARCHAR) || ' (part ' || CAST(part AS VARCHAR) || '/' || CAST(parts AS VARCHAR) || ')'
             ELSE 'missing_name_count=' || CAST(n_missing AS VARCHAR) END AS remarks FROM e
      UNION ALL SELECT company_code, '/in/nomatch_' || CAST(file_no AS VARCHAR) || '.csv', 'nomatch_' || CAST(file_no AS VARCHAR) || '.csv', 'csv', 'S1', NULL,
        'No identifiable headers or content pattern found', NULL, NULL, count(*) + 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM persons GROUP BY company_code, file_no"""


ORACLES["file_log"] = _file_log_oracle()
ORACLES["report_sink"] = f"""SELECT row_number() OVER (ORDER BY file_path, sheet_name, "table", column_index) AS position, header, file_path, sheet_name, "table",
  column_index FROM ({ORACLES["header_report"]})"""
ORACLES["run_outcome"] = sql.typed(ORACLES["run_outcome"], files_processed="BIGINT", files_failed="BIGINT")
