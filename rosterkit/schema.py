"""Schemas, limits and fixed vocabularies shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: output contract, limits and supported types. ---
ROSTER_COLUMNS = [
    "SURNAME", "FIRST_NAME", "COMPLETE_NAME", "SEX", "DATE_OF_BIRTH",
    "CMPY_NO", "POLICY_NUMBER", "FILE_PATH", "SHEET",
]
FIELDS = ["name", "firstlastname", "sex", "dob", "policynum"]

WORKBOOK_TYPES = ["xlsx", "xls", "xlsm", "xlsb"]
TEXT_TYPES = ["csv", "txt", "rpt"]
ARCHIVE_TYPES = ["zip", "zipx", "tar", "7z", "rar"]

HEADER_SEARCH_ROWS = 50
NUMERIC_SAMPLE_ROWS = 100
PROFILE_SAMPLE_ROWS = 200
OUTPUT_PART_ROWS = 500_000
REPORT_PART_ROWS = 1_000_000
DIALECT_SAMPLE_BYTES = 10_000

FUZZY_THRESHOLD = 0.7
NUMERIC_COLUMN_SHARE = 0.9
DEFAULT_ALIAS_COMPANIES = 8
RECENT_RUNS = 200
CODE_SUGGESTIONS = 20
# --- End of fixed values. ---

# Company code of the alias rows that apply to every company.
ALL_COMPANIES = "*"

# A sheet is identified by these columns everywhere; a table adds its first column.
SHEET_KEY = ["company_code", "file_path", "sheet"]
TABLE_KEY = SHEET_KEY + ["col_start"]

RAW_ROWS = T.StructType([
    T.StructField("company_code", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

ROSTER = T.StructType([T.StructField(c, T.StringType()) for c in ROSTER_COLUMNS])

# --- Fixed values: names and types of the run log. ---
RUNS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("company_code", T.StringType()),
    T.StructField("email_received_date", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("finished_at", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("triggered_by", T.StringType()),
    T.StructField("triggered_user", T.StringType()),
    T.StructField("output_folder", T.StringType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("files_processed", T.LongType()),
    T.StructField("files_failed", T.LongType()),
])

FILE_LOGS = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("table_index", T.IntegerType()),
    T.StructField("error_msg", T.StringType()),
    T.StructField("identified_headers", T.StringType()),
    T.StructField("multiple_name", T.BooleanType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("output_row_count", T.LongType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("first_last_name_header", T.StringType()),
    T.StructField("full_name_header", T.StringType()),
    T.StructField("policy_number_header", T.StringType()),
    T.StructField("dob_header", T.StringType()),
    T.StructField("sex_header", T.StringType()),
    T.StructField("remarks", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

RUN_LOGS = T.StructType([
    T.StructField("run_log_id", T.LongType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

# --- End of fixed values. ---

OUTPUT_INDEX = T.StructType([
    T.StructField("output_path", T.StringType()),     # the folder of the part's file
    T.StructField("file_path", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("part_number", T.LongType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("fingerprint", T.LongType()),       # of the rows, whatever their order
    T.StructField("company_code", T.StringType()),
    T.StructField("email_received_date", T.StringType()),
    T.StructField("run_id", T.LongType()),
])

COMPILED_MANIFEST = T.StructType([
    T.StructField("company_code", T.StringType()),
    T.StructField("email_received_date", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("base_versions", T.ArrayType(T.LongType())),
    T.StructField("rows_per_part", T.LongType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("part_count", T.LongType()),
    T.StructField("source_run_count", T.LongType()),
    T.StructField("skipped_files", T.LongType()),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("part_number", T.LongType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("row_count", T.LongType()),
    ]))),
    T.StructField("last_updated_at", T.StringType()),
])

LEASES = T.StructType([
    T.StructField("company_code", T.StringType()),
    T.StructField("email_received_date", T.StringType()),
    T.StructField("fence", T.LongType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("expires_at", T.DoubleType()),
])

ARCHIVED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("moved", T.BooleanType()),
    T.StructField("run_id", T.LongType()),
])

REQUEST = T.StructType([
    T.StructField("company_code", T.StringType()),
    T.StructField("email_received_date", T.StringType()),
    T.StructField("files", T.StringType()),          # kept as JSON text so that a wrong type can be reported
    T.StructField("user", T.StringType()),
    T.StructField("input_folder", T.StringType()),
    T.StructField("processed_at", T.StringType()),
])

ALIAS = T.StructType([
    T.StructField("company_code", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("alias_norm", T.StringType()),
])
