"""Run log: file logs derived from an extraction, run outcomes, history and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterkit.functions import extension, file_name
from rosterkit.operators.extract import has_name
from rosterkit.schema import OUTPUT_PART_ROWS, RECENT_RUNS, SHEET_KEY

# Fixed value: the message of a sheet where nothing was found.
NO_TABLE = "No identifiable headers or content pattern found"

def table_counts(distinct: DataFrame) -> DataFrame:
    """Rows written and rows without a name per table, from the distinct people and their copies."""
    missing = F.sum(F.when(has_name(), 0).otherwise(F.col("copies")))
    return distinct.groupBy("CMPY_NO", "FILE_PATH", "SHEET").agg(
        missing.alias("missing_names"), F.count_if(has_name()).alias("output_rows")
    ).select(
        F.col("CMPY_NO").alias("company_code"), F.col("FILE_PATH").alias("file_path"),
        F.col("SHEET").alias("sheet_label"), "missing_names", "output_rows",
    )


def used_headers(columns: Column) -> Column:
    """Header texts of a list of columns; a column without a header text is named by its position."""
    text = lambda i: F.coalesce(F.col("header_cells")[i], F.concat(F.lit("column_"), (i + 1).cast("string")))
    return F.when(F.size(columns) > 0, F.array_join(F.transform(columns, text), ", "))


def _common(sheet_name: Column) -> list[Column]:
    return [
        F.col("company_code"), F.col("file_path"), file_name(F.col("file_path")).alias("file_name"),
        extension(F.col("file_path")).alias("extension"), sheet_name.alias("sheet_name"),
    ]


def file_log(raw: DataFrame, tables: DataFrame, distinct: DataFrame, rows_per_part: int = OUTPUT_PART_ROWS) -> DataFrame:
    """One log row per output part of every table (``part_number``), and one error row per sheet without a table.

    ``distinct`` are the distinct people of the tables with their copies. All counts combine map-side.
    """
    sizes = raw.groupBy(*SHEET_KEY).agg(F.count("*").alias("row_count"))
    counts = table_counts(distinct)
    found = (
        tables.join(sizes, SHEET_KEY)
        .join(counts, ["company_code", "file_path", "sheet_label"], "left")
        .na.fill(0, ["missing_names", "output_rows"])
    )
    parts = F.greatest(F.ceil(F.col("output_rows") / rows_per_part), F.lit(1)).cast("int")
    remark = F.concat(F.lit("missing_name_count="), F.col("missing_names").cast("string"))
    first = lambda field: used_headers(F.slice(field, 1, 1))
    logged = (
        found.withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
        .select(
            *_common(F.col("sheet_label")),
            F.col("table_no").cast("int").alias("table_index"), F.col("part").cast("long").alias("part_number"),
            F.lit(None).cast("string").alias("error_msg"),
            "identified_headers",
            ((F.size("name") >= 2) | (F.size("firstlastname") > 2)).alias("multiple_name"),
            "row_count",
            F.least(F.lit(rows_per_part), F.col("output_rows") - (F.col("part") - 1) * rows_per_part).cast("long").alias("output_row_count"),
            used_headers(F.col("firstlastname")).alias("first_last_name_header"),
            used_headers(F.col("name")).alias("full_name_header"),
            first("policynum").alias("policy_number_header"),
            first("dob").alias("dob_header"),
            first("sex").alias("sex_header"),
            F.when(F.col("output_rows") == 0, F.concat(F.lit("No output rows ("), remark, F.lit(")")))
            .when(F.col("parts") > 1, F.concat(remark, F.format_string(" (part %d/%d)", "part", "parts")))
            .otherwise(remark).alias("remarks"),
        )
    )
    failed = sizes.join(tables.select(*SHEET_KEY).distinct(), SHEET_KEY, "left_anti").select(
        *_common(F.col("sheet")), F.lit(NO_TABLE).alias("error_msg"), "row_count"
    )
    return logged.unionByName(failed, allowMissingColumns=True)


def run_outcome(file_logs: DataFrame, stopped: DataFrame | None = None) -> DataFrame:
    """Files processed and failed per run, and the run's final status.

    A file counts once however many tables it has, and counts as failed when any of its rows is an error. Both
    groupings combine map-side. ``stopped(run_id)`` names runs the user stopped.
    """
    files = file_logs.groupBy("run_id", "file_path").agg(
        F.max(F.col("error_msg").isNotNull()).alias("failed")
    )
    outcome = files.groupBy("run_id").agg(
        F.count_if(~F.col("failed")).alias("files_processed"), F.count_if("failed").alias("files_failed")
    )
    status = F.when(F.col("files_failed") == 0, "completed").otherwise("failed")
    if stopped is not None:
        marked = stopped.select("run_id").distinct().withColumn("_stopped", F.lit(True))
        outcome = outcome.join(marked, "run_id", "left")
        status = F.when(F.col("_stopped"), "stopped").otherwise(status)
    return outcome.withColumn("status", status).select("run_id", "files_processed", "files_failed", "status")


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """Most recent runs, newest first."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def logs_in_order(file_logs: DataFrame, run_id: int | None = None) -> DataFrame:
    """File logs in the order of insertion, those of one run or of all runs one after the other."""
    logs = file_logs if run_id is None else file_logs.filter(F.col("run_id") == run_id)
    return logs.orderBy("run_id", "log_id")


def run_log_records(file_logs: DataFrame, runs: DataFrame, output_format: str = "csv") -> DataFrame:
    """One export record per run: output name and number of logged rows, runs without logs included."""
    rows = file_logs.groupBy("run_id").agg(F.count("*").alias("logged_rows"))
    day = F.regexp_replace("email_received_date", "-", "")
    name = F.format_string("Log_%s_%s_run%d", day, F.col("company_code"), F.col("run_id"))
    return runs.join(rows, "run_id", "left").select(
        "run_id", name.alias("output_path"), F.lit(output_format).alias("format"),
        F.coalesce("logged_rows", F.lit(0)).alias("logged_rows"),
    )
