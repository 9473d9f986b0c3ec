"""Cumulative compilation: eligible outputs, distinct rows, fixed-size parts, tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterkit.operators.joins import join_small
from rosterkit.operators.numbering import number_parts
from rosterkit.schema import REPORT_PART_ROWS, ROSTER_COLUMNS
from rosterkit.session import stage

RUNNING = "running"
REPORT_KEY = ["company_code", "email_received_date"]
PART_KEY = REPORT_KEY + ["part_number"]


def finished_runs(runs: DataFrame) -> DataFrame:
    """Runs in any terminal state; a failed run still contributes its good files."""
    return runs.filter(F.col("status") != RUNNING)


def eligible_outputs(file_logs: DataFrame, runs: DataFrame) -> DataFrame:
    """File logs of finished runs that have an output. One run may own most logs, hence the guarded join."""
    done = finished_runs(runs).select("run_id", *REPORT_KEY)
    return join_small(file_logs.filter(F.col("output_path").isNotNull()), done, ["run_id"], salt_by=["output_path"])


def source_run_count(runs: DataFrame) -> DataFrame:
    return finished_runs(runs).groupBy(*REPORT_KEY).agg(F.count("*").alias("source_run_count"))


def skipped_outputs(eligible: DataFrame, stored: DataFrame) -> DataFrame:
    """Eligible outputs that are no longer stored: reported, not fatal. ``stored`` lists outputs, such as the output index."""
    wanted = eligible.select(*REPORT_KEY, "output_path").distinct()
    return wanted.join(stored.select("output_path"), "output_path", "left_anti")


def compile_rows(rosters: DataFrame, eligible: DataFrame) -> DataFrame:
    """Distinct rows of every eligible output, per company and date.

    ``rosters`` are the nine text columns plus ``output_path``. The distinct aggregates before its shuffle, so
    re-delivered copies collapse on the map side; the same person from two files stays twice.
    """
    outputs = stage(eligible.select("output_path", *REPORT_KEY).distinct(), "outputs")
    bound = join_small(rosters, outputs, ["output_path"], salt_by=ROSTER_COLUMNS)
    return bound.select(*REPORT_KEY, *ROSTER_COLUMNS).dropDuplicates()


def compile_parts(rows: DataFrame, rows_per_part: int = REPORT_PART_ROWS) -> DataFrame:
    """Number the compiled rows into parts of at most ``rows_per_part``, ordered by all nine columns."""
    return number_parts(rows, REPORT_KEY, ROSTER_COLUMNS, rows_per_part)


def part_summary(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows per part with the number of source runs."""
    counts = parts.groupBy(*PART_KEY).agg(F.count("*").alias("row_count"))
    return counts.join(source_run_count(runs), REPORT_KEY, "left")


def report_summary(summary: DataFrame, runs: DataFrame, skipped: DataFrame) -> DataFrame:
    """Total rows, parts, source runs and skipped outputs per company and date, also where nothing was compiled."""
    totals = summary.groupBy(*REPORT_KEY).agg(
        F.sum("row_count").alias("total_rows"), F.max("part_number").alias("part_count")
    )
    missing = skipped.groupBy(*REPORT_KEY).agg(F.count("*").alias("skipped_files"))
    joined = source_run_count(runs).join(totals, REPORT_KEY, "left").join(missing, REPORT_KEY, "left")
    return joined.na.fill(0, ["total_rows", "part_count", "skipped_files"])


def upsert_compiled(tracked: DataFrame, fresh: DataFrame) -> DataFrame:
    """Tracking rows keyed by company, date and part: the latest update wins.

    A maximum of (time, row) combines map-side, so a key with many updates needs no window.
    """
    rest = [c for c in tracked.columns if c not in PART_KEY and c != "last_updated_at"]
    latest = F.max(F.struct("last_updated_at", *rest)).alias("_latest")
    both = tracked.unionByName(fresh.select(*tracked.columns))
    return both.groupBy(*PART_KEY).agg(latest).select(*PART_KEY, "_latest.*").select(*tracked.columns)


def rebuilt_reports(read: DataFrame, summary: DataFrame) -> DataFrame:
    """Part count of every key whose outputs were read; a key whose outputs held no rows has zero parts."""
    parts = summary.groupBy(*REPORT_KEY).agg(F.max("part_number").alias("part_count"))
    return read.select(*REPORT_KEY).distinct().join(parts, REPORT_KEY, "left").na.fill(0, ["part_count"])


def stale_parts(tracked: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Tracked parts beyond the rebuilt part count of their key. Keys that were not rebuilt are left alone."""
    return tracked.join(rebuilt.select(*REPORT_KEY, "part_count"), REPORT_KEY).filter(
        F.col("part_number") > F.col("part_count")
    ).drop("part_count")


def compile_diagnosis(runs: DataFrame, file_logs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """All runs with their file logs and whether each log is eligible; runs without logs are kept.

    ``stored`` lists each output once, as the output index does; then every log tells whether its output is there.
    Two guarded pieces instead of one outer join: a run that owns most logs must not land in one task.
    """
    logs = file_logs.select("run_id", "log_id", "file_name", "sheet_name", "output_path", "output_row_count", "error_msg")
    shown = runs.select("run_id", *REPORT_KEY, "started_at", "status")
    with_logs = join_small(logs, shown, ["run_id"], salt_by=["log_id"])
    without = shown.join(logs.select("run_id").distinct(), "run_id", "left_anti")
    report = with_logs.unionByName(without, allowMissingColumns=True).withColumn(
        "eligible", F.col("output_path").isNotNull() & (F.col("status") != RUNNING)
    )
    if stored is None:
        return report
    # Logs without an output stay out of the join: their null key would gather them in one task.
    present = stored.select("output_path").withColumn("exists", F.lit(True))
    written = report.filter(F.col("output_path").isNotNull()).join(present, "output_path", "left")
    return written.unionByName(
        report.filter(F.col("output_path").isNull()), allowMissingColumns=True
    ).na.fill(False, ["exists"])
