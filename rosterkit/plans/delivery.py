"""From a folder of files to rosters, file logs and compiled reports.

The store is a folder of Parquet tables:

    runs, output_index             company / date / run
    rosters                        company / date / run / output / part, one file each
    file_logs, run_logs, archived  one partition per run
    run_log_exports                the same logs as CSV with a header, one folder per run
    compiled, compiled_*           the reports and what they are made of (see ``reports``)

Every write replaces its own partitions only, so a repeated job gives the same store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rosterkit.functions import extension, file_name
from rosterkit.operators import compile as comp
from rosterkit.operators import extract, headers, runlog
from rosterkit.operators.joins import join_small
from rosterkit.operators.numbering import number_within
from rosterkit.operators.profile import REPORT_ORDER, header_report
from rosterkit.plans import archive
from rosterkit.plans.reports import compile_reports
from rosterkit.schema import FILE_LOGS, REPORT_PART_ROWS, ROSTER_COLUMNS, RUN_LOGS, RUNS
from rosterkit.session import stage, staging_path
from rosterkit.sources import archives, catalog, delimited, sinks, workbooks
from rosterkit.sources.storage import path_exists

RUN_COLUMNS = ["run_id", "company_code", "email_received_date"]
RUN_KEYS = sinks.RUN_KEY


@dataclass
class Scan:
    """Everything read from a delivery: raw rows, the files that failed, and all files with their origin."""

    rows: DataFrame      # file_path, sheet, row_idx, cells
    errors: DataFrame    # file_path, error_msg
    files: DataFrame     # path, file_name, kind, origin (the delivered file a member came from)


def scan_files(spark: SparkSession, files: DataFrame, folder: str | list[str]) -> Scan:
    """Read all text files, workbooks and archives of a catalog; archive members are read like delivered files."""
    unpacked = staging_path(spark, "unpacked")
    members, archive_errors = archives.expand_archives(spark, files, unpacked)
    delivered = files.select("path", "file_name", "extension", "length", "kind")
    parts = [(delivered, folder)]
    origins = delivered.select("path", "file_name", "kind", F.col("path").alias("origin"))
    if path_exists(unpacked):
        inside = catalog.file_catalog(spark, unpacked).filter(F.col("kind") != "Archive")
        parts.append((inside.select("path", "file_name", "extension", "length", "kind"), unpacked))
        origins = origins.unionByName(_member_origins(members, inside))
    rows, errors = None, archive_errors
    for listed, root in parts:
        text, text_errors = delimited.scan_delimited(spark, root, listed)
        books, book_errors = workbooks.scan_workbooks(listed)
        both = text.unionByName(books)
        rows = both if rows is None else rows.unionByName(both)
        errors = errors.unionByName(text_errors).unionByName(book_errors)
    return Scan(rows, errors, origins)


def _member_origins(members: DataFrame, inside: DataFrame) -> DataFrame:
    """Each unpacked file with the delivered archive it came from, through any nesting."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    links = members.select(bare(F.col("path")).alias("child"), F.col("parent"))
    found = inside.select("path", "file_name", "kind", bare(F.col("path")).alias("child")).join(links, "child").select(
        "path", "file_name", "kind", F.col("parent").alias("origin")
    )
    for _ in range(archives.MAX_DEPTH):
        up = links.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"))
        deeper = found.join(up, bare(F.col("origin")) == F.col("_child"), "left")
        if deeper.filter(F.col("_parent").isNotNull()).isEmpty():
            break
        found = deeper.select("path", "file_name", "kind", F.coalesce("_parent", "origin").alias("origin"))
    return found


def process_files(spark: SparkSession, scan: Scan, work: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rosters and file logs of scanned files; the logs name the part of their output, not yet its path.

    ``work(run_id, company_code, email_received_date, origin)`` says which run asked for which delivered file. A
    file is detected and extracted once per company, however many runs of that company name it.
    """
    owners = stage(
        scan.files.join(work, "origin").select("path", "file_name", "kind", "origin", *RUN_COLUMNS), "owners"
    )
    companies = owners.select(F.col("path").alias("file_path"), "company_code").distinct()
    raw = join_small(scan.rows, companies, ["file_path"], salt_by=["row_idx"])
    tables = extract.plan_tables(raw, headers.detect_headers(raw, alias))
    people = stage(extract.distinct_people(extract.extract_people(raw, tables)), "people")
    roster = people.filter(extract.has_name()).select(*ROSTER_COLUMNS)
    runs_of = owners.select(F.col("path").alias("FILE_PATH"), F.col("company_code").alias("CMPY_NO"), *RUN_COLUMNS)
    rosters = join_small(roster, runs_of, ["FILE_PATH", "CMPY_NO"], salt_by=ROSTER_COLUMNS).select(*ROSTER_COLUMNS, *RUN_COLUMNS)
    logged = runlog.file_log(raw, tables, people)
    run_keys = owners.select(F.col("path").alias("file_path"), "company_code", "run_id")
    sheets = logged.join(run_keys, ["file_path", "company_code"])
    failures = scan.errors.groupBy("file_path").agg(F.min("error_msg").alias("error_msg")).join(
        owners.select(F.col("path").alias("file_path"), "run_id"), "file_path"
    )
    lost = failures.select(
        "run_id", "file_path", file_name(F.col("file_path")).alias("file_name"),
        extension(F.col("file_path")).alias("extension"), "error_msg",
    )
    return rosters, sheets.unionByName(lost, allowMissingColumns=True)


def with_output_paths(logs: DataFrame, index: DataFrame) -> DataFrame:
    """Logs with the folder of the part they tell of, from the index of what was written."""
    parts = index.select("run_id", "file_path", F.col("sheet").alias("sheet_name"), "part_number", "output_path")
    return join_small(logs, parts, ["run_id", "file_path", "sheet_name", "part_number"], "left", salt_by=["file_path", "sheet_name"])


def as_file_logs(logs: DataFrame) -> DataFrame:
    """The file log columns and the part: other columns are left out, missing ones are null."""
    have = set(logs.columns)
    wanted = [*FILE_LOGS.fields, T.StructField("part_number", T.LongType())]
    return logs.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def numbered_logs(logs: DataFrame) -> DataFrame:
    """File logs with their number within the run, by file, sheet and part, and the time of writing."""
    ordered = number_within(logs.drop("log_id"), ["run_id"], ["file_path", "sheet_name", "part_number"], "log_id")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return ordered.withColumn("created_at", now).select(*FILE_LOGS.fieldNames())


def as_run_logs(records: DataFrame, store: str) -> DataFrame:
    """One record per run with the folder that holds its exported log; a run without log rows has none."""
    exported = F.concat(F.lit(f"{store}/run_log_exports/run_id="), F.col("run_id").cast("string"))
    return records.select(
        F.col("run_id").alias("run_log_id"), "run_id", F.when(F.col("logged_rows") > 0, exported).alias("output_path"), "format",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    ).select(*RUN_LOGS.fieldNames())


def finish_runs(runs: DataFrame, file_logs: DataFrame) -> DataFrame:
    """Runs with their outcome; a run without any file log is completed with no files."""
    outcome = runlog.run_outcome(file_logs)
    kept = [c for c in runs.columns if c not in ("status", "files_processed", "files_failed", "finished_at")]
    return runs.select(*kept).join(outcome, "run_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("completed"))
    ).na.fill(0, ["files_processed", "files_failed"]).withColumn(
        "finished_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    ).select(*[F.col(f.name).cast(f.dataType) for f in RUNS.fields])


def run_requests(spark: SparkSession, store: str, requests: DataFrame, alias: DataFrame, rows_per_part: int = REPORT_PART_ROWS,
                 archive_folder: str | None = None) -> None:
    """Scan, log and compile admitted requests: ``run_id, company_code, email_received_date, files, input_folder, user``.

    With a column ``fence`` (the number of the lease of the key) the reports are published under it. With
    ``archive_folder`` the files that no run failed on move there at the end. The input folders of one batch are listed on
    the driver; the trigger bounds how many requests a batch has.
    """
    requests = stage(requests, "requests")
    keys = requests.select(*comp.REPORT_KEY, *[c for c in ("fence",) if c in requests.columns]).distinct()
    if archive_folder:
        requests = stage(archive.finish_interrupted(spark, store, requests), "requests")
    wanted = requests.select(
        *RUN_COLUMNS, F.regexp_replace("input_folder", "/+$", "").alias("input_folder"),
        F.explode(F.from_json("files", "array<string>")).alias("file_name"),
    )
    folders = [r[0] for r in wanted.select("input_folder").distinct().collect() if r[0] and path_exists(r[0])]
    started = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    runs = stage(requests.select(
        *RUN_COLUMNS, started.alias("started_at"), F.lit(None).cast("string").alias("finished_at"),
        F.lit(comp.RUNNING).alias("status"), F.lit("watcher").alias("triggered_by"), F.col("user").alias("triggered_user"),
        F.concat_ws("/", F.lit(store), F.regexp_replace("email_received_date", "-", ""), "company_code").alias("output_folder"),
        F.size(F.from_json("files", "array<string>")).cast("long").alias("total_files"),
        F.lit(0).cast("long").alias("files_processed"), F.lit(0).cast("long").alias("files_failed"),
    ), "runs")
    # Stored before the work, so that other jobs see the key as busy; the finished run replaces its own partition.
    sinks.replace_rows(runs.select(*RUNS.fieldNames()), f"{store}/runs", *RUN_KEYS)
    logs = as_file_logs(spark.createDataFrame([], FILE_LOGS))
    missing, moves = wanted, None
    if folders:
        listed = catalog.file_catalog(spark, folders)
        uri = F.regexp_replace(catalog.decoded_uri(F.col("path")), "^file:/+", "/")
        work = stage(
            wanted.withColumn("uri", F.regexp_replace(F.concat("input_folder", F.lit("/"), "file_name"), "^file:/+", "/"))
            .join(listed.drop("file_name").withColumn("uri", uri), "uri"),
            "work",
        )
        files = work.select("path", F.col("file_name"), "extension", "length", "kind").dropDuplicates(["path"])
        scan = scan_files(spark, stage(files, "files"), folders)
        rosters, logs = process_files(spark, scan, work.select(F.col("path").alias("origin"), *RUN_COLUMNS), alias)
        index = sinks.write_rosters(rosters, f"{store}/rosters")
        sinks.write_output_index(index, f"{store}/output_index")
        logs = as_file_logs(with_output_paths(logs, index))
        missing = wanted.join(work.select("run_id", "file_name"), ["run_id", "file_name"], "left_anti")
        moves = work.select("run_id", F.col("path").alias("origin")), scan.files.select("path", "origin")
    absent = missing.select(
        "run_id", F.concat("input_folder", F.lit("/"), "file_name").alias("file_path"), "file_name",
        F.lit("FileNotFoundError: requested file is missing").alias("error_msg"),
    )
    logs = stage(numbered_logs(logs.unionByName(as_file_logs(absent))), "logs")
    sinks.overwrite_partitions(logs, f"{store}/file_logs", "run_id")
    finished = stage(finish_runs(runs, logs), "finished")
    sinks.write_log_exports(logs, f"{store}/run_log_exports")
    sinks.replace_rows(as_run_logs(runlog.run_log_records(logs, finished), store), f"{store}/run_logs", "run_id")
    sinks.replace_rows(finished, f"{store}/runs", *RUN_KEYS)
    compile_reports(spark, store, keys, rows_per_part)
    if archive_folder and moves:
        archive.archive_files(spark, store, archive.planned_moves(moves[0], logs, moves[1], archive_folder))


def folder_header_report(spark: SparkSession, folder: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Header report of all text files and workbooks of a folder, and the files that failed.

    With ``path`` the report is written there in its order, also when it has no rows.
    """
    files = catalog.file_catalog(spark, folder, kinds=["Text", "Excel"])
    scan = scan_files(spark, files, folder)
    report = header_report(scan.rows.withColumn("company_code", F.lit("")))
    if path:
        sinks.write_sorted(report, path, REPORT_ORDER)
        report = sinks.read_sorted(spark, path).orderBy("position").drop("position")
    return report, scan.errors
