"""Queries of the streaming jobs over rendered request and delivery folders."""

from __future__ import annotations

import time

from pyspark.sql import functions as F, types as T

from rosterkit.functions import file_name
from rosterkit.plans import archive, delivery, reports
from rosterkit.queries import render, sql, views
from rosterkit.schema import ROSTER_COLUMNS, RUNS
from rosterkit.sources import catalog, sinks
from rosterkit.streaming import deliveries, requests

_FAMILIES = ["std", "multi", "nomatch"]


WATCH_SECONDS = 1800  # a watch that does not get on for so long is stopped
_RAN = T.StructType([T.StructField(c, T.StringType()) for c in ("company_code", "email_received_date", "user")] + [T.StructField("fence", T.LongType())])
BLOCK_FILES = 35  # numbered files per date: five of each company, in every layout


def _request_files(spark, sf_dir, inbox, families):
    """One request per company and date; each names the date's files and one that is missing. A second is invalid."""
    people = views.persons(spark, sf_dir).select("company_code", "file_no").distinct()
    names = people.select("company_code", F.floor(F.col("file_no") / BLOCK_FILES).cast("int").alias("block"), F.explode(F.array(*[
        F.format_string(f"{family}_%d.csv", "file_no") for family in families
    ])).alias("file"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("block")).cast("string")
    asked = names.groupBy("company_code", "block").agg(F.sort_array(F.collect_list("file")).alias("files")).select(
        "*", F.explode(F.array(day, F.concat(F.lit("day "), day))).alias("day")
    )
    body = F.to_json(F.struct(
        "company_code", F.col("day").alias("email_received_date"),
        F.concat(F.col("files"), F.array(F.lit("missing.csv"))).alias("files"),
        F.lit("tester").alias("user"), F.lit(inbox).alias("input_folder"),
    ))
    return asked.select(
        F.concat(F.lit("configuration_"), "company_code", F.lit("_"), F.regexp_replace("day", "[^0-9a-z]", ""), F.lit(".json")).alias("name"),
        F.encode(body, "UTF-8").alias("content"),
    )


def _requests_by_family(spark, sf_dir):
    """Three requests of every company and date, one for each layout."""
    people = views.persons(spark, sf_dir).select("company_code", F.floor(F.col("file_no") / BLOCK_FILES).cast("int").alias("block")).distinct()
    asked = people.select("*", F.explode(F.array(*map(F.lit, _FAMILIES))).alias("family"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("block")).cast("string")
    body = F.to_json(F.struct("company_code", day.alias("email_received_date"), F.array(F.lit("a.csv")).alias("files"), F.col("family").alias("user"),
                              F.lit("/in").alias("input_folder")))
    name = F.concat(F.lit("configuration_"), "company_code", F.lit("_"), F.col("block").cast("string"), F.lit("_"), "family", F.lit(".json"))
    return asked.select(name.alias("name"), F.encode(body, "UTF-8").alias("content"))


def _run_stream(spark, sf_dir, families=_FAMILIES, archive_folder=None):
    raw = views.raw_sheets(spark, sf_dir, families)
    inbox = render.write_files(render.delimited(raw), render.folder(spark, "inbox"))
    queue = render.write_files(_request_files(spark, sf_dir, inbox, families), render.folder(spark, "queue"))
    store = render.folder(spark, "store")
    alias = views.aliases(spark)

    def work(session, admitted):
        delivery.run_requests(session, store, admitted, alias, rows_per_part=100, archive_folder=archive_folder)

    requests.start_request_stream(spark, queue, store, f"{store}/checkpoint", work, per_batch=None).awaitTermination()
    return inbox, store


def stream_requests(spark, sf_dir):
    """Every request file processed by the stream: outcome of each run, and the refused requests."""
    _, store = _run_stream(spark, sf_dir)
    runs = sinks.read_table(spark, f"{store}/runs", RUNS).select(
        "company_code", "email_received_date", "status", "total_files", "files_processed", "files_failed"
    )
    refused = spark.read.parquet(f"{store}/quarantine").select("company_code", "email_received_date", F.lit("invalid").alias("status"))
    return runs.unionByName(refused, allowMissingColumns=True)


def stream_compiled(spark, sf_dir):
    """Compiled reports the stream leaves in the store."""
    _, store = _run_stream(spark, sf_dir)
    rows = reports.read_reports(spark, store)
    return rows.select(
        F.col("email_received_date").cast("string").alias("email_received_date"), F.col("part_number").cast("long").alias("part_number"),
        *[c for c in ROSTER_COLUMNS if c != "FILE_PATH"], file_name(F.col("FILE_PATH")).alias("file"),
    )


def stream_archive(spark, sf_dir):
    """Where every delivered file is after the stream has run: files that failed stay in the inbox."""
    inbox, store = _run_stream(spark, sf_dir, ["std", "nomatch"], archive_folder=render.folder(spark, "done"))
    moved = archive.read_archived(spark, store).filter("moved").select(file_name(F.col("target")).alias("file_name"), F.lit("archive").alias("place"))
    left = catalog.file_catalog(spark, inbox).select("file_name", F.lit("inbox").alias("place"))
    return moved.unionByName(left)


def _ran(spark, store):
    """What ran so far; the folder is there before its first files are, so the columns are given."""
    return sinks.read_table(spark, f"{store}/ran", _RAN)


def stream_retries(spark, sf_dir):
    """Requests of one company and date run one after the other in one running query: the numbers of their leases."""
    queue = render.write_files(_requests_by_family(spark, sf_dir), render.folder(spark, "queue"))
    store = render.folder(spark, "store")
    wanted = spark.read.option("multiLine", True).json(queue).count()

    def work(session, admitted):
        admitted.select("company_code", "email_received_date", "user", "fence").write.mode("append").parquet(f"{store}/ran")

    watch = requests.start_request_watch(spark, queue, store, f"{store}/checkpoint", work, every="1 second", retry_seconds=0.1, per_batch=None)
    done, end = 0, time.time() + WATCH_SECONDS
    try:
        while watch.isActive and time.time() < end and done < wanted:
            time.sleep(1)
            now = _ran(spark, store).count()
            if now > done:
                done, end = now, time.time() + WATCH_SECONDS
    finally:
        watch.stop()
    if watch.exception():
        raise watch.exception()
    if done < wanted:
        raise TimeoutError(f"{done} of {wanted} requests ran, and none for {WATCH_SECONDS} seconds")
    return _ran(spark, store).groupBy("company_code", "email_received_date").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("fence")), lambda f: f.cast("string")), ",").alias("fences"),  # a few requests a key
        F.array_join(F.array_sort(F.collect_list("user")), ",").alias("users"))


def stream_deliveries(spark, sf_dir):
    """Catalog of all delivered files, collected by the stream."""
    raw = views.raw_sheets(spark, sf_dir, ["std", "digits"])
    inbox = render.write_files(render.delimited(raw), render.folder(spark, "inbox"))
    table = render.folder(spark, "catalog")
    deliveries.start_delivery_catalog(spark, inbox, table, f"{table}-checkpoint").awaitTermination()
    return spark.read.parquet(table).select("file_name", "extension", "kind")


QUERIES = {q.__name__: q for q in (stream_requests, stream_compiled, stream_archive, stream_retries, stream_deliveries)}

_DAY = f"strftime(DATE '2024-01-01' + CAST(file_no // {BLOCK_FILES} AS INTEGER), '%Y-%m-%d')"
_STD = f"""SELECT '' AS "SURNAME", '' AS "FIRST_NAME", upper(p_name) AS "COMPLETE_NAME", sex_code AS "SEX", dob AS "DATE_OF_BIRTH", company_code AS "CMPY_NO",
  policy AS "POLICY_NUMBER", '' AS "SHEET", 'std_' || CAST(file_no AS VARCHAR) || '.csv' AS file, {_DAY} AS email_received_date FROM persons WHERE k % 11 <> 0"""


def _multi(name: str) -> str:
    return f"""SELECT CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), upper({name}), 'U', '', company_code, policy, '',
  'multi_' || CAST(file_no AS VARCHAR) || '.csv', {_DAY} FROM persons WHERE k % 3 <> 0"""


ORACLES = {
    "stream_requests": f"""WITH {sql.PERSONS}, f AS (SELECT company_code, {_DAY} AS email_received_date, count(DISTINCT file_no) AS n FROM persons GROUP BY ALL)
        SELECT company_code, email_received_date, 'failed' AS status, 3 * n + 1 AS total_files, 2 * n AS files_processed, n + 1 AS files_failed FROM f
        UNION ALL SELECT company_code, 'day ' || email_received_date, 'invalid', NULL, NULL, NULL FROM f""",
    "stream_compiled": f"""WITH {sql.PERSONS}, d AS (SELECT DISTINCT * FROM ({_STD} UNION ALL {_multi("p_name")} UNION ALL {_multi("w2 || ' ' || w1")})),
        n AS (SELECT *, row_number() OVER (PARTITION BY "CMPY_NO", email_received_date ORDER BY "SURNAME" NULLS FIRST, "FIRST_NAME" NULLS FIRST, "COMPLETE_NAME", "SEX",
          "DATE_OF_BIRTH", "CMPY_NO", "POLICY_NUMBER", file, "SHEET") AS i FROM d)
        SELECT * EXCLUDE (i), (i - 1) // 100 + 1 AS part_number FROM n""",
    "stream_archive": f"""WITH {sql.PERSONS} SELECT DISTINCT 'std_' || CAST(file_no AS VARCHAR) || '.csv' AS file_name, 'archive' AS place FROM persons
        UNION ALL SELECT DISTINCT 'nomatch_' || CAST(file_no AS VARCHAR) || '.csv', 'inbox' FROM persons""",
    "stream_retries": f"""WITH {sql.PERSONS} SELECT DISTINCT company_code, {_DAY} AS email_received_date, '1,2,3' AS fences, 'multi,nomatch,std' AS users FROM persons""",
    "stream_deliveries": f"""WITH {sql.PERSONS} SELECT DISTINCT fam || '_' || CAST(file_no AS VARCHAR) || '.csv' AS file_name, 'csv' AS extension, 'Text' AS kind
        FROM persons CROSS JOIN (VALUES ('std'), ('digits')) t(fam)""",
}
