"""Scan requests: validation, admission, requested files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterkit.functions import display_date
from rosterkit.operators.compile import REPORT_KEY, RUNNING
from rosterkit.operators.joins import join_small
from rosterkit.session import stage

# Required fields and the texts of the problems.
REQUIRED_FIELDS = ["company_code", "email_received_date", "files"]
MISSING_FIELD = "missing required field: "
FILES_NOT_LIST = "'files' must be a list"
FILES_EMPTY = "'files' is empty -- nothing to process"
BAD_DATE = "'email_received_date' must be YYYY-MM-DD"
# End of fixed values.


def listed_files(files: Column) -> Column:
    """Requested files; null when the JSON text is no list."""
    return F.when(files.rlike(r"^\s*\["), F.from_json(files, "array<string>"))


def problems() -> Column:
    """All problems of a request, in a fixed order; empty when it is valid."""
    files = listed_files(F.col("files"))
    missing = [F.when(F.col(f).isNull(), F.lit(MISSING_FIELD + f)) for f in REQUIRED_FIELDS]
    present = F.col("files").isNotNull()
    return F.array_compact(F.array(
        *missing,
        F.when(present & files.isNull(), F.lit(FILES_NOT_LIST)),
        F.when(present & (F.size(files) == 0), F.lit(FILES_EMPTY)),
        F.when(
            F.col("email_received_date").isNotNull() & display_date(F.col("email_received_date")).isNull(), F.lit(BAD_DATE)
        ),
    ))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with their ``problems``; split on an empty list."""
    return requests.withColumn("problems", problems())


def admit(requests: DataFrame, runs: DataFrame, request_id: str = "request_id", arrival: str = "arrival") -> DataFrame:
    """Requests with ``admitted``: at most one per company and date, the earliest, and none while a run is going on.

    The earliest request of each key comes from a minimum that combines map-side, because one key may hold most of
    the requests; it is joined back on the unique request id.
    """
    earliest = requests.groupBy(*REPORT_KEY).agg(F.min(F.struct(arrival, request_id)).alias("_first"))
    busy = runs.filter(F.col("status") == RUNNING).select(*REPORT_KEY).distinct()
    chosen = earliest.join(busy, REPORT_KEY, "left_anti").select(
        F.col(f"_first.{request_id}").alias(request_id), F.lit(True).alias("admitted")
    )
    return requests.join(chosen, request_id, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def requested_files(requests: DataFrame, catalog: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Every requested file with whether the catalog has it; missing ones are reported, not dropped.

    A file that most requests name is spread by the guarded join.
    """
    wanted = requests.select(request_id, F.explode(listed_files(F.col("files"))).alias("file_name"))
    present = stage(catalog.select("file_name").distinct().withColumn("present", F.lit(True)), "present")
    joined = join_small(wanted, present, ["file_name"], "left", salt_by=[request_id])
    return joined.withColumn("present", F.coalesce("present", F.lit(False)))
