"""Delivered files move to an archive folder once every run that asked for them has read them without an error.

The moves of a run are planned and written before the first file moves.  A job that is repeated after a failure finds the
plan, moves what is left and does not scan again what is gone already; a moved file counts as moved.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterkit.functions import file_name
from rosterkit.operators.joins import join_small
from rosterkit.operators.naming import unique_names
from rosterkit.schema import ARCHIVED
from rosterkit.session import stage
from rosterkit.sources import sinks
from rosterkit.sources.catalog import decoded_uri
from rosterkit.sources.storage import move_file, path_exists

_PARTS = r"(?s)^(.+?)(\.[^.]*)?$"


def read_archived(spark: SparkSession, store: str) -> DataFrame:
    """Planned moves of all runs and whether they are done."""
    return sinks.read_table(spark, f"{store}/archived", ARCHIVED)


def planned_moves(work: DataFrame, logs: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """``path, target, run_id`` of the delivered files that no run failed on.

    ``work(run_id, origin)`` are the requested files, ``files(path, origin)`` all files read for them (members of archives
    belong to their archive), ``logs`` the runs' file logs. A file that several runs asked for moves with the first one.
    """
    failed = logs.filter("error_msg IS NOT NULL").select(F.col("file_path").alias("path")).distinct()
    origins = join_small(files.select("path", "origin"), failed, ["path"], "left_semi").select("origin").distinct()
    good = work.groupBy("origin").agg(F.min("run_id").alias("run_id")).join(origins, "origin", "left_anti")
    path = decoded_uri(F.col("origin"))
    parts = good.select(path.alias("path"), "run_id", F.regexp_extract(file_name(path), _PARTS, 1).alias("stem"), F.regexp_extract(file_name(path), _PARTS, 2).alias("ending"))
    named = unique_names(parts, "stem", ["path"], "target", within=("run_id", "ending"), safe=False)
    folder_of = F.concat_ws("/", F.lit(folder.rstrip("/")), F.col("run_id").cast("string"), F.concat("target", "ending"))
    return named.select("path", folder_of.alias("target"), "run_id")


def archive_files(spark: SparkSession, store: str, plan: DataFrame) -> None:
    """Write the plan, move the files in tasks and write the result."""
    path = f"{store}/archived"
    plan = stage(plan, "planned-moves")
    sinks.overwrite_partitions(plan.select("path", "target", F.lit(False).alias("moved"), "run_id"), path, "run_id")
    carry_out(spark, store, plan)


def carry_out(spark: SparkSession, store: str, plan: DataFrame) -> None:
    """Move planned files; one that is at its target already is done."""
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            moved = [move_file(a, b) or path_exists_readable(b) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(moved, pa.bool_())], names=["path", "target", "run_id", "moved"])

    tasks = spark.sparkContext.defaultParallelism
    done = plan.select("path", "target", "run_id").repartition(tasks, "path").mapInArrow(run, "path string, target string, run_id long, moved boolean")
    sinks.overwrite_partitions(stage(done, "moved").select(*ARCHIVED.fieldNames()), f"{store}/archived", "run_id")


def path_exists_readable(path: str) -> bool:
    """True if a readable path is there (it is not percent-encoded)."""
    from urllib.parse import quote

    return path_exists(quote(path, safe="/:"))


def finish_interrupted(spark: SparkSession, store: str, requests: DataFrame) -> DataFrame:
    """Carry out moves that earlier attempts of these requests planned; returns the requests without a plan."""
    planned = stage(read_archived(spark, store).join(requests.select("run_id").distinct(), "run_id", "left_semi"), "planned")
    if planned.isEmpty():
        return requests
    carry_out(spark, store, planned)
    return requests.join(planned.select("run_id").distinct(), "run_id", "left_anti")
