"""Request stream: validate, admit, scan, compile and log every request file that appears in a folder."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from rosterkit.operators import leases as lease_rules
from rosterkit.operators import requests as req
from rosterkit.operators.compile import REPORT_KEY
from rosterkit.schema import REQUEST, RUNS
from rosterkit.session import stage
from rosterkit.sources import sinks
from rosterkit.streaming import leases

REQUEST_GLOB = "configuration*.json"  # fixed value: names of request files
MAX_REQUESTS = 100

QUEUE = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("arrival", T.StringType())]
    + REQUEST.fields
    + [T.StructField("admitted", T.BooleanType()), T.StructField("batch_id", T.LongType())]
)
_COLUMNS = ["request_id", "arrival", *REQUEST.fieldNames()]

Work = Callable[[SparkSession, DataFrame], None]


def read_requests(
    spark: SparkSession, folder: str, name_glob: str = REQUEST_GLOB, per_batch: int | None = MAX_REQUESTS,
    archive_folder: str | None = None,
) -> DataFrame:
    """New request files of a folder, files already there included.

    With ``archive_folder`` a request file is moved there once its batch is committed.
    """
    reader = spark.readStream.schema(REQUEST).option("multiLine", True).option("pathGlobFilter", name_glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if archive_folder:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_folder)
    return reader.json(folder).select(
        F.col("_metadata.file_path").alias("request_id"),
        F.date_format("_metadata.file_modification_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("arrival"),
        *REQUEST.fieldNames(),
    )


def with_run_id(admitted: DataFrame) -> DataFrame:
    """A run id that a repeated batch would give again."""
    return admitted.withColumn("run_id", F.xxhash64("request_id", "arrival", *REPORT_KEY).bitwiseAND((1 << 62) - 1))


def waiting(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """Requests that the given batch deferred."""
    queue = sinks.read_table(spark, f"{store}/queue", QUEUE)
    return queue.filter((F.col("batch_id") == batch_id) & ~F.col("admitted")).select(*_COLUMNS)


def admit_and_work(spark: SparkSession, store: str, queue: DataFrame, batch_id: int, work: Work,
                   lease_seconds: float = leases.SECONDS) -> tuple[int, DataFrame]:
    """Run the admitted requests of a queue and record all decisions under the batch; returns how many ran and all decisions.

    The work holds a lease on the company and date of each request and gets its number as ``fence``. A run of another job
    blocks its key while its lease lasts; when that has ended without being given back, the run is set to failed and the
    key is taken over. The decisions are written after the work: a failure in between repeats the same runs into the same
    partitions. Runs that an attempt of this queue left running are its own and do not block it. Earlier decisions of the
    batch about other requests are kept.
    """
    now = time.time()
    own = with_run_id(queue).select("run_id")
    runs = sinks.read_table(spark, f"{store}/runs", RUNS)
    stored = leases.read_leases(spark, store)
    decided = stage(req.admit(queue, lease_rules.busy_keys(runs, stored, own, now)), "decided")
    admitted = stage(with_run_id(decided.filter("admitted")), "admitted")
    ran = admitted.count()
    if ran:
        lost = lease_rules.abandoned_runs(runs, stored, now).join(own, "run_id", "left_anti")
        lost = stage(lost.join(admitted.select(*REPORT_KEY), REPORT_KEY, "left_semi").withColumn("status", F.lit("failed")), "abandoned")
        sinks.replace_rows(lost.select(*RUNS.fieldNames()), f"{store}/runs", *sinks.RUN_KEY)
        with leases.held(spark, store, admitted, lease_seconds) as taken:
            work(spark, admitted.join(taken.select("run_id", "fence"), "run_id"))
    earlier = sinks.read_table(spark, f"{store}/queue", QUEUE).filter(F.col("batch_id") == batch_id)
    kept = earlier.join(decided.select("request_id", "arrival"), ["request_id", "arrival"], "left_anti")
    record = decided.select(*_COLUMNS, "admitted", F.lit(batch_id).cast("long").alias("batch_id"))
    sinks.overwrite_partitions(stage(record.unionByName(kept), "decisions"), f"{store}/queue", "batch_id")
    return ran, decided


def quarantine(spark: SparkSession, store: str, checked: DataFrame, batch_id: int) -> None:
    """Store the invalid requests of a batch with their problems."""
    invalid = checked.filter(F.size("problems") > 0).withColumn("batch_id", F.lit(batch_id).cast("long"))
    sinks.overwrite_partitions(invalid, f"{store}/quarantine", "batch_id")


def handle_batch(store: str, work: Work) -> Callable[[DataFrame, int], None]:
    """Batch function: quarantine invalid requests, admit, work, and keep the deferred ones for the next batch.

    A committed micro-batch is never replayed, so its deferred requests stay in the queue under its number, where
    the next batch finds them. All writes replace the batch's own partitions, so a batch that is run again after a
    failure ends in the same state.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = stage(req.validate_requests(batch.select(*_COLUMNS)), "new-requests")
        quarantine(spark, store, new, batch_id)
        valid = new.filter(F.size("problems") == 0).select(*_COLUMNS)
        admit_and_work(spark, store, valid.unionByName(waiting(spark, store, batch_id - 1)), batch_id, work)

    return run


def one_at_a_time(checked: DataFrame, retry_seconds: float) -> DataFrame:
    """Validated requests as a stream that lets one request of a company and date through at a time, the earliest first.

    The others wait in the state of their key, and a timer lets the next one through although no new request comes.
    Invalid requests pass at once.
    """
    names = [*_COLUMNS, "problems"]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting_texts = json.loads(state.get[0]) if state.exists else []
        out = []
        for batch in batches:
            for row in batch[names].to_dict("records"):
                row["problems"] = list(row["problems"])
                if row["problems"]:
                    out.append(row)
                else:
                    waiting_texts.append([None if v is None or v != v else v for v in (row[c] for c in _COLUMNS)])
        waiting_texts.sort(key=lambda r: (r[1] or "", r[0] or ""))
        if waiting_texts:
            out.append({**dict(zip(_COLUMNS, waiting_texts.pop(0))), "problems": []})
        if waiting_texts:
            state.update((json.dumps(waiting_texts),))
            state.setTimeoutDuration(int(1000 * retry_seconds))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    schema = T.StructType([*[QUEUE[c] for c in _COLUMNS], T.StructField("problems", T.ArrayType(T.StringType()))])
    return checked.select(*names).groupBy(*REPORT_KEY).applyInPandasWithState(step, schema, "waiting string", "append", "ProcessingTimeTimeout")


def read_returned(spark: SparkSession, store: str) -> DataFrame:
    """Requests that a batch gave back because another job held their key."""
    schema = T.StructType([QUEUE[c] for c in _COLUMNS])
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(f"{store}/returned").select(*_COLUMNS)


def handle_passed(store: str, work: Work, lease_seconds: float) -> Callable[[DataFrame, int], None]:
    """Batch function of the watch: work on what the queue let through; what another job blocks goes back as new input."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        passed = stage(batch.select(*_COLUMNS, "problems"), "passed")
        if passed.isEmpty():
            return
        quarantine(spark, store, passed, batch_id)
        valid = passed.filter(F.size("problems") == 0).select(*_COLUMNS)
        _, decided = admit_and_work(spark, store, valid, batch_id, work, lease_seconds)
        back = decided.filter(~F.col("admitted")).select(*_COLUMNS, F.lit(batch_id).alias("batch"))
        back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(f"{store}/returned")

    return run


def start_request_watch(spark: SparkSession, folder: str, store: str, checkpoint: str, work: Work, every: str = "10 seconds",
                        retry_seconds: float = 1.0, lease_seconds: float = leases.SECONDS, **source: object) -> StreamingQuery:
    """Watch a folder until stopped: requests of one company and date run one after the other, without a restart.

    Requests that wait for an earlier one stay in the state of the stream; those that another job blocks are given back
    and come in again with the next batch. ``returned`` of the store must be a folder of this watch alone.
    """
    spark.createDataFrame([], T.StructType([QUEUE[c] for c in _COLUMNS])).write.mode("append").json(f"{store}/returned")
    incoming = read_requests(spark, folder, **source).select(*_COLUMNS).unionByName(read_returned(spark, store))
    passed = one_at_a_time(req.validate_requests(incoming), retry_seconds)
    return (
        passed.writeStream.foreachBatch(handle_passed(store, work, lease_seconds)).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )


def retry_deferred(spark: SparkSession, store: str, work: Work) -> None:
    """Work off the deferred requests while no new ones come; call it after the stream has stopped.

    Every round admits one request per company and date. What a run of another job blocks stays in the queue.
    """
    last = sinks.read_table(spark, f"{store}/queue", QUEUE).agg(F.max("batch_id")).first()[0]
    ran = last is not None
    while ran:
        left = stage(waiting(spark, store, last), "waiting")
        ran = not left.isEmpty() and admit_and_work(spark, store, left, last, work)[0] > 0


def start_request_stream(spark: SparkSession, folder: str, store: str, checkpoint: str, work: Work, **source: object) -> StreamingQuery:
    """Process all request files that are there, then stop; deferred requests wait for the next batch."""
    return (
        read_requests(spark, folder, **source)
        .writeStream.foreachBatch(handle_batch(store, work))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
