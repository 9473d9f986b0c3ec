"""Delivery stream: catalog files as they arrive and archive those that were handled without an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterkit.functions import extension, file_kind, file_name
from rosterkit.plans import archive
from rosterkit.session import stage
from rosterkit.sources import sinks
from rosterkit.sources.catalog import decoded_uri

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"  # fixed by the source

Check = Callable[[SparkSession, DataFrame], DataFrame]


def read_deliveries(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Supported files that appear below a folder; their content is not read.

    Files that a batch moved away before it was committed are passed over when it is repeated.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    files = reader.option("ignoreMissingFiles", True).load(folder).select(
        F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified_at"))
    name = file_name(decoded_uri(F.col("path")))
    return files.select("path", name.alias("file_name"), "length", "modified_at", extension(name).alias("extension"), file_kind(name).alias("kind")).filter(
        F.col("kind") != "Unknown"
    )


def handle_deliveries(table: str, archive_folder: str | None, check: Check | None) -> Callable[[DataFrame, int], None]:
    """Batch function: store the catalog rows, check the files, and move those without an error.

    ``check`` gets the files of a batch and returns ``file_path, error_msg`` of the failed ones. A batch that planned its
    moves before it was interrupted only carries them out.
    """
    moves = f"{table}-moves"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        again = spark.createDataFrame([(batch_id,)], "run_id long")
        if archive_folder and archive.finish_interrupted(spark, moves, again).isEmpty():
            return
        files = stage(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), "delivered")
        sinks.overwrite_partitions(files, table, "batch_id")
        if archive_folder:
            none = spark.createDataFrame([], "file_path string, error_msg string")
            errors = check(spark, files) if check else none
            work = files.select(F.col("batch_id").alias("run_id"), F.col("path").alias("origin"))
            archive.archive_files(spark, moves, archive.planned_moves(work, errors, files.select("path", F.col("path").alias("origin")), archive_folder))

    return run


def start_delivery_catalog(spark: SparkSession, folder: str, table: str, checkpoint: str, archive_folder: str | None = None,
                           check: Check | None = None, **source: object) -> StreamingQuery:
    """Add the catalog rows of new files to a Parquet table, then stop when the folder is done."""
    return (
        read_deliveries(spark, folder, **source).writeStream.foreachBatch(handle_deliveries(table, archive_folder, check))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
