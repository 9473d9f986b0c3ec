"""File catalog of a delivery folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterkit.functions import extension, file_kind, file_name

TARGET_BYTES = 64 * 1024 * 1024
MAX_TASKS = 100_000


def decoded_uri(uri: Column) -> Column:
    """A percent-encoded file URI as readable text."""
    return F.call_function("url_decode", F.replace(uri, F.lit("+"), F.lit("%2B")))


def file_catalog(spark: SparkSession, folder: str | list[str], kinds: list[str] | None = None) -> DataFrame:
    """Supported files below ``folder``: path, name, size, time, extension, kind. Contents are not read.

    Request files and unsupported types are left out. ``path`` is Spark's own file URI, so it joins with the
    ``_metadata.file_path`` of any other scan.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("length"), F.col("modificationTime").alias("modified_at")
        )
    )
    listed = files.select(
        "path", file_name(decoded_uri(F.col("path"))).alias("file_name"), "length", "modified_at",
    ).select("*", extension(F.col("file_name")).alias("extension"), file_kind(F.col("file_name")).alias("kind"))
    return listed.filter(F.col("kind").isin(kinds) if kinds else F.col("kind") != "Unknown")


def spread(files: DataFrame, *keys: str) -> DataFrame:
    """Distribute file rows over tasks by their total size.

    Rows are tiny but stand for whole files, so the number of tasks must come from the bytes behind them; an
    explicit number also keeps adaptive execution from merging them.
    """
    spark = files.sparkSession
    total, count = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(spark.sparkContext.defaultParallelism, total // TARGET_BYTES + 1)
    return files.repartition(int(max(1, min(tasks, count, MAX_TASKS))), *(keys or ("path",)))
