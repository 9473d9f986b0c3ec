"""Result tables: every write is a Spark commit, and a repeated write replaces its own partitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rosterkit.operators.aliases import in_alias_order
from rosterkit.operators.compile import REPORT_KEY
from rosterkit.operators.joins import join_small
from rosterkit.operators.numbering import number_parts
from rosterkit.schema import OUTPUT_INDEX, OUTPUT_PART_ROWS, ROSTER_COLUMNS
from rosterkit.session import stage
from rosterkit.sources.parts import clear_folders, read_parts, stored_files, write_parts
from rosterkit.sources.storage import literal_path, path_exists, remove_file

RUN_KEY = [*REPORT_KEY, "run_id"]  # how runs and their outputs are stored


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table as text-safe columns, or an empty one when nothing was written yet.

    The schema is given, so partition values such as ``00733`` stay text.
    """
    if not path_exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(literal_path(path))


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace exactly the partitions that occur in ``df``."""
    placed = df.hint("rebalance", *partitions)  # few files a partition, though its rows may come from every task
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def replace_rows(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that occur in ``df``, one file each, for tables with a row or a few in a partition.

    Tasks write and swap the files, so a reader finds the old row or the new one, and many partitions cost the driver nothing.
    """
    written = write_parts(df, path, list(partitions), [c for c in df.columns if c not in partitions])
    written.agg(F.count("*")).first()


def output_label() -> Column:
    """Folder name of the output of one file and sheet."""
    return F.md5(F.to_json(F.struct("FILE_PATH", "SHEET")))


def write_rosters(rosters: DataFrame, path: str, rows_per_file: int = OUTPUT_PART_ROWS) -> DataFrame:
    """Roster rows as one file for each part of each output; returns the index of the written parts.

    An output is what one run found on one sheet of one file. Each of its parts has a folder of its own, whose path is
    the same whenever the run is repeated. Only outputs beyond the row limit are numbered. Other columns go along.
    """
    keys = [*RUN_KEY, "output"]
    named = stage(rosters.withColumn("output", output_label()), "outputs")  # read several times, made once
    sizes = stage(named.groupBy(*keys).agg((F.count("*") > rows_per_file).alias("large")), "output-sizes")
    large = sizes.filter("large").select(*keys)
    parts = named.withColumn("part_number", F.lit(1).cast("long"))
    many, outputs = sizes.agg(F.count_if("large"), F.count("*")).first()
    if many:
        cut = number_parts(join_small(named, large, keys, "left_semi", salt_by=ROSTER_COLUMNS), keys, ROSTER_COLUMNS, rows_per_file)
        parts = cut if many == outputs else join_small(parts, large, keys, "left_anti", salt_by=ROSTER_COLUMNS).unionByName(cut)
    place = [*keys, "part_number"]
    written = stage(write_parts(parts, path, place, [c for c in rosters.columns if c not in place]), "written-parts")
    return written.na.drop(subset=place).select(*OUTPUT_INDEX.fieldNames())


def write_output_index(index: DataFrame, path: str) -> None:
    """The index of one or more runs; an earlier index of the same run is replaced whole."""
    overwrite_partitions(index, path, *RUN_KEY)


def write_report_parts(parts: DataFrame, path: str, partitions: list[str]) -> DataFrame:
    """Compiled parts, one file each: a part is bounded, so gathering it in one task is safe.

    The folders are cleared first. Returns ``partitions, part_number, output_path, row_count`` of what was written, staged.
    """
    clear_folders(parts.select(*partitions).distinct(), path)
    written = stage(write_parts(parts, path, [*partitions, "part_number"], ROSTER_COLUMNS, file_per_part=True), "written-report-parts")
    return written.select(*partitions, "part_number", "output_path", "row_count")


def remove_files(paths: DataFrame) -> int:
    """Remove the files of the column ``path`` (readable paths) in tasks; returns how many there were."""
    def run(batches):
        for batch in batches:
            gone = sum(remove_file(p) for p in batch.column(0).to_pylist() if p)
            yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["gone"])

    return paths.select("path").distinct().mapInArrow(run, "gone long").agg(F.sum("gone")).first()[0] or 0


def write_log_exports(logs: DataFrame, path: str) -> None:
    """File logs as CSV with a header, one folder per run; the rows come placed by run and number."""
    logs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("run_id").csv(path)


def write_sorted(df: DataFrame, path: str, order: list[str | Column], file_format: str = "parquet") -> None:
    """A table in total order: files in order of their names hold ranges of rows, each file is sorted.

    A table without rows is one file that has its columns and no rows.
    """
    staged = stage(df, "unsorted")
    if staged.isEmpty():
        placed = staged.coalesce(1)
    else:
        by = [F.col(c) if isinstance(c, str) else c for c in order]
        placed = staged.repartitionByRange(*by).sortWithinPartitions(*by)
    placed.write.mode("overwrite").option("header", True).format(file_format).save(path)


def read_sorted(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A sorted Parquet table with the 1-based place of every row: rows before its file, from one number per file."""
    rows = spark.read.parquet(literal_path(path)).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = stage(sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")), "file-starts")
    return join_small(rows, starts, ["_file"], salt_by=["_row"]).withColumn(name, F.col("_start") + F.col("_row") + 1).drop("_file", "_row", "_start")


def write_library(defaults: DataFrame, residual: DataFrame, reference: DataFrame, notes: DataFrame, quality: DataFrame,
                  path: str) -> None:
    """Alias library outputs: defaults, residual and reference aliases per company, notes, quality report."""
    reference.write.mode("overwrite").partitionBy("company_code").json(f"{path}/reference")
    in_alias_order(defaults, "category").write.mode("overwrite").json(f"{path}/defaults")
    residual.write.mode("overwrite").partitionBy("company_code").json(f"{path}/companies")
    notes.write.mode("overwrite").json(f"{path}/notes")
    quality.orderBy("company_code").write.mode("overwrite").json(f"{path}/quality")


_PLACE = T.StructType([*[T.StructField(c, T.StringType()) for c in REPORT_KEY], T.StructField("run_id", T.LongType()),
                       T.StructField("output", T.StringType()), T.StructField("part_number", T.LongType())])


def stored_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Every stored file of the outputs below a folder: its place, ``output_path`` (its folder) and ``path``."""
    return stored_files(spark, path, _PLACE)


def reread_rosters(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Roster outputs with every column as text and their exact path, whatever characters it has."""
    outputs = stored_outputs(spark, path).select("output_path", *RUN_KEY).distinct()
    rows = read_parts(outputs, [T.StructField(c, T.StringType()) for c in [*ROSTER_COLUMNS, *extra]])
    return rows.select("output_path", *ROSTER_COLUMNS, *extra, *RUN_KEY)
