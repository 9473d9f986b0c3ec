"""Tables of many small files, one for each part: tasks write them, list them and read them by their paths.

A store has a file for every part of every output and report.  Spark's own writer moves each folder on the driver and its
reader lists every folder again with a task of its own, so both cost more than the rows.  Here a task writes the parts that
a shuffle brought to it and returns one row a file; readers get the paths from the index or the manifests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rosterkit.schema import ROSTER_COLUMNS
from rosterkit.sources.storage import list_files, list_folders, open_file_at, qualified, remove_file, replace_file

_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_UNSAFE = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")  # as Spark names folders of partitions
_WRITTEN = "output_path string, file_path string, sheet string, row_count bigint, fingerprint bigint"
_READ_ROWS = 10_000


def folder_name(column: str, value: object) -> str:
    """Folder of a partition value, named as Spark does."""
    text = _NO_VALUE if value is None or value == "" else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{column}={text}"


def folder_values(path: str) -> dict[str, str | None]:
    """Partition values in a path."""
    found = (step.split("=", 1) for step in path.split("/") if "=" in step)
    return {c: None if v == _NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), v) for c, v in found}


def fingerprint_of() -> Column:
    return F.expr("xxhash64(" + ", ".join(ROSTER_COLUMNS) + ")")


def as_type(values: pa.Array, kind: pa.DataType) -> pa.Array:
    return values if values.type == kind else values.cast(kind)


class _Part:
    """A file that is being written; it appears when it is closed."""

    def __init__(self, target: str, alone: bool, row: list, schema: pa.Schema):
        from pyarrow import parquet

        self.target, self.row, self.rows, self.mark, self.first = target, row, 0, 0, None
        self.replacing = replace_file(target, alone)
        self.writer = parquet.ParquetWriter(self.replacing.__enter__(), schema, compression="snappy")

    def add(self, piece: pa.RecordBatch, marks: pa.Array):
        if self.first is None and "FILE_PATH" not in piece.schema.names:
            self.first = [None, None]
        elif self.first is None:
            self.first = [piece.column("FILE_PATH")[0].as_py(), piece.column("SHEET")[0].as_py()]
        self.rows += piece.num_rows
        self.mark ^= int(np.bitwise_xor.reduce(marks.to_numpy()))
        self.writer.write_batch(piece)

    def close(self, shown: str) -> list:
        self.writer.close()
        self.replacing.__exit__(None, None, None)
        return [*self.row, shown, *self.first, self.rows, self.mark]


def write_parts(rows: DataFrame, path: str, place: list[str], in_files: list[str], file_per_part: bool = False) -> DataFrame:
    """One Parquet file for each value of ``place``; returns ``place`` and the path, rows and fingerprint of each, lazily.

    The folders are named by ``place``, whose file columns (``in_files``) are the others. With ``file_per_part`` the last
    of ``place`` is in the name of the file instead, and the path is that of the file; otherwise the file is alone in its
    folder, whose path is given. The result must be staged: computing it again would write again.
    """
    base = qualified(path)
    folders = place[:-1] if file_per_part else place
    roster = set(ROSTER_COLUMNS) <= set(in_files)  # other rows have no fingerprint
    texts = {c: F.when(F.col(c) != "", F.col(c)) for c in place if isinstance(rows.schema[c].dataType, T.StringType)}
    rows = rows.withColumns(texts)  # an empty text has the folder of null, so both are one part
    held = rows.select(*place, *in_files, F.to_json(F.struct(*place)).alias("_key"), (fingerprint_of() if roster else F.lit(0).cast("long")).alias("_mark"))
    by = [F.xxhash64("_key"), "_key"]  # texts of keys begin alike, their hashes tell most of them apart
    ordered = held.repartition(*place).sortWithinPartitions(*by, *(ROSTER_COLUMNS if roster else []))
    kept = [*in_files, place[-1]] if file_per_part else list(in_files)
    schema = to_arrow_schema(rows.select(*kept).schema)
    out = T.StructType([rows.schema[c] for c in place] + list(T._parse_datatype_string(_WRITTEN)))

    def target(values: dict) -> tuple[str, str]:
        folder = "/".join([base, *[folder_name(c, values[c]) for c in folders]])
        if file_per_part:
            file = f"{folder}/part-{values[place[-1]]:09d}.parquet"
            return file, file
        return f"{folder}/part.parquet", folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        part, key, shown, done = None, None, "", []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, start = pc.run_end_encode(batch.column("_key")), 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                piece, start = batch.slice(start, end - start), end
                if part is None or value != key:
                    if part is not None:
                        done.append(part.close(shown))
                    values = {c: piece.column(c)[0].as_py() for c in place}
                    file, shown = target(values)
                    part, key = _Part(file, not file_per_part, [values[c] for c in place], schema), value
                part.add(pa.RecordBatch.from_arrays([as_type(piece.column(c), schema.field(c).type) for c in kept], schema=schema), piece.column("_mark"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(part.close(shown), arrow)], schema=arrow)

    return ordered.mapInArrow(run, out)


def read_parts(parts: DataFrame, columns: list[T.StructField]) -> DataFrame:
    """The rows of the files at ``output_path`` (a file, or a folder of files) with the other columns of ``parts``.

    A column that a file lacks is null; a file that is gone has no rows.
    """
    spark = parts.sparkSession
    carried = [f for f in parts.schema if f.name not in {c.name for c in columns}]
    out = T.StructType([*carried, *columns])
    wanted, arrow = [c.name for c in columns], to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for batch in batches:
            for row in batch.to_pylist():
                for path in list_files(row["output_path"]):
                    file = open_file_at(path)
                    if file is None:
                        continue
                    with file:
                        stored = parquet.ParquetFile(file)
                        have = [n for n in wanted if n in stored.schema_arrow.names]
                        for rows in stored.iter_batches(_READ_ROWS, columns=have):
                            n = rows.num_rows
                            yield pa.RecordBatch.from_arrays(
                                [pa.repeat(pa.scalar(row[f.name], arrow.field(f.name).type), n) for f in carried]
                                + [as_type(rows.column(c), arrow.field(c).type) if c in have else pa.nulls(n, arrow.field(c).type) for c in wanted],
                                schema=arrow)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, since small rows stand for whole files
    return parts.repartition(tasks, "output_path").mapInArrow(run, out)


def stored_files(spark: SparkSession, path: str, schema: T.StructType, levels: int = 3) -> DataFrame:
    """``output_path`` and ``path`` of every Parquet file below a folder, with the values that its folders are named by.

    ``schema`` gives these values' columns in their order. The driver lists the first ``levels`` (companies, dates and
    runs of a store), tasks what is below.
    """
    tops = [qualified(path)]
    for _ in range(levels):
        tops = [below for top in tops for below in list_folders(top)]
    names = schema.fieldNames()
    out = T.StructType([*schema, T.StructField("output_path", T.StringType()), T.StructField("path", T.StringType())])
    arrow = to_arrow_schema(out)
    numbers = {f.name for f in schema if isinstance(f.dataType, T.LongType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                files = list_files(top)
                values = [folder_values(f) for f in files]
                columns = [[int(v[c]) if c in numbers and v.get(c) is not None else v.get(c) for v in values] for c in names]
                columns += [[f.rsplit("/", 1)[0] for f in files], files]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    if not tops:
        return spark.createDataFrame([], out)
    tasks = max(1, min(len(tops), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.createDataFrame([(t,) for t in tops], "top string").repartitionByRange(tasks, "top").mapInArrow(run, out)  # as many for each


def clear_folders(folders: DataFrame, path: str) -> None:
    """Remove the files in the folders named by the columns, which an interrupted attempt may have left."""
    base, names = qualified(path), folders.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = 0
            for row in batch.to_pylist():
                gone += sum(remove_file(f) for f in list_files("/".join([base, *[folder_name(c, row[c]) for c in names]])))
            yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["gone"])

    folders.mapInArrow(run, "gone bigint").agg(F.sum("gone")).first()
