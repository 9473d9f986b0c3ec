"""Row numbers within a key without a single-task window, and the fixed-size parts built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterkit.operators.joins import join_small
from rosterkit.session import stage

# monotonically_increasing_id keeps the partition in the bits above this one.
_PARTITION_SHIFT = 33


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the 1-based position of each row within its key, in the given order.

    A window over a key that holds a third of the data would run in one task. Here the rows are range-partitioned
    by key and order, so that a large key covers many partitions; the placed rows are written once (a second
    evaluation could sample other range bounds); each partition counts its rows per key; and the counts of the
    earlier partitions are added. The counts are at most one row per key plus one per partition, so the rows
    themselves are normally not shuffled again.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in keys + order]
    placed = stage(
        df.repartitionByRange(partitions, *by)
        .sortWithinPartitions(*by)
        .withColumn("_position", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_slice", F.shiftright("_position", _PARTITION_SHIFT))
    place = F.struct(*keys, "_slice").alias("_place")  # compared as a whole, so null keys match themselves
    slices = placed.groupBy(*keys, "_slice").agg(F.min("_position").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        slices.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).select(place, "_first", "_offset"),
        "offsets",
    )
    return join_small(placed.select("*", place), offsets, ["_place"], salt_by=["_position"]).select(
        *df.columns, (F.col("_position") - F.col("_first") + F.col("_offset") + 1).alias(name)
    )


def part_of(row_number: Column, rows_per_part: int) -> Column:
    """1-based part of a 1-based row number."""
    return (F.floor((row_number - 1) / rows_per_part) + 1).cast("long")


def number_parts(
    df: DataFrame, keys: list[str], order: list[str], rows_per_part: int, name: str = "part_number"
) -> DataFrame:
    """Split every key into parts of at most ``rows_per_part`` rows, in a fixed order."""
    numbered = number_within(df, keys, order, "_row_number")
    return numbered.withColumn(name, part_of(F.col("_row_number"), rows_per_part)).drop("_row_number")
