"""Raw sheets: head rows, cells, column blocks, densest rows.

A raw sheet is headerless: every cell is text and the header row is just a data row. Detection looks only at the
head of each sheet, so its groups are bounded (rows x width of the head) however large a file is, and the filter on
``row_idx`` reaches the Parquet scan. All steps are keyed by the sheet, which is hash-partitioned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterkit.functions import is_blank
from rosterkit.operators.joins import join_small
from rosterkit.schema import HEADER_SEARCH_ROWS, SHEET_KEY, TABLE_KEY
from rosterkit.session import stage


def head_rows(raw: DataFrame, rows: int = HEADER_SEARCH_ROWS) -> DataFrame:
    """The first ``rows`` rows of every sheet."""
    return raw.filter(F.col("row_idx") < rows)


def cell(index: int | Column) -> Column:
    """Cell at a 0-based position; null when the row is shorter, so short rows need no padding."""
    return F.get(F.col("cells"), index)


def pad_rows(raw: DataFrame) -> DataFrame:
    """Rows padded with nulls to the width of their sheet.

    Only for output: the operators read cells by position, where a missing cell is null already.
    """
    widths = stage(raw.groupBy(*SHEET_KEY).agg(F.max(F.size("cells")).alias("width")), "widths")
    missing = F.col("width") - F.size("cells")
    return join_small(raw, widths, SHEET_KEY, salt_by=["row_idx"]).withColumn(
        "cells", F.concat("cells", F.array_repeat(F.lit(None).cast("string"), missing))
    )


def head_cells(raw: DataFrame, rows: int = HEADER_SEARCH_ROWS) -> DataFrame:
    """Non-empty cells of the head: sheet key, ``row_idx``, ``col_idx``, ``value``."""
    return (
        head_rows(raw, rows)
        .repartition(*SHEET_KEY)
        .select(*SHEET_KEY, "row_idx", F.posexplode("cells").alias("col_idx", "value"))
        .filter(~is_blank(F.col("value")))
    )


def non_empty_columns(cells: DataFrame) -> DataFrame:
    """Columns with any value in the head."""
    return cells.select(*SHEET_KEY, "col_idx").distinct()


def block_columns(cells: DataFrame) -> DataFrame:
    """Every non-empty column with the contiguous block it belongs to.

    Columns of one island share ``col_idx - row_number``. The windows run over the columns of one sheet.
    """
    in_sheet = Window.partitionBy(*SHEET_KEY).orderBy("col_idx")
    island = Window.partitionBy(*SHEET_KEY, "_island")
    return (
        non_empty_columns(cells)
        .withColumn("_island", F.col("col_idx") - F.row_number().over(in_sheet))
        .withColumn("col_start", F.min("col_idx").over(island))
        .withColumn("col_end", F.max("col_idx").over(island))
        .withColumn("table_idx", F.dense_rank().over(Window.partitionBy(*SHEET_KEY).orderBy("col_start")))
        .drop("_island")
    )


def column_blocks(cells: DataFrame) -> DataFrame:
    """One row per table block: ``table_idx`` (from 1), ``col_start``, ``col_end``."""
    return block_columns(cells).groupBy(*TABLE_KEY).agg(
        F.first("col_end").alias("col_end"), F.first("table_idx").alias("table_idx")
    )


def block_cells(cells: DataFrame) -> DataFrame:
    """Cells with the block they lie in."""
    return cells.join(block_columns(cells), SHEET_KEY + ["col_idx"])


def densest_rows(in_blocks: DataFrame) -> DataFrame:
    """The row of each block with the most non-empty cells; the earliest wins a tie.

    A maximum of (count, -row) needs no window and combines map-side.
    """
    counts = in_blocks.groupBy(*TABLE_KEY, "row_idx").agg(F.count("*").alias("n_cells"))
    best = F.max(F.struct("n_cells", (-F.col("row_idx")).alias("neg"))).alias("_best")
    return counts.groupBy(*TABLE_KEY).agg(best).select(
        *TABLE_KEY, (-F.col("_best.neg")).alias("row_idx"), F.col("_best.n_cells").alias("n_cells")
    )


def joined_header(texts: Column) -> Column:
    """``", "``-joined texts of a collected list of (col_idx, text) structs, in column order."""
    return F.array_join(F.transform(F.array_sort(texts), lambda t: t["text"]), ", ")

