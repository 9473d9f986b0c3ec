"""Header report: every header cell of every table with its position and content category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterkit.functions import strip
from rosterkit.operators.content import categorise_columns
from rosterkit.operators.sheets import block_cells, densest_rows, head_cells
from rosterkit.schema import HEADER_SEARCH_ROWS, PROFILE_SAMPLE_ROWS, SHEET_KEY, TABLE_KEY
from rosterkit.session import stage

REPORT_ORDER = ["file_path", "sheet_name", "table", "column_index"]  # fixed value: by file, sheet, table label and column


def header_report(raw: DataFrame) -> DataFrame:
    """One row per header cell: text, position and category; ``sinks.write_sorted`` gives them their order.

    The header of a block is its densest head row. Categories come from the ``PROFILE_SAMPLE_ROWS`` rows below it,
    so only the top of each sheet is scanned. The column index is the true sheet position.
    """
    reach = HEADER_SEARCH_ROWS + PROFILE_SAMPLE_ROWS
    top = stage(head_cells(raw, reach), "profile")
    cells = block_cells(top.filter(F.col("row_idx") < HEADER_SEARCH_ROWS))
    header = densest_rows(cells).select(*TABLE_KEY, F.col("row_idx").alias("header_row"))
    headers = (
        cells.join(header, TABLE_KEY)
        .filter(F.col("row_idx") == F.col("header_row"))
        .select(*TABLE_KEY, "table_idx", "header_row", "col_idx", strip(F.col("value")).alias("header"))
    )
    sample = headers.select(*TABLE_KEY, "col_idx", "header_row").join(top, SHEET_KEY + ["col_idx"]).filter(
        (F.col("row_idx") > F.col("header_row")) & (F.col("row_idx") <= F.col("header_row") + PROFILE_SAMPLE_ROWS)
    )
    keys = TABLE_KEY + ["col_idx"]
    categories = categorise_columns(sample, keys).select(*keys, "category")
    return (
        headers.join(categories, keys, "left")
        .select(
            "header", "file_path", F.col("sheet").alias("sheet_name"),
            F.format_string("Table %d", F.col("table_idx")).alias("table"),
            F.col("col_idx").alias("column_index"), F.col("header_row").alias("row_index"),
            F.coalesce("category", F.lit("Empty")).alias("category"),
        )
    )
