"""File-name functions: extension, kind, safe names, report names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterkit.functions.dates import compact_date
from rosterkit.schema import ARCHIVE_TYPES, TEXT_TYPES, WORKBOOK_TYPES

SAFE_NAME_CHARS = 200  # fixed value: longest base name of an output


def file_name(path: Column) -> Column:
    """Last path segment."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; '' if there is none (a leading dot starts a hidden name)."""
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*\.([^.]*)$", 1))


def file_kind(path: Column) -> Column:
    """Excel, Text, Archive or Unknown."""
    ext = extension(path)
    return (
        F.when(ext.isin(WORKBOOK_TYPES), "Excel")
        .when(ext.isin(TEXT_TYPES), "Text")
        .when(ext.isin(ARCHIVE_TYPES), "Archive")
        .otherwise("Unknown")
    )


def safe_name(name: Column) -> Column:
    """Base name made safe for any file system.

    Square brackets are replaced too: they are glob syntax in Spark paths.
    """
    return F.left(F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "_"), F.lit(SAFE_NAME_CHARS))


def output_folder(root: str, date: Column, company: Column) -> Column:
    """``root/yyyymmdd/company``."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), compact_date(date), company)


def report_name(prefix: str, date: Column, company: Column, part: Column) -> Column:
    """``prefix_yyyymmdd_company_part``."""
    return F.concat_ws("_", F.lit(prefix), compact_date(date), company, part.cast("string"))
