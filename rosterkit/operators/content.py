"""Column types inferred from cell content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterkit.functions import parse_date, strip
from rosterkit.schema import SHEET_KEY

# Shapes and shares that decide a column's type.
SEX_WORDS = ["m", "f", "male", "female"]
POLICY_SHAPE = r"^[A-Za-z0-9\-./]{6,30}$"
NAME_SHAPE = r"^[A-Za-zÀ-ÿ'\-. ]{2,50}$"
NUMBER_SHAPE = r"^-?\p{Nd}+(?:\.\p{Nd}+)?$"
IDENTIFIER_SHAPE = r"^[A-Za-z0-9\-_]{4,20}$"
TEXT_SHAPE = r"^[A-Za-zÀ-ÿ'\-.\s]{2,}$"
SEX_SHARE = DATE_SHARE = POLICY_SHARE = IDENTIFIER_SHARE = 0.7
NAME_SHARE = TEXT_SHARE = 0.8
NUMBER_SHARE = 0.9
NAME_MIN_VALUES = 5
NAME_MIN_DISTINCT = 0.5
# End of fixed values.

COLUMN_KEY = SHEET_KEY + ["col_idx"]


def _share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def column_shares(cells: DataFrame, keys: list[str] = COLUMN_KEY, general: bool = False) -> DataFrame:
    """Shares of values of each shape, per column of a bounded sample of non-empty cells.

    ``general`` adds the shapes that only the header report needs.
    """
    value = F.col("value")
    shares = [
        F.count("*").alias("n_values"),
        _share(F.lower(value).isin(SEX_WORDS)).alias("sex_share"),
        _share(parse_date(value) != "").alias("date_share"),
        _share(value.rlike(POLICY_SHAPE)).alias("policy_share"),
        _share(value.rlike(NAME_SHAPE)).alias("name_share"),
        (F.size(F.collect_set(value)) / F.count("*")).alias("distinct_share"),
    ]
    if general:
        shares += [
            _share(value.rlike(NUMBER_SHAPE)).alias("number_share"),
            _share(value.rlike(IDENTIFIER_SHAPE)).alias("identifier_share"),
            _share(value.rlike(TEXT_SHAPE)).alias("text_share"),
        ]
    return cells.withColumn("value", strip(value)).groupBy(*keys).agg(*shares)


def column_type() -> Column:
    """Person field of a column from its shares; '' when nothing is certain.

    A name column must also be diverse: labels match the same shape but repeat.
    """
    diverse = (F.col("n_values") >= NAME_MIN_VALUES) & (F.col("distinct_share") > NAME_MIN_DISTINCT)
    return (
        F.when(F.col("sex_share") > SEX_SHARE, "sex")
        .when(F.col("date_share") > DATE_SHARE, "dob")
        .when(F.col("policy_share") > POLICY_SHARE, "policynum")
        .when((F.col("name_share") > NAME_SHARE) & diverse, "name")
        .otherwise("")
    )


def column_category() -> Column:
    """Report category of a column: the person field, else its general shape."""
    field = column_type()
    return (
        F.when(F.coalesce(F.col("n_values"), F.lit(0)) == 0, "Empty")
        .when(field == "sex", "Sex")
        .when(field == "dob", "DOB")
        .when(field == "policynum", "PolicyNumber")
        .when(field == "name", "Name")
        .when(F.col("number_share") > NUMBER_SHARE, "Numeric")
        .when(F.col("identifier_share") > IDENTIFIER_SHARE, "Identifier")
        .when(F.col("text_share") > TEXT_SHARE, "Text")
        .otherwise("Unknown")
    )


def infer_column_types(cells: DataFrame) -> DataFrame:
    """``column_type`` per sheet column."""
    return column_shares(cells).withColumn("column_type", column_type())


def categorise_columns(cells: DataFrame, keys: list[str] = COLUMN_KEY) -> DataFrame:
    """``category`` per sheet column."""
    return column_shares(cells, keys, general=True).withColumn("category", column_category())


def columns_by_content(cells: DataFrame) -> DataFrame:
    """Field columns per sheet, decided by content alone.

    The first two name-like columns are read as surname and first name, further ones as full names; a single one
    is a full name. Lists are bounded by the sheet width.
    """
    typed = infer_column_types(cells)
    found = lambda field: F.sort_array(F.collect_list(F.when(F.col("column_type") == field, F.col("col_idx"))))
    sheets = typed.groupBy(*SHEET_KEY).agg(
        *[found(f).alias(f) for f in ("name", "sex", "dob", "policynum")],
        F.max("col_idx").alias("col_end"),
    )
    pair = F.size("name") >= 2
    none = F.array().cast("array<int>")
    return sheets.select(
        *SHEET_KEY,
        F.lit(0).alias("col_start"),
        "col_end",
        F.when(pair, F.slice("name", 3, F.greatest(F.size("name"), F.lit(1)))).otherwise(F.col("name")).alias("name"),
        F.when(pair, F.slice("name", 1, 2)).otherwise(none).alias("firstlastname"),
        "sex", "dob", "policynum",
    )
