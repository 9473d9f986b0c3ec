"""Header detection: exact alias, then similar alias, then cell content.

The input is the head of each sheet, so every group is bounded; the alias table is joined on the match key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterkit.functions import match_key
from rosterkit.functions.similarity import (
    letter_counts, letter_token, letters_allow, lengths_allow, match_ratio, prefix_size, sorted_letters,
)
from rosterkit.operators.content import columns_by_content
from rosterkit.operators.joins import join_small
from rosterkit.operators.sheets import block_cells, head_cells, joined_header
from rosterkit.schema import ALL_COMPANIES, FIELDS, FUZZY_THRESHOLD, HEADER_SEARCH_ROWS, SHEET_KEY, TABLE_KEY
from rosterkit.session import stage

ANCHOR_FIELDS = ["name", "firstlastname"]


def alias_scopes(company: str = "company_code"):
    """A cell is looked up among its company's own aliases and among those for all companies."""
    return F.explode(F.array(F.col(company), F.lit(ALL_COMPANIES))).alias("scope")


def exact_hits(in_blocks: DataFrame, alias: DataFrame) -> DataFrame:
    """Head cells whose match key is an alias: a row per cell and field (twice if both scopes have the alias)."""
    keyed = in_blocks.withColumn("alias_norm", match_key(F.col("value"))).filter(F.col("alias_norm") != "")
    lookup = alias.select(F.col("company_code").alias("scope"), "field", "alias_norm")
    columns = TABLE_KEY + ["row_idx", "col_idx"]
    scoped = keyed.select(*columns, "alias_norm", alias_scopes())
    return join_small(scoped, lookup, ["scope", "alias_norm"], salt_by=columns).select(*columns, "field")


def similar_aliases(words: DataFrame, alias: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Words similar to an alias of their scope: ``scope, word, field, ratio``.

    ``words(scope, word)`` are distinct match keys. Instead of comparing every word with every alias, both sides
    are indexed by the rare-letter prefix of their letters: every pair at the threshold shares a prefix token, so an
    equi-join finds all candidates. Length and letter bounds, lossless too and evaluated in generated code, cut
    nearly all of them, and only the distinct survivors reach the Python ratio.
    """
    def indexed(df: DataFrame, key: str, counts: str) -> DataFrame:
        letters = df.withColumn(counts, letter_counts(F.col(key))).withColumn("_letters", sorted_letters(F.col(counts)))
        places = F.explode(F.sequence(F.lit(1), prefix_size(F.length(key), threshold)))
        return letters.withColumn("_at", places).withColumn(
            "token", letter_token(F.col("_letters"), F.col("_at"))
        ).drop("_letters", "_at")

    aliases = alias.filter(F.col("alias_norm") != "").select(F.col("company_code").alias("scope"), "field", "alias_norm")
    candidates = (
        join_small(
            indexed(words.select("scope", "word"), "word", "_w"), indexed(aliases, "alias_norm", "_a"),
            ["scope", "token"], salt_by=["word"],
        )
        .filter(lengths_allow(F.length("word"), F.length("alias_norm"), threshold))
        .filter(letters_allow(F.col("_w"), F.col("_a"), F.length("word") + F.length("alias_norm"), threshold))
        .select("scope", "word", "field", "alias_norm")
        .distinct()
    )
    return (
        candidates.withColumn("ratio", match_ratio("word", "alias_norm"))
        .filter(F.col("ratio") >= threshold)
        .groupBy("scope", "word", "field")
        .agg(F.max("ratio").alias("ratio"))
    )


def fuzzy_hits(in_blocks: DataFrame, alias: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Head cells similar to an alias: one row per cell and field.

    The ratio runs on distinct words of a scope; words under ``*`` are compared once for all companies.
    """
    keyed = in_blocks.withColumn("word", match_key(F.col("value"))).filter(F.col("word") != "")
    scoped = keyed.select(*TABLE_KEY, "row_idx", "col_idx", "word", alias_scopes())
    similar = similar_aliases(scoped.select("scope", "word").distinct(), alias, threshold)
    similar = stage(similar.select("scope", "word", "field"), "similar")
    return join_small(scoped, similar, ["scope", "word"]).select(*TABLE_KEY, "row_idx", "col_idx", "field")


def locate_headers(hits: DataFrame) -> DataFrame:
    """Header row of each block (the first with a name hit) and its columns per field.

    Sex, birth date and policy hits alone never make a header. The hits of a row are gathered first (at most the
    width of the sheet) and the first row is a minimum over structs; both groupings share one shuffle by block.
    """
    columns = [
        F.sort_array(F.collect_set(F.when(F.col("field") == f, F.col("col_idx")))).alias(f) for f in FIELDS
    ]
    rows = hits.repartition(*TABLE_KEY).groupBy(*TABLE_KEY, "row_idx").agg(*columns)
    anchored = F.lit(False)
    for field in ANCHOR_FIELDS:
        anchored = anchored | (F.size(field) > 0)
    first = F.min(F.struct(F.col("row_idx").alias("header_row_idx"), *FIELDS)).alias("_first")
    return rows.filter(anchored).groupBy(*TABLE_KEY).agg(first).select(*TABLE_KEY, "_first.*")


def detect_exact(in_blocks: DataFrame, alias: DataFrame) -> DataFrame:
    return locate_headers(exact_hits(in_blocks, alias)).withColumn("method", F.lit("exact"))


def without_header(in_blocks: DataFrame, exact: DataFrame) -> DataFrame:
    """Cells of the blocks that have no exact header."""
    return in_blocks.join(exact.select(*TABLE_KEY), TABLE_KEY, "left_anti")


def detect_fuzzy(rest: DataFrame, alias: DataFrame) -> DataFrame:
    """Similar-alias detection for the blocks without an exact header."""
    return locate_headers(fuzzy_hits(rest, alias)).withColumn("method", F.lit("fuzzy"))


def without_table(cells: DataFrame, matched: DataFrame) -> DataFrame:
    """Cells of the sheets where no block has a header."""
    return cells.join(matched.select(*SHEET_KEY).distinct(), SHEET_KEY, "left_anti")


def detect_content(rest: DataFrame) -> DataFrame:
    """Content detection for the sheets without any header; every row is data then."""
    by_content = columns_by_content(rest).filter((F.size("name") > 0) | (F.size("firstlastname") > 0))
    return by_content.select(
        *TABLE_KEY, "col_end", F.lit(-1).cast("long").alias("header_row_idx"), *FIELDS,
        F.lit("content").alias("method"),
    )


def with_header_text(matches: DataFrame, in_blocks: DataFrame) -> DataFrame:
    """Add the texts of the header row, in column order, as one text and as a position map."""
    values = in_blocks.select(*TABLE_KEY, F.col("row_idx").alias("header_row_idx"), "col_idx", "value")
    header = (
        matches.select(*TABLE_KEY, "header_row_idx")
        .join(values, TABLE_KEY + ["header_row_idx"])
        .groupBy(*TABLE_KEY)
        .agg(F.collect_list(F.struct("col_idx", F.col("value").alias("text"))).alias("_header"))
    )
    return (
        matches.join(header, TABLE_KEY, "left")
        .withColumn("identified_headers", F.coalesce(joined_header(F.col("_header")), F.lit("")))
        .withColumn("header_cells", F.map_from_entries(F.coalesce("_header", F.array().cast("array<struct<col_idx:int,text:string>>"))))
        .drop("_header")
    )


def detect_headers(raw: DataFrame, alias: DataFrame, rows: int = HEADER_SEARCH_ROWS) -> DataFrame:
    """All usable tables of all sheets.

    Columns: table key, ``col_end``, ``header_row_idx`` (-1 for content detection), one array of column positions
    per field, ``method``, ``content_based``, ``identified_headers``, ``header_cells``.

    The cheap step comes first and the others run only if something is left for them. The head cells are staged
    because all steps read them, and so is the result: it is small, and every later step of a job joins it.
    """
    cells = stage(block_cells(head_cells(raw, rows)), "head")
    by_alias = stage(detect_exact(cells, alias), "exact")
    rest = without_header(cells, by_alias)
    if not rest.isEmpty():
        by_alias = by_alias.unionByName(stage(detect_fuzzy(rest, alias), "fuzzy"))
    blocks = cells.select(*TABLE_KEY, "col_end").distinct()
    matches = by_alias.join(blocks, TABLE_KEY)
    rest = without_table(cells, by_alias)
    if not rest.isEmpty():
        matches = matches.unionByName(detect_content(rest))
    found = with_header_text(matches, cells).withColumn("content_based", F.col("method") == "content")
    return stage(found, "matches")
