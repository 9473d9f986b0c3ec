"""Queries of header detection and content typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterkit.functions import match_key
from rosterkit.operators import content, extract, headers, sheets
from rosterkit.queries import sql, views
from rosterkit.schema import ALL_COMPANIES, FIELDS, SHEET_KEY, TABLE_KEY
from rosterkit.session import stage

_FIELD_NAMES = {"name": "name_cols", "firstlastname": "pair_cols", "sex": "sex_cols", "dob": "dob_cols", "policynum": "policy_cols"}


def _listed(df: DataFrame, *keep: str) -> DataFrame:
    """Column lists as comma-joined texts."""
    return df.select(
        *keep, *[F.array_join(F.transform(f, lambda i: i.cast("string")), ",").alias(_FIELD_NAMES[f]) for f in FIELDS]
    )


def _cells(spark, sf_dir, *families) -> DataFrame:
    return sheets.head_cells(views.raw_sheets(spark, sf_dir, list(families) or None))


def non_empty_columns(spark, sf_dir):
    return sheets.non_empty_columns(_cells(spark, sf_dir))


def column_blocks(spark, sf_dir):
    return sheets.column_blocks(_cells(spark, sf_dir))


def head_sample(spark, sf_dir):
    """Rows and cells seen by detection, per sheet."""
    return sheets.head_rows(views.raw_sheets(spark, sf_dir)).groupBy(*SHEET_KEY).agg(
        F.count("*").alias("n_rows"), F.max("row_idx").alias("last_row"),
        F.sum(F.size("cells")).alias("n_cells"),
    )


def pad_rows(spark, sf_dir):
    padded = sheets.pad_rows(views.raw_sheets(spark, sf_dir, ["std", "two"]))
    return padded.select(*SHEET_KEY, "row_idx", F.size("cells").alias("width"), F.concat_ws("|", F.transform("cells", lambda c: F.coalesce(c, F.lit("-")))).alias("row_text"))


def densest_row(spark, sf_dir):
    return sheets.densest_rows(sheets.block_cells(_cells(spark, sf_dir)))


def detect_header(spark, sf_dir):
    located = headers.detect_exact(sheets.block_cells(_cells(spark, sf_dir)), views.aliases(spark))
    return _listed(located, *TABLE_KEY, "header_row_idx")


def detect_header_fuzzy(spark, sf_dir):
    cells = stage(sheets.block_cells(_cells(spark, sf_dir)), "head")
    alias = views.aliases(spark)
    rest = headers.without_header(cells, headers.detect_exact(cells, alias))
    return _listed(headers.detect_fuzzy(rest, alias), *TABLE_KEY, "header_row_idx")


def similar_words(spark, sf_dir):
    """Every distinct word of the documents against the alias table."""
    words = (
        views.table(spark, sf_dir, "documents")
        .select(F.explode(F.split("text", r"\s+")).alias("word"))
        .select(match_key(F.col("word")).alias("word"))
        .filter(F.col("word") != "")
        .distinct()
        .select(F.explode(F.array(F.lit("CO3"), F.lit(ALL_COMPANIES))).alias("scope"), "word")
    )
    return headers.similar_aliases(words, views.aliases(spark)).select("scope", "word", "field", F.round("ratio", 6).alias("ratio"))


def header_intersect(spark, sf_dir):
    hits = headers.exact_hits(sheets.block_cells(_cells(spark, sf_dir)), views.aliases(spark))
    return hits.distinct().groupBy("company_code", "file_path", "row_idx").agg(
        F.count("*").alias("n_hits"), F.count_distinct("field").alias("n_fields")
    )


def detect_fallback(spark, sf_dir):
    """Every usable table with the step that found it."""
    raw = stage(views.raw_sheets(spark, sf_dir), "raw")
    matches = headers.detect_headers(raw, views.aliases(spark))
    return _listed(matches, *TABLE_KEY, "col_end", "header_row_idx", "method", "identified_headers")


def infer_column_type(spark, sf_dir):
    typed = content.infer_column_types(_cells(spark, sf_dir))
    return typed.select(*content.COLUMN_KEY, "n_values", "column_type")


def categorise_column(spark, sf_dir):
    return content.categorise_columns(_cells(spark, sf_dir)).select(*content.COLUMN_KEY, "n_values", "category")


def content_columns(spark, sf_dir):
    return _listed(content.columns_by_content(_cells(spark, sf_dir)), *SHEET_KEY)


def data_rows(spark, sf_dir):
    raw = stage(views.raw_sheets(spark, sf_dir, ["std", "multi", "digits"]), "raw")
    cells = sheets.block_cells(sheets.head_cells(raw))
    found = stage(headers.detect_exact(cells, views.aliases(spark)).select(*TABLE_KEY, "header_row_idx"), "found")
    return extract.data_rows(raw, found).select(*TABLE_KEY, "row_idx", F.array_join("cells", "|", "-").alias("row_text"))


def numeric_name_cols(spark, sf_dir):
    raw = stage(views.raw_sheets(spark, sf_dir, ["std", "digits", "numname"]), "raw")
    cells = sheets.block_cells(sheets.head_cells(raw))
    found = headers.detect_exact(cells, views.aliases(spark))
    return extract.numeric_columns(raw, found).select(*TABLE_KEY, "col_idx", "number_share")


QUERIES = {
    q.__name__: q
    for q in (
        non_empty_columns, column_blocks, head_sample, pad_rows, densest_row, detect_header, detect_header_fuzzy,
        similar_words, header_intersect, detect_fallback, infer_column_type, categorise_column, content_columns,
        data_rows, numeric_name_cols,
    )
}

_HEAD = f"WITH {sql.sheets()},{sql.CELLS}"
_KEY = "company_code, file_path, sheet"
_EMPTY = "'' AS {}"

# The longest common block of two ranges: the longest substring of the first that the second has, the earliest in both.
_BLOCK = """list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(1, ahi - i + 1), lambda l:
    CASE WHEN instr(substr(b, blo + 1, bhi - blo), substr(a, i + 1, l)) > 0
         THEN {'size': l, 'i': -i, 'j': -(blo + instr(substr(b, blo + 1, bhi - blo), substr(a, i + 1, l)) - 1)} END))))"""
_LETTERS = " + ".join(f"least(length(a) - length(replace(a, '{x}', '')), length(b) - length(replace(b, '{x}', '')))" for x in "abcdefghijklmnopqrstuvwxyz")

ORACLES = {
    "similar_words": f"""WITH RECURSIVE {sql.ALIASES}, words AS (SELECT DISTINCT regexp_replace(lower(w), '[^a-z]', '', 'g') AS a FROM (
            SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents)),
        pairs AS (SELECT DISTINCT a, alias_norm AS b FROM words JOIN alias ON a <> ''
          AND 2 * least(length(a), length(alias_norm)) >= 0.7 * (length(a) + length(alias_norm)) - 1e-9),
        near AS (SELECT a, b FROM pairs WHERE 2 * ({_LETTERS}) >= 0.7 * (length(a) + length(b)) - 1e-9),
        blocks AS (
          SELECT a, b, alo, ahi, blo, bhi, {_BLOCK} AS m FROM (SELECT a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi FROM near)
          UNION ALL
          SELECT a, b, alo, ahi, blo, bhi, {_BLOCK} AS m FROM (SELECT a, b, r.alo AS alo, r.ahi AS ahi, r.blo AS blo, r.bhi AS bhi FROM (
            SELECT a, b, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}},
              {{'alo': m.size - m.i, 'ahi': ahi, 'blo': m.size - m.j, 'bhi': bhi}}]) AS r FROM blocks WHERE m IS NOT NULL)) WHERE alo < ahi AND blo < bhi
        ), ratios AS (SELECT a, b, 2.0 * sum(m.size) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b)
        SELECT company_code AS scope, a AS word, field, round(max(ratio), 6)::DOUBLE AS ratio FROM ratios JOIN alias ON alias_norm = b
        WHERE ratio >= 0.7 GROUP BY ALL""",
    "non_empty_columns": f"{_HEAD} SELECT DISTINCT {_KEY}, CAST(col_idx AS INTEGER) AS col_idx FROM cells",
    "column_blocks": f"{_HEAD},{sql.BLOCKS} SELECT * FROM blocks",
    "head_sample": f"""WITH {sql.sheets()} SELECT {_KEY}, count(*) AS n_rows, max(row_idx) AS last_row,
        CAST(sum(len(cells)) AS BIGINT) AS n_cells FROM sheets WHERE row_idx < 50 GROUP BY ALL""",
    "pad_rows": f"""WITH {sql.sheets("std", "two")}, w AS (SELECT {_KEY}, max(len(cells)) AS width FROM sheets GROUP BY ALL)
        SELECT {_KEY}, row_idx, width, array_to_string(list_transform(list_resize(cells, width), lambda x: coalesce(x, '-')), '|') AS row_text
        FROM sheets JOIN w USING ({_KEY})""",
    "densest_row": f"""{_HEAD},{sql.BLOCKS}, n AS (SELECT {_KEY}, col_start, row_idx, count(*) AS n_cells FROM bcells GROUP BY ALL)
        SELECT {_KEY}, col_start, row_idx, n_cells FROM n
        QUALIFY row_number() OVER (PARTITION BY {_KEY}, col_start ORDER BY n_cells DESC, row_idx) = 1""",
    "detect_header": f"{_HEAD},{sql.BLOCKS},{sql.HITS} SELECT * FROM located",
    "header_intersect": f"""{_HEAD},{sql.BLOCKS},{sql.HITS} SELECT company_code, file_path, row_idx, count(*) AS n_hits,
        count(DISTINCT field) AS n_fields FROM hits GROUP BY ALL""",
    "infer_column_type": f"""{_HEAD}, s AS (SELECT {_KEY}, col_idx, {sql.SHARES} FROM cells GROUP BY ALL)
        SELECT {_KEY}, col_idx, n_values, {sql.COLUMN_TYPE} AS column_type FROM s""",
    "categorise_column": f"""{_HEAD}, s AS (SELECT {_KEY}, col_idx, {sql.SHARES} FROM cells GROUP BY ALL)
        SELECT {_KEY}, col_idx, n_values, {sql.CATEGORY} AS category FROM s""",
    "content_columns": f"""{_HEAD}, s AS (SELECT {_KEY}, col_idx, {sql.SHARES} FROM cells GROUP BY ALL),
        t AS (SELECT {_KEY}, col_idx, {sql.COLUMN_TYPE} AS ty FROM s),
        n AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, ty ORDER BY col_idx) AS i,
              count(*) FILTER (ty = 'name') OVER (PARTITION BY {_KEY}) AS names FROM t)
        SELECT {_KEY},
          coalesce(string_agg(CASE WHEN ty = 'name' AND (names < 2 OR i > 2) THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS name_cols,
          coalesce(string_agg(CASE WHEN ty = 'name' AND names >= 2 AND i <= 2 THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS pair_cols,
          coalesce(string_agg(CASE WHEN ty = 'sex' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS sex_cols,
          coalesce(string_agg(CASE WHEN ty = 'dob' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS dob_cols,
          coalesce(string_agg(CASE WHEN ty = 'policynum' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS policy_cols
        FROM n GROUP BY ALL""",
    "data_rows": f"""WITH {sql.sheets("std", "multi", "digits")},{sql.CELLS},{sql.BLOCKS},{sql.HITS}
        SELECT {_KEY}, col_start, row_idx, array_to_string(list_transform(cells, lambda x: coalesce(x, '-')), '|') AS row_text
        FROM sheets JOIN anchors USING ({_KEY}) WHERE row_idx > header_row_idx""",
    "numeric_name_cols": f"""WITH {sql.sheets("std", "digits", "numname")},{sql.CELLS},{sql.BLOCKS},{sql.HITS},
        v AS (SELECT DISTINCT a.{_KEY.replace(", ", ", a.")}, a.col_start, c.row_idx, h.col_idx, c.value FROM anchors a
          JOIN hits h ON h.file_path = a.file_path AND h.col_start = a.col_start AND h.row_idx = a.header_row_idx
          JOIN all_cells c ON c.file_path = a.file_path AND c.col_idx = h.col_idx
          WHERE h.field IN ('name', 'firstlastname') AND c.row_idx > a.header_row_idx AND c.row_idx <= a.header_row_idx + 100
            AND c.value <> '')
        SELECT {_KEY}, col_start, col_idx, avg(CASE WHEN regexp_matches(trim(value), '^[0-9]+$') THEN 1.0 ELSE 0.0 END) AS number_share
        FROM v GROUP BY ALL HAVING number_share >= 0.9""",
    "detect_fallback": f"""WITH {sql.PERSONS}, f AS (SELECT DISTINCT company_code, file_no FROM persons),
        m(fam, col_start, col_end, header_row_idx, name_cols, pair_cols, sex_cols, dob_cols, policy_cols, method, identified_headers) AS (VALUES
          ('std', 0, 3, 2, '0', '', '1', '2', '3', 'exact', 'Member Name, Gender, Born, Contract No'),
          ('multi', 0, 2, 0, '0,1', '', '', '', '2', 'exact', 'Name, Name, Contract No'),
          ('pair', 0, 4, 0, '', '0,1,2,3', '', '', '4', 'exact', 'FamilyName, GivenName, FamilyName, GivenName, Contract No'),
          ('digits', 0, 3, 0, '0', '1,2', '', '', '3', 'exact', 'Name, FamilyName, GivenName, Contract No'),
          ('bare', 0, 3, -1, '0', '', '1', '2', '3', 'content', ''),
          ('two', 0, 1, 0, '0', '', '', '', '1', 'exact', 'Name, Contract No'),
          ('two', 3, 4, 0, '3', '', '4', '', '', 'exact', 'Whole Name, Gender'),
          ('typo', 0, 3, 0, '0', '', '1', '2', '3', 'fuzzy', 'Membr Nam, Gendr, Brth Date, Contract Nmber'),
          ('numname', 0, 1, 0, '0', '', '', '', '1', 'exact', 'Name, ContractNo'))
        SELECT company_code, '/in/' || fam || '_' || CAST(file_no AS VARCHAR) || '.csv' AS file_path, 'S1' AS sheet, col_start, col_end,
          header_row_idx, name_cols, pair_cols, sex_cols, dob_cols, policy_cols, method,
          CASE WHEN company_code = 'CO3' THEN replace(identified_headers, 'Member Name', 'Assured') ELSE identified_headers END AS identified_headers
        FROM f CROSS JOIN m""",
}

ORACLES["detect_header_fuzzy"] = f"""WITH {sql.PERSONS} SELECT DISTINCT company_code, '/in/typo_' || CAST(file_no AS VARCHAR) || '.csv' AS file_path, 'S1' AS sheet,
    0 AS col_start, CAST(0 AS BIGINT) AS header_row_idx, '0' AS name_cols, '' AS pair_cols, '1' AS sex_cols, '2' AS dob_cols, '3' AS policy_cols FROM persons"""

_INT = "INTEGER"
for _name, _types in {
    "column_blocks": {"col_start": _INT, "col_end": _INT, "table_idx": _INT}, "pad_rows": {"width": _INT},
    "densest_row": {"col_start": _INT}, "detect_header": {"col_start": _INT}, "detect_fallback": {"header_row_idx": "BIGINT"},
    "infer_column_type": {"col_idx": _INT}, "categorise_column": {"col_idx": _INT}, "data_rows": {"col_start": _INT},
    "numeric_name_cols": {"col_start": _INT, "col_idx": _INT},
}.items():
    ORACLES[_name] = sql.typed(ORACLES[_name], **_types)
