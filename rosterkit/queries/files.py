"""Queries of the file sources: the derived sheets are written as files and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterkit.functions import file_name
from rosterkit.queries import render, sql, views
from rosterkit.sources import alias_files, alias_library, archives, catalog, delimited, sinks, workbooks

_TEXT_FAMILIES = ("std", "multi", "pair", "two")


def _text_folder(spark, sf_dir):
    raw = views.raw_sheets(spark, sf_dir, list(_TEXT_FAMILIES))
    return render.write_files(render.delimited(raw), render.folder(spark, "text"))


def _shown(rows):
    """Rows by file name, cells joined."""
    return rows.select(
        file_name(F.col("file_path")).alias("file"), "row_idx",
        F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("-"))), "|").alias("row_text"),
    )


def file_catalog(spark, sf_dir):
    listed = catalog.file_catalog(spark, _text_folder(spark, sf_dir))
    return listed.select("file_name", "extension", "kind", "length")


def sniff_dialect(spark, sf_dir):
    files = catalog.file_catalog(spark, _text_folder(spark, sf_dir))
    return delimited.sniff_dialects(files).select(file_name(F.col("path")).alias("file"), "encoding", "separator", "quote", "width", "error")


def scan_delimited(spark, sf_dir):
    folder = _text_folder(spark, sf_dir)
    rows, _ = delimited.scan_delimited(spark, folder, catalog.file_catalog(spark, folder))
    return _shown(rows)


def scan_split_text(spark, sf_dir):
    """The same files cut into splits of 64 kB; several smaller files share a split instead of having a task each."""
    folder = _text_folder(spark, sf_dir)
    settings = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    usual = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:  # the scan stages its rows, so the setting holds for this read only
        rows, _ = delimited.scan_delimited(spark, folder, catalog.file_catalog(spark, folder))
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)
    return _shown(rows)


def scan_odd_text(spark, sf_dir):
    """Customers in files with a byte order mark, late accents in code page 1252, stray and doubled quotes."""
    folder = render.write_files(render.odd_customers(views.table(spark, sf_dir, "customer")), render.folder(spark, "odd"))
    rows, _ = delimited.scan_delimited(spark, folder, catalog.file_catalog(spark, folder))
    return _shown(rows)


def scan_quoted_text(spark, sf_dir):
    """Whole documents as quoted multi-line fields."""
    folder = render.write_files(render.quoted_documents(views.table(spark, sf_dir, "documents")), render.folder(spark, "docs"))
    rows, _ = delimited.scan_delimited(spark, folder, catalog.file_catalog(spark, folder))
    return rows.select(F.get("cells", 0).cast("long").alias("doc_id"), F.size("cells").alias("n_cells"), F.md5(F.get("cells", 1)).alias("text_md5"))


def scan_workbook(spark, sf_dir):
    raw = views.raw_sheets(spark, sf_dir, ["std", "digits", "two"])
    folder = render.write_files(render.workbooks(raw), render.folder(spark, "books"))
    rows, _ = workbooks.scan_workbooks(catalog.file_catalog(spark, folder))
    return _shown(rows).withColumn("sheet", F.lit("S1"))


def expand_archive(spark, sf_dir):
    """Members of all archives, nested ones too, with the errors of unreadable ones."""
    raw = views.raw_sheets(spark, sf_dir, ["std", "multi"])
    folder = render.write_files(render.archives(render.delimited(raw)), render.folder(spark, "archives"))
    members, errors = archives.expand_archives(spark, catalog.file_catalog(spark, folder), render.folder(spark, "unpacked"))
    found = members.select(file_name(F.col("parent")).alias("archive"), "file_name", "kind", F.lit(None).cast("string").alias("error"))
    failed = errors.select(file_name(F.col("file_path")).alias("archive"), F.col("error_msg").alias("error"))
    return found.unionByName(failed, allowMissingColumns=True)


def reread_roster(spark, sf_dir):
    """Stored outputs written below a folder with brackets in its name and read back as text."""
    stored = views.stored_rosters(spark, sf_dir).withColumnRenamed("output_path", "named").select(
        "*", F.col("CMPY_NO").alias("company_code"), F.lit("2024-01-01").alias("email_received_date"),
        F.substring_index("FILE_PATH", "_", -1).substr(1, 1).cast("long").alias("run_id"),
    )
    path = render.folder(spark, "out[Sheet 1]")
    sinks.write_rosters(stored, path, rows_per_file=1000)
    return sinks.reread_rosters(spark, path, extra=("named",)).drop("output_path").withColumnRenamed("named", "output_path")


def load_aliases(spark, sf_dir):
    """Defaults from the nations, one company file per supplier; some files are broken or partly wrong."""
    nation, supplier = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "supplier")
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    base = nation.agg(F.to_json(F.struct(
        F.sort_array(F.collect_list(F.concat(F.lit("Name "), letters(F.col("n_nationkey"))))).alias("name"),
    )).alias("text")).select(F.lit("defaults.json").alias("name"), F.encode("text", "UTF-8").alias("content"))
    k = F.col("s_suppkey")
    text = (
        F.when(k % 10 == 0, "{not json")
        .when(k % 10 == 1, F.format_string('{"name": "Solo %d", "dob": ["Born %s"]}', k, letters(k)))
        .when(k % 10 == 2, F.format_string('{"sex": ["Sex %s", 7, " "], "extra": ["x"]}', letters(k)))
        .otherwise(F.format_string('{"name": ["Holder %s"], "policynum": ["No. %s"]}', letters(k), letters(k)))
    )
    own = supplier.select(F.format_string("s%d.json", k).alias("name"), F.encode(text, "UTF-8").alias("content"))
    defaults_at = render.write_files(base, render.folder(spark, "defaults"))
    companies_at = render.write_files(own, render.folder(spark, "companies"))
    defaults, companies, warnings = alias_files.load_aliases(spark, defaults_at, companies_at)
    rows = defaults.select(F.lit("*").alias("company_code"), "field", "alias_norm").unionByName(companies)
    return rows.select("company_code", "field", "alias_norm", F.lit(None).cast("string").alias("warning")).unionByName(
        warnings.select(F.col("source").alias("company_code"), "warning"), allowMissingColumns=True
    )


def parse_alias_library(spark, sf_dir):
    """Library documents with twenty parts per company and ten companies per document."""
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type")
    label = F.element_at(F.array(*map(F.lit, ["Name", "First/Last", "Sex", "DOB", "Policy #", "Prem", "—"])), (F.col("k") % 7 + 1).cast("int"))
    code = F.replace("p_name", F.lit(" "), F.lit(""))
    cell = F.when(F.col("k") % 2 == 0, F.concat(F.lit("`"), code, F.lit("` → "), F.upper("p_name"), F.lit("/alt · `"), code, F.lit("x`"))).otherwise(F.concat(F.lit("`"), code, F.lit("`, plain")))
    row = F.concat(F.lit("| "), label, F.lit(" | "), F.when(F.col("k") % 7 == 6, "—").otherwise(cell), F.lit(" | "), F.when(F.col("k") % 5 == 0, F.concat(F.lit("Unsafe "), "p_type")).otherwise(""), F.lit(" |"))
    company = F.floor(F.col("k") / 20)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))), lambda r: r["row"])
    blocks = part.groupBy(company.alias("c")).agg(ordered.alias("rows")).select("c", F.concat(
        F.format_string("## K%d", "c"), F.when(F.col("c") % 3 == 0, " (older layout)").otherwise(""), F.lit("\n\n"),
        F.when(F.col("c") % 4 == 0, "Face-sheet delivery.\n").otherwise(""),
        F.lit("| Category | Aliases | Notes |\n|---|---|---|\n"), F.array_join("rows", "\n"), F.lit("\n\n"),
    ).alias("block"))
    docs = blocks.groupBy(F.floor(F.col("c") / 10).alias("d")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "block"))), lambda b: b["block"]), "").alias("body")
    )
    folder = render.write_files(
        docs.select(F.format_string("lib_%d.md", "d").alias("name"), F.encode(F.concat(F.lit("# Library\n\nIntro.\n\n"), "body"), "UTF-8").alias("content")),
        render.folder(spark, "library"),
    )
    lib, notes, _ = alias_library.parse_library(spark, folder)
    entries = lib.groupBy("company_code", "category", F.col("alias_text").alias("text")).agg(F.count("*").alias("n"))
    return entries.unionByName(notes.groupBy("company_code", F.lit("note").alias("category"), F.col("note").alias("text")).agg(F.count("*").alias("n")))


QUERIES = {
    q.__name__: q
    for q in (
        file_catalog, sniff_dialect, scan_delimited, scan_split_text, scan_quoted_text, scan_odd_text, scan_workbook, expand_archive,
        reread_roster, load_aliases, parse_alias_library,
    )
}

_FILE = "regexp_extract(file_path, '([^/]+)$', 1)"
_TEXT = f"WITH {sql.sheets(*_TEXT_FAMILIES)}"
_ROW = "array_to_string(list_transform(cells, lambda x: coalesce(nullif(x, ''), '-')), '|')"
_NUMBER = "CAST(regexp_extract(file_path, '_([0-9]+)', 1) AS INTEGER)"
_LETTERS = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"

ORACLES = {
    "file_catalog": f"""{_TEXT}, l AS (SELECT {_FILE} AS file_name, {_NUMBER} AS n, cells FROM sheets)
        SELECT file_name, 'csv' AS extension, 'Text' AS kind,
          CAST(sum(list_sum(list_transform(cells, lambda x: length(coalesce(x, '')) + CASE WHEN n % 2 = 0 AND coalesce(x, '') <> '' THEN 2 ELSE 0 END)) + len(cells)) AS BIGINT) AS length
        FROM l GROUP BY file_name""",
    "sniff_dialect": f"""{_TEXT} SELECT {_FILE} AS file, 'utf-8' AS encoding, [',', ';', chr(9), '|'][any_value({_NUMBER}) % 4 + 1] AS separator, '"' AS quote,
        CAST(max(len(cells)) AS INTEGER) AS width, CAST(NULL AS VARCHAR) AS error FROM sheets GROUP BY 1""",
    "scan_delimited": f"{_TEXT} SELECT {_FILE} AS file, row_idx, {_ROW} AS row_text FROM sheets",
    "scan_odd_text": """
        SELECT 'odd_' || n || '.csv' AS file, row_number() OVER (PARTITION BY n ORDER BY k) - 1 AS row_idx,
            k || '|' || CASE
                WHEN n % 4 = 0 THEN 'é' WHEN n % 4 = 1 AND k % 50 = 49 THEN 'é ' WHEN n % 4 = 1 THEN 'e'
                WHEN n % 4 = 2 AND k % 50 = 25 THEN '"z' WHEN n % 4 = 2 THEN 'z' ELSE 'a"bx""y' END || '|' || repeat('x', 300) AS row_text
        FROM (SELECT c_custkey AS k, c_custkey // 50 AS n FROM customer)""",
    "scan_split_text": f"{_TEXT} SELECT {_FILE} AS file, row_idx, {_ROW} AS row_text FROM sheets",
    "scan_quoted_text": "SELECT doc_id, 2 AS n_cells, md5(text) AS text_md5 FROM documents",
    "scan_workbook": f"""WITH {sql.sheets("std", "digits", "two")}, t AS (SELECT {_FILE} AS file, row_idx, cells,
          len(cells) - coalesce(list_position(list_transform(list_reverse(cells), lambda x: coalesce(x, '') <> ''), true) - 1, len(cells)) AS used FROM sheets)
        SELECT replace(file, '.csv', '.xlsx') AS file, row_idx, array_to_string(list_transform(cells[1:used], lambda x: coalesce(nullif(x, ''), '-')), '|') AS row_text, 'S1' AS sheet FROM t""",
    "expand_archive": f"""WITH {sql.PERSONS}, f AS (SELECT DISTINCT fam || '_' || CAST(file_no AS VARCHAR) AS stem, file_no % 4 AS turn FROM persons CROSS JOIN (VALUES ('std'), ('multi')) t(fam))
        SELECT stem || CASE turn WHEN 2 THEN '.tar' ELSE '.zip' END AS archive, CASE turn WHEN 1 THEN stem || '.zip' ELSE stem || '.csv' END AS file_name,
          CASE turn WHEN 1 THEN 'Archive' ELSE 'Text' END AS kind, CAST(NULL AS VARCHAR) AS error FROM f WHERE turn < 3
        UNION ALL SELECT stem || '.zip', stem || '.csv', 'Text', NULL FROM f WHERE turn = 1
        UNION ALL SELECT stem || '.7z', NULL, NULL, 'ValueError: unsupported archive type: 7z' FROM f WHERE turn = 3""",
    "load_aliases": f"""SELECT DISTINCT '*' AS company_code, 'name' AS field, 'name' || {_LETTERS.format("n_nationkey")} AS alias_norm, CAST(NULL AS VARCHAR) AS warning FROM nation
        UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'dob', 'born' || {_LETTERS.format("s_suppkey")}, NULL FROM supplier WHERE s_suppkey % 10 = 1
        UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'sex', 'sex' || {_LETTERS.format("s_suppkey")}, NULL FROM supplier WHERE s_suppkey % 10 = 2
        UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'name', 'holder' || {_LETTERS.format("s_suppkey")}, NULL FROM supplier WHERE s_suppkey % 10 > 2
        UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'policynum', 'no' || {_LETTERS.format("s_suppkey")}, NULL FROM supplier WHERE s_suppkey % 10 > 2
        UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), NULL, NULL, unnest(CASE s_suppkey % 10 WHEN 0 THEN ['not a JSON object, defaults only'] WHEN 1 THEN ['field is no list: name']
          ELSE ['unknown key ignored: extra', 'non-text or empty entries dropped: sex'] END) FROM supplier WHERE s_suppkey % 10 < 3""",
    "parse_alias_library": """WITH p AS (SELECT p_partkey AS k, 'K' || CAST(p_partkey // 20 AS VARCHAR) AS company_code, p_partkey // 20 AS c, p_name, p_type,
          ['name', 'firstlastname', 'sex', 'dob', 'policynum', 'prem', NULL][p_partkey % 7 + 1] AS category,
          ['Name', 'First/Last', 'Sex', 'DOB', 'Policy #', 'Prem', '—'][p_partkey % 7 + 1] AS label FROM part),
        e AS (SELECT company_code, category, unnest(CASE WHEN k % 2 = 0 THEN [upper(p_name), replace(p_name, ' ', '') || 'x'] ELSE [replace(p_name, ' ', '')] END) AS text FROM p WHERE category IS NOT NULL
          UNION ALL SELECT company_code, 'note', '[' || label || '] Unsafe ' || p_type FROM p WHERE k % 5 = 0
          UNION ALL SELECT DISTINCT company_code, 'note', '[heading] older layout' FROM p WHERE c % 3 = 0
          UNION ALL SELECT DISTINCT company_code, 'note', 'Face-sheet delivery.' FROM p WHERE c % 4 = 0)
        SELECT company_code, category, text, count(*) AS n FROM e GROUP BY ALL""",
}

_ROSTER_SQL = """SELECT '/out/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS output_path,
  '' AS "SURNAME", '' AS "FIRST_NAME", upper(p_name) AS "COMPLETE_NAME", CASE WHEN l_partkey % 2 = 0 THEN 'M' ELSE 'F' END AS "SEX", '' AS "DATE_OF_BIRTH",
  'C' || CAST(o_custkey % 10 AS VARCHAR) AS "CMPY_NO", CASE WHEN l_partkey % 9 <> 0 THEN '0' || CAST(l_partkey % 40 AS VARCHAR) END AS "POLICY_NUMBER",
  '/in/f_' || CAST(l_suppkey % 5 AS VARCHAR) || '.csv' AS "FILE_PATH", '260' || CAST(l_linenumber % 2 AS VARCHAR) AS "SHEET",
  'C' || CAST(o_custkey % 10 AS VARCHAR) AS company_code, '2024-01-01' AS email_received_date, l_suppkey % 5 AS run_id
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND l_suppkey % 37 <> 0"""
ORACLES["reread_roster"] = _ROSTER_SQL
