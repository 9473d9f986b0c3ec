"""Queries of the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterkit import functions as R
from rosterkit.operators import naming
from rosterkit.queries import sql, views
from rosterkit.schema import CODE_SUGGESTIONS


def match_key(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", R.match_key(F.col("text")).alias("match_key"))


def clean_name(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", R.clean_name(F.col("text")).alias("clean_name"))


def normalize_sex(spark, sf_dir):
    """Sex texts with padding and other values."""
    k = F.col("c_custkey")
    text = F.when(k % 13 == 0, "u").when(k % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), views.sex_text(k), F.lit(" ")))
    return views.table(spark, sf_dir, "customer").select("c_custkey", R.normalize_sex(text).alias("sex"))


def parse_date(spark, sf_dir):
    """Every order date in one of twelve layouts, some of them no dates."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    layouts = [
        "yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MMMM d, yyyy", "yyyy.MM.dd", "dd-MMM-yy",
        "yyyy-MM-dd HH:mm:ss", "d MMM yyyy", "M/d/yy",
    ]
    text = F.when(k % 12 == 10, F.when(F.dayofmonth(d) > 12, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy/MM/dd")))
    text = text.when(k % 12 == 11, F.concat(F.lit("ref "), k.cast("string")))
    for i, layout in enumerate(layouts):
        text = text.when(k % 12 == i, F.date_format(d, layout))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", R.parse_date(text).alias("parsed"))


def digit_flags(spark, sf_dir):
    """Digit and bare-number tests on every word of the documents."""
    words = views.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id").agg(
        F.count_if(R.has_digit(F.col("w"))).alias("n_with_digit"),
        F.count_if(R.is_bare_number(F.col("w"))).alias("n_bare"),
        F.count_if(R.is_blank(F.col("w"))).alias("n_blank"),
    )


def mask_middle(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", R.mask_middle(F.col("text")).alias("masked"))


def _files(spark, sf_dir):
    """A file name per page, from its url and a type that varies."""
    types = F.array(*map(F.lit, ["csv", "TXT", "rpt", "xlsx", "XLS", "xlsm", "zip", "7z", "tar", "pdf", "json", ""]))
    ext = F.element_at(types, (F.col("page_id") % 12 + 1).cast("int"))
    host = F.regexp_extract("url", "https?://([^/]*)", 1)
    return views.table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("/in/"), host, F.when(ext != "", F.concat(F.lit("/data."), ext)).otherwise("/data")).alias("path")
    )


def file_kind(spark, sf_dir):
    path = F.col("path")
    return _files(spark, sf_dir).select("page_id", R.extension(path).alias("extension"), R.file_kind(path).alias("kind"))


def company_key(spark, sf_dir):
    raw = F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("\t "), F.lower("n_name"), F.lit(" ")))
    nation = views.table(spark, sf_dir, "nation")
    customer = views.table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", R.company_key(raw).alias("company_key"))


def date_display(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", R.compact_date(iso).alias("compact"), R.display_date(iso).cast("string").alias("shown")
    )


def report_names(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    company = F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string"))
    return orders.select(
        "o_orderkey", R.output_folder("/out", iso, company).alias("folder"),
        R.report_name("Compiled_Log", iso, company, F.col("o_orderkey") % 3 + 1).alias("report"),
    )


def complete_name(spark, sf_dir):
    """Full name from a cleaned name, two parts and the raw text, with nulls and digits in all places."""
    p = views.persons(spark, sf_dir)
    raw = F.when(F.col("k") % 5 == 0, F.col("c_name")).when(F.col("k") % 5 == 1, "").when(F.col("k") % 5 == 2, F.lit(None)).otherwise(F.col("p_name"))
    surname = F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") % 3 == 1, "").otherwise(F.upper("w1"))
    first = F.upper("w2")
    return p.select(
        "k",
        R.complete_name(R.clean_name(raw), surname, first).alias("complete_name"),
        R.complete_name(R.clean_name(raw), surname, first, raw).alias("checked_name"),
    )


def unique_names(spark, sf_dir):
    """Safe output names; a clash gets _1, _2, ... in page order."""
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$|\d+", "").alias("name"))
    return naming.unique_names(pages, "name", ["page_id"]).select("page_id", "unique_name")


def search_codes(spark, sf_dir):
    """First suggestions for a search term among the customer names."""
    return (
        views.table(spark, sf_dir, "customer")
        .filter(R.contains_text(F.col("c_name"), " ER#0000001 "))
        .select("c_name").orderBy("c_name").limit(CODE_SUGGESTIONS)
    )


def known_codes(spark, sf_dir):
    """Codes of two sources, each once, sorted."""
    orders = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("code"))
    customers = views.table(spark, sf_dir, "customer").select(F.upper("c_mktsegment").alias("code"))
    return orders.union(customers).distinct().orderBy("code")


def new_files(spark, sf_dir):
    """Files present after but not before."""
    files = _files(spark, sf_dir)
    after = files.select(F.concat("path", F.lit("#"), (F.col("page_id") % 9).cast("string")).alias("path"))
    before = files.filter(F.col("page_id") % 2 == 0).select(F.concat("path", F.lit("#"), (F.col("page_id") % 9).cast("string")).alias("path"))
    return after.subtract(before)


QUERIES = {
    q.__name__: q
    for q in (
        match_key, clean_name, normalize_sex, parse_date, digit_flags, mask_middle, file_kind, company_key, date_display,
        report_names, complete_name, unique_names, search_codes, known_codes, new_files,
    )
}

_FILES = """files AS (SELECT page_id, ext, '/in/' || regexp_extract(url, 'https?://([^/]*)', 1) || CASE WHEN ext <> '' THEN '/data.' || ext ELSE '/data' END AS path
  FROM (SELECT page_id, url, ['csv','TXT','rpt','xlsx','XLS','xlsm','zip','7z','tar','pdf','json',''][page_id % 12 + 1] AS ext FROM pages))"""

ORACLES = {
    "match_key": "SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS match_key FROM documents",
    "clean_name": """SELECT doc_id, array_to_string(list_filter(string_split_regex(
        regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z\\s]', ' ', 'g'), '\\s+'), lambda w: w NOT IN ('', 'DECEASED')), ' ') AS clean_name FROM documents""",
    "normalize_sex": """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'U' WHEN c_custkey % 17 = 0 THEN ''
        ELSE CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE '' END END AS sex FROM customer""",
    "parse_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 11 THEN '' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS parsed FROM orders",
    "digit_flags": """SELECT doc_id, count(*) FILTER (regexp_matches(w, '[0-9]')) AS n_with_digit,
        count(*) FILTER (regexp_matches(trim(w, chr(10) || chr(9) || chr(13) || ' '), '^[0-9]+$')) AS n_bare,
        count(*) FILTER (trim(w, chr(10) || chr(9) || chr(13) || ' ') = '') AS n_blank
        FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1""",
    "mask_middle": """SELECT doc_id, CASE WHEN length(text) = 0 THEN NULL WHEN length(text) <= 2 THEN repeat('*', length(text))
        ELSE left(text, 1) || repeat('*', length(text) - 2) || right(text, 1) END AS masked FROM documents""",
    "file_kind": f"""WITH {_FILES} SELECT page_id, lower(ext) AS extension, CASE WHEN lower(ext) IN ('xlsx','xls','xlsm','xlsb') THEN 'Excel'
        WHEN lower(ext) IN ('csv','txt','rpt') THEN 'Text' WHEN lower(ext) IN ('zip','zipx','tar','7z','rar') THEN 'Archive' ELSE 'Unknown' END AS kind FROM files""",
    "company_key": "SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE n_name END AS company_key FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "date_display": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders",
    "report_names": """SELECT o_orderkey, '/out/' || strftime(o_orderdate, '%Y%m%d') || '/C' || CAST(o_custkey % 50 AS VARCHAR) AS folder,
        'Compiled_Log_' || strftime(o_orderdate, '%Y%m%d') || '_C' || CAST(o_custkey % 50 AS VARCHAR) || '_' || CAST(o_orderkey % 3 + 1 AS VARCHAR) AS report FROM orders""",
    "complete_name": f"""WITH {sql.PERSONS}, x AS (SELECT k, upper(p_name) AS p, trim(s || ' ' || upper(w2)) AS joined, k % 5 AS m
        FROM (SELECT *, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE upper(w1) END AS s FROM persons))
        SELECT k, CASE m WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN joined WHEN 2 THEN joined ELSE p END AS complete_name,
          CASE WHEN m < 3 THEN joined ELSE p END AS checked_name FROM x""",
    "unique_names": """WITH s AS (SELECT page_id, left(regexp_replace(regexp_replace(url, '[?#].*$|\\d+', '', 'g'), '[^a-zA-Z0-9_\\-]', '_', 'g'), 200) AS safe FROM pages),
        n AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY page_id) AS n FROM s)
        SELECT page_id, CASE WHEN n = 1 THEN safe ELSE safe || '_' || CAST(n - 1 AS VARCHAR) END AS unique_name FROM n""",
    "search_codes": "SELECT c_name FROM customer WHERE contains(lower(c_name), 'er#0000001') ORDER BY c_name LIMIT 20",
    "known_codes": "SELECT 'C' || CAST(o_custkey % 50 AS VARCHAR) AS code FROM orders UNION SELECT upper(c_mktsegment) FROM customer ORDER BY 1",
    "new_files": f"""WITH {_FILES} SELECT path || '#' || CAST(page_id % 9 AS VARCHAR) AS path FROM files
        EXCEPT SELECT path || '#' || CAST(page_id % 9 AS VARCHAR) FROM files WHERE page_id % 2 = 0""",
}
