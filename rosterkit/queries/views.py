"""Inputs that Spark derives from the provided tables: raw sheets, run log, alias library, requests.

Every view covers its whole tables. Files are rendered with at most ``FILE_ROWS`` rows each, so the number of files
grows with the data and no view needs a window over a growing group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterkit.functions import match_key
from rosterkit.schema import ALL_COMPANIES

FILE_ROWS = 200
COMPANIES = 7

# A small generic alias table; larger libraries are user input.
GENERIC_ALIASES = {
    "name": ["Name", "Member Name", "Whole Name"],
    "firstlastname": ["Given Name", "Family Name"],
    "sex": ["Gender", "Sex Code"],
    "dob": ["Born", "Birth Date"],
    "policynum": ["Contract No", "Contract Number", "Cover Ref"],
}
COMPANY_ALIASES = {"CO3": {"name": ["Assured"]}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aliases(spark: SparkSession) -> DataFrame:
    """``alias(company_code, field, alias_norm)`` with ``*`` for all companies."""
    rows = [(ALL_COMPANIES, f, a) for f, texts in GENERIC_ALIASES.items() for a in texts]
    rows += [(c, f, a) for c, fields in COMPANY_ALIASES.items() for f, texts in fields.items() for a in texts]
    texts = spark.createDataFrame(rows, "company_code string, field string, alias_text string")
    return texts.select("company_code", "field", match_key(F.col("alias_text")).alias("alias_norm"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person per customer: names from ``part``, birth date from the customer's first order."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    first_order = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("k"))
        .agg(F.min("o_orderdate").cast("date").alias("d"))
    )
    words = F.split("p_name", " ")
    # Each person fans out to a row of every layout, so the small input is spread first.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        customer.repartition(tasks, "k").join(part, "k")
        .join(first_order, "k", "left")
        .select(
            "k", "c_name", "p_name", "d",
            F.floor(F.col("k") / FILE_ROWS).cast("long").alias("file_no"),
            (F.col("k") % FILE_ROWS).alias("r"),
            words[0].alias("w1"), words[1].alias("w2"),
            F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij").alias("tag"),
        )
        .withColumn("company_code", F.concat(F.lit("CO"), (F.col("file_no") % COMPANIES).cast("string")))
        .withColumn("policy", F.concat(F.lit("P"), F.lpad(F.col("k").cast("string"), 6, "0")))
        .withColumn("sex_text", sex_text(F.col("k")))
        .withColumn("date_text", date_text(F.col("d"), F.col("k")))
        .withColumn("iso_date", F.coalesce(F.date_format("d", "yyyy-MM-dd"), F.lit("")))
    )


def sex_text(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ["M", "f", "Male", "FEMALE", ""])), (k % 5 + 1).cast("int"))


def date_text(d: Column, k: Column) -> Column:
    """The date in one of seven layouts; day-first only where the day cannot be a month."""
    layouts = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MMMM d, yyyy", None, "dd-MMM-yy"]
    text = F.when(F.dayofmonth(d) > 12, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy.MM.dd"))
    chosen = F.when(k % 7 == 5, text)
    for i, layout in enumerate(layouts):
        if layout:
            chosen = chosen.when(k % 7 == i, F.date_format(d, layout))
    return F.coalesce(chosen, F.lit(""))


def _cells(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v).cast("string") for v in values])


def sheet_families() -> dict[str, tuple[list[Column], Column]]:
    """Sheet layouts: rows above the data, and the cells of a data row."""
    c = F.col
    swapped = F.concat_ws(" ", "w2", "w1")
    first_header = F.when(c("company_code") == "CO3", "Assured").otherwise("Member Name")
    return {
        "std": (
            [_cells("Delivery list"), _cells("", "  ", None), _cells(first_header, "Gender", "Born", "Contract No")],
            _cells(F.when(c("k") % 11 == 0, "").otherwise(c("p_name")), c("sex_text"), c("date_text"), c("policy")),
        ),
        "multi": (
            [_cells("Name", "Name", "Contract No")],
            _cells(c("p_name"), F.when(c("k") % 3 == 0, "").otherwise(swapped), c("policy")),
        ),
        "pair": (
            [_cells("FamilyName", "GivenName", "FamilyName", "GivenName", "Contract No")],
            _cells(
                c("w1"), c("w2"), F.when(c("k") % 4 == 0, " ").otherwise(c("w2")),
                F.when(c("k") % 4 == 0, " ").otherwise(c("tag")), c("policy"),
            ),
        ),
        "digits": (
            [_cells("Name", "FamilyName", "GivenName", "Contract No")],
            _cells(c("c_name"), c("w1"), c("w2"), c("policy")),
        ),
        "bare": ([], _cells(F.concat_ws(" ", "w1", "w2", "tag"), c("sex_text"), c("iso_date"), c("policy"))),
        "two": (
            [_cells("Name", "Contract No", None, "Whole Name", "Gender")],
            _cells(c("p_name"), c("policy"), None, swapped, c("sex_text")),
        ),
        "typo": (
            [_cells("Membr Nam", "Gendr", "Brth Date", "Contract Nmber")],
            _cells(c("p_name"), c("sex_text"), c("iso_date"), c("policy")),
        ),
        "numname": (
            [_cells("Name", "ContractNo")],
            _cells(F.lpad(c("k").cast("string"), 9, "1"), c("policy")),
        ),
        "nomatch": (
            [_cells("Premium", "Amount")],
            _cells((c("k") * 10).cast("string"), F.concat(c("r").cast("string"), F.lit(".50"))),
        ),
    }


def raw_sheets(spark: SparkSession, sf_dir: str, families: list[str] | None = None) -> DataFrame:
    """Raw sheets of the given layouts (all by default), rendered in one pass over the persons."""
    rows = []
    for family, (above, data) in sheet_families().items():
        if families and family not in families:
            continue
        label = F.lit(family).alias("family")
        position = (F.col("r") + len(above)).cast("long").alias("row_idx")
        rows.append(F.array(F.struct(label, position, data.alias("cells"))))
        if above:
            header = F.array(*[
                F.struct(label, F.lit(i).cast("long").alias("row_idx"), cells.alias("cells"))
                for i, cells in enumerate(above)
            ])
            rows.append(F.when(F.col("r") == 0, header).otherwise(F.array().cast("array<struct<family:string,row_idx:bigint,cells:array<string>>>")))
    return (
        persons(spark, sf_dir)
        .select("company_code", "file_no", F.explode(F.concat(*rows)).alias("row"))
        .select(
            "company_code",
            F.concat(F.lit("/in/"), F.col("row.family"), F.lit("_"), F.col("file_no").cast("string"), F.lit(".csv")).alias("file_path"),
            F.lit("S1").alias("sheet"),
            "row.row_idx", "row.cells",
        )
    )


# --- Run log, from orders (runs) and lineitem (their files) ---

RUN_COMPANIES = 10


def _month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-01")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("C"), (F.col("o_custkey") % RUN_COMPANIES).cast("string")).alias("company_code"),
        _month(F.col("o_orderdate")).alias("email_received_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"),
        status.alias("status"),
        F.col("o_orderpriority").alias("triggered_user"),
    )


def output_path() -> Column:
    return F.concat(F.lit("/out/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"))


def file_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file log per line; returned lines are files that failed."""
    failed = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("log_id"),
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("f_"), F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("file_name"),
        F.concat(F.lit("/in/f_"), F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("file_path"),
        F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("sheet_name"),
        F.when(~failed, output_path()).alias("output_path"),
        F.when(failed, "ValueError: unreadable").alias("error_msg"),
        F.when(~failed, F.col("l_quantity").cast("long")).alias("output_row_count"),
    )


def stored_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster rows of every written output; every 37th supplier's outputs are gone."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") != "R") & (F.col("l_suppkey") % 37 != 0))
    text = lambda c: F.col(c).cast("string")
    return lines.join(part, "l_partkey").join(order, "l_orderkey").select(
        output_path().alias("output_path"),
        F.lit("").alias("SURNAME"), F.lit("").alias("FIRST_NAME"), F.upper("p_name").alias("COMPLETE_NAME"),
        F.when(F.col("l_partkey") % 2 == 0, "M").otherwise("F").alias("SEX"), F.lit("").alias("DATE_OF_BIRTH"),
        F.concat(F.lit("C"), (F.col("o_custkey") % RUN_COMPANIES).cast("string")).alias("CMPY_NO"),
        F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("0"), (F.col("l_partkey") % 40).cast("string"))).alias("POLICY_NUMBER"),
        F.concat(F.lit("/in/f_"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".csv")).alias("FILE_PATH"),
        F.concat(F.lit("260"), (F.col("l_linenumber") % 2).cast("string")).alias("SHEET"),
    )


# --- Alias library: customers' companies use words of the documents and part names as aliases ---

LIB_CATEGORIES = ["name", "firstlastname", "sex", "dob", "policynum"]


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lib(company_code, category, alias_text, pos)``: one entry per line; a company is a supplier."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    spelled = F.when(F.col("l_linenumber") % 2 == 0, F.initcap("p_name")).otherwise(F.concat_ws("_", F.split("p_name", " ")))
    categories = F.array(*map(F.lit, LIB_CATEGORIES))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        F.concat(F.lit("L"), F.col("l_suppkey").cast("string")).alias("company_code"),
        F.element_at(categories, (F.col("l_partkey") % 5 + 1).cast("int")).alias("category"),
        F.concat(spelled, F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_type"), F.translate(F.col("l_suppkey").cast("string"), "0123456789", "abcdefghij"))).otherwise("")).alias("alias_text"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("pos"),
    )


def library_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lib_notes(company_code, note)``: a note per order; some carry a warning word."""
    k = F.col("o_orderkey")
    word = F.when(k % 101 == 0, "UNSAFE term").when(k % 103 == 0, "Not one-row header").when(k % 107 == 0, "face-sheet").otherwise("plain")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("L"), (F.col("o_custkey") % 100).cast("string")).alias("company_code"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), word).alias("note"),
    )


# --- Scan requests, from events ---

def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; some lack a field or carry a wrong one."""
    e, u = F.col("event_id"), F.col("user_id")
    names = F.format_string('["f_%d.csv", "f_%d.csv"]', u % 40, e % 50)
    files = F.when(e % 17 == 0, F.lit(None)).when(e % 13 == 0, "f_1.csv").when(e % 11 == 0, "[]").otherwise(names)
    day = F.when(u % 7 == 0, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select(
        e.alias("request_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("arrival"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("C"), (u % RUN_COMPANIES).cast("string"))).alias("company_code"),
        day.alias("email_received_date"),
        files.alias("files"),
        F.col("event_type").alias("user"),
        F.lit("/in").alias("input_folder"),
    )
