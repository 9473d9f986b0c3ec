"""Alias configuration: one JSON file of defaults and one JSON file per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterkit.functions import company_key, file_name, is_blank, match_key
from rosterkit.schema import FIELDS
from rosterkit.sources.catalog import decoded_uri


class AliasConfigError(ValueError):
    """The defaults are unusable; there is no safe fallback for them."""


def _documents(spark: SparkSession, path: str) -> DataFrame:
    name = file_name(decoded_uri(F.col("_metadata.file_path")))
    return (
        spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
        .select(F.regexp_replace(name, r"\.json$", "").alias("source"), F.try_parse_json("value").alias("doc"))
        .withColumn("kind", F.schema_of_variant("doc"))
    )


def _is_object() -> Column:
    return F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))


def _entries(documents: DataFrame) -> DataFrame:
    """Every list entry of every known field, with its JSON type."""
    slots = documents.filter(_is_object()).select("source", "doc", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    value = None
    for field in FIELDS:
        item = F.try_variant_get("doc", f"$.{field}", "array<variant>")
        value = F.when(F.col("field") == field, item) if value is None else value.when(F.col("field") == field, item)
    return slots.select("source", "field", F.explode(value).alias("entry")).select(
        "source", "field", F.schema_of_variant("entry").alias("type"), F.try_variant_get("entry", "$", "string").alias("text")
    )


def _usable(entries: DataFrame) -> DataFrame:
    return entries.filter((F.col("type") == "STRING") & ~is_blank(F.col("text")))


def _warnings(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """Unreadable documents, unknown keys, fields that are no lists, dropped entries: one row each."""
    broken = documents.filter(~_is_object()).select("source", F.lit("not a JSON object, defaults only").alias("warning"))
    keys = documents.filter(_is_object()).select(
        "source", "doc", F.explode(F.map_keys(F.from_json(F.to_json("doc"), "map<string,string>"))).alias("key")
    )
    unknown = keys.filter(~F.col("key").isin(FIELDS)).select(
        "source", F.concat(F.lit("unknown key ignored: "), "key").alias("warning")
    )
    no_list = F.lit(False)
    for field in FIELDS:
        mine = F.col("key") == field
        no_list = no_list | (mine & F.try_variant_get("doc", f"$.{field}", "array<variant>").isNull())
    scalars = keys.filter(no_list).select("source", F.concat(F.lit("field is no list: "), "key").alias("warning"))
    dropped = (
        entries.filter((F.col("type") != "STRING") | is_blank(F.col("text"))).select("source", "field").distinct()
        .select("source", F.concat(F.lit("non-text or empty entries dropped: "), "field").alias("warning"))
    )
    return broken.unionByName(unknown).unionByName(scalars).unionByName(dropped)


def load_aliases(spark: SparkSession, defaults_path: str, companies_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(defaults(field, alias_norm), own(company_code, field, alias_norm), warnings(source, warning))``.

    A broken company file leaves that company with the defaults; broken defaults raise.
    """
    base = _documents(spark, defaults_path)
    if base.isEmpty() or not base.filter(~_is_object()).isEmpty():
        raise AliasConfigError(f"alias defaults are missing or no JSON object: {defaults_path}")
    base_entries = _entries(base)
    defaults = _usable(base_entries).select("field", match_key(F.col("text")).alias("alias_norm")).filter("alias_norm != ''").distinct()
    warnings = _warnings(base, base_entries)
    if companies_path is None:
        return defaults, spark.createDataFrame([], "company_code string, field string, alias_norm string"), warnings
    documents = _documents(spark, companies_path)
    entries = _entries(documents)
    own = _usable(entries).select(
        company_key(F.col("source")).alias("company_code"), "field", match_key(F.col("text")).alias("alias_norm")
    ).filter("alias_norm != ''").distinct()
    return defaults, own, warnings.unionByName(_warnings(documents, entries))


def known_company_codes(spark: SparkSession, *folders: str) -> DataFrame:
    """Codes that have a configuration file in any of the folders, sorted."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(list(folders)).select(
        F.regexp_replace(file_name(decoded_uri(F.col("_metadata.file_path"))), r"\.json$", "").alias("code")
    )
    return names.distinct().orderBy("code")
