"""Alias library: promotion to defaults, residuals per company, merge, collisions, quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterkit.functions import match_key
from rosterkit.operators.joins import join_small
from rosterkit.schema import ALL_COMPANIES, DEFAULT_ALIAS_COMPANIES, FIELDS
from rosterkit.session import stage

# Words in a company's notes that call for a manual review.
SPECIAL_LAYOUT_WORDS = ["not one-row", "face-sheet", "vba", "legend row only"]
UNSAFE_WORD = "unsafe"
# End of fixed values.

ROWS_PER_TASK = 1_000_000  # effective aliases that one task makes
BLOCK_ALIASES = 10_000  # defaults that one group of a join beyond a broadcast holds
MAX_TASKS = 100_000


def normalized(lib: DataFrame) -> DataFrame:
    """Library entries with a usable match key. ``lib(company_code, category, alias_text, pos)``."""
    return lib.withColumn("alias_norm", match_key(F.col("alias_text"))).filter(F.col("alias_norm") != "")


def company_aliases(lib: DataFrame) -> DataFrame:
    """One row per company, category and match key, with its first-seen text.

    This first grouping also takes the load off a match key that most companies share.
    """
    return normalized(lib).groupBy("company_code", "category", "alias_norm").agg(
        F.min(F.struct("pos", "alias_text")).alias("first_seen")
    )


def default_aliases(lib: DataFrame, companies: int = DEFAULT_ALIAS_COMPANIES) -> DataFrame:
    """Aliases used by at least ``companies`` companies in a field, with the first-seen spelling.

    Only the five fields have defaults; other categories of a library are for reference.
    """
    return (
        company_aliases(lib.filter(F.col("category").isin(FIELDS)))
        .groupBy("category", "alias_norm")
        .agg(F.count("*").alias("n_companies"), F.min("first_seen").alias("first_seen"))
        .filter(F.col("n_companies") >= companies)
        .select("category", "alias_norm", F.col("first_seen.alias_text").alias("alias_text"), "n_companies")
    )


def in_alias_order(aliases: DataFrame, *keys: str) -> DataFrame:
    """Case-insensitive alias order within the given keys."""
    return aliases.orderBy(*keys, F.lower("alias_text"), "alias_text")


def residual_aliases(lib: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each company's aliases of the five fields that are not defaults, once each."""
    return (
        company_aliases(lib.filter(F.col("category").isin(FIELDS)))
        .join(defaults.select("category", "alias_norm"), ["category", "alias_norm"], "left_anti")
        .select("company_code", "category", "alias_norm", F.col("first_seen.alias_text").alias("alias_text"))
    )


def reference_aliases(lib: DataFrame) -> DataFrame:
    """Each company's aliases of the categories that are no fields (premium, claim), once each."""
    return company_aliases(lib.filter(~F.col("category").isin(FIELDS))).select(
        "company_code", "category", "alias_norm", F.col("first_seen.alias_text").alias("alias_text"))


def merge_aliases(defaults: DataFrame, own: DataFrame, companies: DataFrame) -> DataFrame:
    """Effective aliases of every company: defaults and its own, each once.

    ``defaults(field, alias_norm)``, ``own(company_code, field, alias_norm)``, ``companies(company_code)``. A company
    without aliases of its own has the defaults. The companies are few rows that stand for many, so their number of tasks
    follows the rows that they will have; both sides are distinct before they meet and what they share is taken from the
    own ones, so the large result is neither shuffled nor grouped. Detection does not need this table: it looks cells up
    under the company and under ``*``.
    """
    defaults = stage(defaults.select("field", "alias_norm").filter(F.col("field").isin(FIELDS)).distinct(), "default-aliases")
    companies = stage(companies.select("company_code").distinct(), "companies")
    n_defaults = defaults.count()
    blocks = n_defaults // BLOCK_ALIASES + 1
    tasks = max(1, min(MAX_TASKS, companies.count() * n_defaults // ROWS_PER_TASK + 1))
    slots = companies.repartition(tasks, "company_code").select("company_code", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    dealt = defaults.withColumn("_block", F.pmod(F.xxhash64("alias_norm"), F.lit(blocks)).cast("int"))
    spread = slots.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = join_small(spread, dealt, ["field", "_block"], salt_by=["company_code"]).select("company_code", "field", "alias_norm")
    # Structs are compared as a whole, so that nulls are equal as in a distinct.
    alias, company = F.struct("field", "alias_norm").alias("_alias"), F.struct("company_code").alias("_company")
    mine = own.select("company_code", "field", "alias_norm").distinct().select("*", alias, company)
    shared = mine.join(defaults.select(alias), "_alias", "left_semi").join(companies.select(company), "_company", "left_semi")
    rest = mine.join(shared.select("_alias", "_company"), ["_alias", "_company"], "left_anti")
    return given.unionByName(rest.select("company_code", "field", "alias_norm"))


def lookup_aliases(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """The two-level alias table that detection joins: defaults under ``*`` and each company's own."""
    everyone = defaults.select(F.lit(ALL_COMPANIES).alias("company_code"), "field", "alias_norm")
    return everyone.unionByName(own.select("company_code", "field", "alias_norm")).distinct()


def alias_collisions(merged: DataFrame) -> DataFrame:
    """Aliases of a company that belong to more than one field."""
    return (
        merged.groupBy("company_code", "alias_norm")
        .agg(F.sort_array(F.collect_set("field")).alias("fields"))
        .filter(F.size("fields") > 1)
    )


def alias_quality(lib: DataFrame, notes: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company: aliases per category, whether it has a name alias, and review flags from its notes.

    Flags are tested per note, so a company with very many notes is never joined into one text.
    """
    counts = lib.groupBy("company_code").agg(
        *[F.count_if(F.col("category") == f).alias(f"n_{f}") for f in FIELDS]
    )
    text = F.lower("note")
    special = F.lit(False)
    for word in SPECIAL_LAYOUT_WORDS:
        special = special | text.contains(word)
    flags = notes.groupBy("company_code").agg(
        F.max(special).alias("special_layout"), F.max(text.contains(UNSAFE_WORD)).alias("unsafe_alias")
    )
    joined = companies.select("company_code").distinct().join(counts, "company_code", "left").join(flags, "company_code", "left")
    sizes = [f"n_{f}" for f in FIELDS]
    return joined.na.fill(0, sizes).na.fill(False, ["special_layout", "unsafe_alias"]).withColumn(
        "no_name_alias", F.col("n_name") == 0
    )
