"""Queries of the alias library."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterkit.operators import aliases as al
from rosterkit.queries import views


def _merged(spark, sf_dir):
    lib = views.library(spark, sf_dir)
    defaults = al.default_aliases(lib).select(F.col("category").alias("field"), "alias_norm")
    own = al.residual_aliases(lib, defaults.withColumnRenamed("field", "category")).withColumnRenamed("category", "field")
    return al.merge_aliases(defaults, own, lib.select("company_code").distinct())


def alias_defaults(spark, sf_dir):
    return al.in_alias_order(al.default_aliases(views.library(spark, sf_dir)), "category")


def alias_residual(spark, sf_dir):
    lib = views.library(spark, sf_dir)
    return al.in_alias_order(al.residual_aliases(lib, al.default_aliases(lib)), "company_code", "category")


def merge_aliases(spark, sf_dir):
    return _merged(spark, sf_dir)


def alias_collisions(spark, sf_dir):
    lib = views.library(spark, sf_dir).withColumn("alias_text", F.regexp_replace("alias_text", "(?i)red|blue|new|old", ""))
    own = al.normalized(lib).select("company_code", F.col("category").alias("field"), "alias_norm").distinct()
    return al.alias_collisions(own).select("company_code", "alias_norm", F.array_join("fields", ",").alias("fields"))


def alias_quality(spark, sf_dir):
    lib = views.library(spark, sf_dir)
    notes = views.library_notes(spark, sf_dir)
    companies = lib.select("company_code").union(notes.select("company_code"))
    return al.alias_quality(lib.filter(~((F.col("category") == "name") & (F.substring("company_code", 2, 1) == "3"))), notes, companies)


QUERIES = {q.__name__: q for q in (alias_defaults, alias_residual, merge_aliases, alias_collisions, alias_quality)}

_LIB = """lib AS (SELECT 'L' || CAST(l_suppkey AS VARCHAR) AS company_code,
  ['name', 'firstlastname', 'sex', 'dob', 'policynum'][l_partkey % 5 + 1] AS category,
  CASE WHEN l_linenumber % 2 = 0 THEN upper(w1[1]) || w1[2:] || ' ' || upper(w2[1]) || w2[2:] ELSE w1 || '_' || w2 END
    || CASE WHEN l_partkey % 3 = 0 THEN ' ' || p_type || translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'abcdefghij') ELSE '' END AS alias_text,
  l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS pos FROM lineitem
  JOIN (SELECT p_partkey, p_type, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part) ON p_partkey = l_partkey),
norm AS (SELECT *, regexp_replace(lower(alias_text), '[^a-z]', '', 'g') AS alias_norm FROM lib),
own AS (SELECT company_code, category, alias_norm, min((pos, alias_text)) AS f FROM norm GROUP BY ALL),
defaults AS (SELECT category, alias_norm, min(f)[2] AS alias_text, count(*) AS n_companies FROM own GROUP BY ALL HAVING count(*) >= 8),
residual AS (SELECT company_code, category, alias_norm, f[2] AS alias_text FROM own WHERE (category, alias_norm) NOT IN (SELECT (category, alias_norm) FROM defaults))"""

ORACLES = {
    "alias_defaults": f"WITH {_LIB} SELECT * FROM defaults",
    "alias_residual": f"WITH {_LIB} SELECT * FROM residual",
    "merge_aliases": f"""WITH {_LIB} SELECT company_code, category AS field, alias_norm FROM residual UNION
        SELECT company_code, category, alias_norm FROM (SELECT DISTINCT company_code FROM lib) CROSS JOIN defaults""",
    "alias_collisions": f"""WITH {_LIB}, x AS (SELECT company_code, category, regexp_replace(lower(regexp_replace(alias_text, '(?i)red|blue|new|old', '', 'g')), '[^a-z]', '', 'g') AS alias_norm FROM lib)
        SELECT company_code, alias_norm, string_agg(DISTINCT category, ',' ORDER BY category) AS fields FROM x WHERE alias_norm <> ''
        GROUP BY company_code, alias_norm HAVING count(DISTINCT category) > 1""",
    "alias_quality": f"""WITH {_LIB}, notes AS (SELECT 'L' || CAST(o_custkey % 100 AS VARCHAR) AS company_code, lower(o_orderpriority || ' ' ||
          CASE WHEN o_orderkey % 101 = 0 THEN 'UNSAFE term' WHEN o_orderkey % 103 = 0 THEN 'Not one-row header' WHEN o_orderkey % 107 = 0 THEN 'face-sheet' ELSE 'plain' END) AS note FROM orders),
        c AS (SELECT company_code FROM lib UNION SELECT company_code FROM notes),
        n AS (SELECT company_code, {", ".join(f"count(*) FILTER (category = '{f}') AS n_{f}" for f in views.LIB_CATEGORIES)}
          FROM lib WHERE NOT (category = 'name' AND company_code[2] = '3') GROUP BY 1),
        g AS (SELECT company_code, bool_or(contains(note, 'not one-row') OR contains(note, 'face-sheet')) AS special_layout, bool_or(contains(note, 'unsafe')) AS unsafe_alias FROM notes GROUP BY 1)
        SELECT company_code, {", ".join(f"coalesce(n_{f}, 0) AS n_{f}" for f in views.LIB_CATEGORIES)}, coalesce(special_layout, false) AS special_layout,
          coalesce(unsafe_alias, false) AS unsafe_alias, coalesce(n_name, 0) = 0 AS no_name_alias FROM c LEFT JOIN n USING (company_code) LEFT JOIN g USING (company_code)""",
}
