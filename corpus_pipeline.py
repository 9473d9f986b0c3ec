"""Corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
documents.  All but the last return the columns of ``documents`` (extra ones too), with what they decided carried out:

1. toxicity: documents that the model rejects go;
2. line_dedup: lines of recurring templates are cut from the texts;
3. simhash: one document of each near-duplicate group stays, that with the smallest id (a null id only if all are null;
   of equal ids any one row);
4. decontamination: word runs that lie in benchmark windows are cut from the texts;
5. packing: the rest as token pieces in sequences.

Where a stage changes a text, ``n_chars`` follows it if it is a column.  Null and empty texts pass every stage (as one
group of near duplicates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterkit.llm import decontamination, line_dedup, packing, simhash, toxicity
from rosterkit.session import stage

# The toxicity model and the fingerprints' XXH64 have no SQL in the checking engine; tests compare with brute force.
ORACLE_SQL = None


def _documents(found: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The document columns of ``row``, with another text."""
    changed = {} if text is None else {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(toxicity.score_toxicity(docs, model).filter("toxic_score < 0.5"), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.drop_recurring_lines(docs), docs.columns, F.col("kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(simhash.one_of_each_group(docs), docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    return _documents(found, docs.columns, F.col("clean_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
