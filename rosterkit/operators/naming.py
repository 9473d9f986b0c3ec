"""Unique output names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterkit.functions import safe_name
from rosterkit.operators.joins import join_small
from rosterkit.operators.numbering import number_within
from rosterkit.session import stage

_SUFFIXED = "^(.*)_([1-9][0-9]{0,17})$"


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name", within: tuple[str, ...] = (), safe: bool = True) -> DataFrame:
    """Safe names that never repeat (among equal ``within``): clashes of a name get ``_1``, ``_2``, ... in the given order.

    A suffix that a name of the input has already is passed over, so ``a, a, a_1`` becomes ``a, a_2, a_1``. Names with
    different stems cannot meet in their suffixed forms, so one pass is enough: the i-th clash takes the i-th free number,
    which is its place when the clashes are laid between the taken numbers. One name may be shared by any number of rows;
    all places come from the range-partitioned numbering.
    """
    keys = [*within, "_base"]
    based = df.withColumn("_base", safe_name(F.col(name)) if safe else F.col(name))
    ranked = number_within(based, keys, order, "_n")
    firsts = ranked.filter("_n = 1").select(*within, F.regexp_extract("_base", _SUFFIXED, 2).alias("_t"), F.regexp_extract("_base", _SUFFIXED, 1).alias("_base"))
    clashing = ranked.filter("_n = 2").select(*keys)
    taken = stage(firsts.filter("_t <> ''").withColumn("_t", F.col("_t").cast("long")).join(clashing, keys, "left_semi"), "taken-suffixes")
    suffix = F.col("_n") - 1
    if not taken.isEmpty():
        # A taken number t with j taken ones up to it has t - j free numbers below, so it lies before the next clash.
        fixed = number_within(taken, keys, ["_t"], "_j").select(*keys, (F.col("_t") - F.col("_j") + 1).alias("_after"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"))
        clashes = join_small(ranked.filter("_n > 1").select(*keys, "_n"), taken.select(*keys).distinct(), keys, "left_semi")
        laid = fixed.unionByName(clashes.select(*keys, (F.col("_n") - 1).alias("_after"), F.lit(1).alias("_kind"), "_n"))
        places = number_within(laid, keys, ["_after", "_kind", "_n"], "_suffix").filter("_kind = 1").select(*keys, "_n", "_suffix")
        ranked = ranked.join(places, [*keys, "_n"], "left")  # the rows of one name differ in their number
        suffix = F.coalesce("_suffix", suffix)
    named = F.when(F.col("_n") > 1, F.concat("_base", F.lit("_"), suffix.cast("string"))).otherwise(F.col("_base"))
    return ranked.select(*df.columns, named.alias(out))
