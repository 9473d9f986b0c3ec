"""Joins between a large side that may hold a hot key and a side that is usually small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_LIMIT_BYTES = 4 * 1024 * 1024  # the driver collects a broadcast and holds it several times over as rows
SALTS = 32
COPIED_BYTES = SALTS * BROADCAST_LIMIT_BYTES  # of all copies of a small side together


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` as JSON text, measured by Spark; meant for staged or otherwise cheap inputs."""
    return df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_by: list[str | Column] | None = None,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Join on equal keys without sending one hot key of ``big`` to one task.

    ``small`` is broadcast when its measured size is within ``limit``. Beyond it each small row is copied to every
    salt and the rows of ``big`` are spread over the salts by a hash of ``salt_by`` (all columns by default), so
    that any number of rows with the same key is shared by many tasks. The salt depends on the row only, so a
    re-run task rebuilds the same split. The larger ``small`` is, the fewer the salts, so that its copies never exceed
    ``COPIED_BYTES`` or its own size; Spark's own splitting of skewed joins then divides what one key still gathers.
    """
    size = measured_bytes(small)
    if size <= limit:
        return big.join(F.broadcast(small), on, how)
    salts = min(SALTS, COPIED_BYTES // size)
    if salts <= 1:
        return big.join(small.hint("merge"), on, how)
    salt_by = salt_by or list(big.columns)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, on + ["_salt"], how).drop("_salt")

