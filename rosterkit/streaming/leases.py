"""Leases in a store: taken before the work, renewed while it lasts, given back after it."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rosterkit.operators import leases
from rosterkit.operators.compile import REPORT_KEY
from rosterkit.plans import reports
from rosterkit.schema import COMPILED_MANIFEST, LEASES
from rosterkit.session import stage
from rosterkit.sources import sinks
from rosterkit.sources.parts import read_parts, stored_files

SECONDS = 600.0
_LEASE_KEY = [*REPORT_KEY, "fence"]


def read_leases(spark: SparkSession, store: str, keys: DataFrame | None = None) -> DataFrame:
    """Leases as they are now: a renewal meanwhile swaps files, so each is found by a listing and read whole."""
    place = T.StructType([LEASES[c] for c in _LEASE_KEY])
    files = stored_files(spark, f"{store}/leases", place, levels=len(_LEASE_KEY))
    fields = [f for f in LEASES if f.name not in _LEASE_KEY]
    stored = read_parts(files.select("output_path", *_LEASE_KEY).distinct(), fields).select(*LEASES.fieldNames())
    return stored if keys is None else reports.of_keys(stored, keys, ["fence"])


def acquire(spark: SparkSession, store: str, admitted: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Leases of the admitted requests, written; ``admitted`` are staged and have one row per key."""
    published = reports.of_keys(sinks.read_table(spark, f"{store}/compiled_manifest", COMPILED_MANIFEST), admitted, ["version"])
    taken = stage(leases.granted(admitted, read_leases(spark, store, admitted), published, time.time() + seconds), "leases")
    sinks.replace_rows(taken.select(*LEASES.fieldNames()), f"{store}/leases", *_LEASE_KEY)
    return taken


def renew(spark: SparkSession, store: str, taken: DataFrame, seconds: float = SECONDS) -> None:
    """Move the end of leases; a lease that was taken over keeps its lower number and blocks nobody."""
    later = taken.withColumn("expires_at", F.lit(time.time() + seconds))
    sinks.replace_rows(later.select(*LEASES.fieldNames()), f"{store}/leases", *_LEASE_KEY)


def release(spark: SparkSession, store: str, taken: DataFrame) -> None:
    """Give leases back."""
    sinks.replace_rows(taken.withColumn("expires_at", F.lit(0.0)).select(*LEASES.fieldNames()), f"{store}/leases", *_LEASE_KEY)


@contextmanager
def held(spark: SparkSession, store: str, admitted: DataFrame, seconds: float = SECONDS) -> Iterator[DataFrame]:
    """Hold leases during the work: renewed every third of their time, given back at its end, also when it fails."""
    taken = acquire(spark, store, admitted, seconds)
    done = threading.Event()

    def beat() -> None:
        while not done.wait(seconds / 3):
            renew(spark, store, taken, seconds)

    heart = threading.Thread(target=beat, daemon=True)
    heart.start()
    try:
        yield taken
    finally:
        done.set()
        heart.join()
        release(spark, store, taken)
