"""Leases on companies and dates: who may work on a key, until when, and with which fencing number.

A lease is a row ``company_code, email_received_date, fence, run_id, expires_at`` (seconds since 1970; 0: given back).  The
highest fence of a key counts.  It only ever rises, so whoever lost a lease can be told by its number, and what such a late
writer publishes is refused (``reports.publish``).  A lease that is not renewed ends by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterkit.operators.compile import REPORT_KEY, RUNNING


def latest_leases(leases: DataFrame) -> DataFrame:
    """The lease with the highest fence of every key."""
    return leases.groupBy(*REPORT_KEY).agg(F.max_by(F.struct("fence", "run_id", "expires_at"), "fence").alias("_l")).select(*REPORT_KEY, "_l.*")


def busy_keys(runs: DataFrame, leases: DataFrame, own: DataFrame, now: float) -> DataFrame:
    """Keys that another job works on, as rows with status ``running``.

    A running run blocks its key while its lease lasts; one that never had a lease blocks it until it is finished. Runs of
    ``own(run_id)`` and their leases do not block.
    """
    others = runs.filter(F.col("status") == RUNNING).join(own, "run_id", "left_anti").select("run_id", *REPORT_KEY)
    ended = leases.filter(F.col("expires_at") <= now).select("run_id").distinct()
    live = latest_leases(leases).filter(F.col("expires_at") > now).join(own, "run_id", "left_anti").select("run_id", *REPORT_KEY)
    return others.join(ended, "run_id", "left_anti").unionByName(live).select(*REPORT_KEY).distinct().withColumn("status", F.lit(RUNNING))


def abandoned_runs(runs: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    """Running runs whose lease has ended without being given back."""
    ended = leases.filter((F.col("expires_at") <= now) & (F.col("expires_at") > 0)).select("run_id").distinct()
    return runs.filter(F.col("status") == RUNNING).join(ended, "run_id", "left_semi")


def granted(admitted: DataFrame, leases: DataFrame, published: DataFrame, expires_at: float) -> DataFrame:
    """A lease for every admitted request (``run_id`` and key), numbered above all leases and published versions of its key.

    A request that is admitted again after an interruption gets a new number, too.
    """
    before = leases.select(*REPORT_KEY, "fence").unionByName(published.select(*REPORT_KEY, F.col("version").alias("fence")))
    highest = before.groupBy(*REPORT_KEY).agg(F.max("fence").alias("fence"))
    return admitted.select("run_id", *REPORT_KEY).join(highest, REPORT_KEY, "left").select(
        *REPORT_KEY, (F.coalesce("fence", F.lit(0)) + 1).alias("fence"), "run_id", F.lit(float(expires_at)).alias("expires_at"))
