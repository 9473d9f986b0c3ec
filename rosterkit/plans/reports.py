"""Cumulative reports of a store, kept up to date run by run.

The store's tables for this, all partitioned by company and date first:

    rosters            run / output / part: the rows of every written output, one folder with one file per part
    output_index       run: folder, source file, sheet, row count and fingerprint of every part
    compiled           version: the rows a compilation added, in parts
    compiled_hashes    version: the hashes of these rows
    compiled_sources   version: the outputs they came from
    compiled_manifest  version: the parts, sources and totals that make up a report; the highest version counts

A compilation compares the finished runs' outputs with the sources of the last manifest, by the small index alone.  Where
outputs only came on top, it reads their rows, drops those whose hashes the report has, appends the rest after the last
full part and leaves all full parts alone.  Where an output is gone or changed, it rebuilds the report.  All files of a
version are written before its manifest, so a reader sees the old report or the new one; a report that ends without rows
has a manifest without parts.  Files that no manifest names any more are removed last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rosterkit.operators import compile as comp
from rosterkit.operators.joins import join_small
from rosterkit.operators.numbering import number_within, part_of
from rosterkit.schema import COMPILED_MANIFEST, FILE_LOGS, OUTPUT_INDEX, REPORT_PART_ROWS, ROSTER_COLUMNS, RUNS
from rosterkit.session import stage
from rosterkit.sources import sinks
from rosterkit.sources.catalog import decoded_uri
from rosterkit.sources.parts import read_parts
from rosterkit.sources.storage import literal_path, path_exists

LITERAL_KEYS = 1000  # a batch of requests has at most a hundred
VERSION_KEY = [*comp.REPORT_KEY, "version"]

_TEXTS = [T.StructField(c, T.StringType()) for c in ROSTER_COLUMNS]
_ROWS = [T.StructField("part_number", T.LongType()), *_TEXTS]
_HASHES = T.StructType([T.StructField("row_hash", T.BinaryType())] + [T.StructField(c, T.StringType()) for c in comp.REPORT_KEY]
                       + [T.StructField("version", T.LongType())])
_SOURCES = T.StructType([T.StructField("output_path", T.StringType()), T.StructField("row_count", T.LongType()),
                         T.StructField("fingerprint", T.LongType())] + [T.StructField(c, T.StringType()) for c in comp.REPORT_KEY]
                        + [T.StructField("version", T.LongType())])


class StaleWriter(Exception):
    """A newer compilation of a key was published meanwhile; this one's manifest is not."""


class Keys:
    """Companies and dates of one job: their distinct rows, and the list of them if they are few, read once."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        found = frame.select(*comp.REPORT_KEY).limit(LITERAL_KEYS + 1).collect()
        self.known = [tuple(r) for r in found] if len(found) <= LITERAL_KEYS else None

    @classmethod
    def of(cls, keys: DataFrame | Keys) -> Keys:
        return keys if isinstance(keys, Keys) else cls(stage(keys.select(*comp.REPORT_KEY).distinct(), "keys"))


def of_keys(stored: DataFrame, keys: DataFrame | Keys, salt_by: list[str]) -> DataFrame:
    """Rows of the given companies and dates.

    The keys of one batch are few and become literal lists, so that only their partitions are listed and read; with
    more than ``LITERAL_KEYS`` the join alone selects them.
    """
    keys = Keys.of(keys)
    wanted = keys.frame.select(*comp.REPORT_KEY)
    if keys.known is None:
        return join_small(stored, wanted, comp.REPORT_KEY, "left_semi", salt_by=salt_by)
    for place, column in enumerate(comp.REPORT_KEY):
        stored = stored.filter(F.col(column).isin(sorted({k[place] for k in keys.known})))
    return stored.join(F.broadcast(wanted), comp.REPORT_KEY, "left_semi")  # at most LITERAL_KEYS rows


def latest_manifests(spark: SparkSession, store: str, keys: DataFrame | Keys | None = None) -> DataFrame:
    """The manifest of the highest version of every key, or of the given keys."""
    stored = sinks.read_table(spark, f"{store}/compiled_manifest", COMPILED_MANIFEST)
    if keys is not None:
        stored = of_keys(stored, keys, ["version"])
    fields = [c for c in COMPILED_MANIFEST.fieldNames() if c not in comp.REPORT_KEY]
    return stored.groupBy(*comp.REPORT_KEY).agg(F.max_by(F.struct(*fields), "version").alias("_m")).select(*comp.REPORT_KEY, "_m.*")


def tracked_parts(manifests: DataFrame) -> DataFrame:
    """One tracking row per part."""
    return manifests.select(*comp.REPORT_KEY, "source_run_count", "last_updated_at", F.explode("parts").alias("_p")).select(
        *comp.REPORT_KEY, "_p.part_number", "_p.output_path", "_p.row_count", "source_run_count", "last_updated_at")


def read_reports(spark: SparkSession, store: str, keys: DataFrame | Keys | None = None) -> DataFrame:
    """The rows of all current reports, or of the given keys', with their part."""
    current = tracked_parts(latest_manifests(spark, store, keys)).select(*comp.REPORT_KEY, "output_path")
    return read_parts(current, _ROWS).select("part_number", *ROSTER_COLUMNS, *comp.REPORT_KEY)


def row_hash() -> Column:
    """128 bits of the nine columns; nulls and empty texts differ."""
    return F.unhex(F.md5(F.to_json(F.struct(*ROSTER_COLUMNS))))


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def _of_versions(stored: DataFrame, keys: Keys, manifests: DataFrame, salt_by: list[str]) -> DataFrame:
    """Rows of the versions that manifests of the keys build on."""
    versions = manifests.select(*comp.REPORT_KEY, F.explode("base_versions").alias("version"))
    return join_small(of_keys(stored, keys, salt_by), versions, VERSION_KEY, "left_semi", salt_by=salt_by)


def plan_compilation(spark: SparkSession, store: str, keys: Keys, rows_per_part: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``decided``: how each key is compiled; ``todo``: the outputs to read; ``old``: the manifests before.

    Only runs, logs, index, manifests and source lists are read, no roster rows.
    """
    runs = stage(of_keys(sinks.read_table(spark, f"{store}/runs", RUNS), keys, ["run_id"]), "runs-of-keys")
    logs = sinks.read_table(spark, f"{store}/file_logs", FILE_LOGS)
    ids = [r[0] for r in comp.finished_runs(runs).select("run_id").limit(LITERAL_KEYS + 1).collect()]
    if len(ids) <= LITERAL_KEYS:  # the logs are stored by run
        logs = logs.filter(F.col("run_id").isin(ids))
    eligible = stage(comp.eligible_outputs(logs, runs).select(*comp.REPORT_KEY, "output_path").distinct(), "eligible")
    index = of_keys(sinks.read_table(spark, f"{store}/output_index", OUTPUT_INDEX), keys, ["output_path"])
    index = stage(index.select(*comp.REPORT_KEY, "output_path", "run_id", "row_count", "fingerprint"), "index")
    old = stage(latest_manifests(spark, store, keys), "manifests")
    present = index.join(eligible, [*comp.REPORT_KEY, "output_path"], "left_semi")
    skipped = comp.skipped_outputs(eligible, index).groupBy(*comp.REPORT_KEY).agg(F.count("*").alias("skipped_files"))
    sources = _of_versions(sinks.read_table(spark, f"{store}/compiled_sources", _SOURCES), keys, old, ["output_path"])
    # A source that a later version read again is in the list of that version, too: equal entries count once.
    known = sources.select(*comp.REPORT_KEY, "output_path", F.col("row_count").alias("_rows"), F.col("fingerprint").alias("_print")).distinct()
    compared = stage(present.join(known, [*comp.REPORT_KEY, "output_path"], "full").withColumn(
        "changed", F.col("run_id").isNull() | (F.col("_print").isNotNull() & (
            (F.col("_print") != F.col("fingerprint")) | (F.col("_rows") != F.col("row_count"))))), "compared")
    changes = compared.groupBy(*comp.REPORT_KEY).agg(F.max("changed").alias("changed"))
    decided = (
        keys.frame.join(old.drop("source_run_count", "skipped_files", "last_updated_at", "total_rows", "part_count"), comp.REPORT_KEY, "left")
        .join(changes, comp.REPORT_KEY, "left").join(skipped, comp.REPORT_KEY, "left")
        .join(comp.source_run_count(runs), comp.REPORT_KEY, "left")
    )
    rebuild = F.col("version").isNull() | F.coalesce("changed", F.lit(False)) | (F.col("rows_per_part") != rows_per_part)
    number = F.coalesce("fence", F.coalesce("version", F.lit(0)) + 1)
    full = F.filter("parts", lambda p: p["row_count"] >= rows_per_part)
    decided = stage(decided.select(
        *comp.REPORT_KEY, rebuild.alias("rebuild"), number.cast("long").alias("version"),
        F.when(rebuild, F.array().cast("array<bigint>")).otherwise(F.col("base_versions")).alias("base_versions"),
        F.when(rebuild, F.lit(None)).otherwise(F.col("parts")).alias("parts"),
        F.when(rebuild, F.lit(0)).otherwise(F.size(full)).cast("long").alias("full_parts"),
        F.coalesce("source_run_count", F.lit(0)).alias("source_run_count"), F.coalesce("skipped_files", F.lit(0)).alias("skipped_files"),
    ), "decided")
    found = compared.filter(F.col("run_id").isNotNull()).join(decided.select(*comp.REPORT_KEY, "rebuild", "version"), comp.REPORT_KEY)
    todo = found.filter(F.col("rebuild") | F.col("_print").isNull()).select(*comp.REPORT_KEY, "version", "output_path", "run_id", "row_count", "fingerprint")
    return decided, stage(todo, "todo"), old


def new_rows(spark: SparkSession, store: str, keys: Keys, decided: DataFrame, todo: DataFrame) -> DataFrame:
    """The distinct rows of the outputs to read that their reports do not hold yet, with their hashes; staged."""
    outputs = todo.select(*comp.REPORT_KEY, "output_path").distinct()
    rows = read_parts(outputs, _TEXTS).drop("output_path").dropDuplicates().withColumn("row_hash", row_hash())
    growing = stage(decided.filter(~F.col("rebuild")), "growing")
    if growing.isEmpty():
        return stage(rows, "new-rows")
    held = _of_versions(sinks.read_table(spark, f"{store}/compiled_hashes", _HASHES), keys, growing, ["row_hash"])
    return stage(rows.join(held.select(*comp.REPORT_KEY, "row_hash"), [*comp.REPORT_KEY, "row_hash"], "left_anti"), "new-rows")


def _last_parts(decided: DataFrame, fresh: DataFrame, rows_per_part: int) -> tuple[DataFrame, DataFrame]:
    """The part that is not full of each key with new rows, as ``key, output_path``, and the rows of these parts."""
    grown = decided.join(fresh.select(*comp.REPORT_KEY).distinct(), comp.REPORT_KEY, "left_semi").filter("parts IS NOT NULL")
    last = stage(grown.select(*comp.REPORT_KEY, F.explode("parts").alias("p")).filter(F.col("p.row_count") < rows_per_part).select(
        *comp.REPORT_KEY, "p.output_path"), "last-parts")
    if last.isEmpty():
        return last, fresh.drop("row_hash").limit(0)
    return last, read_parts(last, _TEXTS).select(*comp.REPORT_KEY, *ROSTER_COLUMNS)


def compile_reports(spark: SparkSession, store: str, keys: DataFrame, rows_per_part: int = REPORT_PART_ROWS) -> DataFrame:
    """Bring the reports of the given companies and dates up to date with all their finished runs.

    A column ``fence`` of ``keys`` is the fencing number of the caller's lease on the key: what a caller with a lower
    number than that of the current report writes is never published.  Returns the tracking rows, whose paths are the
    files of the parts.
    """
    fence = F.max("fence") if "fence" in keys.columns else F.lit(None).cast("bigint")
    keys = Keys(stage(keys.groupBy(*comp.REPORT_KEY).agg(fence.alias("fence")), "keys"))
    decided, todo, old = plan_compilation(spark, store, keys, rows_per_part)
    fresh = new_rows(spark, store, keys, decided, todo)
    last, tail = _last_parts(decided, fresh, rows_per_part)
    written = None
    if not fresh.isEmpty():
        both = tail.withColumn("_age", F.lit(0)).unionByName(fresh.drop("row_hash").withColumn("_age", F.lit(1)))
        numbered = number_within(both, comp.REPORT_KEY, ["_age", *ROSTER_COLUMNS], "_row_number").drop("_age")
        placed = join_small(numbered, decided.select(*VERSION_KEY, "full_parts"), comp.REPORT_KEY, salt_by=ROSTER_COLUMNS)
        parts = placed.select(*VERSION_KEY, *ROSTER_COLUMNS, (part_of(F.col("_row_number"), rows_per_part) + F.col("full_parts")).alias("part_number"))
        written = sinks.write_report_parts(parts, f"{store}/compiled", VERSION_KEY)
    # A null hash for every version that reads anything: what an interrupted attempt left there is replaced in any case.
    marks = todo.select(*VERSION_KEY).distinct().select(F.lit(None).cast("binary").alias("row_hash"), *VERSION_KEY)
    hashes = join_small(fresh.select(*comp.REPORT_KEY, "row_hash"), decided.select(*VERSION_KEY), comp.REPORT_KEY, salt_by=["row_hash"])
    sinks.overwrite_partitions(hashes.select("row_hash", *VERSION_KEY).unionByName(marks), f"{store}/compiled_hashes", *VERSION_KEY)
    sinks.overwrite_partitions(todo.select("output_path", "row_count", "fingerprint", *VERSION_KEY), f"{store}/compiled_sources", *VERSION_KEY)
    manifests = stage(_manifests(decided, todo, written, last, rows_per_part), "new-manifests")
    publish(spark, store, keys, manifests)
    remove_superseded(spark, store, keys, old, manifests)
    return tracked_parts(manifests)


def _manifests(decided: DataFrame, todo: DataFrame, written: DataFrame | None, last: DataFrame, rows_per_part: int) -> DataFrame:
    """The manifests of the new versions: what stays of the parts before, and the parts written now."""
    kept = decided.select(*comp.REPORT_KEY, F.explode("parts").alias("p")).select(*comp.REPORT_KEY, "p.part_number", "p.output_path", "p.row_count")
    parts = kept.join(last.select(*comp.REPORT_KEY, "output_path"), [*comp.REPORT_KEY, "output_path"], "left_anti")
    if written is not None:
        parts = parts.unionByName(written.select(*comp.REPORT_KEY, "part_number", "output_path", "row_count"))
    listed = parts.groupBy(*comp.REPORT_KEY).agg(
        F.array_sort(F.collect_list(F.struct("part_number", "output_path", "row_count"))).alias("parts"),  # one entry per part
        F.sum("row_count").alias("total_rows"), F.max("part_number").alias("part_count"))
    read = todo.select(*comp.REPORT_KEY).distinct().withColumn("_read", F.lit(True))
    none = F.array().cast(COMPILED_MANIFEST["parts"].dataType)
    based = F.when(F.col("_read"), F.array_append("base_versions", F.col("version"))).otherwise(F.col("base_versions"))
    return decided.drop("parts").join(listed, comp.REPORT_KEY, "left").join(read, comp.REPORT_KEY, "left").select(
        *comp.REPORT_KEY, "version", based.alias("base_versions"),
        F.lit(rows_per_part).alias("rows_per_part"), F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("part_count", F.lit(0)).alias("part_count"), "source_run_count", "skipped_files",
        F.coalesce("parts", none).alias("parts"), _now().alias("last_updated_at"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in COMPILED_MANIFEST.fields])


def publish(spark: SparkSession, store: str, keys: Keys, manifests: DataFrame) -> None:
    """Make the new versions the current ones; a version that is not above the current one is refused."""
    current = latest_manifests(spark, store, keys).select(*comp.REPORT_KEY, F.col("version").alias("_current"))
    if not manifests.join(current, comp.REPORT_KEY).filter(F.col("_current") >= F.col("version")).isEmpty():
        raise StaleWriter("a newer version of a report was published meanwhile")
    sinks.replace_rows(manifests, f"{store}/compiled_manifest", *VERSION_KEY)


def remove_superseded(spark: SparkSession, store: str, keys: Keys, old: DataFrame, manifests: DataFrame) -> None:
    """Remove the files of the manifests before that the new ones do not use."""
    current = manifests.select(F.explode("parts").alias("p")).select("p.output_path")
    parts = old.select(F.explode("parts").alias("p")).select(F.col("p.output_path").alias("path")).join(
        current.withColumnRenamed("output_path", "path"), "path", "left_anti")
    based = manifests.select(*comp.REPORT_KEY, F.explode("base_versions").alias("version"))
    gone = stage(old.select(*comp.REPORT_KEY, F.explode("base_versions").alias("version")).join(based, VERSION_KEY, "left_anti"), "superseded")
    tables = []
    if gone.isEmpty():  # nothing was built again: at most the last parts were replaced
        sinks.remove_files(parts)
        return
    for table in ("compiled_hashes", "compiled_sources"):
        if path_exists(f"{store}/{table}"):
            stored = spark.read.schema(T.StructType([_HASHES[c] for c in VERSION_KEY])).parquet(literal_path(f"{store}/{table}"))
            files = of_keys(stored.select(*VERSION_KEY, F.col("_metadata.file_path").alias("path")), keys, ["path"]).distinct()
            tables.append(files.join(gone, VERSION_KEY, "left_semi").select(decoded_uri(F.col("path")).alias("path")))
    for more in tables:
        parts = parts.unionByName(more)
    sinks.remove_files(parts)


def refresh_index(spark: SparkSession, store: str, keys: DataFrame) -> None:
    """Take outputs whose files are gone out of the index of the given companies and dates; only folders are listed.

    The next compilation sees such outputs as skipped and builds the reports again that held their rows.
    """
    keys = Keys.of(keys)
    path = f"{store}/output_index"
    index = of_keys(sinks.read_table(spark, path, OUTPUT_INDEX), keys, ["output_path"])
    listed = sinks.stored_outputs(spark, f"{store}/rosters").select("output_path").distinct()
    gone = index.join(listed, "output_path", "left_anti")
    touched = stage(gone.select(*sinks.RUN_KEY).distinct(), "touched")
    kept = stage(index.join(touched, sinks.RUN_KEY, "left_semi").join(gone.select("output_path"), "output_path", "left_anti"), "kept-index")
    emptied = touched.join(kept.select(*sinks.RUN_KEY).distinct(), sinks.RUN_KEY, "left_anti")
    files = sinks.read_table(spark, path, OUTPUT_INDEX).select(*sinks.RUN_KEY, decoded_uri(F.col("_metadata.file_path")).alias("path"))
    files = stage(files.join(emptied, sinks.RUN_KEY, "left_semi").select("path"), "emptied-index")
    sinks.write_output_index(kept.select(*OUTPUT_INDEX.fieldNames()), path)
    sinks.remove_files(files)
