"""Archives (zip, zipx, tar): members are written to a shared folder and join the work list, nested ones too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterkit.functions import extension, file_kind, file_name
from rosterkit.session import stage
from rosterkit.sources.catalog import decoded_uri, spread
from rosterkit.sources.storage import open_file, write_stream

READABLE_TYPES = ["zip", "zipx", "tar"]
CHUNK_BYTES = 1024 * 1024
MAX_DEPTH = 20

MEMBERS = "archive string, extension string, member_no int, member string, length bigint, error string"
FILES = "archive string, member string, path string, length bigint, error string"


def _zip_members(file):
    import zipfile

    with zipfile.ZipFile(file) as book:
        for i, info in enumerate(book.infolist()):
            if not info.is_dir():
                yield i, info.filename, info.file_size, "encrypted member" if info.flag_bits & 1 else None


def _tar_members(file):
    import tarfile

    with tarfile.open(fileobj=file, mode="r:") as tar:
        for i, info in enumerate(tar):
            if info.isfile():
                yield i, info.name, info.size, None


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path, ext in zip(batch["path"], batch["extension"]):
            try:
                if ext not in READABLE_TYPES:
                    raise ValueError(f"unsupported archive type: {ext}")
                with open_file(path) as file:
                    listed = [(path, ext, *m) for m in (_tar_members(file) if ext == "tar" else _zip_members(file))]
                found.extend(listed)
            except Exception as e:  # one bad archive must not stop the others
                found.append((path, ext, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(found, columns=["archive", "extension", "member_no", "member", "length", "error"]).astype(
            {"member_no": "Int32", "length": "Int64"}
        )


def _chunks(stream):
    while chunk := stream.read(CHUNK_BYTES):
        yield chunk


def _extract_into(folder: str):
    """Task function that writes each member of its batch below ``folder``."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import tarfile
        import zipfile
        from urllib.parse import quote

        for batch in batches:
            done = []
            for archive, members in batch.groupby("archive"):
                with open_file(archive) as file:
                    tar = members["extension"].iloc[0] == "tar"
                    book = tarfile.open(fileobj=file, mode="r:") if tar else zipfile.ZipFile(file)
                    entries = book.getmembers() if tar else book.infolist()
                    home = f"{folder}/{hashlib.sha1(archive.encode()).hexdigest()}"
                    for number, member in zip(members["member_no"], members["member"]):
                        entry = entries[int(number)]
                        # The number keeps equal member names apart; only the last name segment is trusted.
                        name = member.replace(chr(92), "/").rsplit("/", 1)[-1]
                        path = f"{home}/{int(number)}/{quote(name)}"
                        try:
                            with (book.extractfile(entry) if tar else book.open(entry)) as stream:
                                size = write_stream(path, _chunks(stream))
                            done.append((archive, member, path, size, None))
                        except Exception as e:  # e.g. a compression method the reader lacks
                            done.append((archive, member, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(done, columns=["archive", "member", "path", "length", "error"]).astype({"length": "Int64"})

    return extract


def expand_once(archives: DataFrame, folder: str) -> DataFrame:
    """Members of the given archives, written below ``folder``; failures carry an ``error``.

    Listing reads only the directories. Extraction is spread by member, so one huge archive is shared by many tasks.
    """
    listed = stage(
        spread(archives.select("path", "extension", "length")).select("path", "extension").mapInPandas(_list, MEMBERS),
        "members",
    )
    bad = listed.filter(F.col("error").isNotNull()).select(
        "archive", "member", F.lit(None).cast("string").alias("path"), "length", "error"
    )
    good = spread(listed.filter(F.col("error").isNull()), "archive", "member_no").select(
        "archive", "extension", "member_no", "member"
    )
    return stage(good.mapInPandas(_extract_into(folder), FILES).unionByName(bad), "extracted")


def expand_archives(spark: SparkSession, files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files from all archives of a catalog, nested archives included, and the errors.

    Repeats until no archive is left. An archive below ``MAX_DEPTH`` levels is reported as an error, never dropped.
    """
    level = files.filter(F.col("kind") == "Archive").select("path", "extension", "length")
    members = errors = None
    for depth in range(MAX_DEPTH + 1):
        if level.isEmpty():
            break
        if depth == MAX_DEPTH:
            too_deep = level.select(F.col("path").alias("file_path"), F.lit("ValueError: archives nested too deeply").alias("error_msg"))
            errors = errors.unionByName(too_deep)
            break
        found = expand_once(level, f"{folder}/level{depth}")
        fresh = found.filter(F.col("error").isNull()).select(
            F.col("archive").alias("parent"), "member", "path", file_name(decoded_uri(F.col("path"))).alias("file_name"), "length",
            extension(decoded_uri(F.col("path"))).alias("extension"), file_kind(decoded_uri(F.col("path"))).alias("kind"),
        )
        failed = found.filter(F.col("error").isNotNull()).select(F.col("archive").alias("file_path"), F.col("error").alias("error_msg"))
        members = fresh if members is None else members.unionByName(fresh)
        errors = failed if errors is None else errors.unionByName(failed)
        level = fresh.filter(F.col("kind") == "Archive").select("path", "extension", "length")
    if members is None:
        members = spark.createDataFrame([], "parent string, member string, path string, file_name string, length bigint, extension string, kind string")
        errors = spark.createDataFrame([], "file_path string, error_msg string")
    return members, errors
