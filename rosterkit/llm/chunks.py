"""Documents in bounded chunks, and packed questions and answers between chunks and hash buckets.

A global question about n-grams ("how often does this one occur anywhere?") would need a shuffled row for each n-gram.
Here a task packs the questions of a whole chunk of documents into one array for each hash bucket; a bucket merges its
arrays and answers each in the order of its questions.  Shuffles thus carry a few bytes for each question, no key has
rows of its own, and what repeats within a chunk is merged before it is sent.

The chunks are written once to the shared folder, bucketed by chunk, so that joining answers to them never moves the
texts again, and a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterkit.llm.words import slabs, text_sizes
from rosterkit.session import staging_path

CHUNK_BYTES = 8 << 20
SCHEMA = "chunk long, doc_ids array<long>, lengths array<long>, body binary"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession) -> int:
    """Hash buckets of an exchange: they follow the shuffle partitions that the cluster sets for its data."""
    return 4 * shuffle_partitions(spark)


def _pack(number: int, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()),
         pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())),
         pa.array([[len(x) for x in raw]], pa.list_(pa.int64())),
         pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(raw))], pa.binary())],
        names=["chunk", "doc_ids", "lengths", "body"])


def write_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of all rows as chunk rows of about CHUNK_BYTES, one row a chunk, texts compressed.

    A longer text is a chunk alone.  Rows keep no order, null texts become empty, equal rows stay apart.
    """
    spark = docs.sparkSession

    def chunked(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, stop in slabs(text_sizes(batch.column(1)), CHUNK_BYTES):
                yield _pack(number, batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start))
                number += 1

    table, path = f"chunks_{uuid.uuid4().hex}", staging_path(spark, "chunks")
    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(chunked, SCHEMA)
        .write.option("compression", "none").option("path", path).bucketBy(shuffle_partitions(spark), "chunk")
        .saveAsTable(table))
    return spark.table(table)


def unpack(doc_ids: list, lengths: list[int], body: bytes) -> list[bytes]:
    """The texts of one chunk row."""
    data = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(lengths)))
    ends = np.cumsum(lengths).tolist()
    return [data[e - n:e] for e, n in zip(ends, lengths)]


def chunk_rows(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, list, list[bytes]]]:
    """(chunk, document ids, texts) of each chunk row."""
    for i in range(table.num_rows):
        ids = table.column("doc_ids")[i].as_py()
        yield table.column("chunk")[i].as_py(), ids, unpack(ids, table.column("lengths")[i].as_py(),
                                                            table.column("body")[i].as_py())


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(payload: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload, max_output_size=1 << 31), dtype=kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit numbers as their differences, byte by byte, so that what is zero in all of them takes no room."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(payload: bytes) -> np.ndarray:
    gaps = expand(payload, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u8")[:, 0], dtype=np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket comes from the upper half of a hash, so the lower half tells the hashes of a bucket apart."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that deals sorted hashes to buckets, and where each bucket starts in it."""
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def by_range(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``by_bucket``, but a bucket is a range of hashes: what is sent to it differs in fewer bits."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.arange(len(hashes)), np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def answers_of(table: pa.Table, kind, order: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One answer for each question of a chunk, put back from the order in which they were dealt."""
    out = np.zeros(len(order), dtype=kind)
    for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
        out[order[cuts[bucket]:cuts[bucket + 1]]] = expand(payload, kind)
    return out
