"""Columns computed from whole texts in Arrow tasks, next to the untouched row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterkit.llm.words import slabs, text_sizes


def with_text_columns(docs: DataFrame, fields: str, compute: Callable[[list[str | None]], list[pa.Array]],
                      most: int = 1 << 19, carried: tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns of ``docs``, by default all, as a struct, so no name can clash) and the fields that
    ``compute`` makes.

    ``compute`` gets the texts of some rows, about ``most`` bytes at a time, and returns an array for each field; the
    ``carried`` columns of ``docs`` follow the texts as lists.  Texts come back from the task only if they are kept.
    """
    def pack(columns):
        return F.struct(*[F.col(f"`{c}`") for c in columns])

    given = ("text", *carried)
    kept = docs.columns if keep is None else keep
    within = set(given) <= set(kept)

    def add(batches):
        for batch in batches:
            rows, source = batch.column(0), batch.column(0 if within else 1)
            for start, stop in slabs(text_sizes(pc.struct_field(source, "text")), most):
                part = source.slice(start, stop - start)
                made = compute(*[pc.struct_field(part, x).to_pylist() for x in given])
                yield pa.RecordBatch.from_arrays([rows.slice(start, stop - start), *made], names=["row", *names])

    packed = docs.select(pack(kept).alias("row"), *([] if within else [pack(given).alias("given")]))
    added = T.StructType.fromDDL(fields)
    names = [f.name for f in added]
    return packed.mapInArrow(add, T.StructType([packed.schema["row"], *added]))
