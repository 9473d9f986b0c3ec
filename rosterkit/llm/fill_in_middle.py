"""Fill-in-middle transformation of whole texts, cut at units with a sparse exception index.

A text is cut into units (runs of ASCII letters, and every other character alone) and two of its unit borders, drawn
from a hash of its id, part it into prefix, middle and suffix.  All borders are found on the UTF-8 bytes of many texts at
once.  Only multibyte characters are recorded, by position and by the bytes they have beyond one: a binary search among
them converts byte cuts to code points or back, and what lies between two of them is arithmetic.  An ASCII text has an
empty index.

Texts are read and written once, in tasks without a shuffle; nothing about the other rows is needed.

Defined results: a null text is empty and gives an empty ``plain`` output; a null id draws as if its number were empty;
equal ids draw equal hashes; equal rows give equal results; extra columns pass through ``row`` untouched; an empty table
gives no rows; a text's length is bounded by the two gigabytes of a column value only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterkit.llm.words import slabs, text_sizes

# The marks of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# End of fixed values.

SEED = 1
PERCENT = 90       # texts that are transformed
SPM_PERCENT = 20   # of these, with the suffix first
SLAB_BYTES = 1 << 22
_MARK = "|".join((PREFIX, SUFFIX, MIDDLE))


class CodePoints:
    """Places of the multibyte characters of a UTF-8 buffer, and the bytes beyond one of all before each."""

    def __init__(self, data: np.ndarray):
        self.places = np.flatnonzero(data >= 0xC0)
        lead = data[self.places]
        beyond = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.beyond = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(beyond)])

    def of_bytes(self, at: np.ndarray) -> np.ndarray:
        """Code points before byte positions that begin a character."""
        return at - self.beyond[np.searchsorted(self.places, at)]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte positions of characters by number."""
        return points + self.beyond[np.searchsorted(self.places - self.beyond[:-1], points)]


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte positions where a unit begins; ``starts`` are those of the texts, which never share a unit."""
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[starts[starts < len(data)]] = True
    return np.flatnonzero(begins)


def _views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without nulls, and the offsets of its texts."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the bytes where its prefix and its middle end."""
    begins = unit_starts(data, offsets[:-1])
    first = np.searchsorted(begins, offsets)
    units = np.diff(first)
    begins = np.concatenate([begins, [len(data)]])
    drawn = np.sort(np.stack([draw % (units + 1) for draw in draws]), axis=0)
    ends = [np.where(d == units, offsets[1:], begins[np.minimum(first[:-1] + d, len(begins) - 1)]) for d in drawn]
    return units, ends[0], ends[1]


def _transform(texts: pa.Array, kind: np.ndarray, draws: list[np.ndarray], at: list[np.ndarray] | None) -> list[pa.Array]:
    """Units, code points of prefix and middle, and output of each text; ``kind``: 0 plain, 1 prefix first, 2 suffix first.

    ``at`` gives the cuts as code points instead of drawn units; beyond the text they mean its end.
    """
    data, offsets = _views(texts)
    index = CodePoints(data)
    units, one, two = _cuts(data, offsets, draws)
    points = index.of_bytes(offsets)
    if at is not None:
        one, two = (index.to_bytes(np.minimum(points[:-1] + x, points[1:])) for x in np.sort(np.stack(at), axis=0))
    ends = [index.of_bytes(x) for x in (one, two)]
    plain = kind == 0
    raw = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    made = []
    for k, a, b, c, d in zip(kind.tolist(), offsets.tolist(), one.tolist(), two.tolist(), offsets[1:].tolist()):
        if k == 0:
            made.append(raw[a:d])
        elif k == 1:
            made.append(b"".join((marks[0], raw[a:b], marks[1], raw[c:d], marks[2], raw[b:c])))
        else:
            made.append(b"".join((marks[1], raw[c:d], marks[0], raw[a:b], marks[2], raw[b:c])))
    return [pa.array(units, pa.int64()), pa.array(ends[0] - points[:-1], pa.int64(), mask=plain),
            pa.array(ends[1] - ends[0], pa.int64(), mask=plain), pa.array(made, pa.binary()).cast(pa.string(), safe=False)]


def draws_of(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, draws: list[Column], percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> Column:
    """``plain``, ``psm`` or ``spm``; a text that is empty or holds a mark stays plain."""
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return F.when((text == "") | marked | (draws[2] % 100 >= percent), "plain").when(draws[3] % 100 < spm_percent, "spm").otherwise("psm")


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT,
                   keep: list[str] | None = None, cuts: tuple[str, str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns, by default all but ``text``, as a struct), ``form, n, prefix_chars, middle_chars, output``.

    ``cuts`` names two integer columns with code-point cuts to use instead of drawn units (null: 0).
    """
    kept = [c for c in docs.columns if c != "text"] if keep is None else keep
    draws = draws_of(F.col("doc_id"), seed)
    given = [F.greatest(F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)), F.lit(0)) for c in cuts or ()]
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.array(*draws).alias("draws"), F.array(*given).cast("array<long>").alias("cuts"))
    form = form_of(F.col("text"), [F.col("draws")[i] for i in range(4)], percent, spm_percent)
    work = work.select("row", "text", form.alias("form"), "draws", "cuts")

    def run(batches):
        for batch in batches:
            for start, stop in slabs(text_sizes(batch.column(1)), SLAB_BYTES):
                part = batch.slice(start, stop - start)
                texts, form = part.column(1), part.column(2)
                kind = np.select([np.array(form.to_pylist()) == f for f in ("psm", "spm")], [1, 2], 0)
                drawn = part.column(3).flatten().to_numpy().reshape(-1, 4)
                at = part.column(4).flatten().to_numpy().reshape(len(part), -1)
                made = _transform(texts, kind, [drawn[:, 0], drawn[:, 1]], [at[:, 0], at[:, 1]] if at.shape[1] else None)
                yield pa.RecordBatch.from_arrays([part.column(0), form, *made],
                                                 names=["row", "form", "n", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([work.schema["row"], T.StructField("form", T.StringType())]).add("n", "long").add(
        "prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return work.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.

    A transformed text holds no mark, and no mark can arise across a border, so the output splits at its three marks only.
    """
    parts = F.split(output, _MARK, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))).otherwise(
        F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
