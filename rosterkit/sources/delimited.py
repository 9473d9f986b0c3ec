"""Headerless delimited text: dialect detection and the scan into raw rows.

Files of every size are read one way: Spark splits them into lines, and generated code tokenizes the lines. A quoted
cell may hold line breaks. What a line does to the quote state (closed or open before it, closed or open after it) is
known from the line alone, so the states of a file follow from its lines by windows over single blocks and one row
per block. Only files with a line that leaves a quote open need that step; in all others each line is a record.

UTF-16 files are split by byte ranges of whole units, and each range gives the lines that start in it.

Rules: text cells, empty cell = null, exact ``row_idx``; a quote starts a quoted cell only as its first character and
what follows the closing quote is taken as it is; line breaks inside quotes are given as line feeds; an opening quote
that its file never closes is ordinary text, and the lines after it are records. A file whose bytes are not all
UTF-8 is code page 1252, whose undefined bytes become spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rosterkit.operators.joins import join_small
from rosterkit.schema import DIALECT_SAMPLE_BYTES, TEXT_TYPES
from rosterkit.session import stage
from rosterkit.sources.catalog import spread
from rosterkit.sources.storage import open_file, read_start

# Separators considered, and what the code page 1252 has in place of the C1 control characters.
SEPARATORS = [",", ";", "\t", "|"]
QUOTES = ['"', "'"]
C1_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
CP1252_C1 = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace").replace("�", " ")
# End of fixed values.

# Text files by name, whatever the case of their extension.
TEXT_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in kind) for kind in TEXT_TYPES) + "}"
BATCH_ROWS = 10_000

DIALECTS = "path string, length bigint, encoding string, separator string, quote string, width int, error string"
LINES = "path string, block bigint, place bigint, value string, error string"


def guess_encoding(sample: bytes) -> str | None:
    """Encoding of the first bytes of a file; None when they are no text."""
    import codecs

    if sample.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if sample.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    if b"\0" in sample:
        even, odd = sample[::2].count(0), sample[1::2].count(0)
        half = len(sample) // 4
        return "utf-16-le" if odd > half >= even else "utf-16-be" if even > half >= odd else None
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample)
        return "utf-8"
    except UnicodeDecodeError:
        return "cp1252"


def guess_dialect(text: str, cut: bool = False) -> tuple[str, str, int]:
    """Separator, quote and widest row of a text sample: the separator for which most rows agree on one width.

    Among readings that agree as much, one whose quote is the first to start a cell comes before one that takes this
    quote as text: the separators inside quoted cells would make its rows wider. A long sample of one row agrees with
    itself under any separator, so there a separator behind which a quote stands comes first. A separator that stands
    only inside the quoted cells of a reading that agrees at least as much is text; the quote that closes such a cell
    may stand right behind it. The last line of a ``cut`` sample is not whole.
    """
    import csv
    from collections import Counter

    lines = text.splitlines()
    if len(lines) > 1 and (cut or len(text) >= DIALECT_SAMPLE_BYTES - 4):
        lines = lines[:-1]  # the last line of a full sample is cut
    readings = []
    first = {s: re.search(rf"(?:^|{re.escape(s)})([{''.join(QUOTES)}])", text, re.MULTILINE) for s in SEPARATORS}
    for quote in QUOTES:
        for separator in SEPARATORS:
            leads = first[separator].group(1) == quote if first[separator] else quote == QUOTES[0]
            rows = [len(r) for r in csv.reader(lines, delimiter=separator, quotechar=quote) if r]
            widths = Counter(w for w in rows if w > 1)
            if widths:
                width, agreeing = widths.most_common(1)[0]
                behind = len(rows) == 1 and len(text) >= DIALECT_SAMPLE_BYTES // 4 and first[separator] is not None
                readings.append((agreeing / len(rows), leads + (leads and behind), width, separator, quote, max(rows)))
    readings.sort(key=lambda r: r[:3], reverse=True)
    for agreement, leads, _, separator, quote, _ in list(readings):
        if leads and first[separator]:
            q, before = re.escape(quote), re.escape(separator)
            outside = re.sub(rf"(^|{before}){q}[^{q}]*(?:{q}{q}[^{q}]*)*(?:{q}|\Z)", r"\1", text, flags=re.MULTILINE)
            readings = [r for r in readings if r[0] > agreement or r[3] in outside] or readings
    return readings[0][3:] if readings else (",", '"', 1)


def _sniff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path, length in zip(batch["path"], batch["length"]):
            try:
                sample = read_start(path, DIALECT_SAMPLE_BYTES)
                encoding = guess_encoding(sample)
                if encoding is None:
                    raise ValueError("not a text file")
                separator, quote, width = guess_dialect(sample.decode(encoding, errors="replace"), length > len(sample))
                found.append((path, length, encoding, separator, quote, width, None))
            except Exception as e:  # one bad file must not stop the others
                found.append((path, length, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(found, columns=["path", "length", "encoding", "separator", "quote", "width", "error"]).astype(
            {"width": "Int32"}
        )


def sniff_dialects(files: DataFrame) -> DataFrame:
    """Encoding, separator and quote of every text file, from its first bytes only."""
    return spread(files.select("path", "length")).mapInPandas(_sniff, DIALECTS)


def _wide() -> Column:
    return F.col("encoding").startswith("utf-16")


def split_bytes(spark: SparkSession) -> int:
    """Size of Spark's file splits."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB")
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", text.strip().lower()).groups()
    return int(number) * 1024 ** " kmgt".index(unit or " ")


def wide_ranges(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Byte ranges of UTF-16 files, as long as Spark's own file splits and of whole code units."""
    bytes_each = max(2, split_bytes(spark) // 2 * 2)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(bytes_each).cast("long"))
    ranges = files.select("path", "encoding", F.col("length").alias("size"), F.explode(starts).alias("start"))
    end = F.least(F.col("start") + bytes_each, F.col("size"))
    return spread(ranges.select("path", "encoding", "size", "start", end.alias("end"), (end - F.col("start")).alias("length")), "path", "start")


def wide_units(data: bytes, encoding: str, size: int) -> tuple[str, int]:
    """Encoding without a byte order mark, and the bytes of the mark, of the first bytes of a UTF-16 file."""
    import codecs

    if size % 2:
        raise ValueError("a UTF-16 file of an odd number of bytes")
    if encoding != "utf-16":
        return encoding, 0
    return ("utf-16-be" if data.startswith(codecs.BOM_UTF16_BE) else "utf-16-le"), 2


def range_lines(read, size: int, start: int, end: int, encoding: str) -> list[str]:
    """The lines of a UTF-16 file that start within a byte range; ``read(at, n)`` gives bytes of the file.

    The range is read with the two units before it, which tell whether a line starts at its begin, and beyond its end up to
    the end of its last line. Units are numbered as in the file, so both ends fall between units.
    """
    encoding, mark = wide_units(read(0, 2), encoding, size)
    unit = "<u2" if encoding == "utf-16-le" else ">u2"
    first = max(start - 2, 0)
    data, step = read(first, end - first + 2), 1 << 16
    while True:
        units = np.frombuffer(data, dtype=unit)
        feed, back = units == 10, units == 13
        breaks = feed.copy()
        breaks[:-1] |= back[:-1] & ~feed[1:]
        if len(units) and first + len(data) >= size:
            breaks[-1] |= back[-1]
        after = np.flatnonzero(breaks) + 1  # where a line starts, in units of the data
        begins = after * 2 + first
        begins = begins[(begins >= start) & (begins < end) & (begins > 0)] if start else np.concatenate(([mark], begins[begins < end]))
        if not len(begins) or begins[0] >= size:
            return []
        ends = after[after * 2 + first > begins[-1]]
        if len(ends) or first + len(data) >= size:
            break
        data, step = data + read(first + len(data), step), 2 * step
    stop = int(ends[0]) * 2 if len(ends) else len(data)
    text = data[int(begins[0]) - first:stop].decode(encoding)
    lines = re.split("\r\n|\r|\n", text)
    return lines[:-1] if len(ends) else lines


def _wide_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of byte ranges of UTF-16 files; Spark's line reader splits single-byte text only."""
    for batch in batches:
        for path, encoding, size, start, end in zip(batch["path"], batch["encoding"], batch["size"], batch["start"], batch["end"]):
            try:
                with open_file(path) as raw:
                    def read(at, n):
                        raw.seek(at)
                        return raw.read(max(0, min(n, size - at)))

                    values, error = range_lines(read, size, start, end, encoding), None
            except Exception as e:  # reported per file; lines already read are discarded by the caller
                values, error = [None], f"{type(e).__name__}: {e}"
            for first in range(0, len(values), BATCH_ROWS):
                part = values[first:first + BATCH_ROWS]
                yield pd.DataFrame({"path": path, "block": start, "place": range(first, first + len(part)), "value": part, "error": error})


def decoded(value: Column, encoding: Column) -> Column:
    """Text of a raw line. Spark keeps the bytes of a line as they are, so code page 1252 is mapped here."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.when(encoding == "cp1252", F.translate(latin, C1_CONTROLS, CP1252_C1)).otherwise(value)


def _quoted(quote: str) -> tuple[str, str]:
    """Patterns of a quote and of the text between two; possessive, so that long cells cost no stack."""
    q = f"\\x{ord(quote):02x}"
    return q, f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"


def split_record(value: Column, separator: str, quote: str) -> Column:
    """Cells of one record. Records without a quote take a plain split; others are matched field by field."""
    sep = f"\\x{ord(separator):02x}"
    q, inner = _quoted(quote)
    fields = F.regexp_extract_all(
        F.concat(F.lit(separator), value), F.lit(f"{sep}({q}{inner}{q}[^{sep}]*+|[^{sep}]*+)"), F.lit(1)
    )

    def unquoted(cell: Column) -> Column:
        whole = f"(?s)^{q}({inner}){q}(.*)\\z"
        inside = F.replace(F.regexp_extract(cell, whole, 1), F.lit(quote * 2), F.lit(quote))
        return F.when(cell.rlike(whole), F.concat(inside, F.regexp_extract(cell, whole, 2))).otherwise(cell)

    return (
        F.when(value == "", F.array().cast("array<string>"))
        .when(value.contains(quote), F.transform(fields, unquoted))
        .otherwise(F.split(value, sep, -1))
    )


def opens_quote(value: Column, separator: str, quote: str) -> Column:
    """Whether a line that starts outside quotes ends inside."""
    return value.contains(quote) & value.rlike(_open_end(separator, quote))


def stays_open(value: Column, separator: str, quote: str) -> Column:
    """Whether a line that starts inside quotes ends inside."""
    sep = f"\\x{ord(separator):02x}"
    q, inner = _quoted(quote)
    rest = _open_end(separator, quote).removeprefix("^")
    return ~value.contains(quote) | value.rlike(f"^{inner}(?:\\z|{q}[^{sep}]*+{sep}{rest})")


def _open_end(separator: str, quote: str) -> str:
    """Complete fields, then one whose quote is not closed."""
    sep = f"\\x{ord(separator):02x}"
    q, inner = _quoted(quote)
    return f"^(?:(?:{q}{inner}{q}[^{sep}]*+|[^{sep}{q}][^{sep}]*+|){sep})*+{q}{inner}\\z"


def _by_dialect(rule, value: Column) -> Column:
    """Apply a rule by the line's own dialect; the branches are fixed patterns."""
    chosen = None
    for quote in QUOTES:
        for separator in SEPARATORS:
            mine = (F.col("separator") == separator) & (F.col("quote") == quote)
            branch = rule(value, separator, quote)
            chosen = F.when(mine, branch) if chosen is None else chosen.when(mine, branch)
    return chosen


def _cells(value: Column) -> Column:
    return F.transform(_by_dialect(split_record, value), lambda c: F.nullif(c, F.lit("")))


def _lines(spark: SparkSession, folder: str | list[str], wide: DataFrame | None, dialects: DataFrame) -> DataFrame:
    """Raw lines of text files with their dialect and place; places of one block are consecutive."""
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", TEXT_GLOB).text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"), "value",
        )
    )
    lines = join_small(raw, dialects.filter(~_wide()), ["path"], salt_by=["place"])
    if wide is None:
        return lines
    return lines.unionByName(join_small(wide, dialects.filter(_wide()), ["path"], salt_by=["place"]))


def _tokenized(lines: DataFrame) -> DataFrame:
    """Cells of every line taken as a record, with what shows whether it is one."""
    return lines.withColumn("text", decoded(F.col("value"), F.col("encoding"))).select(
        "path", "block", "place", _cells(F.col("text")).alias("cells"),
        _by_dialect(opens_quote, F.col("text")).alias("opens"), F.is_valid_utf8("value").alias("utf8"),
    )


def _offsets(blocks: DataFrame) -> DataFrame:
    """Records before each block of a file, from one row per block with its number of ``rows``."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return stage(blocks.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows"), "offsets")


def _numbered(tokenized: DataFrame) -> DataFrame:
    """Exact ``row_idx`` for lines that are records: the first place and the number of rows of each block suffice."""
    blocks = tokenized.groupBy("path", "block").agg(F.min("place").alias("first_place"), F.count("*").alias("rows"))
    return join_small(tokenized, _offsets(blocks), ["path", "block"], salt_by=["place"]).select(
        F.col("path").alias("file_path"), (F.col("place") - F.col("first_place") + F.col("offset")).alias("row_idx"), "cells"
    )


def _inside(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Quote state before each row, if the first of its keys starts outside (``if_out``) and inside (``if_in``).

    A row with ``opens`` = ``stays`` sets the state, one with ``opens`` only turns it, any other leaves it.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("opens") == F.col("stays")
    turns = rows.withColumn("_turns", F.coalesce(F.count_if(F.col("opens") & ~F.col("stays")).over(before), F.lit(0)))
    last = turns.withColumn("_last", F.last(F.when(sets, F.struct("opens", "_turns")), True).over(before))
    since = (F.col("_turns") - F.coalesce("_last._turns", F.lit(0))) % 2 == 1
    return last.select(
        *rows.columns,
        (F.coalesce("_last.opens", F.lit(False)) != since).alias("if_out"),
        (F.coalesce("_last.opens", F.lit(True)) != since).alias("if_in"),
    )


def _records(lines: DataFrame) -> DataFrame:
    """Rows of files in which some line leaves a quote open: lines of one record are joined again.

    Windows cover one block, or one row per block of a file; only lines of records with several lines are grouped.
    """
    text = F.col("text")
    states = stage(_inside(
        lines.withColumn("text", decoded(F.col("value"), F.col("encoding"))).select(
            "path", "block", "place", "separator", "quote", "text",
            _by_dialect(opens_quote, text).alias("opens"), _by_dialect(stays_open, text).alias("stays"),
        ), ["path", "block"], "place",
    ), "states")
    after = lambda inside: F.when(inside, F.col("stays")).otherwise(F.col("opens"))
    at = F.struct("block", "place")
    blocks = states.groupBy("path", "block").agg(
        F.max_by(after(F.col("if_out")), "place").alias("opens"), F.max_by(after(F.col("if_in")), "place").alias("stays")
    )
    entered = stage(_inside(blocks, ["path"], "block").select("path", "block", F.col("if_out").alias("entry")), "entered")
    placed = join_small(states, entered, ["path", "block"], salt_by=["place"]).withColumn(
        "inside", F.when(F.col("entry"), F.col("if_in")).otherwise(F.col("if_out"))
    )
    ends = stage(placed.groupBy("path").agg(
        F.max_by(after(F.col("inside")), at).alias("unclosed"), F.max(F.when(~F.col("inside"), at)).alias("last_start")
    ), "ends")
    in_block = Window.partitionBy("path", "block").orderBy("place")
    starts = stage(
        join_small(placed, ends, ["path"], salt_by=["place"])
        .withColumn("inside", F.col("inside") & ~(F.col("unclosed") & (at > F.col("last_start"))))
        .withColumn("started", F.count_if(~F.col("inside")).over(in_block))
        .withColumn("several", F.col("inside") | F.coalesce(F.lead("inside").over(in_block), F.lit(True)))
        .select("path", "block", "place", "separator", "quote", "text", "inside", "started", "several"),
        "starts",
    )
    offsets = _offsets(starts.groupBy("path", "block").agg(F.count_if(~F.col("inside")).alias("rows")))
    numbered = join_small(starts, offsets, ["path", "block"], salt_by=["place"]).withColumn(
        "row_idx", F.col("offset") + F.col("started") - 1
    )
    record = ["path", "row_idx", "separator", "quote"]
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    joined = numbered.filter("several").groupBy(*record).agg(
        F.array_join(F.transform(parts, lambda line: line["text"]), "\n").alias("text")
    )
    both = numbered.filter("not several").select(*record, "text").unionByName(joined)
    return both.select(F.col("path").alias("file_path"), "row_idx", _cells(text).alias("cells"))


def scan_delimited(spark: SparkSession, folder: str | list[str], files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows ``(file_path, sheet, row_idx, cells)`` and errors ``(file_path, error_msg)`` of all text files.

    ``files`` is the catalog of ``folder``. The rows are staged once: detection and extraction must see the same
    row numbers, and both then read Parquet with ``row_idx`` statistics. A file that cannot be decoded gives no rows.
    """
    sniffed = stage(sniff_dialects(files.filter(F.col("kind") == "Text")), "sniffed")
    message = lambda df, path: df.filter(F.col("error").isNotNull()).select(
        F.col(path).alias("file_path"), F.col("error").alias("error_msg")
    )
    errors = message(sniffed, "path")
    one_byte = F.when(F.col("encoding") == "utf-8-sig", "utf-8").otherwise(F.col("encoding"))
    dialects = sniffed.filter(F.col("error").isNull()).select("path", one_byte.alias("encoding"), "separator", "quote")
    wide = None
    if not dialects.filter(_wide()).isEmpty():
        read = stage(wide_ranges(spark, sniffed.filter(_wide())).mapInPandas(_wide_lines, LINES), "wide")
        failed = stage(message(read, "path"), "wide-errors")
        errors = errors.unionByName(failed)
        wide = join_small(read.drop("error"), failed.select(F.col("file_path").alias("path")), ["path"], "left_anti", ["place"])
    tokenized = stage(_tokenized(_lines(spark, folder, wide, dialects)), "tokenized")
    checked = tokenized.groupBy("path").agg(F.max("opens").alias("opened"), F.min("utf8").alias("utf8"))
    true_encoding = F.when(_wide(), F.col("encoding")).when(F.col("utf8"), "utf-8").otherwise("cp1252")
    found = stage(
        dialects.join(checked, "path").withColumn("true_encoding", true_encoding)
        .withColumn("other", F.col("encoding") != F.col("true_encoding")).drop("utf8", "encoding")
        .withColumnRenamed("true_encoding", "encoding"),
        "checked",
    )
    again = found.filter("opened or other")
    if again.isEmpty():
        rows = _numbered(tokenized)
    else:
        done = found.filter("not opened and not other").select("path")
        rows = _numbered(join_small(tokenized, done, ["path"], "left_semi", ["place"]))
        other = found.filter("other and not opened")
        rows = rows.unionByName(_numbered(stage(_tokenized(_lines(spark, folder, wide, other)), "tokenized")))
        rows = rows.unionByName(_records(_lines(spark, folder, wide, found.filter("opened"))))
    return stage(rows, "raw-text").select("file_path", F.lit("").alias("sheet"), "row_idx", "cells"), errors
