"""Write the derived sheets as real files, so that the file sources can be queried and checked.

Every file holds at most ``views.FILE_ROWS`` data rows; tasks write their own files to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rosterkit.session import staging_path
from rosterkit.sources.storage import write_stream


def write_files(files: DataFrame, folder: str) -> str:
    """Write ``(name, content binary)`` rows as files below ``folder``; returns the folder."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [write_stream(f"{folder}/{name}", [content]) for name, content in zip(batch["name"], batch["content"])]
            yield pd.DataFrame({"size": sizes})

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.select("name", "content").repartition(tasks, "name").mapInPandas(write, "size bigint").agg(F.sum("size")).collect()
    return folder


def file_base_name():
    return F.regexp_extract("file_path", "([^/]+)$", 1).alias("name")


def file_rows(raw: DataFrame) -> DataFrame:
    """``(name, rows)`` with the rows of each bounded file in order."""
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "cells")))
    return raw.groupBy(file_base_name()).agg(ordered.alias("rows"))


def delimited(raw: DataFrame) -> DataFrame:
    """Text files whose separator varies by file; cells are quoted in every second file."""
    number = F.regexp_extract("name", r"(\d+)", 1).cast("int")
    separator = F.element_at(F.array(*map(F.lit, [",", ";", "\t", "|"])), number % 4 + 1)
    quoted = lambda c: F.when((number % 2 == 0) & (c != ""), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    line = lambda r: F.call_function(
        "array_join", F.transform(r["cells"], lambda c: quoted(F.coalesce(c, F.lit("")))), F.col("separator")
    )
    return (
        file_rows(raw).withColumn("separator", separator)
        .select("name", F.encode(F.concat(F.array_join(F.transform("rows", line), "\n"), F.lit("\n")), "UTF-8").alias("content"))
    )


def quoted_documents(documents: DataFrame, per_file: int = 20) -> DataFrame:
    """Documents as quoted fields with their own line breaks, some files in code page 1252 or UTF-16."""
    record = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\r\n'))
    number = F.floor(F.col("doc_id") / per_file)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))), lambda x: x["r"]), "")
    return documents.groupBy(number.alias("n")).agg(body.alias("text")).select(
        F.format_string("docs_%d.txt", "n").alias("name"),
        F.when(F.col("n") % 5 == 4, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )


def odd_customers(customer: DataFrame, per_file: int = 50) -> DataFrame:
    """Files of four kinds in turn: byte order mark, code page 1252 only at the end, one stray quote, text behind quotes."""
    k, n = F.col("c_custkey"), F.floor(F.col("c_custkey") / per_file)
    cell = (
        F.when(n % 4 == 0, "é")
        .when(n % 4 == 1, F.when(k % per_file == per_file - 1, "é\u0081").otherwise("e"))
        .when(n % 4 == 2, F.when(k % per_file == per_file // 2, '"z').otherwise("z"))
        .otherwise('"a""b"x""y')
    )
    line = F.concat_ws(",", k.cast("string"), cell, F.repeat(F.lit("x"), F.lit(300)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("line")))), lambda r: r["line"]), "\n")
    return customer.groupBy(n.alias("n")).agg(body.alias("text")).select(
        F.format_string("odd_%d.csv", "n").alias("name"),
        F.when(F.col("n") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(F.col("n") % 4 == 1, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )


def _book_bytes(rows) -> bytes:
    """A minimal workbook with one sheet; every other text is shared, the rest inline."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared, lines = [], []
    for r in rows:
        cells = []
        for i, value in enumerate(r["cells"]):
            if value is None or value == "":
                continue
            ref = f"{chr(65 + i)}{r['row_idx'] + 1}"
            if i % 2 == 0:
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared)}</v></c>')
                shared.append(value)
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
        lines.append(f'<row r="{r["row_idx"] + 1}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(raw: DataFrame) -> DataFrame:
    """One workbook per bounded file; a task holds the cells of one file at a time."""
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("row_idx")[["row_idx", "cells"]].to_dict("records")
        return pd.DataFrame({"name": [key[0].replace(".csv", ".xlsx")], "content": [_book_bytes(ordered)]})

    named = raw.select(file_base_name(), "row_idx", "cells")
    return named.groupBy("name").applyInPandas(build, "name string, content binary")


def archives(files: DataFrame) -> DataFrame:
    """Each file alone in an archive: zip, zip within zip, tar, or an unreadable type, by turns."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import tarfile
        import zipfile

        def zipped(name, content):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(name, content)
            return out.getvalue()

        for batch in batches:
            names, contents = [], []
            for name, content in zip(batch["name"], batch["content"]):
                turn = int(re.search(r"\d+", name)[0]) % 4
                stem = name.rsplit(".", 1)[0]
                if turn == 0:
                    contents.append(zipped(f"in/{name}", content))
                elif turn == 1:
                    contents.append(zipped(f"{stem}.zip", zipped(name, content)))
                elif turn == 2:
                    out = io.BytesIO()
                    with tarfile.open(fileobj=out, mode="w") as tar:
                        info = tarfile.TarInfo(f"in/{name}")
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
                    contents.append(out.getvalue())
                else:
                    contents.append(b"not an archive")
                names.append(f"{stem}.{['zip', 'zip', 'tar', '7z'][turn]}")
            yield pd.DataFrame({"name": names, "content": contents})

    return files.mapInPandas(build, "name string, content binary")


def folder(spark, label: str) -> str:
    """A fresh folder for rendered files."""
    return staging_path(spark, label)
