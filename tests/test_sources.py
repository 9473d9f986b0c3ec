import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from rosterkit.operators import aliases as al
from rosterkit.sources import alias_files, alias_library, archives, catalog, delimited, sinks, workbooks


def text_rows(spark, folder):
    rows, errors = delimited.scan_delimited(spark, str(folder), catalog.file_catalog(spark, str(folder)))
    found = {}
    for r in sorted(rows.collect(), key=lambda r: r.row_idx):
        found.setdefault(r.file_path.rsplit("/", 1)[-1], []).append(list(r.cells))
    return found, {r.file_path.rsplit("/", 1)[-1]: r.error_msg for r in errors.collect()}


def test_dialects_encodings_and_bad_files(spark, tmp_path):
    body = [["Name", "Sex", "Note"], ["Ada Mära", "F", "x"], ["Ben Okto", "M"], ["Cy", "", "y", "extra"]]
    for name, sep, enc in [("comma.csv", ",", "utf-8"), ("semi.txt", ";", "cp1252"), ("tab.rpt", "\t", "utf-16"), ("pipe.csv", "|", "utf-8-sig")]:
        (tmp_path / name).write_bytes("\r\n".join(sep.join(r) for r in body).encode(enc))
    (tmp_path / "bad.csv").write_bytes(bytes([0, 159, 146, 150, 0, 0, 1, 2, 255]) * 50)
    (tmp_path / "skip.json").write_text("{}")
    found, errors = text_rows(spark, tmp_path)
    want = [["Name", "Sex", "Note"], ["Ada Mära", "F", "x"], ["Ben Okto", "M"], ["Cy", None, "y", "extra"]]
    assert found == {n: want for n in ("comma.csv", "semi.txt", "tab.rpt", "pipe.csv")}
    assert list(errors) == ["bad.csv"]


def test_quotes(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('Name,Note\n"Mara, Ada","say ""hi"""\nBen,5" pipe"\n"Cy"x,""\n')
    (tmp_path / "lines.csv").write_text('Name,Note\n"Mara,\nAda",a\nBen,b\n')
    found, _ = text_rows(spark, tmp_path)
    assert found["plain.csv"] == [["Name", "Note"], ["Mara, Ada", 'say "hi"'], ["Ben", '5" pipe"'], ["Cyx", None]]
    assert found["lines.csv"] == [["Name", "Note"], ["Mara,\nAda", "a"], ["Ben", "b"]]


def test_stray_quotes_and_late_bytes(spark, tmp_path):
    (tmp_path / "stray.csv").write_text('a,b\nx"y,"z\nB,P2\nC,P3\n')
    (tmp_path / "after.csv").write_text('a,b\n"ab"x""y,1\nc,d\n')
    (tmp_path / "late.csv").write_bytes(b"name,note\n" * 2000 + "Jos\xe9,x\x81\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "SHOUT.CSV").write_text("a,b\nc,d\n")
    found, errors = text_rows(spark, tmp_path)
    assert found["stray.csv"] == [["a", "b"], ['x"y', '"z'], ["B", "P2"], ["C", "P3"]]
    assert found["after.csv"] == [["a", "b"], ['abx""y', "1"], ["c", "d"]]
    assert found["late.csv"][-1] == ["Jos\xe9", "x "] and len(found["late.csv"]) == 2001
    assert found["SHOUT.CSV"] == [["a", "b"], ["c", "d"]]
    assert "empty.csv" not in found and not errors


@pytest.mark.parametrize("ending", ["", 'z,"never closed\nmore,text\n'])
def test_records_over_many_blocks(spark, tmp_path, ending):
    """Quoted cells with line breaks, cut by splits anywhere, against the reader of the standard library."""
    import csv
    import random

    rng = random.Random(5)
    piece = lambda: "".join(rng.choice(["a", "b", ",", "\n", '"', "x y", ""]) for _ in range(rng.randrange(9)))
    rows = [[str(i), piece(), piece()] for i in range(3000)]
    with open(tmp_path / "many.csv", "w", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows(rows)
        file.write(ending)
    want = [[c or None for c in r] for r in rows]
    if ending:
        want += [["z", '"never closed'], ["more", "text"]]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found, _ = text_rows(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found["many.csv"] == want


def test_no_shuffle_of_raw_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nc,d\n")
    rows, _ = delimited.scan_delimited(spark, str(tmp_path), catalog.file_catalog(spark, str(tmp_path)))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_split_file_keeps_exact_row_numbers(spark, tmp_path):
    rows = [f"Person {i},{i}" for i in range(20000)]
    (tmp_path / "big.csv").write_text("\n".join(rows))
    (tmp_path / "other.csv").write_text("\n".join(f"x{i},{i}" for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got, _ = delimited.scan_delimited(spark, str(tmp_path), catalog.file_catalog(spark, str(tmp_path)))
        wrong = got.filter(F.get("cells", 1).cast("long") != F.col("row_idx"))
        assert got.count() == 20300 and wrong.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def xlsx(path, sheets, styles=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Ada Mara</t></si><si><r><t>Ben </t></r><r><t>Okto</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd\\/mm\\/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, data in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{data}</sheetData></worksheet>")


def test_workbook_cells(spark, tmp_path):
    first = (
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="C1" t="str"><v>DOB</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3"><v>12</v></c><c r="C3" s="1"><v>32888</v></c><c r="D3"><v>0.10000000000000001</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4" t="b"><v>1</v></c><c r="C4" s="2"><v>32888.5</v></c></row>'
    )
    xlsx(tmp_path / "book.xlsx", {"People": first, "2601": '<row><c t="inlineStr"><is><t>x</t></is></c></row>'})
    (tmp_path / "locked.xlsx").write_bytes(b"\xd0\xcf\x11\xe0" + b"0" * 100)
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0" + b"0" * 100)
    rows, errors = workbooks.scan_workbooks(catalog.file_catalog(spark, str(tmp_path)))
    got = {(r.sheet, r.row_idx): list(r.cells) for r in rows.collect()}
    assert got == {
        ("People", 0): ["Name", None, "DOB"], ("People", 2): ["Ada Mara", "12", "1990-01-15", "0.1"],
        ("People", 3): ["Ben Okto", "true", "1990-01-15 12:00:00"], ("2601", 0): ["x"],
    }
    assert sorted(r.file_path.rsplit("/", 1)[-1] for r in errors.collect()) == ["locked.xlsx", "old.xls"]


def test_nested_archives_and_failures(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def zipped(**files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, content in files.items():
                z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
        return buffer.getvalue()

    inner = zipped(b_dot_csv="x,y\n1,2\n")
    (src / "outer.zip").write_bytes(zipped(d__a_dot_csv="x,y\n", inner_dot_zip=inner))
    with tarfile.open(src / "t.tar", "w") as tar:
        info = tarfile.TarInfo("../evil name.csv")
        info.size = 4
        tar.addfile(info, io.BytesIO(b"p,q\n"))
    (src / "r.rar").write_bytes(b"Rar!")
    (src / "broken.zip").write_bytes(b"PK broken")
    members, errors = archives.expand_archives(spark, catalog.file_catalog(spark, str(src)), str(out))
    assert sorted(r.file_name for r in members.collect()) == ["a.csv", "b.csv", "evil name.csv", "inner.zip"]
    assert sorted(r.file_path.rsplit("/", 1)[-1] for r in errors.collect()) == ["broken.zip", "r.rar"]
    names = {r.file_name for r in catalog.file_catalog(spark, str(out), ["Text"]).collect()}
    assert names == {"a.csv", "b.csv", "evil name.csv"} and not (tmp_path / "evil name.csv").exists()


def test_alias_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "defaults.json").write_text(json.dumps({"name": ["Full Name"], "sex": ["Sex"]}, indent=2))
    (tmp_path / "c" / "ab1.json").write_text(json.dumps({"name": ["Assured", 5, ""], "sex": "x", "more": ["y"]}))
    (tmp_path / "c" / "BAD.json").write_text("{oops")
    defaults, own, warnings = alias_files.load_aliases(spark, str(tmp_path / "defaults.json"), str(tmp_path / "c"))
    assert sorted(map(tuple, defaults.collect())) == [("name", "fullname"), ("sex", "sex")]
    assert list(map(tuple, own.collect())) == [("AB1", "name", "assured")]
    assert sorted({r.source for r in warnings.collect()}) == ["BAD", "ab1"] and warnings.count() == 4
    companies = spark.createDataFrame([("AB1",), ("BAD",)], "company_code string")
    merged = al.merge_aliases(defaults, own, companies)
    assert merged.filter("company_code = 'BAD'").count() == 2 and merged.count() == 5
    assert [r.code for r in alias_files.known_company_codes(spark, str(tmp_path / "c")).collect()] == ["BAD", "ab1"]
    with pytest.raises(alias_files.AliasConfigError):
        alias_files.load_aliases(spark, str(tmp_path / "c" / "BAD.json"))


LIBRARY = """# Library
intro

## K1 (older layout)

| Category | Aliases | Notes |
|---|---|---|
| Name | `insname` → INS_NAME/alt · `nm` → NM | Unsafe term |
| First/Last | `last`, "quoted" | |
| Sex | — | |
| Prem | `prem`/`premium` | |
| — | — | Not one-row header |
| DOB | plain | |

## K2

Legend row only.

## K1

| Category | Aliases | Notes |
|---|---|---|
| Name | `nm` → NM | |
"""


def test_alias_cells_and_headings(spark):
    cells = {"`a` → A · `b`→ B/bee, `c`": ["A", "B", "c"], "`a`, `b`": ["a", "b"], "`a`/`b`": ["a", "b"], "—": [], "`open": [], "``": [], "": [],
             "`a` →  ": ["a"], "x `a` text → no": ["a"], "`a` → A\n`b` → /x": ["A", "b"]}
    rows = spark.createDataFrame([(c,) for c in cells], "cell string").select("cell", alias_library.alias_texts(F.col("cell")).alias("found")).collect()
    assert {r.cell: r.found for r in rows} == cells
    heads = {"K1": ("K1", ""), "K1 (old)": ("K1", "old"), " K1\t(a (b)) ": ("K1", "a (b)"), "K1 x": ("", ""), "": ("", ""), "K1 (": ("", "")}
    code, note = alias_library.heading_parts(F.col("h"))
    rows = spark.createDataFrame([(h,) for h in heads], "h string").select("h", code.alias("code"), note.alias("note")).collect()
    assert {r.h: (r.code, r.note) for r in rows} == heads


def test_alias_library(spark, tmp_path):
    (tmp_path / "lib.md").write_text(LIBRARY.rsplit("## K1", 1)[0], encoding="utf-8")
    lib, notes, companies = alias_library.parse_library(spark, str(tmp_path))
    assert sorted((r.category, r.alias_text) for r in lib.collect()) == [
        ("firstlastname", "last"), ("name", "INS_NAME"), ("name", "NM"), ("prem", "prem"), ("prem", "premium"),
    ]
    assert sorted((r.company_code, r.note) for r in notes.collect()) == sorted([
        ("K1", "[heading] older layout"), ("K1", "[DOB] no alias in: plain"), ("K1", "[Name] Unsafe term"),
        ("K1", "[—] Not one-row header"), ("K2", "Legend row only."), ("K2", alias_library.NO_TABLE_NOTE),
    ])
    quality = {r.company_code: r for r in al.alias_quality(lib, notes, companies).collect()}
    assert quality["K1"].unsafe_alias and quality["K1"].special_layout and not quality["K1"].no_name_alias
    assert quality["K2"].no_name_alias and quality["K2"].special_layout
    defaults = al.default_aliases(lib, companies=1)
    assert {r.category for r in defaults.collect()} == {"firstlastname", "name"}
    residual = al.residual_aliases(lib, al.default_aliases(lib, companies=9))
    assert {r.category for r in residual.collect()} == {"firstlastname", "name"}
    sinks.write_library(defaults, residual, al.reference_aliases(lib), notes, quality_df(spark, quality), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "defaults")).count() == 3
    written = spark.read.json(str(tmp_path / "out" / "reference")).collect()
    assert sorted((r.company_code, r.category, r.alias_text) for r in written) == [("K1", "prem", "prem"), ("K1", "prem", "premium")]


def quality_df(spark, quality):
    return spark.createDataFrame([(c,) for c in quality], "company_code string")


def test_repeated_block_replaces_the_earlier(spark, tmp_path):
    (tmp_path / "lib.md").write_text(LIBRARY, encoding="utf-8")
    lib, _, _ = alias_library.parse_library(spark, str(tmp_path))
    assert [(r.company_code, r.alias_text) for r in lib.collect()] == [("K1", "NM")]


def test_ranges_of_wide_text_give_each_line_once():
    import random
    import re

    rng = random.Random(1)
    for trial in range(400):
        text = "".join(rng.choice(["a", "é", "\U0001f600", "\u0a0d", "\u0d0a", "\n", "\r", "\r\n", "bc"]) for _ in range(rng.randrange(0, 40)))
        encoding = rng.choice(["utf-16", "utf-16-le", "utf-16-be"])
        data = text.encode(encoding)
        want = re.split("\r\n|\r|\n", text)
        want = want[:-1] if want[-1] == "" else want
        width = 2 * rng.randrange(1, 12)
        got = []
        for start in range(0, max(len(data), 1), width):
            got += delimited.range_lines(lambda at, n: data[at:at + n], len(data), start, min(start + width, len(data)), encoding)
        assert got == want, (text, encoding, width)


def test_one_wide_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [[f"Name {i}", "x" * (i % 50), f"é{i}"] for i in range(3000)]
    (tmp_path / "wide.csv").write_bytes("\r\n".join(",".join(r) for r in rows).encode("utf-16"))
    (tmp_path / "odd.csv").write_bytes("a,b\n1,2\n".encode("utf-16") + b"x")
    setting = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "8k")
    try:
        files = catalog.file_catalog(spark, str(tmp_path))
        ranges = delimited.wide_ranges(spark, delimited.sniff_dialects(files).filter("path LIKE '%wide.csv'"))
        assert ranges.count() > 10 and ranges.agg(F.max("length")).first()[0] == 8192 and ranges.rdd.getNumPartitions() > 1
        found, errors = delimited.scan_delimited(spark, str(tmp_path), files)
        got = found.orderBy("row_idx").collect()
    finally:
        spark.conf.set(setting, usual)
    assert [r.row_idx for r in got] == list(range(3000))
    assert [r.cells for r in got] == [[c or None for c in r] for r in rows]
    assert [r.file_path[-7:] for r in errors.collect()] == ["odd.csv"]


def test_separators_inside_quoted_cells_do_not_choose_the_dialect():
    from rosterkit.sources.delimited import guess_dialect

    assert guess_dialect('7,"' + "One, two, three; four; five. " * 400)[:2] == (",", '"')  # one record fills the sample
    assert guess_dialect('"a, b",1\n"c, d",2\n') == (",", '"', 2)
    assert guess_dialect("'a, b',1\n'c, d',2\n") == (",", "'", 2)
    assert guess_dialect("a;b\nc;d,e\n") == (";", '"', 2)


def test_separators_that_only_quoted_cells_hold_are_text(spark, tmp_path):
    """A pipe before the closing quote made that quote open a cell; one short record agrees with any separator."""
    from rosterkit.sources.delimited import guess_dialect

    texts = {"two": ["a | b | c |", "word " * 3000], "one": ["a | b | c"], "lines": ["a | b\nc | d"], "late": ["a | é; " * 900, "z"]}
    assert guess_dialect('1,"a | b | c |"\r\n2,"' + "word " * 3000)[:2] == (",", '"')
    assert guess_dialect('1,"a | b | c"\r\n') == (",", '"', 2)
    assert guess_dialect('1,"a | b | c"\r\n2', True) == (",", '"', 2)  # cut within a number
    assert guess_dialect('1;"a,b"\n2;"c,d"\n') == (";", '"', 2)
    assert guess_dialect('1|a,"b"\n2|c;d\n') == ("|", '"', 2)
    for name, values in texts.items():
        body = "".join(f'{i},"{v}"\r\n' for i, v in enumerate(values))
        (tmp_path / f"{name}.txt").write_bytes(body.encode("utf-8"))
        (tmp_path / f"{name}_wide.txt").write_bytes(body.encode("utf-16"))
    found, errors = text_rows(spark, tmp_path)
    want = {name: [[str(i), v] for i, v in enumerate(values)] for name, values in texts.items()}
    assert found == {f"{name}{kind}.txt": rows for name, rows in want.items() for kind in ("", "_wide")} and not errors


def test_effective_aliases_are_made_in_many_tasks_without_repeats(spark, monkeypatch):
    from rosterkit.operators import aliases as al

    monkeypatch.setattr(al, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(al, "BLOCK_ALIASES", 3)
    default = [("name", f"n{i}") for i in range(20)] + [("sex", "s"), ("sex", "s"), ("prem", "p")]
    mine = [("c1", "name", "n1"), ("c1", "name", "own"), ("c1", "name", "own"), ("c99", "sex", "s"), (None, "name", "n1"), (None, "dob", "d"), ("c2", None, "x")]
    companies = [(f"c{i}",) for i in range(40)] + [(None,), (None,), ("c1",)]
    merged = al.merge_aliases(
        spark.createDataFrame(default, "field string, alias_norm string"),
        spark.createDataFrame(mine, "company_code string, field string, alias_norm string"), spark.createDataFrame(companies, "company_code string"))
    want = {(c, f, a) for (c,) in companies for f, a in default if f != "prem"} | set(mine)
    rows = [tuple(r) for r in merged.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert merged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < len(want) / 4


def test_small_files_share_a_split(spark, monkeypatch, tmp_path):
    from rosterkit.queries import files

    for i in range(60):
        (tmp_path / f"f_{i}.csv").write_text("a,b\n" * 20)
    seen = []

    def scan(session, folder, catalog):
        seen.append(session.read.text(folder).rdd.getNumPartitions())
        return session.createDataFrame([], "file_path string, row_idx long, cells array<string>"), None

    monkeypatch.setattr(files, "_text_folder", lambda *a: str(tmp_path))
    monkeypatch.setattr(files.delimited, "scan_delimited", scan)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    usual = [spark.conf.get(n) for n in names]
    files.scan_split_text(spark, "")
    assert seen[0] < 30 and [spark.conf.get(n) for n in names] == usual


def test_workbooks_are_built_one_at_a_time(spark, tmp_path):
    from rosterkit.queries import render

    raw = spark.createDataFrame([(f"/in/f_{f}.csv", r, [str(r), None, "x"]) for f in range(3) for r in (2, 0, 1)], "file_path string, row_idx long, cells array<string>")
    books = render.workbooks(raw)
    assert "collect_list" not in books._jdf.queryExecution().optimizedPlan().toString()
    folder = render.write_files(books, str(tmp_path))
    rows, errors = workbooks.scan_workbooks(catalog.file_catalog(spark, folder))
    got = sorted((r.file_path.rsplit("/", 1)[1], r.row_idx, tuple(r.cells)) for r in rows.collect())
    assert errors.count() == 0 and got == [(f"f_{f}.xlsx", r, (str(r), None, "x")) for f in range(3) for r in range(3)]


def test_library_documents_are_read_once(spark, tmp_path):
    """Entries and the five kinds of notes each read all documents again."""
    (tmp_path / "a.md").write_text("# L\n\n## K1 (old)\n\nFace-sheet.\n| Category | Aliases | Notes |\n|---|---|---|\n| Name | `a` → Ann | x |\n")
    found = alias_library.parse_library(spark, str(tmp_path))
    (tmp_path / "a.md").unlink()
    lib, notes, companies = (f.collect() for f in found)
    assert [r.alias_text for r in lib] == ["Ann"] and [r.company_code for r in companies] == ["K1"]
    assert sorted(r.note for r in notes) == ["Face-sheet.", "[Name] x", "[heading] old"]
