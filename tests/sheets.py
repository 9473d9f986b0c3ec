"""Small raw sheets for the unit tests; all values are invented.

Detection has a fixed cost per job, so the tests of a module collect their sheets as files of one input and run the
jobs once.
"""

from rosterkit.operators import extract
from rosterkit.operators.headers import detect_headers
from rosterkit.schema import RAW_ROWS

HEADER = ["Name", "Gender", "Born", "Contract No"]
ROW_1 = ["Ada Mara", "F", "1990-01-15", "P000001"]
ROW_2 = ["Ben Okto", "m", "15/02/1985", "P000002"]


def raw(spark, *rows, company="CO1", path="/in/a.csv", sheet="S1"):
    return spark.createDataFrame([(company, path, sheet, i, list(r)) for i, r in enumerate(rows)], RAW_ROWS)


class Sheets:
    """Named sheets, detected and extracted together on first use."""

    def __init__(self, spark, alias, cases):
        rows = [
            (case.get("company", "CO1"), name, "S1", i, list(r))
            for name, case in cases.items() for i, r in enumerate(case["rows"])
        ]
        self.raw = spark.createDataFrame(rows, RAW_ROWS)
        self.matches = detect_headers(self.raw, alias)
        self._matches = self.matches.collect()
        self._roster = None

    def tables(self, name):
        return sorted((m for m in self._matches if m.file_path == name), key=lambda m: m.col_start)

    def roster(self, name):
        if self._roster is None:
            self._roster = extract.extract_roster(self.raw, self.matches).collect()
        return sorted((r for r in self._roster if r.FILE_PATH == name), key=lambda r: (r.SHEET, r.COMPLETE_NAME))
