"""DuckDB text of the derived inputs, used by the oracle queries. Written apart from the Spark views."""

from __future__ import annotations

PERSONS = """
persons AS (
  SELECT c.c_custkey AS k, c.c_name, p.p_name, o.d,
         c.c_custkey // 200 AS file_no, c.c_custkey % 200 AS r,
         string_split(p.p_name, ' ')[1] AS w1, string_split(p.p_name, ' ')[2] AS w2,
         translate(CAST(c.c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS tag,
         'CO' || CAST((c.c_custkey // 200) % 7 AS VARCHAR) AS company_code,
         'P' || lpad(CAST(c.c_custkey AS VARCHAR), 6, '0') AS policy,
         CASE c.c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'f' WHEN 2 THEN 'Male' WHEN 3 THEN 'FEMALE' ELSE '' END AS sex_text,
         CASE c.c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE '' END AS sex_code,
         coalesce(CASE c.c_custkey % 7
           WHEN 0 THEN strftime(o.d, '%Y-%m-%d') WHEN 1 THEN strftime(o.d, '%m/%d/%Y')
           WHEN 2 THEN strftime(o.d, '%d-%b-%Y') WHEN 3 THEN strftime(o.d, '%Y%m%d')
           WHEN 4 THEN strftime(o.d, '%B %-d, %Y')
           WHEN 5 THEN CASE WHEN day(o.d) > 12 THEN strftime(o.d, '%d.%m.%Y') ELSE strftime(o.d, '%Y.%m.%d') END
           ELSE strftime(o.d, '%d-%b-%y') END, '') AS date_text,
         coalesce(strftime(o.d, '%Y-%m-%d'), '') AS iso_date,
         coalesce(strftime(o.d, '%m/%d/%Y'), '') AS dob
  FROM customer c
  JOIN part p ON p.p_partkey = c.c_custkey
  LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
)"""

_FAMILIES = {
    "std": (
        ["['Delivery list']", "['', '  ', NULL]",
         "[CASE WHEN company_code = 'CO3' THEN 'Assured' ELSE 'Member Name' END, 'Gender', 'Born', 'Contract No']"],
        "[CASE WHEN k % 11 = 0 THEN '' ELSE p_name END, sex_text, date_text, policy]",
    ),
    "multi": (["['Name', 'Name', 'Contract No']"],
              "[p_name, CASE WHEN k % 3 = 0 THEN '' ELSE w2 || ' ' || w1 END, policy]"),
    "pair": (["['FamilyName', 'GivenName', 'FamilyName', 'GivenName', 'Contract No']"],
             "[w1, w2, CASE WHEN k % 4 = 0 THEN ' ' ELSE w2 END, CASE WHEN k % 4 = 0 THEN ' ' ELSE tag END, policy]"),
    "digits": (["['Name', 'FamilyName', 'GivenName', 'Contract No']"], "[c_name, w1, w2, policy]"),
    "bare": ([], "[w1 || ' ' || w2 || ' ' || tag, sex_text, iso_date, policy]"),
    "two": (["['Name', 'Contract No', NULL, 'Whole Name', 'Gender']"],
            "[p_name, policy, NULL, w2 || ' ' || w1, sex_text]"),
    "typo": (["['Membr Nam', 'Gendr', 'Brth Date', 'Contract Nmber']"], "[p_name, sex_text, iso_date, policy]"),
    "numname": (["['Name', 'ContractNo']"], "[lpad(CAST(k AS VARCHAR), 9, '1'), policy]"),
    "nomatch": (["['Premium', 'Amount']"], "[CAST(k * 10 AS VARCHAR), CAST(r AS VARCHAR) || '.50']"),
}

ALIASES = """
alias(company_code, field, alias_norm) AS (VALUES
  ('*', 'name', 'name'), ('*', 'name', 'membername'), ('*', 'name', 'wholename'),
  ('*', 'firstlastname', 'givenname'), ('*', 'firstlastname', 'familyname'),
  ('*', 'sex', 'gender'), ('*', 'sex', 'sexcode'), ('*', 'dob', 'born'), ('*', 'dob', 'birthdate'),
  ('*', 'policynum', 'contractno'), ('*', 'policynum', 'contractnumber'), ('*', 'policynum', 'coverref'), ('CO3', 'name', 'assured')
)"""

# Characters stripped from the ends of a cell in the generated data; the data holds plain spaces only.
BLANK = "(value IS NULL OR trim(value) = '')"


def sheets(*families: str) -> str:
    """CTEs ``persons`` and ``sheets`` (raw rows) for the given layouts, all by default."""
    selects = []
    for family in families or _FAMILIES:
        above, data = _FAMILIES[family]
        where = f"'/in/{family}_' || CAST(file_no AS VARCHAR) || '.csv' AS file_path, 'S1' AS sheet"
        selects.append(
            f"SELECT company_code, {where}, r + {len(above)} AS row_idx, CAST({data} AS VARCHAR[]) AS cells FROM persons"
        )
        for i, cells in enumerate(above):
            selects.append(
                f"SELECT company_code, {where}, {i} AS row_idx, CAST({cells} AS VARCHAR[]) AS cells FROM persons WHERE r = 0"
            )
    return PERSONS + ",\nsheets AS (\n" + "\nUNION ALL\n".join(selects) + "\n)"


CELLS = f"""
all_cells AS (
  SELECT company_code, file_path, sheet, row_idx, unnest(range(len(cells))) AS col_idx, unnest(cells) AS value FROM sheets
),
cells AS (SELECT * FROM all_cells WHERE row_idx < 50 AND NOT {BLANK})"""

BLOCKS = """
cols AS (SELECT DISTINCT company_code, file_path, sheet, col_idx FROM cells),
islands AS (
  SELECT *, col_idx - row_number() OVER (PARTITION BY company_code, file_path, sheet ORDER BY col_idx) AS island FROM cols
),
block_list AS (
  SELECT company_code, file_path, sheet, min(col_idx) AS col_start, max(col_idx) AS col_end
  FROM islands GROUP BY company_code, file_path, sheet, island
),
blocks AS (
  SELECT *, row_number() OVER (PARTITION BY company_code, file_path, sheet ORDER BY col_start) AS table_idx FROM block_list
),
bcells AS (
  SELECT c.*, b.col_start, b.col_end, b.table_idx FROM cells c JOIN blocks b
  USING (company_code, file_path, sheet) WHERE c.col_idx BETWEEN b.col_start AND b.col_end
)"""

HITS = ALIASES + """,
hits AS (
  SELECT DISTINCT b.company_code, b.file_path, b.sheet, b.col_start, b.row_idx, b.col_idx, a.field
  FROM bcells b JOIN alias a
    ON a.alias_norm = regexp_replace(lower(b.value), '[^a-z]', '', 'g') AND a.company_code IN ('*', b.company_code)
),
anchors AS (
  SELECT company_code, file_path, sheet, col_start, min(row_idx) AS header_row_idx
  FROM hits WHERE field IN ('name', 'firstlastname') GROUP BY ALL
),
located AS (
  SELECT h.company_code, h.file_path, h.sheet, h.col_start, a.header_row_idx,
         coalesce(string_agg(CASE WHEN field = 'name' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS name_cols,
         coalesce(string_agg(CASE WHEN field = 'firstlastname' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS pair_cols,
         coalesce(string_agg(CASE WHEN field = 'sex' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS sex_cols,
         coalesce(string_agg(CASE WHEN field = 'dob' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS dob_cols,
         coalesce(string_agg(CASE WHEN field = 'policynum' THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx), '') AS policy_cols
  FROM hits h JOIN anchors a USING (company_code, file_path, sheet, col_start)
  WHERE h.row_idx = a.header_row_idx GROUP BY ALL
)"""


def parse_date(e: str) -> str:
    """Date text to MM/dd/yyyy by a list of formats; covers the layouts of the generated data."""
    formats = ["%Y-%m-%d", "%m/%d/%Y", "%d-%b-%Y", "%Y%m%d", "%B %d, %Y", "%d.%m.%Y", "%Y.%m.%d", "%d-%b-%y", "%d/%m/%Y"]
    tries = ", ".join(f"try_strptime({e}, '{f}')" for f in formats)
    return f"coalesce(strftime(coalesce({tries}), '%m/%d/%Y'), '')"


SHARES = f"""
    count(*) AS n_values,
    avg(CASE WHEN lower(trim(value)) IN ('m', 'f', 'male', 'female') THEN 1.0 ELSE 0.0 END) AS sex_share,
    avg(CASE WHEN {parse_date("trim(value)")} <> '' AND NOT regexp_matches(trim(value), '^[0-9]{{1,7}}$') THEN 1.0 ELSE 0.0 END) AS date_share,
    avg(CASE WHEN regexp_matches(trim(value), '^[A-Za-z0-9\\-./]{{6,30}}$') THEN 1.0 ELSE 0.0 END) AS policy_share,
    avg(CASE WHEN regexp_matches(trim(value), '^[A-Za-zÀ-ÿ''\\-. ]{{2,50}}$') THEN 1.0 ELSE 0.0 END) AS name_share,
    count(DISTINCT trim(value)) / count(*) AS distinct_share,
    avg(CASE WHEN regexp_matches(trim(value), '^-?[0-9]+([.][0-9]+)?$') THEN 1.0 ELSE 0.0 END) AS number_share,
    avg(CASE WHEN regexp_matches(trim(value), '^[A-Za-z0-9\\-_]{{4,20}}$') THEN 1.0 ELSE 0.0 END) AS identifier_share,
    avg(CASE WHEN regexp_matches(trim(value), '^[A-Za-zÀ-ÿ''\\-.\\s]{{2,}}$') THEN 1.0 ELSE 0.0 END) AS text_share"""

COLUMN_TYPE = """CASE
    WHEN sex_share > 0.7 THEN 'sex' WHEN date_share > 0.7 THEN 'dob' WHEN policy_share > 0.7 THEN 'policynum'
    WHEN name_share > 0.8 AND n_values >= 5 AND distinct_share > 0.5 THEN 'name' ELSE '' END"""

CATEGORY = f"""CASE {COLUMN_TYPE}
    WHEN 'sex' THEN 'Sex' WHEN 'dob' THEN 'DOB' WHEN 'policynum' THEN 'PolicyNumber' WHEN 'name' THEN 'Name' ELSE
    CASE WHEN coalesce(n_values, 0) = 0 THEN 'Empty' WHEN number_share > 0.9 THEN 'Numeric'
         WHEN identifier_share > 0.7 THEN 'Identifier' WHEN text_share > 0.8 THEN 'Text' ELSE 'Unknown' END END"""

_FILE = "'/in/{f}_' || CAST(file_no AS VARCHAR) || '.csv'"


def _roster(family, surname, first, complete, sex, dob, policy="policy", sheet="'S1'", where="true") -> str:
    path = _FILE.format(f=family)
    return f"""SELECT {surname} AS "SURNAME", {first} AS "FIRST_NAME", {complete} AS "COMPLETE_NAME", {sex} AS "SEX",
  {dob} AS "DATE_OF_BIRTH", company_code AS "CMPY_NO", {policy} AS "POLICY_NUMBER", {path} AS "FILE_PATH",
  {sheet} AS "SHEET" FROM persons WHERE {where}"""


_NULL = "CAST(NULL AS VARCHAR)"
ROSTERS = {
    "std": [_roster("std", "''", "''", "upper(p_name)", "sex_code", "dob", where="k % 11 <> 0")],
    "multi": [
        _roster("multi", _NULL, _NULL, "upper(p_name)", "'U'", "''", where="k % 3 <> 0"),
        _roster("multi", _NULL, _NULL, "upper(w2 || ' ' || w1)", "'U'", "''", where="k % 3 <> 0"),
    ],
    "pair": [
        _roster("pair", "upper(w1)", "upper(w2)", "upper(w1 || ' ' || w2)", "'U'", "''"),
        _roster("pair", "upper(w2)", "upper(tag)", "upper(w2 || ' ' || tag)", "'U'", "''", where="k % 4 <> 0"),
    ],
    "digits": [_roster("digits", "upper(w1)", "upper(w2)", "upper(w1 || ' ' || w2)", "''", "''")],
    "bare": [_roster("bare", "''", "''", "upper(w1 || ' ' || w2 || ' ' || tag)", "sex_code", "dob")],
    "two": [
        _roster("two", "''", "''", "upper(p_name)", "''", "''", sheet="'S1_table1'"),
        _roster("two", "''", "''", "upper(w2 || ' ' || w1)", "sex_code", "''", policy=_NULL, sheet="'S1_table2'"),
    ],
    "typo": [_roster("typo", "''", "''", "upper(p_name)", "sex_code", "dob")],
    "numname": [],
    "nomatch": [],
}


def roster(*families: str) -> str:
    """The expected roster of the given layouts, straight from the persons."""
    selects = [s for f in (families or ROSTERS) for s in ROSTERS[f]]
    return f"WITH {PERSONS}\nSELECT DISTINCT * FROM (\n" + "\nUNION ALL\n".join(selects) + "\n)"


def typed(text: str, **types: str) -> str:
    """The query with some columns cast, so that both engines agree on types."""
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
    return f"SELECT * REPLACE ({casts}) FROM ({text})"
