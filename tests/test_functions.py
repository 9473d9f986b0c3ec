
import pytest
from pyspark.sql import functions as F

from rosterkit import functions as R


def evaluate(spark, expression, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", expression(F.col("v")).alias("out"))
    return [r.out for r in sorted(df.collect(), key=lambda r: r.i)]


def check(spark, expression, cases):
    assert evaluate(spark, expression, [c[0] for c in cases]) == [c[1] for c in cases]


def test_clean_name(spark):
    check(spark, R.clean_name, [
        ("x\u2003y", "X Y"), ("vera_lund", "VERA LUND"), ("Lund,Vera(2)", "LUND VERA"), ("Vera Deceased Lund", "VERA LUND"),
        ("DECEASED,deceased", ""), ("deceasedly", "DECEASEDLY"), ("...", ""), ("\t", ""), (None, None), ("ßä", "SS"), ("q", "Q"),
    ])


def test_digits(spark):
    check(spark, R.has_digit, [("a\u0967b", True), ("IV", False), ("½", False), ("0", True), (" ", False)])
    check(spark, R.is_bare_number, [("00", True), ("\t41\n", True), ("4 1", False), ("+41", False), ("4.1", False), (None, False)])


def test_sex(spark):
    check(spark, R.normalize_sex, [
        ("\tmALE", "M"), ("Female\n", "F"), ("f ", "F"), ("mf", "MF"), ("x", "X"), ("0", "0"), ("\n", ""), (None, ""),
    ])


@pytest.mark.parametrize("text, expected", [
    # Month first; day first only where the month is impossible.
    ("11/12/2013", "11/12/2013"), ("23/12/2013", "12/23/2013"), ("12-23-2013", "12/23/2013"), ("7.4.2003", "07/04/2003"),
    # Names of months on either side, whole or cut.
    ("3 Sep 2011", "09/03/2011"), ("September 3, 2011", "09/03/2011"), ("03-Sep-11", "09/03/2011"),
    # Digits alone: eight of them, year, month or day first.
    ("20240229", "02/29/2024"), ("27062001", "06/27/2001"), ("06272001", "06/27/2001"),
    # Times of day are cut off.
    ("2007-08-09 23:59:59", "08/09/2007"), ("2007-08-09T01:02:03Z", "08/09/2007"),
    # Two-digit years turn at 69.
    ("4/30/68", "04/30/2068"), ("4/30/69", "04/30/1969"), ("4/30/00", "04/30/2000"),
    # No such day, incomplete, or no date at all.
    ("2023-02-29", ""), ("29 Feb 2100", ""), ("31 Jun 2010", ""), ("2010-00-10", ""), ("44/44/2010", ""), ("Sep 2011", ""),
    ("2011", ""), ("77", ""), ("1234567890", ""), ("3,14", ""), ("tomorrow", ""), ("-", ""), ("\n", ""), (None, ""),
])
def test_parse_date(spark, text, expected):
    assert evaluate(spark, R.parse_date, [text]) == [expected]


def test_parse_date_agrees_with_the_calendar(spark):
    days = spark.sql("select explode(sequence(date'1896-02-25', date'2104-03-05', interval 1 day)) d")
    wrong = days.select(
        "d", *[R.parse_date(F.date_format("d", f)).alias(n) for n, f in
               [("a", "yyyy-MM-dd"), ("b", "dd MMMM yyyy"), ("c", "MMM d, yyyy"), ("e", "yyyyMMdd")]],
        F.date_format("d", "MM/dd/yyyy").alias("want"),
    ).filter("a <> want or b <> want or c <> want or e <> want")
    assert wrong.isEmpty()


def test_mask_key_and_match_key(spark):
    check(spark, R.mask_middle, [("abcdef", "a****f"), ("abc", "a*c"), ("ab", "**"), ("a", "*"), ("", None), (None, None)])
    check(spark, R.company_key, [(" co1\t", "CO1"), (None, "")])
    check(spark, R.match_key, [("Policy No. 1", "policyno"), ("Größe", "gre"), (None, "")])


def test_files_and_dates(spark):
    check(spark, R.file_kind, [
        ("a/b.CSV", "Text"), ("x.rpt", "Text"), ("x.xlsb", "Excel"), ("x.tar", "Archive"), ("x.7z", "Archive"), ("x.pdf", "Unknown"),
        ("none", "Unknown"), (".csv", "Unknown"),
    ])
    check(spark, R.safe_name, [("a b[1]", "a_b_1_"), ("x" * 300, "x" * 200)])
    check(spark, lambda c: R.display_date(c).cast("string"), [("2024-1-5", "2024-01-05"), ("2024-13-01", None), ("01/02/2024", None), ("2024-02-30", None)])
    check(spark, R.compact_date, [("2024-01-05", "20240105")])


def test_contains_text(spark):
    check(spark, lambda c: R.contains_text(c, " DA "), [("Ada", True), ("Ben", False)])
    check(spark, lambda c: R.contains_text(c, ""), [("Ada", True)])


def test_similarity_prefilter_is_lossless(spark):
    """The indexed join finds exactly the pairs that comparing everything with everything finds."""
    import random
    from difflib import SequenceMatcher

    from rosterkit.operators.headers import similar_aliases

    rng = random.Random(11)
    aliases = ["name", "insuredname", "fullname", "lastname", "sex", "gender", "dob", "dateofbirth", "policynumber"]
    words = set(aliases)
    for _ in range(800):
        w = list(rng.choice(aliases))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and at < len(w):
                w.pop(at)
            else:
                w.insert(at, rng.choice("abcdefghijklmnopqrstuvwxyz"))
        words.add("".join(w) or "x")
    words |= {"".join(rng.choice("aeinmrstolpd") for _ in range(rng.randint(1, 12))) for _ in range(400)}
    df = spark.createDataFrame([("*", w) for w in sorted(words)], "scope string, word string")
    lib = spark.createDataFrame([("*", f"f_{a}", a) for a in aliases], "company_code string, field string, alias_norm string")
    found = {(r.word, r.field) for r in similar_aliases(df, lib).collect()}
    expected = {(w, f"f_{a}") for w in words for a in aliases if SequenceMatcher(None, w, a).ratio() >= 0.7}
    assert found == expected


def test_unique_names_pass_over_taken_suffixes(spark):
    from rosterkit.operators.naming import unique_names

    names = ["a", "a", "a_1", "a", "a_3", "a", "a_1", "b", "b_1", "c", "c", "a_01", "a", "x/y", "x?y", "d_2", "d_2", "d", "d", "d", "a_1_1", None, None]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string").repartition(3)
    got = {r.i: r.unique_name for r in unique_names(df, "name", ["i"]).collect()}
    assert [got[i] for i in range(21)] == [
        "a", "a_2", "a_1", "a_4", "a_3", "a_5", "a_1_2", "b", "b_1", "c", "c_1", "a_01", "a_6", "x_y", "x_y_1", "d_2", "d_2_1", "d", "d_1", "d_3", "a_1_1"]
    twice = df.withColumn("k", F.explode(F.array(F.lit("p"), F.lit("q"))))
    kept = unique_names(twice, "name", ["i"], within=("k",), safe=False).filter("name is not null")
    assert kept.select("k", "unique_name").distinct().count() == 42
