"""Date functions: a permissive parser for birth dates and the two date texts of the run log."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterkit.functions.text import strip

# Two-digit years from this one on belong to the 1900s.
CENTURY_PIVOT = 69
_MONTH_NAMES = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_WEEKDAY_NAMES = (
    "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs?(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"

_TIME_OF_DAY = (
    r"(?:t|[\s,]+)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?\s*(?:z|utc|gmt)?(?:[+-]\d{2}:?\d{2})?$"
)
_PIECE = rf"(?:\d{{1,4}}(?:st|nd|rd|th)?|(?:{_MONTH_NAMES}))"
_GAP = r"(?:[-/.,\s]|of(?=\s))*"
_THREE_PIECES = rf"^(?:(?:{_WEEKDAY_NAMES})[.,\s]+)?{_PIECE}{_GAP}{_PIECE}{_GAP}{_PIECE}$"
_EIGHT_DIGITS = r"^\d{8}$"
_TEN_CHARACTERS = r"^(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})$"
_DAY_MONTH_YEAR = rf"(?i)^(?:0[1-9]|[12]\d|3[01])[- ](?:{'|'.join(_MONTH_STARTS[i:i + 3] for i in range(0, 36, 3))})[- ](?:\d{{4}}|\d{{2}})$"
_TOKEN = rf"\d+|{_MONTH_NAMES}"


# A real calendar day written MM/dd/yyyy, leap years included, as one word of a text.
_REAL_DAY = (
    r"(?<!\S)(?!\S*/0000(?!\S))(?:(?:(?:0[13578]|1[02])/(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)/(?:0[1-9]|[12]\d|30)|"
    r"02/(?:0[1-9]|1\d|2[0-8]))/\d{4}|"
    r"02/29/(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00))(?!\S)"
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for an expression that uses it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def _day(year: Column, month: Column, day: Column) -> Column:
    """``MM/dd/yyyy`` of parts that should have the right length."""
    return F.concat(month, F.lit("/"), day, F.lit("/"), year)


def _first_real(*days: Column) -> Column:
    """The first of some ``MM/dd/yyyy`` texts that is a real calendar day, else ''."""
    return F.regexp_extract(F.concat_ws(" ", *days), _REAL_DAY, 0)


def _two(token: Column) -> Column:
    """Pad a one-digit number; longer tokens stay and fail the day check where they do not belong."""
    return F.when(F.length(token) == 1, F.concat(F.lit("0"), token)).otherwise(token)


def _year(token: Column) -> Column:
    """Four-digit year of a token; short years pivot at a fixed year."""
    short = F.concat(F.when(_two(token) < str(CENTURY_PIVOT), "20").otherwise("19"), _two(token))
    return F.when(F.length(token) <= 2, short).otherwise(token)


def _is_year(token: Column) -> Column:
    """True for a token that can only be a year: more than two digits, or above 31."""
    return (F.length(token) > 2) | (_two(token) > "31")


def _eight_digits(s: Column) -> Column:
    """yyyyMMdd, else ddMMyyyy, else MMddyyyy."""
    part = lambda start, n: F.substring(s, start, n)
    return _first_real(
        _day(part(1, 4), part(5, 2), part(7, 2)),
        _day(part(5, 4), part(3, 2), part(1, 2)),
        _day(part(5, 4), part(1, 2), part(3, 2)),
    )


def _ten_characters(s: Column) -> Column:
    """The two usual fixed layouts, year first or year last, read by position."""
    part = lambda start, n: F.substring(s, start, n)
    year_first = F.substring(s, 5, 1).isin("-", "/", ".")
    day_first = part(1, 2) > "12"
    return _first_real(_day(
        F.when(year_first, part(1, 4)).otherwise(part(7, 4)),
        F.when(year_first, part(6, 2)).when(day_first, part(4, 2)).otherwise(part(1, 2)),
        F.when(year_first, part(9, 2)).when(day_first, part(1, 2)).otherwise(part(4, 2)),
    ))


def _month(word: Column) -> Column:
    """Two-digit month of a month name."""
    start = F.call_function("instr", F.lit(_MONTH_STARTS), F.left(word, F.lit(3)))
    return _two(F.floor((start + 2) / 3).cast("string"))


def _day_month_year(s: Column) -> Column:
    """Two-digit day, short month name, year, read by position."""
    return _first_real(_day(_year(F.substring(s, 8, 4)), _month(F.lower(F.substring(s, 4, 3))), F.substring(s, 1, 2)))


def _with_month_name(t: Column) -> Column:
    """Three tokens, one of them a month name: the other two are day and year."""
    a, b, c = F.get(t, 0), F.get(t, 1), F.get(t, 2)
    word = lambda x: x >= "a"
    month_word = F.when(word(a), a).when(word(b), b).otherwise(c)
    first, second = F.when(word(a), b).otherwise(a), F.when(word(c), b).otherwise(c)
    year_first = _is_year(first) | (word(c) & ~_is_year(second))
    return _first_real(_day(
        _year(F.when(year_first, first).otherwise(second)),
        _month(month_word),
        _two(F.when(year_first, second).otherwise(first)),
    ))


def _all_numbers(t: Column, text: Column) -> Column:
    """Three numbers: year first if the first can only be a year, else month first unless that is impossible."""
    a, b, c = F.get(t, 0), F.get(t, 1), F.get(t, 2)
    year_first, day_first = _is_year(a), _two(a) > "12"
    main = _day(
        _year(F.when(year_first, a).otherwise(c)),
        _two(F.when(year_first | day_first, b).otherwise(a)),
        _two(F.when(year_first, c).when(day_first, a).otherwise(b)),
    )
    # A two-digit triple that is no day-month-year may still be year-month-day.
    other = F.when(text.rlike(r"^\d\d([-/])\d{1,2}\1\d{1,2}$"), _day(_year(a), _two(b), _two(c)))
    return _first_real(main, other)


def parse_date(c: Column) -> Column:
    """Birth date as ``MM/dd/yyyy`` text, or '' when the text is no complete date.

    Month comes first in an ambiguous all-number date and day first when the month would be impossible. A time of
    day is ignored, incomplete dates are never completed, and bare numbers count only with exactly eight digits.
    Fixed layouts are read by position inside whole-stage codegen; other texts are tokenized once and every rule
    works on the tokens. No Python runs per value.
    """
    lowered = F.lower(strip(c))
    text = F.when(lowered.contains(":"), F.regexp_replace(lowered, _TIME_OF_DAY, "")).otherwise(lowered)

    def from_tokens(s: Column) -> Column:
        return _let(
            F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0)),
            lambda t: F.when(
                F.size(t) == 3,
                F.when(F.exists(t, lambda x: x >= "a"), _with_month_name(t)).otherwise(_all_numbers(t, s)),
            ),
        )

    general = _let(text, lambda s: (
        F.when(s.rlike(_TEN_CHARACTERS), _ten_characters(s))
        .when(s.rlike(_EIGHT_DIGITS), _eight_digits(s))
        .when(s.rlike(_THREE_PIECES), from_tokens(s))
    ))
    return F.coalesce(
        F.when(c.rlike(_TEN_CHARACTERS), _ten_characters(c))
        .when(c.rlike(_EIGHT_DIGITS), _eight_digits(c))
        .when(c.rlike(_DAY_MONTH_YEAR), _day_month_year(c))
        .when(c.rlike(r"\d"), general),
        F.lit(""),
    )


def compact_date(iso: Column) -> Column:
    """``yyyy-MM-dd`` to ``yyyyMMdd``."""
    return F.regexp_replace(iso, "-", "")


def display_date(iso: Column) -> Column:
    """``yyyy-MM-dd`` text as a DATE; null when it is no such date."""
    return F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(iso, F.lit("yyyy-M-d")).cast("date"))
