"""Text functions: match keys, blanks, digits, masks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space when a cell is stripped (Unicode White_Space plus
# the four ASCII separators). SQL ``trim`` alone would remove only the space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for a null or an all-white-space cell; never null."""
    return c.isNull() | (strip(c) == "")


def match_key(c: Column) -> Column:
    """Key used to compare header texts: lower case, letters a-z only; null becomes the empty key."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", "")


def has_digit(c: Column) -> Column:
    """True if the text holds a decimal digit of any script."""
    return c.rlike(r"\p{Nd}")


def is_bare_number(c: Column) -> Column:
    """True if the stripped text is digits only; null counts as false."""
    return F.coalesce(strip(c).rlike(r"^\p{Nd}+$"), F.lit(False))


def company_key(c: Column) -> Column:
    """Canonical company code: stripped, upper case, null as the empty code."""
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def mask_middle(c: Column) -> Column:
    """Keep the first and last character and star the rest; up to two characters become all stars."""
    size = F.length(c)
    return (
        F.when(size == 0, F.lit(None).cast("string"))
        .when(size <= 2, F.repeat(F.lit("*"), size))
        .otherwise(F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), size - 2), F.right(c, F.lit(1))))
    )


def contains_text(c: Column, term: str | None) -> Column:
    """Case-insensitive substring test; an empty term keeps everything."""
    if not term:
        return F.lit(True)
    return F.lower(c).contains(term.strip().lower())
