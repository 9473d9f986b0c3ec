"""Person-name and sex functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterkit.functions.text import has_digit, strip

# The marker word some senders append to a name, and the spellings of the two sexes.
DECEASED_MARKER = "DECEASED"
MALE_WORDS = ["m", "male"]
FEMALE_WORDS = ["f", "female"]


def clean_name(c: Column) -> Column:
    """Upper case, letters A-Z separated by single spaces, marker word removed. Null stays null.

    Two regex passes and a trim, all inside whole-stage codegen; the second pass runs only where the marker occurs.
    """
    words = F.regexp_replace(F.upper(c), "[^A-Z]+", " ")
    dropped = F.regexp_replace(words, f"(?:^| ){DECEASED_MARKER}(?= |$)", "")
    return F.trim(F.when(words.contains(DECEASED_MARKER), dropped).otherwise(words))


def normalize_sex(c: Column) -> Column:
    """M or F for the known spellings, the upper-cased text for others, '' for null or blank."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(text.isin(MALE_WORDS), "M").when(text.isin(FEMALE_WORDS), "F").otherwise(F.upper(text))


def full_name(surname: Column, first_name: Column) -> Column:
    """``SURNAME FIRST_NAME``; null as soon as one part is null (a blank part is fine)."""
    return F.trim(F.concat(surname, F.lit(" "), first_name))


def complete_name(cleaned: Column, surname: Column, first_name: Column, raw: Column | None = None) -> Column:
    """The cleaned full name, or the joined parts when it is missing.

    ``raw`` is the source text before cleaning: a digit in it means the cell held no name, so the parts win.
    """
    joined = full_name(surname, first_name)
    usable = cleaned.isNotNull() & (cleaned != "")
    if raw is not None:
        usable = usable & ~F.coalesce(has_digit(raw), F.lit(False))
    return F.when(usable, cleaned).otherwise(joined)
