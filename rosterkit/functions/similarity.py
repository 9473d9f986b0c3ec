"""String similarity for header texts: the ratio itself, and lossless native bounds on it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from rosterkit.schema import FUZZY_THRESHOLD

# Fixed value: letters from rare to frequent in English. Any total order is correct; rare first prunes most.
LETTERS_RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"


@F.pandas_udf(T.DoubleType())
def match_ratio(word: pd.Series, candidate: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of each pair; the order of the arguments matters for some pairs.

    No built-in function has this metric. It runs on pairs that passed the native bounds only.
    """
    from difflib import SequenceMatcher

    return pd.Series(
        [SequenceMatcher(None, w, c).ratio() for w, c in zip(word, candidate)], index=word.index, dtype="float64"
    )


def letter_counts(key: Column) -> Column:
    """How often each letter occurs in a match key, rare letters first."""
    return F.array(*[F.length(key) - F.length(F.replace(key, F.lit(x))) for x in LETTERS_RARE_FIRST])


def sorted_letters(counts: Column) -> Column:
    """The letters of a key as one text, rare letters first."""
    return F.concat(*[F.repeat(F.lit(x), F.get(counts, i)) for i, x in enumerate(LETTERS_RARE_FIRST)])


def letter_token(letters: Column, at: Column) -> Column:
    """Token at a 1-based position of the sorted letters: the letter and which occurrence of it this is.

    Two keys share exactly as many tokens as they have letters in common, with repetition.
    """
    letter = F.substr(letters, at, F.lit(1))
    return F.concat(letter, (at - F.call_function("instr", letters, letter)).cast("string"))


def prefix_size(length: Column, threshold: float = FUZZY_THRESHOLD) -> Column:
    """How many leading tokens must be indexed so that every pair at or above the threshold shares one.

    The ratio 2M/(a+b) needs M >= t(a+b)/2 common letters, and b >= a*t/(2-t) follows from M <= b. So at least
    ceil(a*t/(2-t)) tokens are shared, and the first a - that + 1 tokens of both sides must intersect.
    """
    least = F.ceil(length * (threshold / (2 - threshold)) - 1e-9).cast("int")
    return (length - least + 1).cast("int")


def lengths_allow(a: Column, b: Column, threshold: float = FUZZY_THRESHOLD) -> Column:
    """False when the lengths alone rule the threshold out."""
    return 2 * F.least(a, b) >= (a + b) * F.lit(threshold) - 1e-9


def letters_allow(counts_a: Column, counts_b: Column, lengths: Column, threshold: float = FUZZY_THRESHOLD) -> Column:
    """False when the common letters rule the threshold out; ``lengths`` is the sum of both lengths."""
    common = F.lit(0)
    for i in range(len(LETTERS_RARE_FIRST)):
        common = common + F.least(F.get(counts_a, i), F.get(counts_b, i))
    return 2 * common >= lengths * F.lit(threshold) - 1e-9


def least_common_letters(length: int, threshold: float = FUZZY_THRESHOLD) -> int:
    """Python twin of the bound in :func:`prefix_size`, for tests."""
    return math.ceil(length * (threshold / (2 - threshold)) - 1e-9)
