"""Trigram similarity, tokens and patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, padded with two blanks before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def overlap(a: Column, b: Column) -> Column:
    """Share of common elements of two sets, 0 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def subsequence_pattern(token: Column) -> Column:
    """A regular expression that finds the letters of an alphanumeric token in order."""
    return F.concat(F.lit("(?i)"), F.array_join(F.split(token, "(?<=.)(?=.)"), ".*"))
