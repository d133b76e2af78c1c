"""Keys, tokens and shingles of text columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coobs.functions.binding import let

WORD = r"[\p{L}\p{N}]+"


def canonical_text(s: Column) -> Column:
    """Idempotent key: lower case, punctuation removed, whitespace collapsed.

    A string without any letter or digit keeps its raw form.
    """
    bare = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\s]+", "")
    key = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.length(key) > 0, key).otherwise(s)


def compact_key(s: Column) -> Column:
    """Idempotent key of short codes: lower case without whitespace."""
    key = F.regexp_replace(F.lower(s), r"\s+", "")
    return F.when(F.length(key) > 0, key).otherwise(s)


def map_placeholder(s: Column) -> Column:
    """Digits to one placeholder, so two corpora that number differently compare."""
    return F.regexp_replace(s, "[0-9]", "0")


def word_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0))


def char_tokens(s: Column) -> Column:
    """One token per character."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def shingles(tokens: Column, width: int) -> Column:
    """The set of ``width``-grams of a token array."""

    def grams(t: Column) -> Column:
        n = F.size(t) - F.lit(width - 1)
        every = F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.array_join(F.slice(t, i, width), " "),
        )
        return F.when(n > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def hash_bit(token: Column, bits: int) -> Column:
    """Folded position of a token in a vector of ``bits`` bits."""
    head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(bits)).cast("int")


def folded_bits(tokens: Column, bits: int) -> Column:
    """Set bits of a row, ascending."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: hash_bit(t, bits))))


def family(name: Column) -> Column:
    """Feature family: the part of a name before the first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))
