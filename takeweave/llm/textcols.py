"""Column expressions on words and shingles that several operators share. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SHINGLE = 5


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; a null or blank text has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(word_hashes: Column, size: Column, k: int = SHINGLE) -> Column:
    """Hash of each run of ``k`` words, by position; empty where there are fewer than ``k`` words."""
    at = lambda i, d: F.get(word_hashes, i + F.lit(d))
    return F.when(size < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), size - k), lambda i: F.xxhash64(*[at(i, d) for d in range(k)]))
    )


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``_row`` beside the named ones, so that no name of the input clashes."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row") if df.columns else F.struct().alias("_row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
