"""Files of a batch paired into kits, and reconciliation of key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File endings in the order they are looked for.
KIND_ENDINGS = {"words": r"\.words\.json$", "canonical": r"\.canonical\.txt$", "align": r"\.align\.txt$", "norm": r"\.norm\.txt$", "text": r"\.txt$", "audio": r"\.(wav|flac|m4a|mp3)$"}
STEM_ENDING = r"(\.words\.json|\.canonical\.txt|\.align\.txt|\.norm\.txt|\.txt|\.wav|\.flac|\.m4a|\.mp3)$"


def catalog(paths: DataFrame) -> DataFrame:
    """path, stem (lower case), kind."""
    kind = None
    for name, pattern in KIND_ENDINGS.items():
        hit = F.lower("path").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return paths.select("path", F.lower(F.regexp_replace("path", STEM_ENDING, "")).alias("stem"), kind.alias("kind"))


def kits(paths: DataFrame) -> DataFrame:
    """One row a stem: words, script (align, norm, text in this order), audio; derivative stems are left out."""
    c = catalog(paths).where("kind <> 'canonical'")
    one = lambda k: F.min(F.when(F.col("kind") == k, F.col("path")))
    return c.groupBy("stem").agg(one("words").alias("words"), F.coalesce(one("align"), one("norm"), one("text")).alias("script"), one("audio").alias("audio"))


def bundles(paths: DataFrame) -> DataFrame:
    """stem and the sorted paths of each kind joined by commas."""
    c = catalog(paths)
    some = lambda k: F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("path")))), ",").alias(k)
    return c.groupBy("stem").agg(*[some(k) for k in KIND_ENDINGS])


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """side (both, left, right) and the number of keys, of two one-column tables of keys."""
    a, b = left.toDF("key").distinct().withColumn("l", F.lit(1)), right.toDF("key").distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, "key", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.min("key").alias("least"))
