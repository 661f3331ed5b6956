"""The health report of a batch (A17): normalise, split and align blocks of each item, and their totals by status, in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeweave.functions import text as tx

#: Lines without a match that an item may have and still be ok.
UNMATCHED = 2
SUMS = ("orig_len", "norm_len", "removed_newlines", "suspects", "sentences", "stops", "inner_stops", "lines", "matched", "relaxed", "unmatched")


def normalise_block(texts: DataFrame, normalise=tx.export_form) -> DataFrame:
    """(rec_id, orig_len, norm_len, removed_newlines, suspects) of texts(rec_id, text): suspects are control, replacement and private characters left."""
    n = texts.select("rec_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("n", normalise(F.col("t")))
    breaks = lambda c: F.regexp_count(c, F.lit("\n"))
    odd = F.regexp_count("n", F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFD}\\x{E000}-\\x{F8FF}]"))
    sums = {"orig_len": F.length("t"), "norm_len": F.length("n"), "removed_newlines": breaks("t") - breaks("n"), "suspects": odd}
    return n.groupBy("rec_id").agg(*[F.sum(c).cast("long").alias(k) for k, c in sums.items()])


def split_block(sentences: DataFrame, hard: str = tx.STOPS) -> DataFrame:
    """(rec_id, sentences, len_min, len_median, len_p95, len_max, stops, inner_stops) of sentences(rec_id, text).

    stops counts sentences that end in a hard mark, closers aside, inner_stops those with one before their end (A06).
    """
    ends = F.col("text").rlike(f"[{hard}][{tx.CLOSERS}]*$")
    inner = F.regexp_replace("text", f"[{hard}]+[{tx.CLOSERS}]*$", "").rlike(f"[{hard}]")
    size = F.length("text")
    return sentences.groupBy("rec_id").agg(
        F.count("*").alias("sentences"), F.min(size).alias("len_min"), F.percentile(size, F.lit(0.5)).alias("len_median"), F.percentile(size, F.lit(0.95)).alias("len_p95"), F.max(size).alias("len_max"), F.count_if(ends).alias("stops"), F.count_if(inner).alias("inner_stops"),
    )


def align_block(summary: DataFrame) -> DataFrame:
    """(rec_id, lines, matched, relaxed, unmatched) of ``ownmatch.match_summary``."""
    s = summary.select("rec_id", F.col("n_lines").alias("lines"), (F.col("anchor") + F.col("relaxed")).alias("matched"), "relaxed")
    return s.withColumn("unmatched", F.col("lines") - F.col("matched"))


def report(normalised: DataFrame, split: DataFrame, aligned: DataFrame, unmatched: int = UNMATCHED) -> DataFrame:
    """One row an item, one a status and one in all (level item, status, all): the blocks' counts, with rates from their sums.

    An item is missing where a block has no row of it, review with more than ``unmatched`` lines without a match, else ok. Medians and 95th
    percentiles are those of items and null in totals, where only sums, least and greatest mean something. An empty batch has no rows.
    """
    j = normalised.join(split, "rec_id", "full").join(aligned, "rec_id", "full")
    gone = F.col("orig_len").isNull() | F.col("sentences").isNull() | F.col("lines").isNull()
    j = j.withColumn("status", F.when(gone, "missing").when(F.col("unmatched") > unmatched, "review").otherwise("ok"))
    g = j.groupingSets([[F.col("status"), F.col("rec_id")], [F.col("status")], []], "status", "rec_id").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("items"), *[F.sum(c).cast("long").alias(c) for c in SUMS],
        F.min("len_min").alias("len_min"), F.max("len_max").alias("len_max"), F.max("len_median").alias("_m"), F.max("len_p95").alias("_p"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(100 * F.col(a) / F.col(b), 2))
    level = F.when(F.col("_g") == 0, "item").when(F.col("_g") == 1, "status").otherwise("all")
    own = lambda c: F.when(F.col("_g") == 0, F.col(c))
    g = g.select(level.alias("level"), "status", "rec_id", "items", *SUMS, "len_min", own("_m").alias("len_median"), own("_p").alias("len_p95"), "len_max", rate("stops", "sentences").alias("stop_rate"), rate("matched", "lines").alias("match_rate"))
    return g.where("level <> 'all' or items > 0")
