"""Batch records: the best file of a stem, totals of a batch, take statistics and the guard on the share that is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeweave.operators.align import word_grams
from takeweave.operators.retake import clusters

TEXT_ORDER = ("align", "norm", "text")
AUDIO_ORDER = (".wav", ".flac", ".m4a", ".mp3")


def _ranked(value: Column, order: tuple[str, ...]) -> Column:
    """Place of ``value`` in ``order`` from 1; null where it is not listed."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(place > 0, place)


def best_text(catalog: DataFrame, order: tuple[str, ...] = TEXT_ORDER) -> DataFrame:
    """stem, path: the script of each stem by kind, in ``order``; of equal kinds the least path (J02). Stems without a script have no row."""
    c = catalog.withColumn("_p", _ranked(F.col("kind"), order)).where("_p is not null")
    return c.groupBy("stem").agg(F.min(F.struct("_p", "path")).alias("m")).select("stem", "m.path")


def best_audio(catalog: DataFrame, order: tuple[str, ...] = AUDIO_ORDER) -> DataFrame:
    """stem, path: the recording of each stem by file ending, in ``order``; of equal endings the least path."""
    ending = F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1)
    c = catalog.where("kind = 'audio'").withColumn("_p", _ranked(ending, order)).where("_p is not null")
    return c.groupBy("stem").agg(F.min(F.struct("_p", "path")).alias("m")).select("stem", "m.path")


def stage_summary(items: DataFrame) -> DataFrame:
    """total, ok, failed of ``items(ok boolean)``; an unknown outcome counts as failed."""
    return items.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))


def take_stats(takes: DataFrame, window_ms: int) -> DataFrame:
    """rec_id, total, kept, total_ms, cut_ms of keeping the last take of each cluster."""
    length = F.col("t1") - F.col("t0")
    cut = F.coalesce(F.sum(F.when(~F.col("is_last"), length)), F.lit(0))
    return clusters(takes, window_ms).groupBy("rec_id").agg(F.count("*").alias("total"), F.count_if("is_last").alias("kept"), F.sum(length).alias("total_ms"), cut.alias("cut_ms"))


def guarded(takes: DataFrame, window_ms: int, relaxed_ms: int, percent: int = 60) -> DataFrame:
    """rec_id, cand_id, guard_action of the takes kept.

    A recording that would lose more than ``percent`` of its time is done again with the window ``relaxed_ms`` (relaxed); where
    that still cuts too much, the action is abort. Only such recordings are read a second time.
    """
    over = lambda t, w: take_stats(t, w).where(100 * F.col("cut_ms") > percent * F.col("total_ms")).select("rec_id")
    bad = over(takes, window_ms)
    again = takes.join(bad, "rec_id", "left_semi")
    still = over(again, relaxed_ms).withColumn("guard_action", F.lit("abort"))
    first = clusters(takes, window_ms).where("is_last").join(bad, "rec_id", "left_anti").select("rec_id", "cand_id", F.lit("none").alias("guard_action"))
    second = clusters(again, relaxed_ms).where("is_last").join(still, "rec_id", "left").select("rec_id", "cand_id", F.coalesce("guard_action", F.lit("relaxed")).alias("guard_action"))
    return first.unionByName(second)


def occurrences(lines: DataFrame, stream: DataFrame, n: int = 3) -> DataFrame:
    """(item_id, doc_id, start) of every place, overlapping ones too, where all words of a line stand in a stream.

    Lines meet streams on their first ``n`` words; lines of fewer words have no row. start counts words from 0.
    """
    first = word_grams(lines, "item_id", n).where("pos = 0").select("item_id", "gram")
    met = word_grams(stream, "doc_id", n).join(first, "gram").select("item_id", "doc_id", "pos")
    whole = met.join(lines.select("item_id", F.col("words").alias("_l")), "item_id").join(stream.select("doc_id", F.col("words").alias("_s")), "doc_id")
    return whole.where(F.slice("_s", F.col("pos") + 1, F.size("_l")) == F.col("_l")).select("item_id", "doc_id", F.col("pos").cast("long").alias("start"))
