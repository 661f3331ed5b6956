"""Relations that the transcript operators work on, derived from the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, cand_id, k, t0, t1 (ms), score: events read as takes."""
    e = table(spark, sf_dir, "events")
    t0 = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return e.select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("cand_id"), F.col("event_type").alias("k"), t0.alias("t0"), (t0 + F.floor(F.col("value") * 60000)).alias("t1"), F.col("value").alias("score"))


T = "t AS (SELECT user_id AS rec_id, event_id AS cand_id, event_type AS k, epoch_us(ts)//1000-1704067200000 AS t0, epoch_us(ts)//1000-1704067200000+CAST(floor(value*60000) AS BIGINT) AS t1, value AS score FROM events)"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n (from 1), line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("n"), "line")


G = "g AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS BIGINT) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, idx, text, start_ms, end_ms: conversation turns as a word timeline."""
    c = table(spark, sf_dir, "conversations")
    w = c.select(F.col("conv_id").alias("rec_id"), "turn", F.posexplode(F.split(F.trim(F.regexp_replace("text", "[ \\n\\t]+", " ")), " ")).alias("p", "text"))
    idx = F.row_number().over(Window.partitionBy("rec_id").orderBy("turn", "p")) - 1
    start = F.lit(300).cast("long") * idx + F.lit(700) * F.col("turn")
    return w.select("rec_id", idx.cast("long").alias("idx"), "text", start.alias("start_ms"), (start + 250).alias("end_ms"))


W = (
    "w0 AS (SELECT conv_id AS rec_id, turn, generate_subscripts(ws, 1) AS p, unnest(ws) AS text FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')), ' ') AS ws FROM conversations)), "
    "w1 AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY turn, p) - 1 AS idx FROM w0), "
    "w AS (SELECT rec_id, idx, text, 300*idx+700*turn AS start_ms, 300*idx+700*turn+250 AS end_ms FROM w1)"
)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: file names as a batch of recordings would have them, derived from the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("stem"))
    audio = F.expr("element_at(array('.wav', '.flac', '.m4a', '.mp3'), cast(least(doc_id % 6, 3) + 1 as int))")
    ends = F.array(
        F.when(F.col("doc_id") % 5 != 0, F.lit(".words.json")),
        F.when(F.col("doc_id") % 7 != 0, F.lit(".txt")),
        F.when(F.col("doc_id") % 3 == 0, F.lit(".norm.txt")),
        F.when(F.col("doc_id") % 4 == 0, F.lit(".align.txt")),
        F.when(F.col("doc_id") % 11 == 0, F.lit(".canonical.txt")),
        F.when(F.col("doc_id") % 6 < 4, audio),
    )
    return d.select("stem", F.explode(F.array_compact(ends)).alias("x")).select(F.concat("stem", "x").alias("path"))


P = (
    "p AS (SELECT 's' || doc_id || '.words.json' AS path FROM documents WHERE doc_id%5<>0 UNION ALL SELECT 's' || doc_id || '.txt' FROM documents WHERE doc_id%7<>0 "
    "UNION ALL SELECT 's' || doc_id || '.norm.txt' FROM documents WHERE doc_id%3=0 UNION ALL SELECT 's' || doc_id || '.align.txt' FROM documents WHERE doc_id%4=0 "
    "UNION ALL SELECT 's' || doc_id || '.canonical.txt' FROM documents WHERE doc_id%11=0 "
    "UNION ALL SELECT 's' || doc_id || ['.wav', '.flac', '.m4a', '.mp3'][doc_id%6+1] FROM documents WHERE doc_id%6<4)"
)
