"""Multi-party dialogues seen from each participant.

For every participant of a conversation (each role but system) the dialogue is rendered with that speaker as
assistant, the others as named users and system turns as they are. Masks give the code points that training
should learn: the speaker's own texts with their end marks.

A rendering is cut into parts of ``TURNS_PER_PART`` consecutive turn numbers. A part of more than ``ROWS_PER_PART`` rows (turn
numbers that repeat, null turns, the conversation of the null conv_id) is given in several rows of at most so many, with the same
part and rising ``start``, so that no row gathers an unbounded conversation: the rows of a speaker in the order of part and start,
joined, are the whole rendering, and ``start`` and the masks count from its beginning.

Null roles speak as "unknown", null texts are empty, null turns come first in a part of their own, rows with a null conv_id form
one conversation. Rows with equal turn stand in the order of role and text; repeated rows are rendered as often as they occur.
Conversations of system turns only have no participant and no rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.session import written

TURNS_PER_PART = 256
ROWS_PER_PART = 256
END = "<|end|>"


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == "system", F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _starts(turns: DataFrame) -> DataFrame:
    """(_k, _n, part, piece, speaker, start): where each speaker's rendering of a piece of a part begins, from the lengths alone."""
    nobody = F.lit(None).cast("string")
    by_role = turns.groupBy("_k", "_n", "part", "piece", "role").agg(F.count("*").alias("n"), F.sum(F.length("t").cast("long")).alias("chars"))
    speakers = by_role.where("role <> 'system'").select("_k", "_n", F.col("role").alias("speaker")).distinct()
    size = F.col("chars") + F.col("n") * (F.length(_head(F.col("role"), nobody)) + len(END) + 1)
    totals = by_role.groupBy("_k", "_n", "part", "piece").agg(F.sum(size).alias("size"))
    saved = F.col("n") * (F.length(_head(F.col("role"), F.col("role"))) - F.length(_head(F.col("role"), nobody)))
    own = by_role.where("role <> 'system'").select("_k", "_n", "part", "piece", F.col("role").alias("speaker"), saved.alias("own"))
    sizes = totals.join(speakers, ["_k", "_n"]).join(own, ["_k", "_n", "part", "piece", "speaker"], "left")
    before = Window.partitionBy("_k", "_n", "speaker").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_k", "_n", "part", "piece", "speaker", F.coalesce(F.sum(F.col("size") + F.coalesce("own", F.lit(0))).over(before), F.lit(0)).cast("long").alias("start"))


def _pieces(turns: DataFrame, rows: int) -> DataFrame:
    """``turns`` with ``piece``: 0, or the place of a row in its part by ``rows``, where the part has more rows than that.

    Large parts are range-sorted with a salt, so that equal rows spread too, and ranked by the row counts of the sorted partitions.
    """
    key = ["_k", "_n", "part"]
    large = written(turns.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > rows).drop("n"), "large-parts")
    if large.isEmpty():
        # Not a literal: the optimizer would take it out of the grouping, and the texts would be shuffled again for the join.
        return turns.withColumn("piece", F.col("part") - F.col("part"))
    salted = written(turns.join(large, key, "left_semi").withColumn("salt", F.monotonically_increasing_id()), "large-part-turns")
    order = [*key, "turn", "role", "t", "salt"]
    placed = salted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_o", F.monotonically_increasing_id())
    placed = written(placed, "large-part-order").withColumn("_p", F.shiftright("_o", 33))
    runs = placed.groupBy(*key, "_p").agg(F.min("_o").alias("_first"), F.count("*").alias("_c"))
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    placed = placed.join(runs, [*key, "_p"]).withColumn("piece", F.floor((F.col("_o") - F.col("_first") + F.col("_before")) / rows))
    few = turns.join(large, key, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    return few.unionByName(placed.select(few.columns))


def rotate(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_own_turns, start, text, masks): masks are "begin:end" joined by commas.

    The texts are shuffled once, to gather each part; they meet the speakers where they lie, and only there the renderings arise.
    """
    c = conversations
    turns = c.select(
        c["conv_id"].alias("conv_id"),
        F.coalesce(c["conv_id"].cast("string"), F.lit("")).alias("_k"),
        c["conv_id"].isNull().alias("_n"),
        c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(c["text"].cast("string"), F.lit("")).alias("t"),
    ).withColumn("part", F.floor(F.coalesce("turn", F.lit(-1)) / turns_per_part))
    turns = _pieces(turns, rows_per_part)
    parts = turns.groupBy("_k", "_n", "part", "piece").agg(F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role", "t"))).alias("xs"))
    parts = parts.join(_starts(turns), ["_k", "_n", "part", "piece"])
    marked = F.transform("xs", lambda x: F.struct(x["t"].alias("t"), _head(x["role"], F.col("speaker")).alias("head"), (x["role"] == F.col("speaker")).alias("own")))
    parts = parts.select("conv_id", "speaker", "part", "start", marked.alias("xs"))
    pieces = F.transform("xs", lambda x: F.concat(x["head"], x["t"], F.lit(END + "\n")))
    parts = parts.select("*", F.array_join(pieces, "").alias("text"))
    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["t"]) + F.lit(len(END))
        mask = F.when(x["own"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], mask).alias("out"))

    masks = F.aggregate("xs", zero, step)["out"]
    return parts.select("conv_id", "speaker", "part", F.size("xs").cast("long").alias("n_turns"), F.size(masks).cast("long").alias("n_own_turns"), "start", "text", F.array_join(masks, ",").alias("masks"))


ORACLE = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS t FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
r AS (SELECT m.*, s.speaker, CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(t) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT conv_id, speaker, turn // 256 AS part, count(*) AS n_turns, count(*) FILTER (WHERE role = speaker) AS n_own_turns, CAST(min(pos) AS BIGINT) AS start,
  string_agg(head || t || '<|end|>' || chr(10), '' ORDER BY turn, role, t) AS text,
  string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(head) + length(t) + 7 AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, t) FILTER (WHERE role = speaker) AS masks
FROM o GROUP BY conv_id, speaker, turn // 256
"""
