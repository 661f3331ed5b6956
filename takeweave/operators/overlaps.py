"""Neighbouring keeps that say the same merged to the later one (D06): safe, or aggressive over one blank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.functions import text as tx

#: Least Jaccard of the words, in percent, and whether one blank keep may lie between.
POLICIES = {"none": (101, False), "safe": (85, False), "aggressive": (75, True)}
#: A gap may be longer than the blank keep in it by this.
SLACK_MS = 50


def _fold_task(bridges: bool):
    """The fold over keeps (rec, pos, blank, near, s, e) sorted by rec and pos: its state is the last kept span and one blank, so it reads a stream.

    Gives (rec, pos, chain): keeps of one chain are merged, blanks that a chain bridges belong to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, chain, span, held = object(), 0, None, None  # held: a blank that waits, with its place
        out: list[tuple] = []

        def let_go() -> None:
            nonlocal chain, held, span
            chain += 1
            out.append((rec, held[0], chain))
            span, held = None, None  # a keep is not compared over a blank that stays

        for batch in batches:
            for now, pos, blank, near, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != rec:
                    if held:
                        let_go()
                    rec, chain, span, held = now, 0, None, None
                if bridges and blank:
                    if held:
                        let_go()
                    held = (pos, s, e)
                    continue
                joins = False
                if span and near:
                    meets = min(span[1], e) - max(span[0], s) > 0
                    if held and not meets:
                        meets = s - span[1] <= max(0, held[2] - held[1]) + SLACK_MS
                    joins = meets and s >= span[0]
                if joins:
                    if held:
                        out.append((rec, held[0], chain))
                        span = (min(span[0], held[1]), max(span[1], held[2]))
                        held = None
                    span = (min(span[0], s), max(span[1], e))
                else:
                    if held:
                        let_go()
                    chain += 1
                    span = (s, e)
                out.append((rec, pos, chain))
            if out:
                yield _rows(out)
                out = []
        if held:
            let_go()
            yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["rec_id", "pos", "chain"])

    return run


def _jaccard(a: Column, b: Column) -> Column:
    """Percent of shared words of two word sets, floored; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 100).otherwise(F.floor(100 * F.size(F.array_intersect(a, b)) / union))


def chains(keeps: DataFrame, policy: str = "safe") -> DataFrame:
    """``keeps`` (rec_id, pos, text, s_ms, e_ms, ...) with chain and removed.

    Keeps stand in the order of pos, which is unique in a recording. A keep joins the chain of the one before it if their words meet by Jaccard (85 percent
    safe, 75 aggressive), it overlaps the chain's span and does not start before it. The aggressive policy sets one blank keep between the two aside:
    then a gap no longer than the blank and 50 ms will do too, and the blank joins the chain. The later text stays, so of a chain the last keep is not
    removed. With policy none each keep is its own chain. Null texts are blank; keeps without times or recording are left out.
    """
    least, bridges = POLICIES[policy]
    k = keeps.where("rec_id is not null and s_ms is not null and e_ms is not null")
    words = F.array_distinct(tx.match_tokens(F.coalesce("text", F.lit(""))))
    k = k.withColumn("_w", words).withColumn("_blank", F.size("_w") == 0)
    order = Window.partitionBy("rec_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~F.col("_blank"), F.col("_w")), ignorenulls=True).over(order) if bridges else F.lag("_w").over(Window.partitionBy("rec_id").orderBy("pos"))
    k = k.withColumn("_near", F.coalesce(_jaccard(F.col("_w"), before) >= least, F.lit(False)))
    rows = k.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("pos").cast("long").alias("pos"), "_blank", "_near", F.col("s_ms").cast("long"), F.col("e_ms").cast("long"))
    folded = rows.repartition("rec_id").sortWithinPartitions("rec_id", "pos").mapInArrow(_fold_task(bridges), "rec_id long, pos long, chain long")
    j = k.drop("_w", "_near").join(folded, ["rec_id", "pos"])
    own = Window.partitionBy("rec_id", "chain")
    last = F.coalesce(F.max(F.when(~F.col("_blank"), F.col("pos"))).over(own), F.max("pos").over(own))
    return j.withColumn("removed", F.col("pos") != last).drop("_blank")


def merged(chained: DataFrame) -> DataFrame:
    """(rec_id, pos, text, s_ms, e_ms, n_merged): what is kept of each chain, with the span of all its keeps."""
    kept = F.max_by(F.struct("pos", "text"), F.struct((~F.col("removed")).cast("int"), "pos"))
    g = chained.groupBy("rec_id", "chain").agg(kept.alias("k"), F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms"), F.count_if("removed").alias("n_merged"))
    return g.select("rec_id", "k.pos", "k.text", "s_ms", "e_ms", "n_merged")


def totals(chained: DataFrame) -> DataFrame:
    """(rec_id, before, after, ms_before, ms_after, removed): keeps and their time before and after, as D06 reports them."""
    b = chained.groupBy("rec_id").agg(F.count("*").alias("before"), F.sum(F.greatest(F.col("e_ms") - F.col("s_ms"), F.lit(0))).alias("ms_before"), F.count_if("removed").alias("removed"))
    a = merged(chained).groupBy("rec_id").agg(F.count("*").alias("after"), F.sum(F.greatest(F.col("e_ms") - F.col("s_ms"), F.lit(0))).alias("ms_after"))
    return b.join(a, "rec_id").select("rec_id", "before", "after", "ms_before", "ms_after", "removed")
