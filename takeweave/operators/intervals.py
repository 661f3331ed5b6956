"""Interval algebra on (rec_id, s_ms, e_ms). Every operator is partitioned by rec_id; times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(iv: DataFrame, lo: int, hi: int) -> DataFrame:
    """Cut intervals to [lo, hi] and drop what becomes empty."""
    return iv.withColumn("s_ms", F.greatest("s_ms", F.lit(lo).cast("long"))).withColumn("e_ms", F.least("e_ms", F.lit(hi).cast("long"))).where("e_ms > s_ms")


def word_gaps(words: DataFrame) -> DataFrame:
    """Gap before each word: rec_id, idx, gap_ms (null for the first word)."""
    return words.select("rec_id", "idx", (F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("rec_id").orderBy("idx"))).alias("gap_ms"))


def pauses(words: DataFrame, min_ms: int = 450) -> DataFrame:
    """Gaps of at least ``min_ms`` between words as intervals."""
    before = F.lag("end_ms").over(Window.partitionBy("rec_id").orderBy("idx"))
    return words.select("rec_id", before.alias("s_ms"), F.col("start_ms").alias("e_ms")).where(F.col("e_ms") - F.col("s_ms") >= min_ms)


def merge(iv: DataFrame, gap: int = 0) -> DataFrame:
    """Join intervals that overlap or lie within ``gap``: rec_id, s_ms, e_ms, members."""
    order = Window.partitionBy("rec_id").orderBy("s_ms", "e_ms")
    reach = F.max("e_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = iv.select("rec_id", "s_ms", "e_ms", F.when(F.col("s_ms") > reach + gap, 1).otherwise(0).alias("new"))
    islands = fresh.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("rec_id", "island").agg(F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms"), F.count("*").alias("members")).drop("island")


def complement(iv: DataFrame, totals: DataFrame) -> DataFrame:
    """What the intervals leave of [0, total_ms] of each recording in ``totals`` (I05). Recordings without intervals keep all."""
    merged = merge(iv).select("rec_id", "s_ms", "e_ms")
    edges = merged.unionByName(totals.select("rec_id", F.col("total_ms").alias("s_ms"), F.col("total_ms").alias("e_ms")))
    order = Window.partitionBy("rec_id").orderBy("s_ms", "e_ms")
    return edges.select("rec_id", F.coalesce(F.max("e_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("a"), F.col("s_ms").alias("b")).where("b > a").select("rec_id", F.col("a").alias("s_ms"), F.col("b").alias("e_ms"))


def nearest(points: DataFrame, boundaries: DataFrame, radius: int) -> DataFrame:
    """``points(rec_id, id, x)`` with the boundary ``b`` nearest to x within ``radius``, null if none; ties take the smaller.

    Both sides are cut into buckets of ``radius`` and a point meets the three buckets around it: an equi-join, so no range of a
    recording is compared as a whole.
    """
    cell = lambda c: F.floor(c / radius)
    p = points.select("rec_id", "id", "x", F.explode(F.sequence(cell(F.col("x")) - 1, cell(F.col("x")) + 1)).alias("cell"))
    b = boundaries.select(F.col("rec_id").alias("r"), F.col("b"), cell(F.col("b")).alias("c")).distinct()
    near = p.hint("merge").join(b, (p.rec_id == b.r) & (p.cell == b.c)).where(F.abs(F.col("b") - F.col("x")) <= radius)
    best = near.groupBy("rec_id", "id").agg(F.min_by("b", F.struct(F.abs(F.col("b") - F.col("x")), "b")).alias("b"))
    return points.hint("merge").join(best, ["rec_id", "id"], "left").select("rec_id", "id", "x", "b")


def snap(iv: DataFrame, boundaries: DataFrame, radius: int, min_ms: int = 0) -> DataFrame:
    """Move both ends of ``iv(rec_id, id, s_ms, e_ms)`` to the nearest boundary.

    label tells what moved (both, start, end, no-snap); flag is invalid when the ends cross, too-short below ``min_ms``, else ok.
    """
    s = nearest(iv.select("rec_id", "id", F.col("s_ms").alias("x")), boundaries, radius).select("rec_id", "id", F.col("b").alias("sb"))
    e = nearest(iv.select("rec_id", "id", F.col("e_ms").alias("x")), boundaries, radius).select("rec_id", "id", F.col("b").alias("eb"))
    j = iv.join(s, ["rec_id", "id"]).join(e, ["rec_id", "id"])
    a, z = F.coalesce("sb", "s_ms"), F.coalesce("eb", "e_ms")
    moved_s, moved_e = F.col("sb").isNotNull(), F.col("eb").isNotNull()
    label = F.when(moved_s & moved_e, "both").when(moved_s, "start").when(moved_e, "end").otherwise("no-snap")
    return j.select("rec_id", "id", a.alias("s_ms"), z.alias("e_ms"), label.alias("label"), F.when(z <= a, "invalid").when(z - a < min_ms, "too-short").otherwise("ok").alias("flag"))


def pad(iv: DataFrame, before: int = 80, after: int = 120) -> DataFrame:
    """Widen intervals, not below 0."""
    return iv.withColumn("s_ms", F.greatest(F.col("s_ms") - before, F.lit(0).cast("long"))).withColumn("e_ms", F.col("e_ms") + after)


def split_long(iv: DataFrame, max_ms: int) -> DataFrame:
    """Cut intervals into pieces of at most ``max_ms``: rec_id, s_ms, e_ms."""
    cut = iv.where("e_ms > s_ms").select("rec_id", "e_ms", F.explode(F.sequence(F.col("s_ms"), F.col("e_ms") - 1, F.lit(max_ms).cast("long"))).alias("s"))
    return cut.select("rec_id", F.col("s").alias("s_ms"), F.least(F.col("s") + max_ms, "e_ms").alias("e_ms"))


def folded(iv: DataFrame, min_ms: int) -> DataFrame:
    """Fold intervals shorter than ``min_ms`` into the one before, or the next when they come first.

    Between two intervals of ``min_ms`` or more nothing is ever folded, so the ordered fold runs over the short runs between such
    places, not over a whole recording.
    """
    order = Window.partitionBy("rec_id").orderBy("s_ms", "e_ms")
    long = F.col("e_ms") - F.col("s_ms") >= min_ms
    parted = iv.select("rec_id", "s_ms", "e_ms", long.alias("_long")).withColumn("_new", F.when(F.col("_long") & F.lag("_long").over(order), 1).otherwise(0))
    parted = parted.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    arrays = parted.groupBy("rec_id", "_g").agg(F.sort_array(F.collect_list(F.struct("s_ms", "e_ms"))).alias("xs"))
    empty = F.expr("cast(array() as array<struct<s_ms:bigint,e_ms:bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        short = (x["e_ms"] - x["s_ms"] < min_ms) | (last["e_ms"] - last["s_ms"] < min_ms)
        joined = F.array(F.struct(last["s_ms"].alias("s_ms"), F.greatest(last["e_ms"], x["e_ms"]).alias("e_ms")))
        return F.when(F.size(acc) == 0, F.array(x)).when(short, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.concat(acc, F.array(x)))

    return arrays.select("rec_id", F.explode(F.aggregate("xs", empty, step)).alias("x")).select("rec_id", "x.s_ms", "x.e_ms")


def union_merged(a: DataFrame, b: DataFrame, totals: DataFrame) -> DataFrame:
    """(rec_id, s_ms, e_ms): both interval tables together, cut to [0, total_ms] of ``totals`` and merged (U01). Recordings without a total go."""
    both = a.select("rec_id", "s_ms", "e_ms").unionByName(b.select("rec_id", "s_ms", "e_ms")).join(totals, "rec_id")
    cut = both.select("rec_id", F.greatest("s_ms", F.lit(0).cast("long")).alias("s_ms"), F.least("e_ms", "total_ms").alias("e_ms")).where("e_ms > s_ms")
    return merge(cut).select("rec_id", "s_ms", "e_ms")


def split_at_boundaries(iv: DataFrame, boundaries: DataFrame, max_ms: int = 20_000) -> DataFrame:
    """(rec_id, s_ms, e_ms): intervals cut to pieces of at most ``max_ms`` at the last boundary that is in reach, else at the limit.

    ``iv(rec_id, id, s_ms, e_ms)``, ``boundaries(rec_id, b)``. Cuts keep a distance (a quarter of ``max_ms``, 400 to 1500 ms) from both ends
    of what is left. Intervals meet the boundaries in cells of ``max_ms``, and each is folded with its own boundaries alone.
    """
    far = max(400, min(max_ms // 4, 1500))
    cells = iv.where(F.col("e_ms") - F.col("s_ms") > max_ms).select("rec_id", "id", "s_ms", "e_ms", F.explode(F.sequence(F.floor(F.col("s_ms") / max_ms), F.floor(F.col("e_ms") / max_ms))).alias("cell"))
    points = boundaries.select("rec_id", "b", F.floor(F.col("b") / max_ms).alias("cell")).distinct()
    met = cells.join(points, ["rec_id", "cell"], "left").groupBy("rec_id", "id", "s_ms", "e_ms").agg(F.collect_set("b").alias("ps"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        cut = F.coalesce(F.array_max(F.filter("ps", lambda p: (p >= at + far) & (p <= F.least(F.col("e_ms") - far, at + max_ms)))), at + max_ms)
        return F.when(F.col("e_ms") - at <= max_ms, acc).otherwise(F.struct(cut.alias("at"), F.concat(acc["out"], F.array(cut)).alias("out")))

    most = F.size("ps") + F.floor((F.col("e_ms") - F.col("s_ms")) / max_ms).cast("int") + 1
    cuts = F.aggregate(F.sequence(F.lit(1), most), F.struct(F.col("s_ms").alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]
    edges = met.select("rec_id", F.concat(F.array("s_ms"), cuts, F.array("e_ms")).alias("x"))
    pieces = edges.select("rec_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("x") - 2), lambda i: F.struct(F.get("x", i).alias("s_ms"), F.get("x", i + 1).alias("e_ms")))).alias("p")).select("rec_id", "p.*")
    return pieces.unionByName(iv.where((F.col("e_ms") - F.col("s_ms") <= max_ms) & (F.col("e_ms") > F.col("s_ms"))).select("rec_id", "s_ms", "e_ms"))


def keeps_of_edit_list(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """Keep intervals of ``segments(rec_id, s_ms, e_ms, action)``: explicit keeps win, else the complement of the cuts."""
    explicit = segments.where("action = 'keep'")
    with_keep = explicit.select("rec_id").distinct()
    cuts = segments.where("action = 'cut'").join(with_keep, "rec_id", "left_anti")
    rest = complement(cuts.select("rec_id", "s_ms", "e_ms"), totals.join(with_keep, "rec_id", "left_anti"))
    return merge(explicit.select("rec_id", "s_ms", "e_ms")).select("rec_id", "s_ms", "e_ms").unionByName(rest)


def active_at(points: DataFrame, iv: DataFrame, tail: int = 50, cell_ms: int = 3_600_000) -> DataFrame:
    """``points(rec_id, id, x)`` with the interval ``[s, e + tail]`` that holds x, the first by start (J09): intervals meet the cells they cover."""
    cells = iv.select(F.col("rec_id").alias("r"), F.col("id").alias("iv_id"), "s_ms", "e_ms", F.explode(F.sequence(F.floor(F.col("s_ms") / cell_ms), F.floor((F.col("e_ms") + tail) / cell_ms))).alias("c"))
    p = points.withColumn("cell", F.floor(F.col("x") / cell_ms))
    hit = p.join(cells, (p.rec_id == cells.r) & (p.cell == cells.c) & F.col("x").between(F.col("s_ms"), F.col("e_ms") + tail))
    best = hit.groupBy("rec_id", "id").agg(F.min_by("iv_id", F.struct("s_ms", "iv_id")).alias("iv_id"))
    return points.join(best, ["rec_id", "id"], "left").select("rec_id", "id", "iv_id")


def snap_inside(iv: DataFrame, boundaries: DataFrame, radius: int = 200) -> DataFrame:
    """``iv(rec_id, id, s_ms, e_ms)`` with ends moved to the nearest boundary within ``radius`` that lies inside the interval."""
    s = nearest(iv.select("rec_id", "id", F.col("s_ms").alias("x")), boundaries, radius).select("rec_id", "id", F.col("b").alias("sb"))
    e = nearest(iv.select("rec_id", "id", F.col("e_ms").alias("x")), boundaries, radius).select("rec_id", "id", F.col("b").alias("eb"))
    j = iv.hint("merge").join(s, ["rec_id", "id"]).hint("merge").join(e, ["rec_id", "id"])
    a = F.when(F.col("sb").between(F.col("s_ms"), F.col("e_ms")), F.col("sb")).otherwise(F.col("s_ms"))
    z = F.when(F.col("eb").between(F.col("s_ms"), F.col("e_ms")), F.col("eb")).otherwise(F.col("e_ms"))
    return j.select("rec_id", "id", a.alias("s_ms"), F.greatest(a, z).alias("e_ms"))


def audit(iv: DataFrame, boundaries: DataFrame, radius: int, gap: int) -> DataFrame:
    """One row an interval with its way through snapping, padding and merging.

    orig_s/e, snap_s/e, pad_s/e; merged_into is the least id of the island it ends in, final_s/e that island's ends.
    """
    snapped = snap_inside(iv, boundaries, radius).select("rec_id", "id", F.col("s_ms").alias("snap_s"), F.col("e_ms").alias("snap_e"))
    padded = pad(snapped.withColumn("s_ms", F.col("snap_s")).withColumn("e_ms", F.col("snap_e")))
    order = Window.partitionBy("rec_id").orderBy("s_ms", "e_ms", "id")
    fresh = F.when(F.col("s_ms") > F.max("e_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)) + gap, 1).otherwise(0)
    p = padded.withColumn("_new", fresh).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("rec_id", "_i")
    p = p.select("rec_id", "id", "snap_s", "snap_e", F.col("s_ms").alias("pad_s"), F.col("e_ms").alias("pad_e"), F.min("id").over(island).alias("merged_into"), F.min("s_ms").over(island).alias("final_s"), F.max("e_ms").over(island).alias("final_e"))
    return iv.select("rec_id", "id", F.col("s_ms").alias("orig_s"), F.col("e_ms").alias("orig_e")).join(p, ["rec_id", "id"])
