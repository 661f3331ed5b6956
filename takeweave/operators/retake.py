"""Take de-duplication: clusters of repeats, keep-last, path choice and monotonic order. All partitioned by recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.operators import intervals


def clusters(takes: DataFrame, window_ms: int, keys: tuple[str, ...] = ("rec_id", "k")) -> DataFrame:
    """Takes with cluster, rank, is_last: a cluster ends when the next take of the key starts more than ``window_ms`` later.

    With a window of 0 or less every take is alone. Ties order by (t0, t1, cand_id).
    """
    order = Window.partitionBy(*keys).orderBy("t0", "t1", "cand_id")
    fresh = F.when(F.lag("t0").over(order).isNull(), 0).when(F.lit(window_ms <= 0) | (F.col("t0") - F.lag("t0").over(order) > window_ms), 1).otherwise(0)
    c = takes.withColumn("_new", fresh).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    inside = Window.partitionBy(*keys, "cluster").orderBy("t0", "t1", "cand_id")
    return c.withColumn("rank", F.row_number().over(inside)).withColumn("is_last", F.lead("cand_id").over(inside).isNull())


def keep_last(takes: DataFrame, window_ms: int, keys: tuple[str, ...] = ("rec_id", "k")) -> DataFrame:
    """The last take of each cluster (D03, policy last)."""
    return clusters(takes, window_ms, keys).where("is_last")


def last_by_gap(takes: DataFrame, max_gap: int) -> DataFrame:
    """Takes whose next take of the key starts more than ``max_gap`` after their end, and the last ones."""
    nxt = F.lead("t0").over(Window.partitionBy("rec_id", "k").orderBy("t0", "t1", "cand_id"))
    return takes.withColumn("_next", nxt).where(F.col("_next").isNull() | (F.col("_next") - F.col("t1") > max_gap)).drop("_next")


def _islands(takes: DataFrame, reach: int) -> DataFrame:
    """``takes`` with island: a new one begins with a take that starts ``reach`` or more after all ends before it. One window per recording, no array."""
    order = Window.partitionBy("rec_id").orderBy("t0", "t1", "cand_id")
    before = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = takes.withColumn("_new", F.when(F.col("t0") - before >= reach, 1).otherwise(0))
    return fresh.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def monotonic(takes: DataFrame, epsilon: int = 20, mode: str = "strict") -> DataFrame:
    """Takes in order without overlap (D07): a take that starts more than ``epsilon`` before the last accepted end is dropped (strict) or trimmed (soft).

    Dropped takes do not advance the end, so this is an ordered fold; it runs over one island of overlapping takes at a time, as a
    take that overlaps no earlier one is accepted whatever came before. Null times sort first; a take without an end ends the fold's
    comparisons until the next one with an end.
    """
    if mode == "off":
        return takes.select("rec_id", "t0", "t1", "cand_id", F.lit(False).alias("trimmed"))
    zero = F.expr("named_struct('end', cast(null as bigint), 'out', cast(array() as array<struct<t0:bigint,t1:bigint,cand_id:bigint,trimmed:boolean>>))")

    def step(acc: Column, x: Column) -> Column:
        late = F.coalesce(x["t0"] < acc["end"] - epsilon, F.lit(False))
        gone = F.coalesce(x["t1"] <= acc["end"], F.lit(False)) & late
        drop = late if mode == "strict" else gone
        row = F.struct(F.when(late, acc["end"]).otherwise(x["t0"]).alias("t0"), x["t1"].alias("t1"), x["cand_id"].alias("cand_id"), late.alias("trimmed"))
        return F.when(drop, acc).otherwise(F.struct(x["t1"].alias("end"), F.concat(acc["out"], F.array(row)).alias("out")))

    xs = _islands(takes, -epsilon).groupBy("rec_id", "island").agg(F.sort_array(F.collect_list(F.struct("t0", "t1", "cand_id"))).alias("xs"))
    return xs.select("rec_id", F.explode(F.aggregate("xs", zero, step)["out"]).alias("x")).select("rec_id", "x.*")


def best_path(takes: DataFrame, epsilon: int = 20, gap_ms: int = 3_600_000, late_bonus: float = 0.05, early_penalty: float = -0.1, gap_penalty: float = -0.2) -> DataFrame:
    """The chain of takes without overlap of the highest value (D04): rec_id, island, cand_id, t0, t1, island_value for the takes on it.

    takes(rec_id, cand_id, t0, t1, score, length, rank, is_last), the last two from :func:`clusters`; without these columns takes have no
    length and are the only one of their cluster. Takes without times are not on a path, null scores count 0. A take is worth
    score + min(0.2, 0.01 * length) + late_bonus * rank, and early_penalty more unless it is its cluster's last; a step over a gap
    of more than ``gap_ms`` costs ``gap_penalty`` (both penalties are negative). A step may overlap by ``epsilon``. Ties take the
    earliest step and the latest end.

    Where no take reaches over a gap of ``gap_ms``, every chain that goes on pays the same penalty, so such islands are solved one by
    one, each with an array of (value, end, place of the take before), and an island stays when it is worth more than the penalty. The
    value of a recording is the sum over its islands, with one penalty for each but the first.
    """
    for name, usual in (("length", F.lit(0)), ("rank", F.lit(1)), ("is_last", F.lit(True))):
        if name not in takes.columns:
            takes = takes.withColumn(name, usual)
    worth = F.coalesce(F.col("score"), F.lit(0.0)) + F.least(F.lit(0.2), 0.01 * F.greatest("length", F.lit(0))) + late_bonus * F.greatest("rank", F.lit(1)) + F.when(F.col("is_last"), 0.0).otherwise(early_penalty)
    xs = _islands(takes.where("t0 is not null and t1 is not null"), gap_ms + 1).withColumn("w", worth)
    xs = xs.groupBy("rec_id", "island").agg(F.sort_array(F.collect_list(F.struct("t0", "t1", "cand_id", "w"))).alias("xs"))
    empty = F.expr("cast(array() as array<struct<v:double,t1:bigint,prev:int>>)")

    def step(acc: Column, x: Column) -> Column:
        cost = lambda p: F.when(x["t0"] - p["t1"] > gap_ms, F.lit(gap_penalty)).otherwise(0.0)
        able = F.transform(acc, lambda p, i: F.struct(F.when(p["t1"] <= x["t0"] + epsilon, p["v"] + cost(p)).alias("v"), (-i).alias("i")))
        best = F.array_max(able)
        goes = F.coalesce(best["v"] > 0, F.lit(False))
        return F.concat(acc, F.array(F.struct((x["w"] + F.when(goes, best["v"]).otherwise(0.0)).alias("v"), x["t1"].alias("t1"), F.when(goes, -best["i"]).otherwise(-1).alias("prev"))))

    solved = xs.withColumn("st", F.aggregate("xs", empty, step))
    solved = solved.withColumn("top", F.array_max(F.transform("st", lambda p, i: F.struct(p["v"].alias("v"), p["t1"].alias("t1"), (-i).alias("i")))))
    start = F.struct((-F.col("top.i")).alias("at"), F.array().cast("array<int>").alias("out"))
    back = F.aggregate(F.sequence(F.size("st") - 1, F.lit(0)), start, lambda acc, i: F.when(acc["at"] == i, F.struct(F.get(F.col("st"), i)["prev"].alias("at"), F.concat(acc["out"], F.array(i)).alias("out"))).otherwise(acc))
    solved = solved.select("rec_id", "island", F.col("top.v").alias("island_value"), F.transform(back["out"], lambda i: F.get(F.col("xs"), i)).alias("path"))
    rec = Window.partitionBy("rec_id")
    gain = F.col("island_value") + gap_penalty
    best = F.row_number().over(rec.orderBy(F.desc("island_value"), "island"))
    kept = solved.withColumn("_gain", gain).withColumn("_any", F.max(gain).over(rec) > 0).withColumn("_r", best).where("_gain > 0 or (not _any and _r = 1)")
    return kept.select("rec_id", "island", "island_value", F.explode("path").alias("x")).select("rec_id", "island", "x.cand_id", "x.t0", "x.t1", "island_value")


def path_values(path: DataFrame, gap_penalty: float = -0.2) -> DataFrame:
    """(rec_id, n, value): takes on the best path of each recording and what it is worth."""
    per = path.groupBy("rec_id", "island").agg(F.count("*").alias("n"), F.first("island_value").alias("v"))
    return per.groupBy("rec_id").agg(F.sum("n").alias("n"), (F.sum("v") + gap_penalty * (F.count("*") - 1)).alias("value"))


def adjacent_spans(takes: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """Takes whose gap to the previous one is at most ``gap_ms`` merged to spans with their ids and a preview of the first three."""
    order = Window.partitionBy("rec_id").orderBy("t0", "t1", "cand_id")
    fresh = F.when(F.col("t0") - F.lag("t1").over(order) > gap_ms, 1).otherwise(0)
    s = takes.withColumn("_new", fresh).withColumn("span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("rec_id", "span").agg(F.min("t0").alias("s_ms"), F.max("t1").alias("e_ms"), F.sort_array(F.collect_list(F.struct("t0", "t1", "cand_id"))).alias("m"))
    ids = F.transform("m", lambda x: x["cand_id"].cast("string"))
    return g.select("rec_id", "span", "s_ms", "e_ms", F.array_join(ids, ",").alias("ids"), F.array_join(F.slice(ids, 1, 3), "/").alias("preview"))


def last_lines(lines: DataFrame, min_chars: int = 12, window: int = 50) -> DataFrame:
    """Keep the last of repeated lines of a document (flagship; D01, D05): lines(doc_id, n, line) with key, cluster, is_last, kept.

    Repeats are lines with equal folded text at most ``window`` lines apart. Lines shorter than ``min_chars`` when folded are not compared.
    """
    key = F.lower(F.trim(F.regexp_replace("line", "[^\\p{L}\\p{N}]+", " ")))
    keyed = lines.withColumn("key", key)
    order = Window.partitionBy("doc_id", "key").orderBy("n")
    keyed = keyed.withColumn("_new", F.when(F.col("n") - F.lag("n").over(order) > window, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lead("n").over(Window.partitionBy("doc_id", "key", "cluster").orderBy("n")).isNull()
    return keyed.withColumn("is_last", last).withColumn("kept", last | (F.length("key") < min_chars)).drop("_new")


def keep_ratio(kept: DataFrame, everything: DataFrame) -> DataFrame:
    """rec_id, keep_ms, total_ms, cut_ratio in [0, 1] (A04): kept(rec_id, s_ms, e_ms) against the span of everything."""
    k = kept.groupBy("rec_id").agg(F.sum(F.col("e_ms") - F.col("s_ms")).alias("keep_ms"))
    t = everything.groupBy("rec_id").agg((F.max("e_ms") - F.min("s_ms")).alias("total_ms"))
    j = t.join(k, "rec_id", "left").select("rec_id", F.coalesce("keep_ms", F.lit(0)).alias("keep_ms"), "total_ms")
    ratio = F.when(F.col("total_ms") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("keep_ms") / F.col("total_ms")))).otherwise(0.0)
    return j.withColumn("cut_ratio", ratio)


def final_hits(hits: DataFrame, min_chars: int = 12, gap_ms: int = 30_000, low: float = 0.78) -> DataFrame:
    """Hits that stay of a sentence (D05, P04, P05): confident ones, of which those less than ``gap_ms`` apart leave the last.

    hits(rec_id, cand_id, k, t0, t1, score, length): k names the sentence, length counts its folded characters; sentences of fewer
    than ``min_chars`` keep all. Null scores are not confident.
    """
    good = clusters(score_gate(hits, low), gap_ms)
    return good.where((F.col("length") < min_chars) | F.col("is_last")).drop("cluster", "rank", "is_last")


def score_gate(hits: DataFrame, low: float = 0.78) -> DataFrame:
    """Hits of at least ``low`` (P04); null scores go."""
    return hits.where(F.col("score") >= low)


def keep_last_pipeline(takes: DataFrame, boundaries: DataFrame, window_ms: int, snap_ms: int = 200, gap_ms: int = 60, min_ms: int = 180, policy: str = "last") -> DataFrame:
    """(rec_id, s_ms, e_ms): what is kept of each recording.

    Clusters of takes leave their last one (policy last) or the best path (dp), then the takes are put in strict order, snapped to
    boundaries inside them, padded, merged over small gaps, and short pieces folded into their neighbours.
    takes(rec_id, cand_id, k, t0, t1, score, length), boundaries(rec_id, b). The cuts are ``intervals.complement`` of the result.
    """
    ranked = clusters(takes, window_ms)
    chosen = ranked.where("is_last") if policy == "last" else best_path(ranked)
    ordered = monotonic(chosen).select("rec_id", F.col("cand_id").alias("id"), F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"))
    snapped = intervals.snap_inside(ordered, boundaries, snap_ms).where("e_ms > s_ms")
    return intervals.folded(intervals.merge(intervals.pad(snapped), gap_ms).select("rec_id", "s_ms", "e_ms"), min_ms)


def sentence_review_pipeline(hits: DataFrame, boundaries: DataFrame, totals: DataFrame, gap_ms: int = 30_000, span_gap_ms: int = 1000, snap_ms: int = 200, join_ms: int = 60, min_ms: int = 180, low: float = 0.78) -> DataFrame:
    """(rec_id, s_ms, e_ms): the edit list of the sentence review.

    Final hits (D05) are merged to spans of neighbours (D08), snapped, padded, merged and folded like takes; a recording without any
    keeps its whole timeline (M16). Review points come from ``matching.review_points`` on the same hits.
    """
    spans = adjacent_spans(final_hits(hits, gap_ms=gap_ms, low=low), span_gap_ms).select("rec_id", F.col("span").alias("id"), "s_ms", "e_ms")
    snapped = intervals.snap_inside(spans, boundaries, snap_ms).where("e_ms > s_ms")
    keeps = intervals.folded(intervals.merge(intervals.pad(snapped), join_ms).select("rec_id", "s_ms", "e_ms"), min_ms)
    rest = totals.join(keeps.select("rec_id").distinct(), "rec_id", "left_anti").where("total_ms > 0")
    return keeps.unionByName(rest.select("rec_id", F.lit(0).cast("long").alias("s_ms"), F.col("total_ms").cast("long").alias("e_ms")))
