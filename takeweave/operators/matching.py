"""Lines found in a word stream, exactly or in part, with places, times and review points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.operators.align import match_lines, word_grams
from takeweave.operators.records import occurrences
from takeweave.session import written


def token_stream(words: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """words(rec_id, idx, text) with token, lo, hi, alias_hit (M01): lower case, whole-token aliases, character offsets in the joined stream."""
    canon = {v: k for k, vs in aliases.items() for v in vs}
    token = F.lower("text")
    named = F.create_map(*[F.lit(x) for kv in canon.items() for x in kv])[token] if canon else F.lit(None).cast("string")
    t = words.select("rec_id", "idx", F.coalesce(named, token).alias("token"), named.isNotNull().alias("alias_hit"))
    hi = F.sum(F.length("token")).over(Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return t.select("rec_id", "idx", "token", (hi - F.length("token")).alias("lo"), hi.alias("hi"), "alias_hit")


def alias_hits(docs: DataFrame, key: str, aliases: dict[str, list[str]]) -> DataFrame:
    """(key, canonical, variant, n) of variants found in ``docs(key, words)`` (J13): an equi-join on runs of as many words as a variant has, all sizes in one pass."""
    pairs = [(canonical, " ".join(v.split()), len(v.split())) for canonical, variants in aliases.items() for v in variants]
    table = docs.sparkSession.createDataFrame(pairs, "canonical string, variant string, size int")
    size = F.size("words")

    def runs(n: int, known: list[str]) -> Column:
        """Runs of ``n`` words that are variants: the others are dropped before they become rows."""
        at = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
        at = F.filter(F.col("words") if n == 1 else at, lambda x: x.isin(known))
        return F.when(size >= n, F.transform(at, lambda x: F.struct(x.alias("variant"), F.lit(n).alias("size")))).otherwise(F.expr("cast(array() as array<struct<variant:string,size:int>>)"))

    found = F.concat(*[runs(n, [v for _, v, k in pairs if k == n]) for n in sorted({k for _, _, k in pairs})])
    one = docs.select(key, F.explode(found).alias("x")).groupBy(key, "x.variant", "x.size").agg(F.count("*").alias("n"))
    return one.join(table, ["variant", "size"]).groupBy(key, "canonical", "variant").agg(F.sum("n").alias("n"))


def fast_candidates(lines: DataFrame, stream: DataFrame, most: int = 5, least: int = 3, limit: int | None = None) -> DataFrame:
    """(item_id, doc_id, start, k, hits): windows by the longest word runs, ``most`` down to ``least``, that meet at all.

    lines(item_id, words), stream(doc_id, words). With ``limit``, only so many windows of a line and stream stay, by hits, then place.
    """
    # Rows are told apart by a number, so that runs of two texts with one key don't join. A run of k words is k - least + 1 shorter ones in a row on one diagonal.
    a = word_grams(lines.withColumn("_l", F.monotonically_increasing_id()).select(F.struct("item_id", "_l").alias("l"), "words"), "l", least).withColumnRenamed("pos", "o")
    b = word_grams(stream.withColumn("_s", F.monotonically_increasing_id()).select(F.struct("doc_id", "_s").alias("s"), "words"), "s", least)
    met = a.join(b, "gram").select("l", "s", "o", "pos", (F.col("pos") - F.col("o")).alias("d"))
    run = Window.partitionBy("l", "s", "d").orderBy("o")
    longer = [F.when(F.lead("o", k - least).over(run) == F.col("o") + k - least, F.lit(k)) for k in range(least + 1, most + 1)]
    met = met.withColumn("_ks", F.array_compact(F.array(F.lit(least), *longer))).withColumn("k", F.explode("_ks"))
    hits = met.groupBy(F.col("l.item_id").alias("item_id"), F.col("s.doc_id").alias("doc_id"), "k", F.greatest("d", F.lit(0)).alias("start")).agg(F.count("*").alias("hits"))
    own = Window.partitionBy("item_id", "doc_id")
    w = hits.withColumn("_top", F.max("k").over(own)).where("k = _top")
    w = w.select("item_id", "doc_id", "start", "k", "hits")
    return w if limit is None else w.withColumn("_r", F.row_number().over(own.orderBy(F.desc("hits"), "start"))).where(F.col("_r") <= limit).drop("_r")


def partial_matches(lines: DataFrame, stream: DataFrame, n: int = 3, percent: int = 50) -> DataFrame:
    """(item_id, doc_id, start, n_words, score): the longest common run of words of a line over all streams.

    Word runs meet on n-grams; neighbours on one diagonal join to runs. Ties take the least (doc_id, start). Runs under
    ``percent`` of the line's words and lines of fewer than ``n`` words have no row.
    """
    a, b = word_grams(lines, "item_id", n).withColumnRenamed("pos", "o"), word_grams(stream, "doc_id", n)
    met = a.join(b, "gram").select("item_id", "doc_id", "o", "pos", (F.col("pos") - F.col("o")).alias("d"))
    island = F.col("o") - F.row_number().over(Window.partitionBy("item_id", "doc_id", "d").orderBy("o"))
    runs = met.withColumn("_i", island).groupBy("item_id", "doc_id", "d", "_i").agg((F.count("*") + n - 1).alias("run"), F.min("pos").alias("start"))
    best = runs.groupBy("item_id").agg(F.min(F.struct((-F.col("run")).alias("m"), "doc_id", "start")).alias("b"))
    j = best.join(lines.select("item_id", F.size("words").alias("size")), "item_id").where(-100 * F.col("b.m") >= percent * F.col("size"))
    return j.select("item_id", "b.doc_id", F.col("b.start").cast("long").alias("start"), (-F.col("b.m")).alias("n_words"), F.round(-F.col("b.m") / F.col("size"), 9).alias("score"))


def sentence_hits(lines: DataFrame, stream: DataFrame, n: int = 3, percent: int = 50) -> DataFrame:
    """(item_id, doc_id, start, n_words, score, kind): every exact place of a line (strict), else its best part (fuzzy)."""
    exact = occurrences(lines, stream, n).join(lines.select("item_id", F.size("words").cast("long").alias("n_words")), "item_id")
    exact = exact.select("item_id", "doc_id", "start", "n_words", F.lit(1.0).alias("score"), F.lit("strict").alias("kind"))
    rest = lines.join(exact.select("item_id").distinct(), "item_id", "left_anti")
    return exact.unionByName(partial_matches(rest, stream, n, percent).withColumn("kind", F.lit("fuzzy")))


def review_stats(lines: DataFrame, hits: DataFrame, low: float = 0.8) -> DataFrame:
    """One row: lines, matched, low_conf, unmatched, strict, fuzzy, spans, longest."""
    per = hits.groupBy("item_id").agg(F.max("score").alias("score"), F.min("kind").alias("kind"), F.count("*").alias("spans"), F.max("n_words").alias("longest"))
    j = lines.select("item_id").join(per, "item_id", "left")
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return j.agg(
        F.count("*").alias("lines"), one(F.col("score") >= low).alias("matched"), one(F.col("score") < low).alias("low_conf"), F.count_if(F.col("score").isNull()).alias("unmatched"),
        one(F.col("kind") == "strict").alias("strict"), one(F.col("kind") == "fuzzy").alias("fuzzy"), F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
    )


def hit_times(hits: DataFrame, words: DataFrame) -> DataFrame:
    """hits(rec_id, id, start, n_words) with s_ms, e_ms of their first and last word; a hit past the last word ends there."""
    last = F.max("idx").over(Window.partitionBy("rec_id"))
    w = words.select("rec_id", "idx", "start_ms", "end_ms", last.alias("_last"))
    s = hits.join(w.select("rec_id", F.col("idx").alias("start"), F.col("start_ms").alias("s_ms"), "_last"), ["rec_id", "start"])
    s = s.withColumn("idx", F.least(F.col("start") + F.col("n_words") - 1, "_last"))
    return s.join(w.select("rec_id", "idx", F.col("end_ms").alias("e_ms")), ["rec_id", "idx"]).select("rec_id", "id", "s_ms", "e_ms")


def relaxed_matches(lines: DataFrame, stream: DataFrame, ladder: tuple[tuple[int, float], ...] = ((5, 0.35), (4, 0.46), (3, 0.55))) -> DataFrame:
    """match_lines with ``stage``: each step of (n, ratio) tries the lines that no earlier one found."""
    found, rest = None, lines
    for stage, (n, ratio) in enumerate(ladder, 1):
        m = written(match_lines(rest, stream, n=n, ratio=ratio).withColumn("stage", F.lit(stage)), "relaxed-matches")  # read twice: as the result and by the next step
        found = m if found is None else found.unionByName(m)
        rest = rest.join(m.select("item_id").distinct(), "item_id", "left_anti")
    return found


def greedy_order(candidates: DataFrame, expand: int = 0) -> DataFrame:
    """(rec_id, line, s, e): each line, in order, takes its first candidate at or after the end of the one before.

    candidates(rec_id, line, s, e). Lines without such a candidate have no row; ``expand`` widens a chosen span on both sides,
    the start not before the previous end. An ordered fold over one recording's candidates.
    """
    xs = candidates.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("line", "s", "e"))).alias("xs"))
    zero = F.expr("named_struct('line', cast(null as bigint), 'end', cast(0 as bigint), 'out', cast(array() as array<struct<line:bigint,s:bigint,e:bigint>>))")

    def step(acc: Column, x: Column) -> Column:
        row = F.struct(x["line"].alias("line"), F.greatest(x["s"] - expand, acc["end"]).alias("s"), (x["e"] + expand).alias("e"))
        skip = F.coalesce(x["line"] == acc["line"], F.lit(False)) | (x["s"] < acc["end"])
        return F.when(skip, acc).otherwise(F.struct(x["line"].alias("line"), (x["e"] + expand).alias("end"), F.concat(acc["out"], F.array(row)).alias("out")))

    return xs.select("rec_id", F.explode(F.aggregate("xs", zero, step)["out"]).alias("x")).select("rec_id", "x.*")


def review_points(lines: DataFrame, low: float = 0.5) -> DataFrame:
    """(rec_id, no, at_ms, reason): no_match at the end of the hits before, low_conf at the hit's own time.

    lines(rec_id, no, t0, t1, score), in the order of no; t0 is null where nothing was found. Confident hits give no row.
    """
    carried = F.coalesce(F.max("t1").over(Window.partitionBy("rec_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    reason = F.when(F.col("t0").isNull(), "no_match").when(F.col("score") < low, "low_conf")
    return lines.select("rec_id", "no", F.coalesce("t0", carried).alias("at_ms"), reason.alias("reason")).where("reason is not null")


def sentence_markers(lines: DataFrame, low: float = 0.5, chars: int = 64) -> DataFrame:
    """(rec_id, name, at_ms, comment): L rows of the hits, R rows of the review points, texts cut to ``chars``."""
    texts = lines.select("rec_id", "no", F.substring("text", 1, chars).alias("text"))
    hit = lines.where("t0 is not null").select("rec_id", F.concat(F.lit("L"), "no").alias("name"), F.col("t0").alias("at_ms"), F.substring("text", 1, chars).alias("comment"))
    tag = F.when(F.col("reason") == "low_conf", "[review-low] ").otherwise("[review] ")
    review = review_points(lines, low).join(texts, ["rec_id", "no"]).select("rec_id", F.concat(F.lit("R"), "no").alias("name"), "at_ms", F.concat(tag, "text").alias("comment"))
    return hit.unionByName(review)


def sentence_edit_list(lines: DataFrame, totals: DataFrame, low: float = 0.5) -> DataFrame:
    """(rec_id, s_ms, e_ms): confident hits as keeps; a recording without any keeps its whole timeline."""
    keep = lines.where(F.col("t0").isNotNull() & (F.col("score") >= low)).select("rec_id", F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"))
    rest = totals.join(keep.select("rec_id").distinct(), "rec_id", "left_anti").select("rec_id", F.lit(0).cast("long").alias("s_ms"), F.col("total_ms").alias("e_ms"))
    return keep.unionByName(rest)


def tokens_of_spans(spans: DataFrame, tokens: DataFrame, cell: int = 256) -> DataFrame:
    """(rec_id, id, first_idx, last_idx): the tokens that character spans touch.

    spans(rec_id, id, lo, hi), tokens(rec_id, idx, lo, hi), ends exclusive. Both meet in cells of ``cell`` characters, so no recording
    is compared as a whole. Empty spans and spans outside the text have no row.
    """
    cells = lambda df: F.explode(F.sequence(F.floor(df["lo"] / cell), F.floor((df["hi"] - 1) / cell)))
    s = spans.where("hi > lo").select("rec_id", "id", "lo", "hi", cells(spans).alias("cell"))
    t = tokens.where("hi > lo").select("rec_id", "idx", F.col("lo").alias("tlo"), F.col("hi").alias("thi"), cells(tokens).alias("cell"))
    met = s.join(t, ["rec_id", "cell"]).where("tlo < hi and thi > lo")
    return met.groupBy("rec_id", "id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
