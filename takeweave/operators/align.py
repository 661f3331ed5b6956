"""Alignment of script passages to token streams by word n-grams and bounded edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.functions import nearends

# Accented letters and the plain ones they are compared as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyys"
BLOCK_WORDS = 256
#: Characters of the lines and words of the recording that one row of the backward sweep has.
SWEEP_CHARS, SWEEP_WORDS = 1 << 14, 1 << 15


def folded_words(c: Column) -> Column:
    """Words of letters and digits in lower case without accents; letters of other scripts stay."""
    return F.split(F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[^\\p{L}\\p{N}]+", " ")), " ")


def word_grams(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """(key, pos, gram) of each run of ``n`` words of ``df(key, words)``; pos counts from 0."""
    size = F.size("words")
    grams = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
    return df.select(key, F.posexplode(F.when(size >= n, grams)).alias("pos", "gram"))


def anchors(lines: DataFrame, stream: DataFrame, n: int = 3, cap: int | None = None) -> DataFrame:
    """(item_id, doc_id, start, hits): windows where a line may begin in a stream, by shared n-grams (M03, J07); all, or the best ``cap`` a pair.

    lines(item_id, words), stream(doc_id, words). A gram at offset o of the line and position p of the stream puts the window at p - o.
    """
    a = word_grams(lines, "item_id", n).withColumnRenamed("pos", "o")
    b = word_grams(stream, "doc_id", n)
    w = a.join(b, "gram").groupBy("item_id", "doc_id", F.greatest(F.col("pos") - F.col("o"), F.lit(0)).alias("start")).agg(F.count("*").alias("hits"))
    if cap is None:
        return w
    best = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(F.desc("hits"), F.desc("start")))
    return w.withColumn("_r", best).where(F.col("_r") <= cap).drop("_r")


def stream_blocks(stream: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, _b, _ws): ``stream(key, words)`` in blocks of ``BLOCK_WORDS`` words, each with ``reach`` words more."""
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / BLOCK_WORDS).cast("int"))
    return stream.select(key, "words", F.explode(places).alias("_b")).select(key, "_b", F.slice("words", F.col("_b") * BLOCK_WORDS + 1, F.lit(BLOCK_WORDS + reach)).alias("_ws"))


def windows_text(windows: DataFrame, lines: DataFrame, stream: DataFrame) -> DataFrame:
    """``windows(item_id, doc_id, start, ...)`` with a, the line's text, and b, the text of as many words of the stream.

    Streams are cut into overlapping blocks of ``BLOCK_WORDS`` words and the longest line, so that a window meets one block, not a whole document.
    """
    longest = lines.agg(F.max(F.size("words"))).first()[0] or 0
    blocks = stream_blocks(stream, "doc_id", longest)
    w = windows.withColumn("_b", F.floor(F.col("start") / BLOCK_WORDS).cast("int")).join(lines, "item_id").join(blocks, ["doc_id", "_b"])
    part = F.slice("_ws", F.col("start") - F.col("_b") * BLOCK_WORDS + 1, F.size("words"))
    return w.select(*windows.columns, F.array_join("words", " ").alias("a"), F.array_join(part, " ").alias("b"))


def match_lines(lines: DataFrame, stream: DataFrame, n: int = 3, cap: int | None = None, ratio: float = 0.35) -> DataFrame:
    """(item_id, doc_id, start, dist, hits): the window of each pair with the lowest edit distance, then the latest.

    The window is as long as the line in words; the distance in characters must not exceed ``ratio`` of the longer text. Windows
    whose length alone says more are not compared.
    """
    w = windows_text(anchors(lines, stream, n, cap), lines, stream).withColumn("longer", F.greatest(F.length("a"), F.length("b")))
    w = w.withColumn("most", F.floor(F.col("longer") * ratio).cast("int")).where(F.abs(F.length("a") - F.length("b")) <= F.col("most"))
    w = w.withColumn("dist", F.expr("levenshtein(a, b, most)")).where("dist >= 0")
    best = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("dist", F.desc("start")))
    return w.withColumn("_r", best).where("_r = 1").select("item_id", "doc_id", "start", "dist", "hits")


def weighted_distance(a: Column, b: Column, table: tuple[str, str]) -> Column:
    """Edit distance in which letters of one class cost a quarter (M07): ``table`` maps letters to the first of their class."""
    keyed = lambda c: F.translate(c, *table)
    return 0.25 * F.levenshtein(a, b) + 0.75 * F.levenshtein(keyed(a), keyed(b))


def backward_sweep(lines: DataFrame, stream: DataFrame, n: int = 3, ratio: float = 0.35) -> DataFrame:
    """(rec_id, no, start, dist): of windows stepped back from the end of the own recording, the latest that is near enough.

    lines(rec_id, no, words) are those without another match, stream(rec_id, words). Windows have max(size of the line, 2n) words and
    step by half of that; the window that ends the recording comes first.

    Lines go by ``SWEEP_CHARS`` characters, recordings by ``SWEEP_WORDS`` words: all lines of a row are read over its words together, from the end, in
    ``nearends.latest_windows``.
    """
    size = F.greatest(F.size("words"), F.lit(2 * n))
    l = lines.where("words is not null").select("rec_id", "no", size.alias("size"), F.array_join("words", " ").alias("a"))
    longest = lines.agg(F.max(F.size("words"))).first()[0] or 0
    upto = F.sum(F.length("a") + 1).over(Window.partitionBy("rec_id").orderBy("no", "a").rowsBetween(Window.unboundedPreceding, 0))
    l = l.withColumn("_c", F.floor((upto - 1) / SWEEP_CHARS)).groupBy("rec_id", "_c").agg(F.collect_list(F.struct("no", "a", "size")).alias("ls"))
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / SWEEP_WORDS).cast("int"))
    s = stream.where("words is not null").select("rec_id", "words", F.size("words").alias("have"), F.explode(places).alias("_b"))
    s = s.select("rec_id", "have", "_b", F.array_join(F.slice("words", F.col("_b") * SWEEP_WORDS + 1, F.lit(SWEEP_WORDS + max(longest, 2 * n))), nearends.GAP).alias("ws"))
    # Each row stands for many comparisons: rows are spread by number, since their bytes alone would put them into few tasks.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = l.hint("merge").join(s, "rec_id").repartition(parts, "rec_id", "_c", "_b")
    near = nearends.latest_windows(F.col("ls.a"), F.col("ls.size"), F.col("ws"), F.col("_b") * SWEEP_WORDS, SWEEP_WORDS, F.col("have"), ratio)
    w = w.select("rec_id", F.col("ls.no").alias("nos"), F.explode(near).alias("x"))
    at = lambda i: F.get("x", F.lit(i))
    w = w.select("rec_id", F.get("nos", at(0)).alias("no"), at(1).alias("start"), at(2).alias("dist"))
    return w.groupBy("rec_id", "no").agg(F.max(F.struct("start", "dist")).alias("x")).select("rec_id", "no", "x.*")


def gram_jaccard(lines: DataFrame, stream: DataFrame, n: int = 3, least: float = 0.12) -> DataFrame:
    """(item_id, doc_id, inter, jaccard): multiset Jaccard of n-grams from ``least`` on."""
    a = word_grams(lines, "item_id", n).groupBy("item_id", "gram").agg(F.count("*").alias("ca"))
    # Only n-grams that some line has are grouped; how many a text has in all is known from its words.
    b = word_grams(stream, "doc_id", n).join(a.select("gram").distinct(), "gram", "left_semi").groupBy("doc_id", "gram").agg(F.count("*").alias("cb"))
    total = lambda df, key, name: df.where(F.size("words") >= n).groupBy(key).agg(F.sum(F.size("words") - (n - 1)).alias(name))
    na, nb = total(lines, "item_id", "na"), total(stream, "doc_id", "nb")
    j = a.join(b, "gram").groupBy("item_id", "doc_id").agg(F.sum(F.least("ca", "cb")).alias("inter")).join(na, "item_id").join(nb, "doc_id")
    return j.select("item_id", "doc_id", "inter", F.round(F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")), 9).alias("jaccard")).where(F.col("jaccard") >= least)


def _met_grams(a: DataFrame, stream: DataFrame, n: int) -> DataFrame:
    """(gram): the n-grams of ``a`` that a text has; the others of the texts are dropped before anything is grouped."""
    return word_grams(stream, "doc_id", n).select("gram").join(a.select("gram").distinct(), "gram", "left_semi").distinct()


def missing_grams(lines: DataFrame, stream: DataFrame, n: int = 3) -> DataFrame:
    """(item_id, missing): how many n-grams of a line stand in no document."""
    a = word_grams(lines, "item_id", n)
    return a.join(_met_grams(a, stream, n), "gram", "left_anti").groupBy("item_id").agg(F.count("*").alias("missing"))


def top_missing_grams(lines: DataFrame, stream: DataFrame, n: int = 3, top: int = 20) -> DataFrame:
    """(gram, lines): the ``top`` n-grams that most lines have and no document, ties in the order of the gram."""
    a = word_grams(lines, "item_id", n).select("item_id", "gram").distinct()
    gone = a.join(_met_grams(a, stream, n), "gram", "left_anti").groupBy("gram").agg(F.count("*").alias("lines"))
    return gone.orderBy(F.desc("lines"), "gram").limit(top)


def whole_windows(lines: DataFrame, stream: DataFrame, percent: int = 80, short_percent: int = 75) -> DataFrame:
    """(rec_id, no, start, n_words, percent, earlier): the last window of the own recording that is near enough to each line.

    lines(rec_id, no, words), stream(rec_id, words). Every window whose number of words differs from the line's by at most a fifth (two
    words for lines of up to six) is a match where 100 * (1 - edit distance / longer text), both without spaces, is ``percent`` or more,
    ``short_percent`` for the short lines. The match that ends last is kept, among equal ends the nearest, then the longest; earlier
    counts the others. Lines without a match, and lines or streams that are null or without words, have no row.

    A match is at most k edits away, k by the line's length. Lines meet the blocks of their own recording, and ``nearends.near_windows`` tells the
    windows of at most k edits with their distance: all windows that end at one word are compared in one scan, and only where some near part ends.
    """
    clean = F.filter("words", lambda w: w != "")
    short = F.col("size") <= 6
    l = lines.select("rec_id", "no", clean.alias("w")).where("size(w) > 0").select("rec_id", "no", F.size("w").alias("size"), F.array_join("w", "").alias("a"))
    slack = F.when(short, 2).otherwise(F.greatest(F.lit(1), F.round(F.col("size") * 0.2).cast("int")))
    l = l.withColumn("slack", slack).withColumn("need", F.when(short, min(percent, short_percent)).otherwise(percent))
    l = l.withColumn("k", F.floor(F.length("a") * (100 - F.col("need")) / F.col("need")).cast("int"))
    longest = l.agg(F.max(F.col("size") + F.col("slack"))).first()[0] or 0

    s = stream.select("rec_id", clean.alias("words")).where("size(words) > 0")
    places = F.sequence(F.lit(0), F.floor((F.col("have") - 1) / BLOCK_WORDS).cast("int"))
    w = l.hint("merge").join(s.select("rec_id", F.size("words").alias("have")), "rec_id").withColumn("_b", F.explode(places)).drop("have")
    # Each row stands for many comparisons: rows are spread by number, since their bytes alone would put them into few tasks.
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = w.repartition(parts, "rec_id", "_b").hint("merge").join(stream_blocks(s, "rec_id", longest).repartition(parts, "rec_id", "_b"), ["rec_id", "_b"])
    near = nearends.near_windows(F.col("a"), F.array_join("_ws", nearends.GAP), F.lit(BLOCK_WORDS), F.col("k"))
    w = w.select("rec_id", "no", "_b", "size", "slack", "need", F.length("a").alias("la"), F.explode(near).alias("x"))
    at = lambda i: F.get("x", F.lit(i))
    w = w.select("rec_id", "no", "size", "slack", "need", (F.col("_b") * BLOCK_WORDS + at(0)).alias("start"), at(1).alias("n_words"), F.greatest("la", at(2)).alias("longer"), at(3).alias("d"))
    longer = F.col("longer")
    w = w.where((F.abs(F.col("n_words") - F.col("size")) <= F.col("slack")) & (F.col("d") <= F.floor((100 - F.col("need")) * longer / 100)))
    w = w.select("rec_id", "no", "start", "n_words", F.floor(100 * (longer - F.col("d")) / longer).cast("int").alias("percent"), F.struct(F.col("start") + F.col("n_words"), (-F.col("d") / longer), F.col("n_words")).alias("rank"))
    g = w.groupBy("rec_id", "no").agg(F.max(F.struct("rank", "start", "n_words", "percent")).alias("x"), (F.count("*") - 1).alias("earlier"))
    return g.select("rec_id", "no", "x.start", "x.n_words", "x.percent", "earlier")
