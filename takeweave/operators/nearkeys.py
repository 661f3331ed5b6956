"""Keys of lines that near-equal lines share (D01): the first-seen key within an edit distance, found without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeweave.session import discard, written


BLOCK = 128
#: Recordings of up to so many keys and characters in them compare all keys.
FEW, SHORT = 512, 50_000


def initials(c: Column, table: tuple[str, str]) -> Column:
    """A key of mapped first letters: ``table`` maps characters to the letter that stands for them, others stay; white space goes."""
    return F.translate(F.regexp_replace(F.lower(c), "\\s+", ""), *table)


def _edits(length: Column, percent: int) -> Column:
    """Most edits between a key and one at least as long that is near enough."""
    return F.floor(percent * length / (100 - percent)).cast("int")


def _piece(length: Column, percent: int) -> Column:
    """Length of the pieces that a key is cut into: short enough for one more than there may be edits, and by preference one less."""
    q = F.floor(length / (_edits(length, percent) + 1)).cast("int")
    return F.when(q >= 3, q - 1).otherwise(q)


def _place() -> Column:
    return F.struct(F.col("n"), F.xxhash64("key").alias("d"))


def near_pairs(keys: DataFrame, percent: int = 15) -> DataFrame:
    """(rec_id, e, l): pairs of keys of a recording whose edit distance is at most ``percent`` of the longer one; e is seen before l.

    keys(rec_id, n, key) has each key of a recording once, n its first place; e and l are (n, digest of the key), so that long keys
    don't travel with each of their pieces. Keys of recordings of up to ``FEW`` keys and ``SHORT`` characters meet each other
    inside the join, which writes no pair but the near ones and costs each key a bounded number of comparisons; those of larger recordings
    meet by their pieces.
    """
    held = keys.groupBy("rec_id").agg(F.count("*").alias("held"), F.sum(F.length("key")).alias("chars")).where("held > 1")
    counted = keys.join(held.hint("merge"), "rec_id")
    few = (F.col("held") <= FEW) & (F.col("chars") <= SHORT)
    met = _met_by_length(counted.where(few).drop("held", "chars"), percent)
    return met.unionByName(_met_by_pieces(counted.where(~few).drop("held", "chars"), percent))


def _near(percent: int) -> Column:
    return F.expr(f"levenshtein(ke, kl, cast(floor({percent} * greatest(length(ke), length(kl)) / 100) as int)) >= 0")


def _met_by_length(keys: DataFrame, percent: int) -> DataFrame:
    a = keys.select("rec_id", _place().alias("e"), F.col("key").alias("ke"), F.length("key").alias("le"))
    b = keys.select(F.col("rec_id").alias("r"), _place().alias("l"), F.col("key").alias("kl"), F.length("key").alias("ll"))
    alike = (100 - percent) * F.greatest("le", "ll") <= 100 * F.least("le", "ll")
    return a.hint("merge").join(b, (F.col("rec_id") == F.col("r")) & (F.col("e") < F.col("l")) & alike & _near(percent)).select("rec_id", "e", "l")


def _met_by_pieces(keys: DataFrame, percent: int) -> DataFrame:
    """A key of length m that is at most k edits away from a longer one leaves at least one of any k + 1 of its pieces whole, at most k
    characters off its place. So each key posts the k + 1 pieces that are rarest in its recording, and only keys that hold one there
    are compared. Pieces travel as digests; they outnumber the keys by far, which size estimates don't see, so no join may broadcast them.
    """
    at = keys.select("rec_id", _place().alias("x"), "key", F.length("key").alias("len"))
    q, k = _piece(F.col("len"), percent), _edits(F.col("len"), percent)
    pieces = at.withColumn("q", q).withColumn("k", k)
    digest = lambda gram: F.xxhash64("rec_id", "q", gram)
    cut = F.regexp_extract_all("key", F.concat(F.lit("(?s).{"), F.col("q").cast("string"), F.lit("}")), F.lit(0))
    pieces = pieces.select("rec_id", "x", "len", "q", "k", F.posexplode(cut).alias("i", "gram")).select("rec_id", "x", "len", "k", (F.col("i") * F.col("q")).alias("o"), digest(F.col("gram")).alias("h"))
    shorter = F.sequence(F.ceil(F.col("len") * (100 - percent) / 100).cast("int"), F.col("len"))
    sizes = F.array_distinct(F.transform(shorter, lambda n: _piece(n, percent)))
    probes = at.select("rec_id", "x", "key", "len", F.explode(sizes).alias("q")).where("q > 0 and q <= len")
    # Places of a string are counted from its start: long keys are cut to overlapping blocks first.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("len") - F.col("q")) / BLOCK).cast("int")), lambda b: F.struct((b * BLOCK).alias("at"), F.substring("key", b * BLOCK + 1, F.lit(BLOCK - 1) + F.col("q")).alias("t")))
    probes = probes.select("rec_id", "x", "len", "q", F.explode(blocks).alias("b"))
    grams = F.transform(F.sequence(F.lit(0), F.length("b.t") - F.col("q")), lambda p: F.struct((F.col("b.at") + p).alias("p"), F.substring(F.col("b.t"), p + 1, F.col("q")).alias("gram")))
    probes = probes.select("rec_id", F.col("x").alias("y"), F.col("len").alias("len2"), "q", F.explode(grams).alias("g")).select("y", "len2", "g.p", digest(F.col("g.gram")).alias("h"))
    often = probes.groupBy("h").agg(F.count("*").alias("df"))
    rare = pieces.join(often.hint("merge"), "h").groupBy("rec_id", "x", "len", "k").agg(F.sort_array(F.collect_list(F.struct("df", "o", "h"))).alias("ps"))
    posted = rare.select("rec_id", "x", "len", "k", F.explode(F.slice("ps", F.lit(1), F.col("k") + 1)).alias("p1")).where("p1.df > 1").select("rec_id", "x", "len", "k", "p1.o", "p1.h")
    met = posted.hint("merge").join(probes, "h").where((F.abs(F.col("p") - F.col("o")) <= F.col("k")) & (F.col("len2") >= F.col("len")) & ((100 - percent) * F.col("len2") <= 100 * F.col("len")) & (F.col("x") != F.col("y")))
    pairs = met.select("rec_id", F.least("x", "y").alias("e"), F.greatest("x", "y").alias("l")).distinct()
    text = keys.select("rec_id", _place().alias("x"), "key")
    full = pairs.hint("merge").join(text.toDF("rec_id", "e", "ke"), ["rec_id", "e"]).hint("merge").join(text.toDF("rec_id", "l", "kl"), ["rec_id", "l"])
    return full.where(_near(percent)).select("rec_id", "e", "l")


def leaders(pairs: DataFrame) -> DataFrame:
    """(rec_id, l, e): for each key that follows another, the first key it follows.

    pairs(rec_id, e, l) as :func:`near_pairs` gives them. In the order of their first places, a key follows the first key near it that follows
    none itself, one hop only; a key with none near is one to follow. All keys whose earlier neighbours are settled are settled in one round, so
    rounds are as many as the longest row of keys that wait for each other.
    """
    pairs = left = written(pairs, "near-pairs")
    followers = None
    while not left.isEmpty():
        heads = left.select("rec_id", F.col("e").alias("x")).hint("merge").join(left.select("rec_id", F.col("l").alias("x")), ["rec_id", "x"], "left_anti").distinct()
        new = written(left.hint("merge").join(heads.withColumnRenamed("x", "e"), ["rec_id", "e"]).select("rec_id", F.col("l").alias("x")).distinct(), "followers")
        rest = left.hint("merge").join(heads.withColumnRenamed("x", "e"), ["rec_id", "e"], "left_anti")
        rest = rest.hint("merge").join(new.withColumnRenamed("x", "l"), ["rec_id", "l"], "left_anti").hint("merge").join(new.withColumnRenamed("x", "e"), ["rec_id", "e"], "left_anti")
        old, left = left, written(rest.select("rec_id", "e", "l"), "near-left")
        if old is not pairs:
            discard(old)
        followers = new if followers is None else followers.union(new)
    if followers is None:
        return pairs.select("rec_id", "l", "e")
    followed = pairs.hint("merge").join(followers.withColumnRenamed("x", "e"), ["rec_id", "e"], "left_anti")
    return followed.groupBy("rec_id", "l").agg(F.min("e").alias("e"))


def line_keys(lines: DataFrame, percent: int = 15) -> DataFrame:
    """(rec_id, n, key, line_key, first): the key of each line, that of the first line near enough, and where it was first seen.

    lines(rec_id, n, key): keys are folded texts, or :func:`initials`; a null or empty key counts as "_". Near enough is an edit distance of at most
    ``percent`` (below 50) of the longer key. Equal keys share one whatever their number; keys first seen at an equal n stand in the order of a digest. Lines
    with a null rec_id are left out.
    """
    if not 0 <= percent < 50:
        raise ValueError("percent lies from 0 to 49")
    key = F.when(F.coalesce("key", F.lit("")) == "", "_").otherwise(F.col("key"))
    lines = lines.select("rec_id", F.col("n").cast("long").alias("n"), key.alias("key"))
    keys = lines.groupBy("rec_id", "key").agg(F.min("n").alias("n")).select("rec_id", "n", "key")
    # A key stands for many pieces: keys are spread by number, since their bytes alone would put them into few tasks.
    keys = written(keys.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec_id", "key"), "line-keys")
    to = leaders(near_pairs(keys, percent)).toDF("rec_id", "x", "e")
    heads = keys.select("rec_id", _place().alias("e"), F.col("key").alias("line_key"))
    named = keys.select("rec_id", "key", _place().alias("x")).hint("merge").join(to, ["rec_id", "x"], "left").withColumn("e", F.coalesce("e", "x")).hint("merge").join(heads, ["rec_id", "e"])
    named = named.select("rec_id", "key", "line_key", F.col("e.n").alias("first"))
    return lines.hint("merge").join(named, ["rec_id", "key"]).select("rec_id", "n", "key", "line_key", "first")
