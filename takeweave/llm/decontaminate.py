"""Benchmark decontamination with windows of item size, counted exactly.

A document is read in windows as long as a benchmark item. Only positions whose shingle some item holds (hits) are kept; from them
the shared shingles of every window of a document and item are counted as multisets: a hit counts for the starts from which the
window reaches it and does not yet hold as many of its shingle as the item, which is one interval of starts, so the windows that
cover most intervals are the best ones, whatever the order of the passages. Compared are a document and the items of which it has
one of the rarest shingles, as many as a window may miss and one more; a window without any of them is below ``SIMILARITY``.
(Weights by rarity among the items would lower the score of items that the benchmark holds twice.)

The best window and the item are fingerprinted by a 64-bit SimHash of their words. ``hamming`` tells how far apart the two are; it
decides nothing: pairs of similarity 0.75 differ in up to 22 of 64 bits and more, and blocks that guarantee such a radius are two or
three bits wide, so an index over them would return nearly every item for every window.

Items of equal words are searched as one and reported each. Null texts and items without words match nothing. Items shorter than five
words match as a whole sequence. Rows with equal or null doc_id are searched one by one. Very long texts are searched whole. Columns
of the input beside the id and text are not read. An empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.llm.textcols import SHINGLE, hashes, shingle_hashes, word_array
from takeweave.session import written

SIMILARITY = 0.75
#: Shingles of one benchmark block that is broadcast to the executors (about 100 bytes each); a larger benchmark is searched block by block.
BLOCK_SHINGLES = 200_000
#: Shingles remembered on either side of an item's shingle; where others stand there, a hit keeps more words than it must.
NEIGHBOURS = 8
#: Hits are compared in cells of so many positions, so that a long document with many items does not meet each of them as a whole.
CELL = 256


def simhash(word_hashes: Column) -> Column:
    """64 bits: bit b is set when more than half of the hashes have it set."""
    votes = lambda b: F.aggregate(word_hashes, F.lit(0), lambda s, h: s + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.when(votes(b) * 2 > F.size(word_hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc))


def _lower_words(text: Column) -> Column:
    return word_array(F.lower(text))


def items_table(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_i, n, size, fingerprint, grams) of each item text with words, where n counts words and size shingles, and (_i, item_id) of all items."""
    t = benchmark.select(benchmark["item_id"].alias("item_id"), F.monotonically_increasing_id().alias("_i"), hashes(_lower_words(benchmark["text"].cast("string"))).alias("ih"))
    t = t.withColumn("n", F.size("ih")).where("n > 0").withColumn("same", F.sha2(F.array_join(F.transform("ih", lambda x: x.cast("string")), " "), 256))
    every = written(t, "items-all")
    classes = every.groupBy("same").agg(F.min_by(F.struct("_i", "n", "ih"), "_i").alias("x")).select("same", "x.*")
    short = F.when(F.col("n") < SHINGLE, F.array(F.xxhash64(F.lit(0), F.col("n"), F.array_join(F.transform("ih", lambda x: x.cast("string")), " "))))
    classes = classes.withColumn("fingerprint", simhash(F.col("ih"))).withColumn("grams", F.coalesce(short, shingle_hashes(F.col("ih"), F.col("n"))))
    classes = written(classes.select("same", "_i", "n", F.size("grams").alias("size"), "fingerprint", "grams"), "items")
    members = every.select("same", "item_id").join(classes.select("same", "_i"), "same").select("_i", "item_id")
    return classes.drop("same"), members


def _missing(size: Column, similarity: float) -> Column:
    """Shingles of an item of ``size`` that a window of at least ``similarity`` may lack."""
    return size - F.ceil(size * F.lit(similarity) - F.lit(1e-9))


def _places(items: DataFrame, weights: DataFrame, similarity: float) -> DataFrame:
    """Of each shingle of the items: those before and after it (a few), and the items (_i, size) that it has to find."""
    grams = items.select("_i", F.posexplode("grams").alias("q", "g"), "grams").select("g", F.when(F.col("q") > 0, F.get("grams", F.col("q") - 1)).alias("prev"), F.get("grams", F.col("q") + 1).alias("next"))
    around = grams.select("g").distinct()
    for side in ("prev", "next"):
        few = grams.where(F.col(side).isNotNull()).select("g", side).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("g").orderBy(side))).where(F.col("_k") <= NEIGHBOURS)
        around = around.join(few.groupBy("g").agg(F.collect_list(side).alias(f"{side}s")), "g", "left")
    rarest = Window.partitionBy("_i").orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)
    first = weights.join(weights.groupBy("g").agg(F.count("*").alias("df")), "g").withColumn("before", F.coalesce(F.sum("c").over(rarest), F.lit(0)))
    first = first.where(F.col("before") <= _missing(F.col("size"), similarity)).groupBy("g").agg(F.collect_list(F.struct("_i", "size")).alias("finds"))
    return around.join(first, "g", "left")


def _short_run(n: int):
    """Hash of the ``n`` words from a position, as that of a whole item of ``n`` words."""
    return lambda i: F.xxhash64(F.lit(0), F.lit(n), F.array_join(F.transform(F.slice("h", i + 1, n), lambda x: x.cast("string")), " "))


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each document row and item.

    ``start_word`` counts from 0; ties take the earliest window.
    """
    items, members = items_table(benchmark)
    weights = written(items.select("_i", "n", "size", F.explode("grams").alias("g")).groupBy("_i", "n", "size", "g").agg(F.count("*").alias("c")), "weights")
    places = written(_places(items, weights, similarity), "places")
    blocks = max(1, -(-places.count() // BLOCK_SHINGLES))
    longest = items.agg(F.max("size")).first()[0] or 0
    reach = int(longest * (1 - similarity) / (1 + similarity)) + 1  # more positions in a row are no hits in no window that counts

    text = docs.select(docs[id_column].alias("doc_id"), F.monotonically_increasing_id().alias("_r"), _lower_words(docs["text"].cast("string")).alias("w"))
    text = text.withColumn("n_doc", F.size("w")).withColumn("h", hashes(F.col("w"))).drop("w")
    short = [r[0] for r in items.where(F.col("n") < SHINGLE).select("n").distinct().collect()]  # at most four sizes
    own = shingle_hashes(F.col("h"), F.col("n_doc"))
    for n in sorted(short):
        own = F.concat(own, F.when(F.col("n_doc") < n, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("n_doc") - n), _short_run(n))))
    text = text.withColumn("dg", own)
    # One narrow stage: explode, probe the broadcast shingles, and keep the hits; the arrays are never copied for rows that do not match.
    # (The outer form keeps the optimizer from filtering on the array's size below, where it would be computed again.)
    pos = text.select("doc_id", "_r", "n_doc", "h", "dg", F.posexplode_outer("dg").alias("p", "g"))
    whole = F.greatest(F.col("n_doc") - (SHINGLE - 1), F.lit(0))
    place = F.col("p") if not short else F.when(F.col("p") < whole, F.col("p"))
    if short:
        lo = whole
        for n in sorted(short):
            place = F.coalesce(place, F.when(F.col("p") < lo + F.greatest(F.col("n_doc") - n + 1, F.lit(0)), F.col("p") - lo))
            lo = lo + F.greatest(F.col("n_doc") - n + 1, F.lit(0))
    # A hit keeps its own word, and at the ends of a run also those that a gap within a window can hold.
    after = F.coalesce((F.col("p") + 1 < whole) & F.array_contains("nexts", F.get("dg", F.col("p") + 1)), F.lit(False))
    before = F.coalesce((F.col("p") < whole) & (F.col("p") > 0) & F.array_contains("prevs", F.get("dg", F.col("p") - 1)), F.lit(False))
    lead, trail = F.when(before, 0).otherwise(reach), F.when(after, 0).otherwise(reach + SHINGLE - 1)
    found = None
    for b in range(blocks):  # each block is a job of its own, so that the executors hold one block at a time
        part = places if blocks == 1 else places.where(F.pmod(F.xxhash64("g", F.lit(1)), F.lit(blocks)) == b)
        hit = pos.join(F.broadcast(part), "g").select("doc_id", "_r", "n_doc", "h", "g", "finds", place.alias("p"), lead.alias("lead"), trail.alias("trail"))
        hit = hit.withColumn("first", F.greatest(F.col("p") - F.col("lead"), F.lit(0)))
        hit = hit.select("doc_id", "_r", "n_doc", "p", "g", "finds", "first", F.slice("h", F.col("first") + 1, F.col("p") + F.col("trail") - F.col("first") + 1).alias("words"))
        hit = written(hit.withColumn("cell", F.floor(F.col("p") / CELL)), "hits")
        found = hit if found is None else found.union(hit)
    hits = found
    best = _best(hits, weights, similarity)

    inside = (F.col("p") >= F.col("start")) & (F.col("p") < F.col("start") + F.col("n_words"))
    near = best.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("n_words") - 1) / CELL)))).join(hits.select("_r", "cell", "doc_id", "p", "first", "words"), ["_r", "cell"]).where(inside)
    words = near.select("doc_id", "_r", "_i", "start", "n_words", "similarity", "first", F.posexplode("words").alias("j", "w")).withColumn("j", F.col("first") + F.col("j"))
    words = words.where((F.col("j") >= F.col("start")) & (F.col("j") < F.col("start") + F.col("n_words")))
    whole = words.groupBy("doc_id", "_r", "_i", "start", "n_words", "similarity").agg(F.collect_set(F.struct("j", "w")).alias("ws")).withColumn("wf", simhash(F.col("ws.w")))
    pairs = whole.join(items.select("_i", "fingerprint"), "_i").join(members, "_i").withColumn("hamming", F.bit_count(F.col("wf").bitwiseXOR(F.col("fingerprint"))))
    return pairs.select("doc_id", "item_id", F.col("start").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), F.col("hamming").cast("int").alias("hamming"), "similarity", "_r")


def _best(hits: DataFrame, weights: DataFrame, similarity: float) -> DataFrame:
    """(_r, _i, start, n_words, similarity): the best window of each document row and item among those of ``similarity`` or more."""
    found = hits.select("_r", "p", F.explode("finds").alias("f")).select("_r", "f._i", "p", "f.size")
    cells = F.sequence(F.floor(F.greatest(F.col("p") - F.col("size") + 1, F.lit(0)) / CELL), F.floor((F.col("p") + F.col("size") - 1) / CELL))
    near = found.select("_r", "_i", F.explode(cells).alias("cell")).distinct()
    # From here all is by document row and item: one exchange.
    x = near.join(hits.select("_r", "cell", "n_doc", "p", "g"), ["_r", "cell"]).join(weights, ["_i", "g"]).repartition("_r", "_i")
    pair = ["_r", "_i", "n", "size", "n_doc"]
    x = x.groupBy(*pair, "g", "c").agg(F.sort_array(F.collect_list(F.col("p").cast("int"))).alias("ps"))
    full = lambda p, j: F.struct(p.alias("p"), F.when(j >= F.col("c"), F.get("ps", j - F.col("c").cast("int"))).alias("full"))
    x = x.select(*pair, F.explode(F.transform("ps", full)).alias("x")).select(*pair, "x.*")
    last = F.greatest(F.col("n_doc") - F.col("n"), F.lit(0))
    lo = F.greatest(F.col("full") + 1, F.col("p") - F.col("size") + 1, F.lit(0))  # greatest() skips nulls
    x = x.withColumn("lo", lo).withColumn("hi", F.least(F.col("p"), last)).where("lo <= hi")
    ends = F.array(F.struct(F.col("lo").alias("s"), F.lit(1).alias("v")), F.struct((F.col("hi") + 1).alias("s"), F.lit(-1).alias("v")))
    x = x.select(*pair, F.explode(ends).alias("e")).groupBy(*pair, "e.s").agg(F.sum("e.v").alias("v"))
    both = F.sum("v").over(Window.partitionBy("_r", "_i").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(F.col("n_doc") < F.col("n"), F.col("n_doc") - SHINGLE + 1).otherwise(F.col("size"))
    x = x.withColumn("both", both).withColumn("similarity", F.col("both") / (F.col("size") + held - F.col("both")).cast("double")).where(F.col("similarity") >= similarity)
    best = x.groupBy("_r", "_i", "n", "n_doc").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"))).alias("m"))
    return written(best.select("_r", "_i", (-F.col("m.s")).alias("start"), F.least("n", "n_doc").alias("n_words"), F.col("m.similarity").alias("similarity")), "best-windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The result of :func:`matches` without the internal row number."""
    return matches(docs, benchmark, similarity=similarity).drop("_r")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; all columns stay as they were.

    A row goes by its own text, whatever its doc_id: rows that share a doc_id, null too, are told apart, rows of equal text are not.
    """
    key = F.sha2(docs["text"].cast("string"), 256)
    bad = matches(docs.select(key.alias("_key"), docs["text"].alias("text")), benchmark, "_key", similarity).select(F.col("doc_id").alias("_bad")).distinct()
    bad = written(bad, "contaminated")
    rows = docs.select(key.alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return rows.join(bad, F.col("_key") == F.col("_bad"), "left_anti").select("_row.*")
