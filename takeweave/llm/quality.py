"""Quality rules with thresholds adapted to each language and source.

Every document gets integer measures (words, symbols, repeated lines and windows, upper-case share, ...).
A mergeable quantile sketch of each share is kept for each (language, source): integer log-linear buckets with
counts (values below 64 exactly, above that within 1/32), so sketches of any parts of a group merge by adding counts and
the result does not depend on the order of merging. The threshold of a share in a group is

    q75 + SPREAD * max(q75 - q25, what the sketch cannot tell apart at q75, one event in a document of the group's median size)

and every term is read from the group's own sketches, so it moves with what is usual there. A share counts the events
(symbols, upper-case letters, marks, repeated lines) beyond the first ``FREE_EVENTS``, as a few of them say little about a
document. Sparse groups lean on what is around them: a group of n documents takes the weighted mean of its own threshold (n) and
its language's (``PRIOR_DOCS``), and a language that of its own and all documents'. Documents are joined with their group's
thresholds and kept when they fail neither the base rules nor a threshold.

Null text has no words and fails the base rule. Null languages and sources are groups of their own. Rows with equal
doc_id are judged one by one. Equal shares are treated alike. Very long texts are measured whole. Columns of the input, whatever
their names, are carried as one struct beside the measures. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.llm.textcols import SHINGLE, hashes, shingle_hashes, word_array
from takeweave.session import written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
PRIOR_DOCS = 50
SPREAD = 4
FREE_EVENTS = 3
#: Shares: the events and the size they are set against (parts per million), and mean word length (thousandths of a character).
EVENTS = {"symbol_ppm": ("n_symbols", "word_chars"), "upper_ppm": ("n_upper", "word_chars"), "shout_ppm": ("n_shout", "word_chars"), "dup_line_ppm": ("n_dup_lines", "n_lines")}
LENGTH = "word_length_milli"
SHARES = (*EVENTS, LENGTH)
SIZES = ("word_chars", "n_lines")
_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the struct ``_m`` of all measures of the string column ``text``."""
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", word_array(F.col("_text")))
    df = df.withColumn("_n", F.size("_w")).withColumn("_h", hashes(F.col("_w")))
    df = df.withColumn("_chars", F.length(F.array_join("_w", ""))).drop("_w")
    df = df.withColumn("_g", shingle_hashes(F.col("_h"), F.col("_n"))).drop("_h")
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    # Windows in order of their hash, only where some window occurs twice.
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    same = lambda x, i, d: F.coalesce(F.get(F.col("_s"), i + F.lit(d))["h"] == x["h"], F.lit(False))
    twice = F.filter("_s", lambda x, i: ((i > 0) & same(x, i, -1)) | same(x, i, 1))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("_s")
    covered = F.transform("_p", lambda p, i: F.least(F.lit(SHINGLE), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(SHINGLE))))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    count = lambda pattern: F.length(F.regexp_replace("_text", pattern, "")).cast("long")
    return df.select(
        *[c for c in df.columns if c not in ("_text", "_n", "_chars", "_p", "_lines")],
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            F.col("_chars").cast("long").alias("word_chars"),
            count("[^#*$%&|<>]+").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            count("[^\\p{Lu}]+").alias("n_upper"),
            count("[^!?]+").alias("n_shout"),
        ).alias("_m"),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, exact at any size."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def shares(m: Column) -> dict[str, Column]:
    """The shares that thresholds are set on, as integers."""
    part = lambda n, size: _div(F.greatest(n - FREE_EVENTS, F.lit(0)) * 1_000_000, F.greatest(size, F.lit(1)))
    return {**{name: part(m[n], m[size]) for name, (n, size) in EVENTS.items()}, LENGTH: _div(m["word_chars"] * 1000, F.greatest(m["n_words"], F.lit(1)))}


def bucket(v: Column) -> Column:
    """Sketch bucket of a value of 0 or more: itself below 64, else 32 buckets to each power of two."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(shift * 32 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("long")


def lowest(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise(((b - shift * 32) * F.pow(F.lit(2.0), shift)).cast("long")).cast("long")


def sketch(table: DataFrame) -> DataFrame:
    """Counts (level, lang, source, share, bucket, n) of a measured table (lang, source, _m): level 0 by language and source, 1 by language, 3 all."""
    values = shares(F.col("_m")) | {n: F.col("_m")[n] for n in SIZES}
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), bucket(v).alias("bucket")) for name, v in values.items()]))
    counts = table.select("lang", "source", rows.alias("r")).groupBy("lang", "source", "r.share", "r.bucket").agg(F.count("*").alias("n"))
    levels = counts.rollup("share", "bucket", "lang", "source").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    return levels.where("level in (0, 1, 3)").select("level", "lang", "source", "share", "bucket", "n")


def thresholds(counts: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """(lang, source, one column a share): the greatest accepted value for each language and source."""
    group = Window.partitionBy("level", "lang", "source", "share")
    run = counts.withColumn("cum", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: lowest(F.min(F.when(F.col("cum") * 4 >= F.col("total") * q, F.col("bucket"))))
    q = run.groupBy("level", "lang", "source", "share").agg(F.max("total").alias("total"), *[at(k).alias(f"q{25 * k}") for k in (1, 2, 3)])
    of = lambda share, quartile: F.max(F.when(F.col("share") == share, F.col(quartile)))
    event = {name: _div(F.lit(1_000_000), F.greatest(of(size, "q50"), F.lit(1))) for name, (_, size) in EVENTS.items()}
    limit = lambda s: of(s, "q75") + SPREAD * F.greatest(of(s, "q75") - of(s, "q25"), _div(of(s, "q75"), F.lit(32)), event.get(s, F.lit(0).cast("long")))
    wide = q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[limit(s).alias(s) for s in SHARES])
    own = wide.where("level = 0").drop("level")
    lang = wide.where("level = 1").select(F.col("lang").alias("l1"), F.col("total").alias("t1"), *[F.col(s).alias(f"{s}_1") for s in SHARES])
    every = wide.where("level = 3").select(F.lit(1).alias("one"), *[F.col(s).alias(f"{s}_3") for s in SHARES])
    both = own.withColumn("one", F.lit(1)).join(lang, F.col("lang").eqNullSafe(F.col("l1"))).join(every, "one")
    mean = lambda n, a, b: _div(n * a + prior_docs * b, n + prior_docs)
    return both.select("lang", "source", *[mean(F.col("total"), F.col(s), mean(F.col("t1"), F.col(f"{s}_1"), F.col(f"{s}_3"))).alias(s) for s in SHARES])


def judged(docs: DataFrame, columns: list[str], prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """``_row`` (the named columns), ``_m``, base_failed and kept for every row of ``docs(text, lang, source, ...)``.

    The measured table is written once to shared storage; sketches read its measures, the join all of it.
    """
    base = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("_row"),
        docs["text"].cast("string").alias("_t"),
        docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"),
    )
    table = written(measured(base, "_t").drop("_t"), "measured")
    limits = thresholds(written(sketch(table), "sketch"), prior_docs)
    limits = written(limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*SHARES).alias("_limit")), "thresholds")
    joined = table.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    ok = F.lit(True)
    for name, v in shares(F.col("_m")).items():
        ok = ok & (v <= F.col("_limit")[name])
    failed = base_failed(F.col("_m"))
    return joined.select("_row", "_m", failed.alias("base_failed"), (~failed & F.coalesce(ok, F.lit(True))).alias("kept"))


def verdicts(docs: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every row."""
    return judged(docs, ["doc_id"], prior_docs).select("_row.doc_id", *[F.col("_m")[m].alias(m) for m in _METRICS], "base_failed", "kept")


def filtered(docs: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judged(docs, docs.columns, prior_docs).where("kept").select("_row.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w0 WHERE len(w) >= 5)),
tw AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS r FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM tw) GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^!?]+', '', 'g')) AS BIGINT) AS n_shout
  FROM d JOIN w0 USING (rid) LEFT JOIN rep USING (rid)),
s AS (SELECT *, greatest(n_symbols - 3, 0) * 1000000 // greatest(word_chars, 1) AS symbol_ppm, greatest(n_upper - 3, 0) * 1000000 // greatest(word_chars, 1) AS upper_ppm,
  greatest(n_shout - 3, 0) * 1000000 // greatest(word_chars, 1) AS shout_ppm, greatest(n_dup_lines - 3, 0) * 1000000 // greatest(n_lines, 1) AS dup_line_ppm,
  word_chars * 1000 // greatest(n_words, 1) AS word_length_milli FROM m),
v AS (SELECT lang, source, unnest(['symbol_ppm', 'upper_ppm', 'shout_ppm', 'dup_line_ppm', 'word_length_milli', 'word_chars', 'n_lines']) AS share,
  unnest([symbol_ppm, upper_ppm, shout_ppm, dup_line_ppm, word_length_milli, word_chars, n_lines]) AS v FROM s),
b AS (SELECT lang, source, share, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS bucket FROM v),
lv AS (SELECT 0 AS level, lang, source, share, bucket FROM b UNION ALL SELECT 1, lang, NULL, share, bucket FROM b UNION ALL SELECT 3, NULL, NULL, share, bucket FROM b),
c AS (SELECT level, lang, source, share, bucket, count(*) AS n FROM lv GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, share ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY level, lang, source, share) AS total FROM c),
q AS (SELECT level, lang, source, share, max(total) AS total, min(CASE WHEN cum * 4 >= total THEN bucket END) AS b25, min(CASE WHEN cum * 4 >= total * 2 THEN bucket END) AS b50,
  min(CASE WHEN cum * 4 >= total * 3 THEN bucket END) AS b75 FROM r GROUP BY level, lang, source, share),
t0 AS (SELECT *, CASE WHEN b25 < 64 THEN b25 ELSE (b25 - (b25 // 32 - 1) * 32) << (b25 // 32 - 1) END AS q25, CASE WHEN b50 < 64 THEN b50 ELSE (b50 - (b50 // 32 - 1) * 32) << (b50 // 32 - 1) END AS q50,
  CASE WHEN b75 < 64 THEN b75 ELSE (b75 - (b75 // 32 - 1) * 32) << (b75 // 32 - 1) END AS q75 FROM q),
t AS (SELECT a.level, a.lang, a.source, a.share, CAST(a.total AS BIGINT) AS total, CAST(a.q75 + 4 * greatest(a.q75 - a.q25, a.q75 // 32, CASE WHEN z.q50 IS NULL THEN 0 ELSE 1000000 // greatest(z.q50, 1) END) AS BIGINT) AS t
  FROM t0 a LEFT JOIN t0 z ON z.level = a.level AND z.lang IS NOT DISTINCT FROM a.lang AND z.source IS NOT DISTINCT FROM a.source
    AND z.share = CASE a.share WHEN 'dup_line_ppm' THEN 'n_lines' WHEN 'word_length_milli' THEN '' ELSE 'word_chars' END
  WHERE a.share NOT IN ('word_chars', 'n_lines')),
lim AS (SELECT a.lang, a.source, a.share, (a.total * a.t + 50 * ((l.total * l.t + 50 * e.t) // (l.total + 50))) // (a.total + 50) AS t
  FROM t a JOIN t l ON l.level = 1 AND l.share = a.share AND l.lang IS NOT DISTINCT FROM a.lang JOIN t e ON e.level = 3 AND e.share = a.share WHERE a.level = 0),
wide AS (SELECT lang, source, max(t) FILTER (share = 'symbol_ppm') AS a, max(t) FILTER (share = 'upper_ppm') AS b, max(t) FILTER (share = 'shout_ppm') AS c, max(t) FILTER (share = 'dup_line_ppm') AS d, max(t) FILTER (share = 'word_length_milli') AS e FROM lim GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND symbol_ppm <= a AND upper_ppm <= b AND shout_ppm <= c AND dup_line_ppm <= d AND word_length_milli <= e AS kept
FROM s JOIN wide ON s.lang IS NOT DISTINCT FROM wide.lang AND s.source IS NOT DISTINCT FROM wide.source
"""
