"""Reports over batches: counters, verdicts, health, drift, log metrics, source files, presets and rename plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.operators.pairing import STEM_ENDING


def change_counters(rows: DataFrame, counters: list[str]) -> DataFrame:
    """rows with ok, and the sum of each counter over them."""
    return rows.agg(F.count_if("ok").alias("n_ok"), *[F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).alias(c) for c in counters])


def suspicious(docs: DataFrame, examples: int = 8) -> DataFrame:
    """(doc_id, controls, symbols, mixed, examples): control and symbol characters, and words that mix Latin and Han.

    examples: the first ``examples`` distinct mixed words in order, joined by spaces.
    """
    count = lambda cls: F.length(F.regexp_replace("text", f"[^{cls}]", ""))
    mixed = F.filter(F.split("text", "[ \\n\\t]+"), lambda w: w.rlike("\\p{IsHan}") & w.rlike("\\p{IsLatin}"))
    d = docs.select("doc_id", F.length(F.regexp_replace("text", "[^\\p{Cc}]|[\\n\\t\\r]", "")).alias("controls"), count("\\p{S}").alias("symbols"), mixed.alias("_m"))
    return d.select("doc_id", "controls", "symbols", F.size("_m").alias("mixed"), F.array_join(F.slice(F.array_sort(F.array_distinct("_m")), 1, examples), " ").alias("examples"))


def acceptance(stats: DataFrame, least: int = 100, mode: str = "align") -> DataFrame:
    """(verdict, reason, n) of stats(n_lines, mode): FAIL with too few lines or another mode."""
    reason = F.when(F.col("mode").isNull() | (F.col("mode") != mode), "mode").when(F.col("n_lines") < least, "lines").otherwise("")
    return stats.select(reason.alias("reason")).groupBy(F.when(F.col("reason") == "", "PASS").otherwise("FAIL").alias("verdict"), "reason").agg(F.count("*").alias("n"))


def line_sanity(words: DataFrame, lines: DataFrame) -> DataFrame:
    """(rec_id, n_words, n_lines, suspicious): more lines than one and a half times the words (A16). Both sides are counted before they meet."""
    w, n = words.groupBy("rec_id").agg(F.count("*").alias("n_words")), lines.groupBy("rec_id").agg(F.count("*").alias("n_lines"))
    j = w.join(n, "rec_id", "full").select("rec_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return j.withColumn("suspicious", 2 * F.col("n_lines") > 3 * F.col("n_words"))


def health(items: DataFrame) -> DataFrame:
    """Per status, and in all (status null): items, lines, changed (A17). items(status, n_lines, changed)."""
    return items.rollup("status").agg(F.count("*").alias("items"), F.sum("n_lines").alias("lines"), F.count_if("changed").alias("changed"))


def drift(a: DataFrame, b: DataFrame, percent: int = 10, unaligned: int = 2) -> DataFrame:
    """Two runs' (rec_id, cut_ms, unaligned): verdict of each recording in either run.

    missing where one run lacks it, unaligned above the bound in either, drift where the cut times differ by more than ``percent`` of the first.
    """
    j = a.select("rec_id", F.col("cut_ms").alias("cut_a"), F.col("unaligned").alias("un_a")).join(b.select("rec_id", F.col("cut_ms").alias("cut_b"), F.col("unaligned").alias("un_b")), "rec_id", "full")
    verdict = (
        F.when(F.col("cut_a").isNull() | F.col("cut_b").isNull(), "missing")
        .when(F.greatest("un_a", "un_b") > unaligned, "unaligned")
        .when(100 * F.abs(F.col("cut_a") - F.col("cut_b")) > percent * F.col("cut_a"), "drift")
        .otherwise("ok")
    )
    return j.select("rec_id", "cut_a", "cut_b", verdict.alias("verdict"))


def log_metrics(logs: DataFrame, names: list[str]) -> DataFrame:
    """(log_id, <name>...): the first number after each name in logs(log_id, text), in any case; null where there is none."""
    found = lambda n: F.regexp_extract("text", f"(?i){n}[ \\t]*[:=][ \\t]*([0-9]+)", 1)
    return logs.select("log_id", *[F.when(found(n) != "", found(n).cast("long")).alias(n) for n in names])


def render_totals(items: DataFrame) -> DataFrame:
    """One row: items, segments, keep_ms over items(ok, segments, keep_ms) with ok."""
    some = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).alias(c)
    return items.agg(F.count_if("ok").alias("items"), some("segments"), some("keep_ms"))


def region_rows(regions: DataFrame) -> DataFrame:
    """(rec_id, comma, semicolon): regions(rec_id, cand_id, state, t0, t1) that are not deleted, as rows of both CSV dialects."""
    kept = regions.where("state <> 'delete'")
    cells = [F.col("cand_id").cast("string"), F.col("t0").cast("string"), F.col("t1").cast("string"), F.col("state")]
    return kept.select("rec_id", F.concat_ws(",", *cells).alias("comma"), F.concat_ws(";", *cells).alias("semicolon"))


def assembled(kits: DataFrame, stats: DataFrame, renders: DataFrame) -> DataFrame:
    """kits(stem, words, script, audio), stats(stem, n_lines), renders(stem, done) as one row an item with status.

    status: failed without words or script, no-audio, pending until rendered, else ok.
    """
    j = kits.join(stats, "stem", "left").join(renders, "stem", "left")
    status = F.when(F.col("words").isNull() | F.col("script").isNull(), "failed").when(F.col("audio").isNull(), "no-audio").when(~F.coalesce("done", F.lit(False)), "pending").otherwise("ok")
    outputs = sum((F.col(c).isNotNull().cast("int") for c in ("words", "script", "audio")), F.lit(0))
    return j.select("stem", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), outputs.alias("n_files"), F.coalesce("audio", "script").alias("source"), status.alias("status"))


def resolved_sources(requests: DataFrame, catalog: DataFrame, base: str) -> DataFrame:
    """requests(id, path) with the catalog's path (J05): as it is, else below ``base``, else the least path of the same stem; how tells which."""
    files = catalog.select(F.col("path").alias("f")).distinct()
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), STEM_ENDING, ""))
    by_stem = files.groupBy(stem(F.col("f")).alias("_stem")).agg(F.min("f").alias("by_stem"))
    r = requests.withColumn("_below", F.concat(F.lit(base.rstrip("/") + "/"), "path")).withColumn("_stem", stem(F.col("path")))
    r = r.join(files.select(F.col("f").alias("path"), F.col("f").alias("exact")), "path", "left")
    r = r.join(files.select(F.col("f").alias("_below"), F.col("f").alias("below")), "_below", "left").join(by_stem, "_stem", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("below").isNotNull(), "base").when(F.col("by_stem").isNotNull(), "stem").otherwise("missing")
    return r.select("id", F.coalesce("exact", "below", "by_stem").alias("source"), how.alias("how"))


def resolved_settings(items: DataFrame, presets: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """items(id, preset, <name>...) with each setting from the item, else from its preset row, else the default."""
    p = presets.select("preset", *[F.col(n).alias(f"_p_{n}") for n in defaults])
    return items.join(p, "preset", "left").select("id", *[F.coalesce(F.col(n), F.col(f"_p_{n}"), v).alias(n) for n, v in defaults.items()])


def relative_path(c: Column, root: str) -> Column:
    """Path below ``root`` without it, else as it is; backslashes become slashes."""
    c, root = F.replace(c, F.lit("\\"), F.lit("/")), root.rstrip("/") + "/"
    return F.when(c.startswith(root), F.substr(c, F.lit(len(root) + 1))).otherwise(c)


def rename_plan(paths: DataFrame, delete: str = "", replace: dict[str, str] | None = None, pattern: tuple[str, str] | None = None, case: str = "", separator: str = "", prefix: str = "", suffix: str = "") -> DataFrame:
    """(old, new) of paths(path) (P12): on the name without its ending, in this order, characters deleted, strings replaced, a pattern
    replaced, trimmed, lower or upper case, runs of space, - and _ to ``separator``, prefix and suffix. Equal new names of a folder are numbered (1), (2), ... by old path. No file is touched.
    """
    folder, name = F.regexp_extract("path", "^(.*/)?", 0), F.regexp_extract("path", "([^/]*)$", 1)
    ending = F.regexp_extract(name, STEM_ENDING, 0)
    stem = F.translate(F.regexp_replace(name, STEM_ENDING, ""), delete, "")
    for k, v in (replace or {}).items():
        stem = F.replace(stem, F.lit(k), F.lit(v))
    if pattern:
        stem = F.regexp_replace(stem, *pattern)
    stem = F.trim(stem)
    stem = F.lower(stem) if case == "lower" else F.upper(stem) if case == "upper" else stem
    if separator:
        stem = F.regexp_replace(stem, "[ _-]+", separator)
    d = paths.select(F.col("path").alias("old"), folder.alias("_f"), F.concat(F.lit(prefix), stem, F.lit(suffix)).alias("_s"), ending.alias("_e"))
    no = F.row_number().over(Window.partitionBy("_f", "_s", "_e").orderBy("old")) - 1
    return d.withColumn("_n", no).select("old", F.concat("_f", "_s", F.when(F.col("_n") > 0, F.format_string("(%d)", "_n")).otherwise(""), "_e").alias("new"))


# Marks whose share is compared.
ALIGN_MARKS = "，。？！：；——…,.?!:;"


def alignability(texts: DataFrame, words: DataFrame, marks: str = ALIGN_MARKS) -> DataFrame:
    """(rec_id, score): how well a text should align with the words heard, 0 to 100.

    texts(rec_id, text) and words(rec_id, text); rows of one rec_id are taken together, white space is left out, pairs of characters do
    not cross rows. The mean of three shares of the text: characters that the words have too (counted), marks that they have too (1 where
    the text has none), and pairs of neighbouring characters that stand in the words. A recording without text has score 0; one without
    text rows has no row. Grams are counted before they meet.
    """

    def grams(df: DataFrame, side: str) -> DataFrame:
        cs = F.filter(F.split(F.regexp_replace("text", "\\s+", ""), ""), lambda c: c != "")
        d = df.select("rec_id", F.coalesce(cs, F.expr("cast(array() as array<string>)")).alias("c"))
        pairs = F.transform(F.arrays_zip(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))).alias("b")), lambda p: F.concat(p["a"], p["b"]))
        g = d.select("rec_id", F.explode(F.concat("c", pairs)).alias("gram")).groupBy("rec_id", "gram").agg(F.count("*").alias("n"))
        return g.select("rec_id", "gram", *[F.when(F.lit(side == s), F.col("n")).otherwise(0).alias(s) for s in ("t", "w")])

    g = grams(texts, "t").unionByName(grams(words, "w")).groupBy("rec_id", "gram").agg(F.sum("t").alias("t"), F.sum("w").alias("w"))
    one, mark, met = F.length("gram") == 1, F.contains(F.lit(marks), F.col("gram")), F.least("t", "w")
    total = lambda value, on: F.coalesce(F.sum(F.when(on, value)), F.lit(0))
    s = g.groupBy("rec_id").agg(
        total(F.col("t"), one).alias("n"), total(met, one).alias("chars"), total(F.col("t"), one & mark).alias("marks"), total(met, one & mark).alias("marked"),
        total(F.col("t"), ~one).alias("pairs"), total(F.when(F.col("w") > 0, F.col("t")).otherwise(0), ~one).alias("paired"),
    )
    share = F.col("chars") / F.col("n") + F.when(F.col("marks") > 0, F.col("marked") / F.col("marks")).otherwise(1.0) + F.col("paired") / F.greatest("pairs", F.lit(1))
    score = F.when(F.col("n") > 0, F.round(share / 3 * 100, 2)).otherwise(0.0)
    return texts.select("rec_id").distinct().join(s.select("rec_id", score.alias("score")), "rec_id", "left").select("rec_id", F.coalesce("score", F.lit(0.0)).alias("score"))
