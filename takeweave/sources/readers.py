"""Readers of the text forms that recordings come in; each takes a table (rec_id, content) or a path of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeweave.operators.intervals import merge


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, content): one row a file, the stem in lower case as rec_id; a byte order mark goes."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(F.lower(name).alias("rec_id"), F.regexp_replace("value", "^﻿", "").alias("content"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """(rec_id, line_no from 1, text, replaced): replaced marks undecodable characters."""
    return files.select("rec_id", F.posexplode(F.split("content", "\r?\n")).alias("p", "text")).select("rec_id", (F.col("p") + 1).alias("line_no"), "text", F.contains("text", F.lit("�")).alias("replaced"))


def _ms(*paths: Column) -> Column:
    return F.round(F.coalesce(*paths) * 1000).cast("long")


def words(files: DataFrame) -> DataFrame:
    """(rec_id, word_idx, text, start_ms, end_ms) of word lists in any of the four layouts (S01); a missing end is the start."""
    v = F.try_parse_json("content")
    arr = "array<variant>"
    top = files.select("rec_id", v.alias("v")).select(
        "rec_id",
        F.coalesce(
            F.try_variant_get("v", "$.words", arr),
            F.flatten(F.transform(F.try_variant_get("v", "$.segments", arr), lambda s: F.coalesce(F.try_variant_get(s, "$.words", arr), F.expr("cast(array() as array<variant>)")))),
            F.try_variant_get("v", "$.items", arr),
            F.try_variant_get("v", "$", arr),
        ).alias("ws"),
    )
    w = top.select("rec_id", F.posexplode("ws").alias("word_idx", "w"))
    get = lambda kind, *keys: F.coalesce(*[F.try_variant_get("w", f"$.{k}", kind) for k in keys])
    start = get("double", "start", "ts", "begin")
    return w.select("rec_id", "word_idx", get("string", "text", "word", "char", "token").alias("text"), _ms(start).alias("start_ms"), _ms(get("double", "end", "te", "finish"), start).alias("end_ms"))


def cleaned_words(words: DataFrame) -> DataFrame:
    """Words with text and a positive length, numbered anew by (start, end); reordered tells whether a recording was out of order."""
    w = words.withColumn("text", F.trim("text")).where("text <> '' and end_ms > start_ms")
    late = F.coalesce(F.col("start_ms") < F.lag("start_ms").over(Window.partitionBy("rec_id").orderBy("word_idx")), F.lit(False))
    w = w.withColumn("_late", late)
    by_time = Window.partitionBy("rec_id").orderBy("start_ms", "end_ms", "word_idx")
    return w.select("rec_id", (F.row_number().over(by_time) - 1).alias("word_idx"), "text", "start_ms", "end_ms", F.max("_late").over(Window.partitionBy("rec_id")).alias("reordered"))


_EDL = "struct<segments:array<struct<start:double,end:double,action:string,type:string,keep:boolean,reason:string>>,actions:array<struct<start:double,end:double,type:string,reason:string>>>"


def edit_lists(files: DataFrame) -> DataFrame:
    """(rec_id, s_ms, e_ms, action, reason): segments, or old actions where no segment is usable; drop and delete read as cut."""
    j = files.select("rec_id", F.from_json("content", _EDL).alias("j"))
    norm = lambda c: F.when(F.lower(c).isin("cut", "drop", "delete", "remove"), "cut").otherwise("keep")
    new = j.select("rec_id", F.explode("j.segments").alias("x")).select("rec_id", _ms(F.col("x.start")).alias("s_ms"), _ms(F.col("x.end")).alias("e_ms"), norm(F.coalesce("x.action", "x.type", F.when(~F.col("x.keep"), "cut"), F.lit("keep"))).alias("action"), F.col("x.reason").alias("reason")).where("e_ms > s_ms")
    old = j.select("rec_id", F.explode("j.actions").alias("x")).select("rec_id", _ms(F.col("x.start")).alias("s_ms"), _ms(F.col("x.end")).alias("e_ms"), norm(F.coalesce("x.type", F.lit("cut"))).alias("action"), F.col("x.reason").alias("reason")).where("e_ms > s_ms")
    return new.unionByName(old.join(new.select("rec_id").distinct(), "rec_id", "left_anti"))


def _stamp_ms(c: Column) -> Column:
    p = F.split(F.regexp_replace(F.trim(c), ",", "."), "[:.]")
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    return at(1) * 3_600_000 + at(2) * 60_000 + at(3) * 1000 + at(4)


def subtitles(files: DataFrame) -> DataFrame:
    """(rec_id, block, s_ms, e_ms, text) of SRT files: a digit line opens a block, an arrow line sets its times, other lines are text."""
    x = files.select("rec_id", F.posexplode(F.split("content", "\r?\n")).alias("p", "line"))
    order = Window.partitionBy("rec_id").orderBy("p")
    arrow_next = F.coalesce(F.lead("line").over(order), F.lit("")).contains("-->")
    opens = F.col("line").rlike("^\\s*[0-9]+\\s*$") & arrow_next
    x = x.withColumn("opens", opens).withColumn("block", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    time = F.col("line").contains("-->")
    text = F.when(~time & ~F.col("opens") & (F.trim("line") != ""), F.struct("p", "line"))
    g = x.groupBy("rec_id", "block").agg(F.max(F.when(time, F.col("line"))).alias("t"), F.sort_array(F.collect_list(text)).alias("xs"))
    ends = F.split("t", "-->")
    return g.select("rec_id", "block", _stamp_ms(F.get(ends, 0)).alias("s_ms"), _stamp_ms(F.get(ends, 1)).alias("e_ms"), F.array_join(F.transform("xs", lambda v: v["line"]), "\n").alias("text"))


# Header names of marker tables, in order of preference, and the states a marker may have.
MARKER_NAMES = {"name": ("name", "marker name", "title"), "start": ("start", "start time", "in"), "duration": ("duration",), "end": ("end", "out"), "note": ("description", "comment", "notes"), "state": ("type", "state")}
MARKER_STATES = ("keep", "delete", "undecided")


def _cells(line: Column) -> Column:
    """Cells of one CSV line; quoted ones may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def markers(files: DataFrame) -> DataFrame:
    """(rec_id, row from 1, name, s_ms, e_ms, note, state) of marker CSV text in files(rec_id, content).

    The first line names the columns, in any order and by any name of ``MARKER_NAMES``; others are ignored. A start that is missing or no
    number is 0; the end is start + duration, else the end column, never before the start; missing names and notes are empty, an unknown
    state is keep. Lines of blank cells go but count as rows. A null content has no rows.
    """
    lines = F.split(F.regexp_replace("content", "^\ufeff", ""), "\r?\n")
    head = F.transform(_cells(F.get(lines, F.lit(0))), lambda h: F.lower(F.trim(h)))
    x = files.select("rec_id", head.alias("head"), F.posexplode(lines).alias("row", "line")).where("row > 0").withColumn("cells", _cells(F.col("line")))
    x = x.where(F.exists("cells", lambda c: F.trim(c) != ""))

    def cell(field: str) -> Column:
        at = F.coalesce(*[F.when(F.array_contains("head", n), F.array_position("head", n)) for n in MARKER_NAMES[field]])
        return F.get("cells", (at - 1).cast("int"))

    number = lambda field: F.trim(cell(field)).try_cast("double")
    start = F.coalesce(number("start"), F.lit(0.0))
    length = F.coalesce(number("duration"), F.greatest(number("end") - start, F.lit(0.0)), F.lit(0.0))
    state = F.lower(F.trim(cell("state")))
    return x.select(
        "rec_id", "row", F.coalesce(cell("name"), F.lit("")).alias("name"), _ms(start).alias("s_ms"), _ms(start + length).alias("e_ms"), F.coalesce(cell("note"), F.lit("")).alias("note"),
        F.when(state.isin(*MARKER_STATES), state).otherwise("keep").alias("state"),
    )


def silences(log: DataFrame) -> DataFrame:
    """(rec_id, s_ms, e_ms) of log(rec_id, line_no, line) with silence_start / silence_end lines.

    Unpaired and inverted ones go, those that touch within a millisecond are merged.
    """
    t = lambda name: F.regexp_extract("line", f"{name}: *(-?[0-9.]+)", 1).try_cast("double")
    start = F.last(t("silence_start"), ignorenulls=True).over(Window.partitionBy("rec_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return merge(log.select("rec_id", _ms(start).alias("s_ms"), _ms(t("silence_end")).alias("e_ms")).where("e_ms > s_ms"), 1).select("rec_id", "s_ms", "e_ms")


def mapping(files: DataFrame) -> DataFrame:
    """(key, value) of JSON maps (rec_id = priority, content); values are strings or lists, the least priority wins."""
    lists = F.from_json("content", "map<string,array<string>>")
    single = F.transform_values(F.from_json("content", "map<string,string>"), lambda _, v: F.array(v))
    x = files.select(F.col("rec_id").alias("prio"), F.explode(F.coalesce(lists, single)).alias("key", "vs")).select("prio", "key", F.explode("vs").alias("value"))
    best = F.row_number().over(Window.partitionBy("value").orderBy("prio", "key"))
    return x.withColumn("_r", best).where("_r = 1").select("key", "value")


def batch_reports(files: DataFrame) -> DataFrame:
    """(rec_id, stem, lines, mode) of nested batch reports in files(rec_id, content) (S10). Reports that do not parse have no row."""
    layout = "prep_norm struct<items: array<struct<stem: string, lines: bigint, mode: string>>>"
    return files.select("rec_id", F.explode(F.from_json("content", layout)["prep_norm"]["items"]).alias("x")).select("rec_id", "x.*")
