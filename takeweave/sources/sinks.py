"""Text forms of results: subtitles, transcripts, edit lists, marker tables. One row a recording; writing is left to Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave import session


def stamp(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm (P10)."""
    part = lambda div, mod: F.floor(ms / div) % mod
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def _lines(spans: DataFrame, line: Column, name: str, sep: str) -> DataFrame:
    rows = spans.withColumn("_no", F.row_number().over(Window.partitionBy("rec_id").orderBy("s_ms", "e_ms", "id"))).withColumn("_line", line)
    g = rows.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("_no", "_line"))).alias("xs"))
    return g.select("rec_id", F.array_join(F.transform("xs", lambda x: x["_line"]), sep).alias(name))


def subtitles(spans: DataFrame) -> DataFrame:
    """(rec_id, srt) of spans(rec_id, id, s_ms, e_ms, text)."""
    return _lines(spans, F.concat(F.col("_no").cast("string"), F.lit("\n"), stamp(F.col("s_ms")), F.lit(" --> "), stamp(F.col("e_ms")), F.lit("\n"), "text", F.lit("\n")), "srt", "\n")


def transcript(spans: DataFrame) -> DataFrame:
    """(rec_id, txt): kept texts in order."""
    return _lines(spans, F.col("text"), "txt", "\n")


def markers(spans: DataFrame) -> DataFrame:
    """(rec_id, csv): Name,Start,End,Duration,Comment,Type rows in seconds with three decimals."""
    sec = lambda c: F.format_string("%d.%03d", F.floor(c / 1000), c % 1000)
    row = F.concat_ws(",", F.concat(F.lit("L"), "id"), sec(F.col("s_ms")), sec(F.col("e_ms")), sec(F.col("e_ms") - F.col("s_ms")), F.concat(F.lit("[keep] "), "text"), F.lit("keep"))
    return _lines(spans, row, "csv", "\n").withColumn("csv", F.concat(F.lit("Name,Start,End,Duration,Comment,Type\n"), "csv"))


def edit_list(segments: DataFrame) -> DataFrame:
    """(rec_id, json): segments(rec_id, s_ms, e_ms, action) in order with the end clamped."""
    s = F.struct((F.col("s_ms") / 1000).alias("start"), (F.greatest("s_ms", "e_ms") / 1000).alias("end"), "action")
    return segments.groupBy("rec_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(s)).alias("segments"))).alias("json"))


def cut_markers(cuts: DataFrame) -> DataFrame:
    """Three rows a cut: CUT_n at its start, END_n at its end, CUTSPAN_n over both."""
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("s_ms", "e_ms"))
    c = cuts.select("rec_id", "s_ms", "e_ms", n.cast("string").alias("n"))
    row = lambda name, a, b: F.struct(F.concat(F.lit(name), "n").alias("name"), stamp(F.col(a), ".").alias("start"), (F.col(b) - F.col(a)).alias("duration_ms"))
    return c.select("rec_id", F.explode(F.array(row("CUT_", "s_ms", "s_ms"), row("END_", "e_ms", "e_ms"), row("CUTSPAN_", "s_ms", "e_ms"))).alias("x")).select("rec_id", "x.*")


AUDIT = ("rec_id", "no", "s_ms", "e_ms", "note")


def audit_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Write the rows ``AUDIT`` of each step of a batch to one table split by kind, and read it back (K09); keys of ``tables`` are the kinds."""
    rows = None
    for kind, t in tables.items():
        t = t.select(*AUDIT, F.lit(kind).alias("kind"))
        rows = t if rows is None else rows.unionByName(t)
    path = session.new_path(rows.sparkSession, "audit")
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def append_report(rows: DataFrame, path: str) -> None:
    """Add a batch's rows to the report at ``path``, which need not exist yet (K10). A batch that fails adds nothing that readers see."""
    rows.write.mode("append").parquet(path)


def text_variants(lines: DataFrame, variants: dict[str, Column], path: str) -> None:
    """Write each variant of the lines as text files under ``path``/variant=name, one line a row (K11); a null is an empty line.

    Line breaks inside a variant become spaces, so that rows and lines stay one to one.
    """
    forms = F.array(*[F.struct(F.lit(name).alias("variant"), F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]+", " ").alias("value")) for name, c in variants.items()])
    lines.select(F.explode(forms).alias("x")).select("x.variant", "x.value").write.partitionBy("variant").option("lineSep", "\n").text(path)
