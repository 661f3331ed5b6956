"""Sentence segmentation: documents in, numbered pieces out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.functions import text as tx

OPENERS, CLOSERS = "([{（【", ")]}）】"
#: Texts that are walked at once.
ROWS = 256


def walked(docs: DataFrame, pieces: Callable[[str], Iterable[str]], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, xs): the pieces of each text of docs(keys, text), found where the text lies; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                cut = pa.array([None if t is None else list(pieces(t)) for t in some.column("text").to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keys), cut], names=[*keys, "xs"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, xs array<string>")


def sentence_array(c: Column) -> Column:
    """Sentences of a text by hard stops, trimmed, blanks dropped. White space ends no piece, so it may be collapsed first."""
    return F.filter(F.transform(tx.hard_stops(F.regexp_replace(c, "\\s+", " ")), lambda x: F.trim(x)), lambda x: x != "")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, text) by hard stops, trimmed, blanks dropped (G01, G12). Numbered in their own text: no sentence is shuffled."""
    return docs.select("doc_id", F.posexplode(sentence_array(F.col("text"))).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("sent_no"), "text")


def packed_pieces(docs: DataFrame, soft: str = ",，、;；", max_chars: int = 200) -> DataFrame:
    """(doc_id, pieces): clauses packed to pieces of at most ``max_chars``; a longer clause is cut (G06). An ordered fold over one document's clauses."""
    clauses = F.regexp_extract_all(F.regexp_replace("text", "\\s+", " "), F.lit(f"[^{soft}]{{1,{max_chars - 1}}}[{soft}]?|[{soft}]"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        fits = F.length(last) + F.length(x) <= max_chars
        return F.when((F.size(acc) > 0) & fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, x)))).otherwise(F.concat(acc, F.array(x)))

    return docs.select("doc_id", F.aggregate(clauses, F.expr("cast(array() as array<string>)"), step).alias("pieces"))


def depth_split(docs: DataFrame, marks: str = ",;，；。") -> DataFrame:
    """(doc_id, piece_no, text): split after marks outside brackets (G04). Depth is a running count over the brackets of one text, which is a row and is walked where it lies."""
    stops = re.compile(f"[{re.escape(marks + OPENERS + CLOSERS)}]")

    def pieces(t: str) -> Iterator[str]:
        depth, at = 0, 0
        for m in stops.finditer(t):
            c = m.group()
            depth += (c in OPENERS) - (c in CLOSERS)
            if c in marks and depth <= 0:
                yield t[at : m.end()]
                at = m.end()
        if at < len(t):
            yield t[at:]

    return walked(docs, pieces).select("doc_id", F.posexplode("xs").alias("p", "text")).select("doc_id", F.col("p").cast("long").alias("piece_no"), "text")


def merged_wraps(lines: DataFrame) -> DataFrame:
    """(doc_id, par_no, text): lines joined unless the one before ends a sentence or is blank."""
    order = Window.partitionBy("doc_id").orderBy("n")
    before = F.lag(F.trim("line")).over(order)
    new = F.when(before.isNull() | (before == "") | before.rlike(f"[{tx.STOPS}][{tx.CLOSERS}]*$"), 1).otherwise(0)
    p = lines.withColumn("_new", new).withColumn("par_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = p.groupBy("doc_id", "par_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.trim("line").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return g.where("trim(text) <> ''").select("doc_id", F.col("par_no").cast("long").alias("par_no"), "text")


def protected_sentences(docs: DataFrame, hold=tx.hold_dots) -> DataFrame:
    """(doc_id, sent_no, text) by stops that ``hold`` leaves alone (G02; G03 with ``hold_inner_dots``)."""
    return sentences(docs.select("doc_id", hold(F.col("text")).alias("text"))).withColumn("text", tx.release_dots(F.col("text")))


def guarded_sentences(docs: DataFrame, soft: str = ",，、;；") -> DataFrame:
    """(doc_id, sent_no, text): documents of one sentence or none are split again at soft marks."""
    s = sentences(docs).withColumn("_n", F.max("sent_no").over(Window.partitionBy("doc_id"))).where("_n > 1").drop("_n")
    few = docs.join(s.select("doc_id").distinct(), "doc_id", "left_anti")
    p = few.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"[^{soft}]+[{soft}]*"), F.lit(0))).alias("p", "t"))
    p = p.select("doc_id", "p", F.trim(F.regexp_replace("t", "\\s+", " ")).alias("text")).where("text <> ''")
    return s.unionByName(p.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("p")).cast("long").alias("sent_no"), "text"))


def short_merged(pieces: Column, least: int) -> Column:
    """Pieces with short neighbours joined, never across a stop; pieces of closers alone join the one before (G07). A fold over one array."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        short = ((F.length(last) < least) | (F.length(x) < least)) & ~last.rlike(f"[{tx.STOPS}][{tx.CLOSERS}]*\\s*$")
        joins = (F.size(acc) > 0) & (short | x.rlike(f"^[{tx.CLOSERS}\\s]+$"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, F.expr("cast(array() as array<string>)"), step)


def prefix_joined(pieces: Column, connectives: list[str], most: int) -> Column:
    """A piece of at most ``most`` characters that begins with a connective joins the next (G09). A fold over one array."""
    starts = "^\\s*(" + "|".join(connectives) + ")"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & F.coalesce(last.rlike(starts) & (F.length(last) <= most), F.lit(False))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, F.expr("cast(array() as array<string>)"), step)


def rule_split(docs: DataFrame, soft: str = ",，、;；", least: int = 8, max_chars: int = 200) -> DataFrame:
    """(doc_id, pieces): clauses by stops and soft marks, cut at ``max_chars``, short ones joined to their neighbours.

    The pieces of a document join to its text with runs of white space as one space. Null text gives null.
    """
    marks = soft + tx.STOPS
    clauses = F.regexp_extract_all(F.regexp_replace("text", "\\s+", " "), F.lit(f"[^{marks}]{{1,{max_chars}}}[{marks}]*[{tx.CLOSERS}]*|[{marks}]+"), F.lit(0))
    return docs.select("doc_id", short_merged(clauses, least).alias("pieces"))


LIST_OR_HEADING = "^([-*#•]|[0-9]+[.)])"


def reflowed(lines: DataFrame) -> DataFrame:
    """(doc_id, par_no, text): lines joined to paragraphs; lists and headings keep their own lines."""
    order = Window.partitionBy("doc_id").orderBy("n")
    line = F.trim("line")
    before = F.lag(line).over(order)
    new = before.isNull() | (before == "") | before.rlike(f"[{tx.STOPS}][{tx.CLOSERS}]*$") | line.rlike(LIST_OR_HEADING) | before.rlike(LIST_OR_HEADING)
    p = lines.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("par_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = p.groupBy("doc_id", "par_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.trim("line").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return g.where("trim(text) <> ''").select("doc_id", F.col("par_no").cast("long").alias("par_no"), "text")


def matter(lines: DataFrame, pattern: str, depth: int = 20) -> DataFrame:
    """Lines with removed: ``pattern`` matches among the first or last ``depth`` lines of the document."""
    size = F.max("n").over(Window.partitionBy("doc_id"))
    near = (F.col("n") <= depth) | (F.col("n") > size - depth)
    return lines.withColumn("removed", near & F.col("line").rlike(pattern))


def adjacent_overlaps(lines: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n, lo, hi): lines that stay when a line whose words meet the next one's by Jaccard ``percent`` or more gives way to it.

    lo to hi are the line numbers that the kept line stands for. The later text always stays, so neighbours alone decide.
    """
    order = Window.partitionBy("doc_id").orderBy("n")
    words = F.array_distinct(F.filter(F.split(F.lower("line"), "[ \\t]+"), lambda w: w != ""))
    w = lines.select("doc_id", "n", words.alias("w")).withColumn("_next", F.lead("w").over(order))
    met = (F.size("_next") > 0) & (100 * F.size(F.array_intersect("w", "_next")) >= percent * F.size(F.array_union("w", "_next")))
    w = w.select("doc_id", "n", F.coalesce(met, F.lit(False)).alias("gone"))
    group = F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("gone"), 0).otherwise(1)
    g = w.withColumn("_g", group).groupBy("doc_id", "_g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return g.select("doc_id", F.col("hi").alias("n"), "lo", "hi")
