"""Queries of sinks, sources and streams. Sources read what the sinks make of relation T, so each is held against T itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave import session
from takeweave.functions import text as tx
from takeweave.operators import align
from takeweave.operators import intervals as iv
from takeweave.operators import retake as rt
from takeweave.plans.fixtures import G, T, doc_lines, table, takes
from takeweave.queries.intervals import _CL, DAY, GAP, HOUR, _b, _iv
from takeweave.queries.layout import ORACLES as _LAYOUT
from takeweave.queries.text import _CANON, _EXPORT, _FOLD
from takeweave.sources import readers, sinks
from takeweave.streaming import jobs


def _spans(s, d):
    return takes(s, d).select("rec_id", F.col("cand_id").alias("id"), F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"), F.concat(F.col("k"), F.lit(" "), F.col("cand_id")).alias("text"))


def _as_files(df, column):
    return df.select(F.col("rec_id").cast("string").alias("rec_id"), F.col(column).alias("content"))


def _word_files(s, d):
    w = F.struct(F.col("text").alias("word"), (F.col("s_ms") / 1000).alias("start"), (F.col("e_ms") / 1000).alias("end"))
    g = _spans(s, d).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("s_ms", "e_ms", "id", w.alias("w")))).alias("xs"))
    ws = F.transform("xs", lambda x: x["w"])
    layouts = F.when(F.col("rec_id") % 3 == 0, F.to_json(F.struct(ws.alias("words")))).when(F.col("rec_id") % 3 == 1, F.to_json(F.struct(F.array(F.struct(ws.alias("words"))).alias("segments")))).otherwise(F.to_json(ws))
    return g.select(F.col("rec_id").cast("string").alias("rec_id"), layouts.alias("content"))


def _edl_files(s, d):
    seg = _spans(s, d).select("rec_id", "s_ms", "e_ms", F.when(F.col("id") % 2 == 0, "drop").otherwise("keep").alias("action"))
    return _as_files(sinks.edit_list(seg), "json")


def _aliased(s, d):
    """Marker tables of each recording under one of three headers, with quoted names, blank lines and cells of no use."""
    sec = lambda c: F.format_string("%d.%03d", F.floor(F.col(c) / 1000), F.col(c) % 1000)
    long = F.format_string("%d.%03d", F.floor((F.col("e_ms") - F.col("s_ms")) / 1000), (F.col("e_ms") - F.col("s_ms")) % 1000)
    name = F.concat(F.lit('"a ""'), "id", F.lit('"", b"'))
    kind = F.col("rec_id") % 3
    row = F.when(kind == 0, F.concat_ws(",", sec("e_ms"), name, F.lit("x"), sec("s_ms"), F.lit(" Delete "))).when(kind == 1, F.concat_ws(",", name, sec("s_ms"), long, "text")).otherwise(F.concat_ws(",", F.lit("cut"), sec("s_ms"), F.lit(""), long, name))
    head = F.when(kind == 0, "Out, Title ,Colour,IN,State").when(kind == 1, "Marker Name,Start Time,Duration,Notes").otherwise("Type,Start,End,Duration,Name")
    g = _spans(s, d).select("rec_id", "id", row.alias("row")).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("xs"))
    return g.select(F.col("rec_id").cast("string").alias("rec_id"), F.concat(F.lit("\ufeff"), head, F.lit("\n ,,\n"), F.array_join(F.transform("xs", lambda x: x["row"]), "\r\n")).alias("content"))


def _audit(s, d):
    repeats = rt.clusters(takes(s, d), DAY).select("rec_id", F.col("cand_id").alias("no"), F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"), F.when(F.col("is_last"), "last").otherwise("earlier").alias("note"))
    moved = iv.audit(_iv(s, d), _b(s, d), HOUR, GAP).select("rec_id", F.col("id").alias("no"), F.col("final_s").alias("s_ms"), F.col("final_e").alias("e_ms"), F.concat(F.lit("into "), "merged_into").alias("note"))
    return sinks.audit_tables({"repeat": repeats, "adjust": moved})


def _report(s, d):
    path = session.new_path(s, "report")
    for corpus, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        out = tx.export_form(F.col("text"))
        sinks.append_report(table(s, d, corpus).select(F.lit(corpus).alias("corpus"), F.col(key).alias("id"), F.length("text").alias("before"), F.length(out).alias("after"), (out != F.col("text")).alias("changed")), path)
    return s.read.parquet(path)


def _variants(s, d):
    path = session.new_path(s, "variants")
    line = F.col("line")
    sinks.text_variants(doc_lines(s, d), {"norm": tx.export_form(line), "align": F.array_join(align.folded_words(line), " "), "canonical": F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]", "")}, path)
    return s.read.schema("value string, variant string").option("lineSep", "\n").text(path)


QUERIES = {
    "s05_header_names": lambda s, d: readers.markers(_aliased(s, d)),
    "k09_audit_tables": _audit,
    "k10_appended_report": _report,
    "k11_text_variants": _variants,
    "k01_subtitles": lambda s, d: sinks.subtitles(_spans(s, d)),
    "k02_transcript": lambda s, d: sinks.transcript(_spans(s, d)),
    "k05_cut_markers": lambda s, d: sinks.cut_markers(_spans(s, d)),
    "s01_s02_words": lambda s, d: readers.cleaned_words(readers.words(_word_files(s, d))).select("rec_id", "text", "start_ms", "end_ms", "reordered"),
    "s04_k06_edit_lists": lambda s, d: readers.edit_lists(_edl_files(s, d)).select("rec_id", "s_ms", "e_ms", "action"),
    "s05_k03_markers": lambda s, d: readers.markers(_as_files(sinks.markers(_spans(s, d)), "csv")).select("rec_id", "name", "s_ms", "e_ms", "state"),
    "s06_subtitles": lambda s, d: readers.subtitles(_as_files(sinks.subtitles(_spans(s, d)), "srt")).select("rec_id", "s_ms", "e_ms", "text"),
    "t02_sessions": lambda s, d: jobs.finished(jobs.sessions(jobs.event_stream(s, d)), "complete"),
    "t04_tumbling_counts": lambda s, d: jobs.finished(jobs.tumbling_counts(jobs.event_stream(s, d)), "complete"),
    "t05_distinct_events": lambda s, d: jobs.finished(jobs.distinct_events(jobs.event_stream(s, d))),
}

_STAMP = "printf('%02d:%02d:%02d{m}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
_TX = "k || ' ' || cand_id"
_D = "epoch_us(ts)//1000"
_LINE = "(SELECT doc_id, n, line, line AS text FROM g)"
ORACLES = {
    "s05_header_names": f"WITH {T} SELECT CAST(rec_id AS VARCHAR) AS rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY cand_id) + 1 AS INTEGER) AS row, 'a \"' || cand_id || '\", b' AS name, t0 AS s_ms, t1 AS e_ms, CASE WHEN rec_id % 3 = 1 THEN k || ' ' || cand_id ELSE '' END AS note, CASE WHEN rec_id % 3 = 0 THEN 'delete' ELSE 'keep' END AS state FROM t",
    "k09_audit_tables": f"SELECT * FROM ({_CL} SELECT rec_id, cand_id AS no, t0 AS s_ms, t1 AS e_ms, CASE WHEN is_last THEN 'last' ELSE 'earlier' END AS note, 'repeat' AS kind FROM r) UNION ALL SELECT rec_id, id, final_s, final_e, 'into ' || merged_into, 'adjust' FROM ({_LAYOUT['i14_audit']})",
    "k10_appended_report": f"SELECT corpus, id, CAST(length(text) AS INTEGER) AS before, CAST(length(o) AS INTEGER) AS after, o <> text AS changed FROM (SELECT *, {_EXPORT} AS o FROM (SELECT 'documents' AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark))",
    "k11_text_variants": f"WITH {G} SELECT 'norm' AS variant, {_EXPORT} AS value FROM {_LINE} UNION ALL SELECT 'align', array_to_string({_FOLD}, ' ') FROM {_LINE} UNION ALL SELECT 'canonical', {_CANON} FROM {_LINE}",
    "k01_subtitles": f"WITH {T}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id) AS no FROM t) SELECT rec_id, string_agg(no || chr(10) || {_STAMP.format(c='t0', m=',')} || ' --> ' || {_STAMP.format(c='t1', m=',')} || chr(10) || {_TX} || chr(10), chr(10) ORDER BY no) AS srt FROM n GROUP BY rec_id",
    "k02_transcript": f"WITH {T} SELECT rec_id, string_agg({_TX}, chr(10) ORDER BY t0, t1, cand_id) AS txt FROM t GROUP BY rec_id",
    "k05_cut_markers": f"WITH {T}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t0, t1) AS no FROM t) SELECT rec_id, 'CUT_' || no AS name, {_STAMP.format(c='t0', m='.')} AS start, 0 AS duration_ms FROM n UNION ALL SELECT rec_id, 'END_' || no, {_STAMP.format(c='t1', m='.')}, 0 FROM n UNION ALL SELECT rec_id, 'CUTSPAN_' || no, {_STAMP.format(c='t0', m='.')}, t1 - t0 FROM n",
    "s01_s02_words": f"WITH {T} SELECT CAST(rec_id AS VARCHAR) AS rec_id, {_TX} AS text, t0 AS start_ms, t1 AS end_ms, false AS reordered FROM t WHERE t1 > t0",
    "s04_k06_edit_lists": f"WITH {T} SELECT CAST(rec_id AS VARCHAR) AS rec_id, t0 AS s_ms, t1 AS e_ms, CASE WHEN cand_id % 2 = 0 THEN 'cut' ELSE 'keep' END AS action FROM t WHERE t1 > t0",
    "s05_k03_markers": f"WITH {T} SELECT CAST(rec_id AS VARCHAR) AS rec_id, 'L' || cand_id AS name, t0 AS s_ms, t1 AS e_ms, 'keep' AS state FROM t",
    "s06_subtitles": f"WITH {T} SELECT CAST(rec_id AS VARCHAR) AS rec_id, t0 AS s_ms, t1 AS e_ms, {_TX} AS text FROM t",
    "t02_sessions": "WITH a AS (SELECT user_id, event_type, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) > 86400000000 THEN 1 ELSE 0 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id, event_type ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, event_type, min(u) // 1000 AS start_ms, count(*) AS n FROM b GROUP BY user_id, event_type, g",
    "t04_tumbling_counts": f"SELECT {_D} - {_D} % 86400000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "t05_distinct_events": "SELECT DISTINCT event_id, user_id FROM events",
}
