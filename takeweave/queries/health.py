"""Queries of the health report, on relation W and the turns of conversations, and of documents that land as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.functions import counted as ct
from takeweave.operators import health, ownmatch, segment
from takeweave.plans.fixtures import table
from takeweave.queries import counts, script
from takeweave.queries.text import _CLOSE, _EXPORT, _STOP
from takeweave.session import new_path
from takeweave.streaming import landing


def _texts(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("rec_id"), "text")


def _sentences(s, d):
    return segment.sentences(_texts(s, d).withColumnRenamed("rec_id", "doc_id")).select(F.col("doc_id").alias("rec_id"), "text")


def _report(s, d):
    # Some recordings lack a block: those whose lines or sentences were lost.
    split = health.split_block(_sentences(s, d)).where("rec_id % 17 <> 3")
    aligned = health.align_block(ownmatch.match_summary(script._matches(s, d))).where("rec_id % 13 <> 5")
    return health.report(health.normalise_block(_texts(s, d)), split, aligned)


def _landed(s, d):
    stream = landing.landing_table(s, f"{d}/documents.parquet*", "doc_id long, text string, lang string, source string, n_chars long")
    out = new_path(s, "landed")
    landing.start(stream, lambda docs: ct.counted(docs, counts.RULES), out, new_path(s, "landing-state")).awaitTermination()
    return landing.landed(s, out)


QUERIES = {"a17_health_report": _report, "a06_inner_stops": lambda s, d: health.split_block(_sentences(s, d)), "t01_landed_documents": _landed}

_SPLIT = (
    f"h0 AS (SELECT conv_id AS rec_id, unnest(regexp_extract_all(text, '[^{_STOP}]+[{_STOP}]*[{_CLOSE}]*')) AS t FROM conversations), h1 AS (SELECT rec_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM h0), "
    f"sb AS (SELECT rec_id, count(*) AS sentences, CAST(min(length(text)) AS INTEGER) AS len_min, quantile_cont(length(text), 0.5) AS len_median, quantile_cont(length(text), 0.95) AS len_p95, CAST(max(length(text)) AS INTEGER) AS len_max, count(*) FILTER (regexp_matches(text, '[{_STOP}][{_CLOSE}]*$')) AS stops, "
    f"count(*) FILTER (regexp_matches(regexp_replace(text, '[{_STOP}]+[{_CLOSE}]*$', ''), '[{_STOP}]')) AS inner_stops FROM h1 WHERE text <> '' GROUP BY rec_id)"
)
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in health.SUMS)
_REPORT = (
    f"{script._OWN}, {_SPLIT}, nb0 AS (SELECT conv_id AS rec_id, coalesce(text, '') AS t, {_EXPORT} AS n FROM conversations), "
    "nb AS (SELECT rec_id, sum(length(t)) AS orig_len, sum(length(n)) AS norm_len, sum(length(t) - length(replace(t, chr(10), '')) - length(n) + length(replace(n, chr(10), ''))) AS removed_newlines, sum(length(n) - length(regexp_replace(n, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffd}\\x{e000}-\\x{f8ff}]', '', 'g'))) AS suspects FROM nb0 GROUP BY rec_id), "
    "ab AS (SELECT rec_id, count(*) AS lines, count(method) AS matched, count(*) FILTER (method LIKE 'relaxed%') AS relaxed, count(*) - count(method) AS unmatched FROM om GROUP BY rec_id), "
    "jo AS (SELECT *, CASE WHEN orig_len IS NULL OR sentences IS NULL OR lines IS NULL THEN 'missing' WHEN unmatched > 2 THEN 'review' ELSE 'ok' END AS status FROM nb FULL JOIN (FROM sb WHERE rec_id % 17 <> 3) USING (rec_id) FULL JOIN (FROM ab WHERE rec_id % 13 <> 5) USING (rec_id)), "
    f"gr AS (SELECT grouping(status, rec_id) AS g, status, rec_id, count(*) AS items, {_SUMS}, min(len_min) AS len_min, max(len_median) AS m, max(len_p95) AS p, max(len_max) AS len_max FROM jo GROUP BY GROUPING SETS ((status, rec_id), (status), ())) "
    f"SELECT CASE g WHEN 0 THEN 'item' WHEN 1 THEN 'status' ELSE 'all' END AS level, status, rec_id, items, {', '.join(health.SUMS)}, len_min, CASE WHEN g = 0 THEN m END AS len_median, CASE WHEN g = 0 THEN p END AS len_p95, len_max, "
    "CASE WHEN sentences > 0 THEN round(100 * stops / sentences, 2) END AS stop_rate, CASE WHEN lines > 0 THEN round(100 * matched / lines, 2) END AS match_rate FROM gr"
)

ORACLES = {
    "a17_health_report": f"WITH {_REPORT}",
    "a06_inner_stops": f"WITH {_SPLIT} SELECT * FROM sb",
    "t01_landed_documents": f"WITH {counts._FULL.replace(counts._X, 'x AS (SELECT doc_id, text FROM documents)')} SELECT * FROM fc",
}
