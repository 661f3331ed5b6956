"""Queries of batch records, on relations P, T, N and D."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.operators import align, pairing, records
from takeweave.plans.fixtures import T, paths, table, takes
from takeweave.queries.intervals import DAY, HOUR
from takeweave.queries.text import _GRAMS, _KITS, _PCAT


def _words(s, d, name, key):
    return table(s, d, name).select(key, align.folded_words(F.col("text")).alias("words"))


def _outcomes(s, d):
    return pairing.kits(paths(s, d)).select((F.col("words").isNotNull() & F.col("script").isNotNull() & F.col("audio").isNotNull()).alias("ok"))


QUERIES = {
    "j02_best_text": lambda s, d: records.best_text(pairing.catalog(paths(s, d))),
    "j03_best_audio": lambda s, d: records.best_audio(pairing.catalog(paths(s, d))),
    "a01_stage_summary": lambda s, d: records.stage_summary(_outcomes(s, d)),
    "a03_take_stats": lambda s, d: records.take_stats(takes(s, d), DAY),
    "d12_guarded": lambda s, d: records.guarded(takes(s, d), DAY, HOUR, 50),
    "m02_occurrences": lambda s, d: records.occurrences(_words(s, d, "benchmark", "item_id"), _words(s, d, "documents", "doc_id")),
}

_LAST = "SELECT *, coalesce(lead(t0) OVER (PARTITION BY rec_id, k ORDER BY t0, t1, cand_id) - t0 > {ms}, true) AS is_last FROM {src}"
_STATS = "SELECT rec_id, count(*) AS total, count(*) FILTER (is_last) AS kept, CAST(sum(t1 - t0) AS BIGINT) AS total_ms, CAST(coalesce(sum(t1 - t0) FILTER (NOT is_last), 0) AS BIGINT) AS cut_ms FROM {src} GROUP BY rec_id"

ORACLES = {
    "j02_best_text": f"WITH {_PCAT} SELECT stem, arg_min(path, CASE kind WHEN 'align' THEN 1 WHEN 'norm' THEN 2 ELSE 3 END) AS path FROM c WHERE kind IN ('align', 'norm', 'text') GROUP BY stem",
    "j03_best_audio": f"WITH {_PCAT} SELECT stem, arg_min(path, CASE WHEN path LIKE '%.wav' THEN 1 WHEN path LIKE '%.flac' THEN 2 WHEN path LIKE '%.m4a' THEN 3 ELSE 4 END) AS path FROM c WHERE kind = 'audio' GROUP BY stem",
    "a01_stage_summary": f"WITH {_KITS}, o AS (SELECT words IS NOT NULL AND script IS NOT NULL AND audio IS NOT NULL AS ok FROM kt) SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM o",
    "a03_take_stats": f"WITH {T}, r AS ({_LAST.format(ms=DAY, src='t')}) {_STATS.format(src='r')}",
    "d12_guarded": f"WITH {T}, r AS ({_LAST.format(ms=DAY, src='t')}), s AS ({_STATS.format(src='r')}), bad AS (SELECT rec_id FROM s WHERE 100 * cut_ms > 50 * total_ms), "
    f"a AS (SELECT * FROM t WHERE rec_id IN (SELECT rec_id FROM bad)), r2 AS ({_LAST.format(ms=HOUR, src='a')}), s2 AS ({_STATS.format(src='r2')}) "
    "SELECT rec_id, cand_id, 'none' AS guard_action FROM r WHERE is_last AND rec_id NOT IN (SELECT rec_id FROM bad) "
    "UNION ALL SELECT rec_id, cand_id, CASE WHEN 100 * cut_ms > 50 * total_ms THEN 'abort' ELSE 'relaxed' END FROM r2 JOIN s2 USING (rec_id) WHERE is_last",
    "m02_occurrences": f"WITH {_GRAMS} SELECT lg.item_id, sg.doc_id, CAST(sg.pos AS BIGINT) AS start FROM lg JOIN sg USING (gram) JOIN l ON l.item_id = lg.item_id JOIN st ON st.doc_id = sg.doc_id WHERE lg.o = 0 AND st.ws[sg.pos+1:sg.pos+len(l.ws)] = l.ws",
}
