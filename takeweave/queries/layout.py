"""Queries of text rules, splitting and interval audits, on relations D, G and T."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.functions import foreign
from takeweave.functions import text as tx
from takeweave.operators import intervals as iv
from takeweave.operators import segment
from takeweave.plans.fixtures import G, T, doc_lines, table, takes
from takeweave.queries.intervals import _NEAR, GAP, HOUR, _b, _iv
from takeweave.queries.text import _CLOSE, _SENT, _STOP
from takeweave.sources import readers

# What the documents lack is put into their texts for the rules to work on: brackets, compatibility characters, addresses, units.
_PUT = {
    "brackets": (("a ", "(ab (x) cd) "), ("o ", "（中文 b） ")),
    "signs": (("the ", "⼀⼈⺀ "), ("and ", "中１２A ")),
    "units": (("the ", "三 seconds "), ("and ", "5 minutes ")),
    "dots": (("the ", "e.g. www.a.io "), (", ", "... ")),
    "none": (),
}


def _docs(s, d, put="none"):
    t = F.col("text")
    for a, b in _PUT[put]:
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(s, d, "documents").select("doc_id", t.alias("text"))


def _x(put: str) -> str:
    t = "text"
    for a, b in _PUT[put]:
        t = f"replace({t}, '{a}', '{b}')"
    return f"x AS (SELECT doc_id, {t} AS text FROM documents)"


def _map(put, f):
    return lambda s, d: _docs(s, d, put).select("doc_id", f(F.col("text")).alias("out"))


def _reports(s, d):
    item = F.struct(F.col("cand_id").cast("string").alias("stem"), F.col("t0").alias("lines"), F.col("k").alias("mode"))
    g = takes(s, d).groupBy("rec_id").agg(F.collect_list(item).alias("items"))
    return g.select(F.col("rec_id").cast("string").alias("rec_id"), F.to_json(F.struct(F.struct("items").alias("prep_norm"))).alias("content"))


def _pieces(s, d):
    p = segment.rule_split(_docs(s, d)).withColumn("pieces", segment.prefix_joined(F.col("pieces"), ["and", "but", "und", "et"], 12))
    return p.select("doc_id", F.size("pieces").alias("n"), F.array_join("pieces", "").alias("joined"))


_MATTER = "(?i)licensed|copyright|all rights reserved"

QUERIES = {
    "f10_reflowed": lambda s, d: segment.reflowed(doc_lines(s, d)),
    "f11_matter": lambda s, d: segment.matter(doc_lines(s, d), _MATTER).where("removed").select("doc_id", "n"),
    "f12_foreign": _map("brackets", lambda c: foreign.drop_foreign(c, tail=True)),
    "f14_compatibility": lambda s, d: _docs(s, d, "signs").select("doc_id", tx.compatibility(F.col("text")).alias("out"), tx.unmapped(F.col("text")).alias("unmapped")),
    "f15_mixed_width": _map("signs", tx.mixed_width),
    "f17_units": _map("units", tx.unit_form),
    "g02_protected": lambda s, d: segment.protected_sentences(_docs(s, d, "dots")),
    "g03_resplit": lambda s, d: segment.protected_sentences(_docs(s, d), tx.hold_inner_dots),
    "g05_g07_g09_pieces": _pieces,
    "g13_guarded": lambda s, d: segment.guarded_sentences(_docs(s, d)),
    "d06_adjacent_overlaps": lambda s, d: segment.adjacent_overlaps(doc_lines(s, d)),
    "i08_snap_inside": lambda s, d: iv.snap_inside(_iv(s, d), _b(s, d), HOUR),
    "i14_audit": lambda s, d: iv.audit(_iv(s, d), _b(s, d), HOUR, GAP),
    "s10_batch_reports": lambda s, d: readers.batch_reports(_reports(s, d)),
}

_LIST = "^([-*#•]|[0-9]+[.)])"
_CJK = "\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}"
_HELD = "chr(57344)"


def _foreign(t: str) -> str:
    return f"array_to_string(list_filter(regexp_extract_all({t}, '[(（][^()（）]*[)）]|[^()（）]+|[()（）]'), lambda p: NOT (left(p, 1) IN ('(', '（') AND length(p) > 1 AND 10 * length(regexp_replace(p, '[^!-~]', '', 'g')) >= 7 * length(regexp_replace(p, '[ \\n\\t]', '', 'g')))), '')"


_HOLD = "regexp_replace({t}, '([A-Za-z0-9])\\.([A-Za-z0-9])', '\\1' || chr(57344) || '\\2', 'g')"
_ABBR = "regexp_replace({t}, '(^|[^A-Za-z])(Mr|Mrs|Ms|Dr|Prof|St|vs|etc|e\\x{{E000}}g|i\\x{{E000}}e)\\.', '\\1\\2' || chr(57344), 'g')"
_ON_Y = _SENT.replace("FROM documents", "FROM y")
_SNAP = f"s AS (SELECT rec_id, cand_id AS id, t0, t1, {_NEAR.format(x='t.t0')} AS sb, {_NEAR.format(x='t.t1')} AS eb FROM t), z AS (SELECT rec_id, id, t0, t1, CASE WHEN sb BETWEEN t0 AND t1 THEN sb ELSE t0 END AS s_ms, greatest(CASE WHEN sb BETWEEN t0 AND t1 THEN sb ELSE t0 END, CASE WHEN eb BETWEEN t0 AND t1 THEN eb ELSE t1 END) AS e_ms FROM s)"

ORACLES = {
    "f10_reflowed": f"WITH {G}, a AS (SELECT *, trim(line) AS t, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM g), q AS (SELECT *, sum(CASE WHEN b IS NULL OR b = '' OR regexp_matches(b, '[{_STOP}][{_CLOSE}]*$') OR regexp_matches(t, '{_LIST}') OR regexp_matches(b, '{_LIST}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS par FROM a), r AS (SELECT doc_id, CAST(par AS BIGINT) AS par_no, string_agg(t, ' ' ORDER BY n) AS text FROM q GROUP BY doc_id, par) SELECT * FROM r WHERE trim(text) <> ''",
    "f11_matter": f"WITH {G}, a AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM g) SELECT doc_id, n FROM a WHERE (n <= 20 OR n > m - 20) AND regexp_matches(line, '{_MATTER}')",
    "f12_foreign": f"WITH {_x('brackets')} SELECT doc_id, regexp_replace({_foreign(_foreign('text'))}, '([{_CJK}，。！？：；（）])[ ]*[!-~][ -~]*\\z', '\\1') AS out FROM x",
    "f14_compatibility": f"WITH {_x('signs')} SELECT doc_id, translate(text, '⼀⼈', '一人') AS out, CAST(length(text) - length(replace(text, '⺀', '')) AS INTEGER) AS unmapped FROM x",
    "f15_mixed_width": f"WITH {_x('signs')} SELECT doc_id, regexp_replace(regexp_replace(lower(translate(text, '０１２３４５６７８９', '0123456789')), '([{_CJK}])([a-z0-9])', '\\1 \\2', 'g'), '([a-z0-9])([{_CJK}])', '\\1 \\2', 'g') AS out FROM x",
    "f17_units": f"WITH {_x('units')} SELECT doc_id, replace(replace(replace(replace(translate(lower(text), '零〇一二三四五六七八九两', '001234567892'), ' milliseconds', 'ms'), ' seconds', 's'), ' minutes', 'min'), ' hours', 'h') AS out FROM x",
    "g02_protected": f"WITH {_x('dots')}, y AS (SELECT doc_id, {_ABBR.format(t=_HOLD.format(t=_HOLD.format(t='text')))} AS text FROM x), {_ON_Y} SELECT doc_id, sent_no, replace(text, {_HELD}, '.') AS text FROM s2",
    "g03_resplit": f"WITH y AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\n\\t]+', ' ', 'g'), '\\.( ?[^A-Z .])', {_HELD} || '\\1', 'g') AS text FROM documents), {_ON_Y} SELECT doc_id, sent_no, replace(text, {_HELD}, '.') AS text FROM s2",
    "g13_guarded": f"WITH {_SENT}, m AS (SELECT doc_id FROM s2 GROUP BY doc_id HAVING count(*) > 1), f0 AS (SELECT doc_id, generate_subscripts(ps, 1) AS p, unnest(ps) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[^,，、;；]+[,，、;；]*') AS ps FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m))), f1 AS (SELECT doc_id, p, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM f0) SELECT doc_id, sent_no, text FROM s2 WHERE doc_id IN (SELECT doc_id FROM m) UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p), text FROM f1 WHERE text <> ''",
    "d06_adjacent_overlaps": f"WITH {G}, a AS (SELECT doc_id, n, list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \\t]+'), lambda w: w <> '')) AS w FROM g), b AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY n) AS x FROM a), c AS (SELECT doc_id, n, coalesce(len(x) > 0 AND 100 * len(list_intersect(w, x)) >= 85 * (len(w) + len(x) - len(list_intersect(w, x))), false) AS gone FROM b), e AS (SELECT *, sum((NOT gone)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - (NOT gone)::INT AS i FROM c) SELECT doc_id, max(n) AS n, min(n) AS lo, max(n) AS hi FROM e GROUP BY doc_id, i",
    "i08_snap_inside": f"WITH {T}, {_SNAP} SELECT rec_id, id, s_ms, e_ms FROM z",
    "i14_audit": f"WITH {T}, {_SNAP}, p AS (SELECT *, greatest(s_ms - 80, 0) AS ps, e_ms + 120 AS pe FROM z), q AS (SELECT *, CASE WHEN ps > max(pe) OVER (PARTITION BY rec_id ORDER BY ps, pe, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} THEN 1 ELSE 0 END AS f FROM p), r AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY ps, pe, id ROWS UNBOUNDED PRECEDING) AS i FROM q) SELECT rec_id, id, t0 AS orig_s, t1 AS orig_e, s_ms AS snap_s, e_ms AS snap_e, ps AS pad_s, pe AS pad_e, min(id) OVER w AS merged_into, min(ps) OVER w AS final_s, max(pe) OVER w AS final_e FROM r WINDOW w AS (PARTITION BY rec_id, i)",
    "s10_batch_reports": f"WITH {T} SELECT CAST(rec_id AS VARCHAR) AS rec_id, CAST(cand_id AS VARCHAR) AS stem, t0 AS lines, k AS mode FROM t",
}
