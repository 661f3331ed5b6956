"""Queries from script lines to cuts, on the words of recordings (relation W), and of overlapping keeps, on the lines of documents (relation G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from takeweave.operators import align, overlaps, ownmatch, retake
from takeweave.operators import intervals as iv
from takeweave.plans.fixtures import G, W, doc_lines, table, words
from takeweave.queries.composed import _bare_words
from takeweave.queries.intervals import _M, _MONO
from takeweave.queries.text import _FOLD
from takeweave.session import written

CAP = 20
WINDOW, SNAP, GAP, SHORT = 60_000, 1000, 60, 180


def _sentences(s, d):
    """Sentences of the turns as script lines; every seventh word from the fourth on is left out, so that most lines only nearly match."""
    stops = F.regexp_extract_all("text", F.lit("[^.!?\n]+"), F.lit(0))
    c = table(s, d, "conversations").select(F.col("conv_id").alias("rec_id"), "turn", F.posexplode(stops).alias("p", "t"))
    kept = F.filter(_bare_words(F.col("t")), lambda w, i: (i % 7 != 3) & (w != ""))
    return c.select("rec_id", (F.col("turn") * 100_000 + F.col("p")).cast("long").alias("no"), kept.alias("words")).where("size(words) > 0")


def _spoken(s, d):
    plain = F.regexp_replace(F.array_join(align.folded_words(F.col("text")), ""), "[^a-z0-9]", "x")
    return words(s, d).withColumn("text", plain)


def _matches(s, d):
    return ownmatch.relaxed_own_matches(_sentences(s, d), _spoken(s, d))


def _line_takes(s, d):
    lines, spoken = _sentences(s, d), _spoken(s, d)
    return written(ownmatch.takes_of_lines(ownmatch.relaxed_own_matches(lines, spoken), lines, spoken), "line-takes"), spoken


def _keeps(s, d):
    t, spoken = _line_takes(s, d)
    pauses = spoken.where("idx % 11 = 10").select("rec_id", F.col("end_ms").alias("b"))
    return retake.keep_last_pipeline(t, pauses, WINDOW, snap_ms=SNAP, gap_ms=GAP, min_ms=SHORT), spoken


def _cuts(s, d):
    keeps, spoken = _keeps(s, d)
    return iv.complement(keeps, spoken.groupBy("rec_id").agg(F.max("end_ms").alias("total_ms")))


def _turn_lines(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("no"), "text")


def _spans(s, d):
    """Lines of documents as keeps that overlap: every third repeats the one before, every ninth is blank."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("n"))
    g = doc_lines(s, d).withColumn("t", F.when(F.col("n") % 3 == 1, F.coalesce(before, "line")).otherwise(F.col("line")))
    text = F.when((F.col("doc_id") + F.col("n")) % 9 == 4, "").otherwise(F.col("t"))
    start = 1000 * F.col("n") - 400 * (F.col("n") * 7919 % 3)
    return g.select(F.col("doc_id").alias("rec_id"), F.col("n").alias("pos"), text.alias("text"), start.alias("s_ms"), (start + 700 + 300 * (F.length("line") % 5)).alias("e_ms"))


QUERIES = {
    "m03_latest_anchors": lambda s, d: ownmatch.anchor_windows(_turn_lines(s, d), words(s, d), cap=CAP),
    "m08_m14_own_matches": _matches,
    "a12_method_counts": lambda s, d: ownmatch.match_summary(_matches(s, d)),
    "d10_lines_to_keeps": lambda s, d: _keeps(s, d)[0],
    "d10_lines_to_cuts": _cuts,
    "d06_safe_chains": lambda s, d: overlaps.chains(_spans(s, d), "safe").select("rec_id", "pos", "chain", "removed"),
    "d06_aggressive_chains": lambda s, d: overlaps.chains(_spans(s, d), "aggressive").select("rec_id", "pos", "chain", "removed"),
    "d06_aggressive_totals": lambda s, d: overlaps.totals(overlaps.chains(_spans(s, d), "aggressive")),
}

_CANON = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_ANCHORS = (
    f"{W}, cw AS (SELECT rec_id, idx, {_CANON.format(x='text')} AS t FROM w), ct AS (SELECT rec_id, string_agg(t, '' ORDER BY idx) AS t FROM cw GROUP BY rec_id), "
    f"l AS (SELECT conv_id AS rec_id, turn AS no, {_CANON.format(x='text')} AS t FROM conversations), a0 AS (SELECT *, length(t) AS len, least(length(t), 6) AS q FROM l WHERE t <> ''), "
    "a1 AS (SELECT rec_id, no, len, q, unnest(range(0, len - q + 1)) AS o, t FROM a0), a2 AS (SELECT rec_id, no, len, o, q, substr(t, o + 1, q) AS gram FROM a1), "
    "g0 AS (SELECT DISTINCT rec_id, q, gram FROM a2), p0 AS (SELECT rec_id, q, unnest(range(0, length(t) - q + 1)) AS p, t FROM ct JOIN (SELECT DISTINCT rec_id, q FROM g0) USING (rec_id)), p1 AS (SELECT rec_id, q, p, substr(t, p + 1, q) AS gram FROM p0), "
    "p2 AS (SELECT rec_id, q, gram, list(p) AS ps FROM p1 JOIN g0 USING (rec_id, q, gram) GROUP BY ALL), "
    "r AS (SELECT rec_id, q, gram, ps, list_max(ps) AS p FROM p2 UNION ALL SELECT rec_id, q, gram, ps, list_max([x FOR x IN ps IF x <= p - q]) FROM r WHERE len([x FOR x IN ps IF x <= p - q]) > 0), "
    "h AS (SELECT a2.rec_id, no, o, p, greatest(p - len, 0) AS lo, least(p + len, length(ct.t)) AS hi FROM a2 JOIN r USING (rec_id, q, gram) JOIN ct USING (rec_id)), "
    "h1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY rec_id, no, lo, hi ORDER BY o, -p) = 1 THEN 1 ELSE 0 END AS fresh FROM h), "
    f"h2 AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY rec_id, no ORDER BY o, -p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h1 QUALIFY before < {CAP}), "
    "h3 AS (SELECT *, count(*) OVER (PARTITION BY rec_id, no) AS anchor_hits FROM h2) SELECT rec_id, no, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, anchor_hits FROM h3 WHERE fresh = 1"
)

_BARE = "[regexp_replace(x, '[^a-z0-9]', 'x', 'g') FOR x IN {x}]"
_LINES = (
    "s0 AS (SELECT conv_id AS rec_id, turn, generate_subscripts(ps, 1) - 1 AS p, unnest(ps) AS text FROM (SELECT *, regexp_extract_all(text, '[^.!?\\n]+') AS ps FROM conversations)), "
    f"s1 AS (SELECT rec_id, CAST(turn * 100000 + p AS BIGINT) AS no, {_BARE.format(x=_FOLD)} AS ws FROM s0), s2 AS (SELECT rec_id, no, [x FOR x, i IN ws IF i % 7 <> 4 AND x <> ''] AS ws FROM s1), ln AS (SELECT * FROM s2 WHERE len(ws) > 0), "
    f"sw AS (SELECT rec_id, idx, regexp_replace(array_to_string({_FOLD}, ''), '[^a-z0-9]', 'x', 'g') AS text, start_ms, end_ms FROM w), st AS (SELECT rec_id, list(text ORDER BY idx) AS ws FROM sw GROUP BY rec_id)"
)


def _step(i: int, n: int, ratio: float, lines: str) -> str:
    """Common table expressions of one step of the ladder: b{i} has the lines' best windows, f{i} their report."""
    return (
        f"lg{i} AS (SELECT rec_id, no, o, array_to_string(ws[o+1:o+{n}], ' ') AS gram FROM (SELECT rec_id, no, ws, unnest(range(0, len(ws) - {n - 1})) AS o FROM {lines} WHERE len(ws) >= {n})), "
        f"sg{i} AS (SELECT rec_id, p, array_to_string(ws[p+1:p+{n}], ' ') AS gram FROM (SELECT rec_id, ws, unnest(range(0, len(ws) - {n - 1})) AS p FROM st WHERE len(ws) >= {n})), "
        f"an{i} AS (SELECT rec_id, no, greatest(p - o, 0) AS start, count(*) AS hits FROM lg{i} JOIN sg{i} USING (rec_id, gram) GROUP BY ALL), "
        f"wi{i} AS (SELECT rec_id, no, start, hits, len(st.ws[start+1:start+len(l.ws)]) AS n_words, array_to_string(l.ws, ' ') AS a, array_to_string(st.ws[start+1:start+len(l.ws)], ' ') AS b FROM an{i} JOIN {lines} l USING (rec_id, no) JOIN st USING (rec_id)), "
        f"di{i} AS (SELECT *, levenshtein(a, b) AS d, greatest(length(a), length(b)) AS longer FROM wi{i}), "
        f"bo{i} AS (SELECT * FROM di{i} WHERE d <= floor(longer * {ratio}::DOUBLE) QUALIFY row_number() OVER (PARTITION BY rec_id, no ORDER BY d, start DESC) = 1), "
        f"ag{i} AS (SELECT rec_id, no, CAST(sum(hits) AS BIGINT) AS anchor_hits, count(*) AS windows FROM an{i} GROUP BY ALL), "
        f"f{i} AS (SELECT l.rec_id, l.no, l.ws, bo.start, bo.n_words, bo.d, bo.longer, coalesce(ag.anchor_hits, 0) AS anchor_hits, coalesce(ag.windows, 0) AS windows, CASE WHEN ag.no IS NULL THEN 'no-anchor' WHEN bo.no IS NULL THEN 'distance' END AS reason FROM {lines} l LEFT JOIN ag{i} ag USING (rec_id, no) LEFT JOIN bo{i} bo USING (rec_id, no)), "
        f"u{i} AS (SELECT rec_id, no, ws FROM f{i} WHERE reason IS NOT NULL)"
    )


_OWN = (
    f"{W}, {_LINES}, {_step(1, 5, 0.35, 'ln')}, {_step(2, 4, 0.46, 'u1')}, {_step(3, 3, 0.55, 'u2')}, "
    "fa AS (SELECT *, 'anchor' AS method FROM f1 WHERE reason IS NULL UNION ALL SELECT *, 'relaxed-2' FROM f2 WHERE reason IS NULL UNION ALL SELECT *, CASE WHEN reason IS NULL THEN 'relaxed-3' END FROM f3), "
    "om AS (SELECT rec_id, no, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, CAST(d AS BIGINT) AS dist, round(1 - d / longer, 6) AS score, anchor_hits, windows, reason, method FROM fa)"
)
# Lines in the order of their numbers, each compared with the keys that stand before it.
_TAKEN = (
    f"{_OWN}, q0 AS (SELECT rec_id, no, array_to_string(ws, '') AS key FROM ln), q1 AS (SELECT rec_id, key, min(no) AS no FROM q0 GROUP BY ALL), q2 AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY no) AS i FROM q1), "
    "kr AS (SELECT rec_id, i, key, [key] AS heads, key AS own FROM q2 WHERE i = 1 UNION ALL SELECT rec_id, i, key, CASE WHEN own IS NULL THEN heads || [key] ELSE heads END, coalesce(own, key) FROM (SELECT q2.rec_id, q2.i, q2.key, kr.heads, "
    "[h FOR h IN kr.heads IF levenshtein(h, q2.key) * 100 <= 15 * greatest(length(h), length(q2.key))][1] AS own FROM kr JOIN q2 ON q2.rec_id = kr.rec_id AND q2.i = kr.i + 1)), "
    "t AS (SELECT om.rec_id, om.no AS cand_id, kr.own AS k, a.start_ms AS t0, b.end_ms AS t1, om.score FROM om JOIN q0 USING (rec_id, no) JOIN kr ON kr.rec_id = om.rec_id AND kr.key = q0.key JOIN w a ON a.rec_id = om.rec_id AND a.idx = om.start JOIN w b ON b.rec_id = om.rec_id AND b.idx = om.start + om.n_words - 1 WHERE om.reason IS NULL), "
    "bd AS (SELECT rec_id, end_ms AS t0 FROM w WHERE idx % 11 = 10), "
    f"a AS (SELECT *, CASE WHEN t0 - lag(t0) OVER q > {WINDOW} THEN 1 ELSE 0 END AS f FROM t WINDOW q AS (PARTITION BY rec_id, k ORDER BY t0, t1, cand_id)), c AS (SELECT *, sum(f) OVER (PARTITION BY rec_id, k ORDER BY t0, t1, cand_id ROWS UNBOUNDED PRECEDING) AS cluster FROM a), "
    "kl AS (SELECT * FROM c QUALIFY lead(cand_id) OVER (PARTITION BY rec_id, k, cluster ORDER BY t0, t1, cand_id) IS NULL), "
    f"{_MONO.format(src='kl')}, mk AS (SELECT * FROM mono WHERE ok)"
)
_near = lambda x: f"(SELECT arg_min(b.t0, struct_pack(d := abs(b.t0 - {x}), v := b.t0)) FROM bd b WHERE b.rec_id = t.rec_id AND abs(b.t0 - {x}) <= {SNAP})"
_LINE_KEEPS = (
    f"{_TAKEN}, sn AS (SELECT t.rec_id, t.t0, t.t1, {_near('t.t0')} AS sb, {_near('t.t1')} AS eb FROM mk t), z AS (SELECT rec_id, CASE WHEN sb BETWEEN t0 AND t1 THEN sb ELSE t0 END AS s_ms, greatest(CASE WHEN sb BETWEEN t0 AND t1 THEN sb ELSE t0 END, CASE WHEN eb BETWEEN t0 AND t1 THEN eb ELSE t1 END) AS e_ms FROM sn), "
    f"x AS (SELECT rec_id, greatest(s_ms - 80, 0) AS s_ms, e_ms + 120 AS e_ms FROM z WHERE e_ms > s_ms), {_M.format(gap=GAP)}, fo AS (SELECT rec_id, s_ms, e_ms, row_number() OVER (PARTITION BY rec_id ORDER BY s_ms, e_ms) AS rn FROM m), "
    f"fd AS (SELECT rec_id, rn, s_ms, e_ms, 1 AS gid FROM fo WHERE rn = 1 UNION ALL SELECT n.rec_id, n.rn, CASE WHEN least(n.e_ms - n.s_ms, p.e_ms - p.s_ms) < {SHORT} THEN p.s_ms ELSE n.s_ms END, "
    f"CASE WHEN least(n.e_ms - n.s_ms, p.e_ms - p.s_ms) < {SHORT} THEN greatest(p.e_ms, n.e_ms) ELSE n.e_ms END, p.gid + CASE WHEN least(n.e_ms - n.s_ms, p.e_ms - p.s_ms) < {SHORT} THEN 0 ELSE 1 END FROM fd p JOIN fo n ON n.rec_id = p.rec_id AND n.rn = p.rn + 1), "
    "fr AS (SELECT rec_id, s_ms, e_ms FROM fd QUALIFY row_number() OVER (PARTITION BY rec_id, gid ORDER BY rn DESC) = 1)"
)
_LINE_CUTS = (
    f"{_LINE_KEEPS}, ed AS (SELECT rec_id, s_ms, least(e_ms, tm) AS e_ms, tm FROM fr JOIN (SELECT rec_id, max(end_ms) AS tm FROM w GROUP BY rec_id) USING (rec_id) UNION ALL SELECT rec_id, max(end_ms), max(end_ms), max(end_ms) FROM w GROUP BY rec_id), "
    "cp AS (SELECT rec_id, coalesce(max(e_ms) OVER (PARTITION BY rec_id ORDER BY s_ms, e_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_ms, s_ms AS e_ms FROM ed) SELECT rec_id, s_ms, e_ms FROM cp WHERE e_ms > s_ms"
)

# One keep a step; outs has the chains that the step settles, a blank waits in hp, hs, he.
_SPANS = (
    f"{G}, v0 AS (SELECT doc_id AS rec_id, n AS pos, CASE WHEN (doc_id + n) % 9 = 4 THEN '' WHEN n % 3 = 1 THEN coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY n), line) ELSE line END AS text, 1000 * n - 400 * (n * 7919 % 3) AS s, 700 + 300 * (length(line) % 5) AS d FROM g), "
    "v1 AS (SELECT rec_id, pos, s, s + d AS e, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+|[^\\sa-z0-9_]')) AS ws FROM v0), v2 AS (SELECT *, len(ws) = 0 AS blank FROM v1)"
)
_JAC = "CASE WHEN len(list_distinct(ws || b)) = 0 THEN 100 ELSE floor(100 * len(list_intersect(ws, b)) / len(list_distinct(ws || b))) END"
_SAFE = (
    f"{_SPANS}, v3 AS (SELECT *, lag(ws) OVER (PARTITION BY rec_id ORDER BY pos) AS b FROM v2), v4 AS (SELECT *, coalesce({_JAC} >= 85, false) AS near, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS i FROM v3), "
    "sf AS (SELECT rec_id, i, pos, blank, 1::BIGINT AS chain, s AS ss, e AS se FROM v4 WHERE i = 1 UNION ALL SELECT rec_id, i, pos, blank, CASE WHEN j THEN chain ELSE chain + 1 END, CASE WHEN j THEN least(ss, s) ELSE s END, CASE WHEN j THEN greatest(se, e) ELSE e END FROM "
    "(SELECT v4.*, sf.chain, sf.ss, sf.se, v4.near AND least(sf.se, v4.e) - greatest(sf.ss, v4.s) > 0 AND v4.s >= sf.ss AS j FROM sf JOIN v4 ON v4.rec_id = sf.rec_id AND v4.i = sf.i + 1)) "
    "SELECT rec_id, pos, chain, pos <> max(pos) OVER (PARTITION BY rec_id, chain) AS removed FROM sf"
)
_BRIDGED = (
    f"{_SPANS}, v3 AS (SELECT *, last_value(CASE WHEN NOT blank THEN ws END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v2), v4 AS (SELECT *, coalesce({_JAC} >= 75, false) AS near, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS i FROM v3), "
    "ag AS (SELECT DISTINCT rec_id, 0::BIGINT AS i, 0::BIGINT AS chain, NULL::BIGINT AS ss, NULL::BIGINT AS se, NULL::BIGINT AS hp, NULL::BIGINT AS hs, NULL::BIGINT AS he, [{'p': 0::BIGINT, 'c': 0::BIGINT}] AS outs FROM v4 UNION ALL "
    "SELECT rec_id, i, CASE WHEN blank THEN chain + lets WHEN j THEN chain ELSE chain + lets + 1 END, CASE WHEN blank THEN CASE WHEN lets = 1 THEN NULL ELSE ss END WHEN j THEN least(ss, hs, s) ELSE s END, "
    "CASE WHEN blank THEN CASE WHEN lets = 1 THEN NULL ELSE se END WHEN j THEN greatest(se, he, e) ELSE e END, CASE WHEN blank THEN pos END, CASE WHEN blank THEN s END, CASE WHEN blank THEN e END, "
    "CASE WHEN blank THEN CASE WHEN lets = 1 THEN [{'p': hp, 'c': chain + 1}] ELSE [] END ELSE CASE WHEN lets = 1 THEN [{'p': hp, 'c': CASE WHEN j THEN chain ELSE chain + 1 END}] ELSE [] END || [{'p': pos, 'c': CASE WHEN j THEN chain ELSE chain + lets + 1 END}] END FROM "
    "(SELECT v4.*, ag.chain, ag.ss, ag.se, ag.hp, ag.hs, ag.he, CASE WHEN ag.hp IS NULL THEN 0 ELSE 1 END AS lets, "
    "coalesce(v4.near AND (least(ag.se, v4.e) - greatest(ag.ss, v4.s) > 0 OR (ag.hp IS NOT NULL AND v4.s - ag.se <= greatest(0, ag.he - ag.hs) + 50)) AND v4.s >= ag.ss, false) AS j FROM ag JOIN v4 ON v4.rec_id = ag.rec_id AND v4.i = ag.i + 1)), "
    "en AS (SELECT rec_id, unnest(outs) AS o FROM ag WHERE i > 0 UNION ALL SELECT rec_id, {'p': hp, 'c': chain + 1} FROM ag WHERE hp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY i DESC) = 1 AND i = (SELECT max(i) FROM v4 WHERE v4.rec_id = ag.rec_id)), "
    "ch AS (SELECT v4.rec_id, v4.pos, o.c AS chain, v4.blank, v4.s, v4.e FROM v4 JOIN en ON en.rec_id = v4.rec_id AND o.p = v4.pos), "
    "cr AS (SELECT *, pos <> coalesce(max(CASE WHEN NOT blank THEN pos END) OVER q, max(pos) OVER q) AS removed FROM ch WINDOW q AS (PARTITION BY rec_id, chain))"
)

ORACLES = {
    "m03_latest_anchors": f"WITH RECURSIVE {_ANCHORS}",
    "m08_m14_own_matches": f"WITH {_OWN} SELECT * FROM om",
    "a12_method_counts": f"WITH {_OWN} SELECT rec_id, count(*) AS n_lines, count(*) FILTER (method = 'anchor') AS anchor, count(*) FILTER (method LIKE 'relaxed%') AS relaxed, count(*) FILTER (reason = 'no-anchor') AS no_anchor, count(*) FILTER (reason = 'distance') AS distance, CAST(sum(anchor_hits) AS BIGINT) AS anchor_hits FROM om GROUP BY rec_id",
    "d10_lines_to_keeps": f"WITH RECURSIVE {_LINE_KEEPS} SELECT rec_id, s_ms, e_ms FROM fr",
    "d10_lines_to_cuts": f"WITH RECURSIVE {_LINE_CUTS}",
    "d06_safe_chains": f"WITH RECURSIVE {_SAFE}",
    "d06_aggressive_chains": f"WITH RECURSIVE {_BRIDGED} SELECT rec_id, pos, chain, removed FROM cr",
    "d06_aggressive_totals": f"WITH RECURSIVE {_BRIDGED}, ct AS (SELECT rec_id, chain, max(e) - min(s) AS ms FROM cr GROUP BY ALL), ca AS (SELECT rec_id, count(*) AS after, CAST(sum(greatest(ms, 0)) AS BIGINT) AS ms_after FROM ct GROUP BY rec_id), cb AS (SELECT rec_id, count(*) AS before, CAST(sum(greatest(e - s, 0)) AS BIGINT) AS ms_before, count(*) FILTER (removed) AS removed FROM cr GROUP BY rec_id) SELECT rec_id, before, after, ms_before, ms_after, removed FROM cb JOIN ca USING (rec_id)",
}
