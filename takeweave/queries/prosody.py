"""Queries of line breaks: clauses of documents, and candidates and best breaks of recordings, on relations D and W."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.operators import prosody, segment
from takeweave.plans.fixtures import W, table, words
from takeweave.queries.text import _SENT, _STOP

PHRASES = (" and", " but", " because", " und", " et")
CUES = ("and", "but", "so")
LEAST, MOST = 12, 60


def _clauses(s, d):
    return prosody.clause_split(segment.sentences(table(s, d, "documents")), PHRASES, least=LEAST, most=MOST)


def _candidates(s, d):
    return prosody.break_candidates(words(s, d), cues=CUES)


def _best(s, d):
    w = words(s, d)
    return prosody.best_breaks(prosody.break_candidates(w, cues=CUES), w.where("trim(text) <> ''").groupBy("rec_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("n")))


QUERIES = {"g08_clauses": _clauses, "g10_break_candidates": _candidates, "g11_best_breaks": _best}

_listed = lambda chars: "(" + ", ".join("'" + c.replace("'", "''") + "'" for c in dict.fromkeys(chars)) + ")"
_ends_in = lambda phrases, at: " OR ".join(f"array_to_string(list_slice(cs, {at} - {len(p) - 1}, {at}), '') = '{p}'" for p in phrases)
_LONGEST = max(map(len, PHRASES))
_TAIL = " || ".join([*[f"lag(c, {k}, '') OVER o" for k in range(_LONGEST - 1, 0, -1)], "c"])
_PHRASE_LENGTH = " ".join(f"WHEN ends_with(tail, '{p}') THEN {len(p)}" for p in PHRASES)

# Each step finds the next cut from the last one alone: the first mark that is far enough, else the last that came too early, else the bound.
_CLAUSES = (
    f"{_SENT}, ch AS (SELECT doc_id, sent_no, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT doc_id, sent_no, string_split(text, '') AS cs FROM s2)), "
    f"tl AS (SELECT doc_id, sent_no, i, c, {_TAIL} AS tail FROM ch WINDOW o AS (PARTITION BY doc_id, sent_no ORDER BY i)), "
    f"mk AS (SELECT doc_id, sent_no, CAST(i AS BIGINT) AS e, CASE {_PHRASE_LENGTH} WHEN c IN {_listed(prosody.SOFT + ';；')} THEN 1 ELSE 0 END AS t FROM tl), "
    "ml AS (SELECT doc_id, sent_no, list({'e': e, 't': t} ORDER BY e) AS ms FROM mk WHERE t > 0 GROUP BY ALL), "
    "c1 AS (SELECT doc_id, sent_no, text, CAST(length(text) AS BIGINT) AS n, coalesce(ms, []) AS ms FROM s2 LEFT JOIN ml USING (doc_id, sent_no)), "
    "c2 AS (SELECT doc_id, sent_no, n, ms, 0::BIGINT AS lo, 0::BIGINT AS hi FROM c1 UNION ALL SELECT doc_id, sent_no, n, ms, hi, "
    f"least(n, coalesce(list_min([x.e FOR x IN ms IF x.e - hi >= {LEAST} AND x.e - x.t <= hi + {MOST - 1}]), CASE WHEN hi + {MOST - 1} >= n THEN n END, list_max([x.e FOR x IN ms IF x.e > hi AND x.e - hi < {LEAST}]), hi + {MOST - 1})) FROM c2 WHERE hi < n), "
    "c3 AS (SELECT doc_id, sent_no, hi, trim(substr(text, lo + 1, hi - lo)) AS text FROM c2 JOIN s2 USING (doc_id, sent_no) WHERE hi > 0) "
    "SELECT doc_id, sent_no, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY hi) AS clause_no, text FROM c3 WHERE text <> ''"
)

_MARKS = dict.fromkeys(prosody.QUOTE_OPENS + prosody.QUOTE_CLOSES + prosody.BRACKET_OPENS + prosody.BRACKET_CLOSES)
_pushed = lambda opens, closes: "CASE c " + " ".join(f"WHEN '{o}' THEN '{k}'" for o, k in zip(opens, closes, strict=True)) + " ELSE '' END"
_next = lambda stack, opens, closes: f"CASE WHEN {stack} <> '' AND right({stack}, 1) = c THEN left({stack}, length({stack}) - 1) ELSE {stack} || {_pushed(opens, closes)} END"
_CAND = (
    f"{W}, h0 AS (SELECT rec_id, idx, string_split(text, '') AS cs, coalesce(greatest(lead(start_ms) OVER (PARTITION BY rec_id ORDER BY idx) - end_ms, 0), 0) AS gap FROM w WHERE trim(text) <> ''), "
    f"h1 AS (SELECT rec_id, idx, i, cs[i] AS c, {_ends_in(CUES, 'i')} AS cue, CASE WHEN i = len(cs) THEN gap ELSE 0 END AS gap FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM h0)), "
    "h2 AS (SELECT *, count(*) OVER o + dense_rank() OVER (PARTITION BY rec_id ORDER BY idx) - 1 AS pos FROM h1 WINDOW o AS (PARTITION BY rec_id ORDER BY idx, i ROWS UNBOUNDED PRECEDING)), "
    f"k0 AS (SELECT rec_id, pos, c, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS m FROM h2 WHERE c IN {_listed(_MARKS)}), "
    "k1 AS (SELECT DISTINCT rec_id, 0::BIGINT AS m, 0::BIGINT AS pos, '' AS q, '' AS b FROM k0 UNION ALL SELECT k0.rec_id, k0.m, k0.pos, "
    f"{_next('q', prosody.QUOTE_OPENS, prosody.QUOTE_CLOSES)}, {_next('b', prosody.BRACKET_OPENS, prosody.BRACKET_CLOSES)} FROM k1 JOIN k0 ON k0.rec_id = k1.rec_id AND k0.m = k1.m + 1), "
    "h3 AS (SELECT h2.*, coalesce(last_value(length(k1.q) IGNORE NULLS) OVER o, 0) AS quotes, coalesce(last_value(length(k1.b) IGNORE NULLS) OVER o, 0) AS brackets, max(h2.pos) OVER (PARTITION BY h2.rec_id) AS n FROM h2 LEFT JOIN k1 ON k1.rec_id = h2.rec_id AND k1.pos = h2.pos AND k1.m > 0 "
    "WINDOW o AS (PARTITION BY h2.rec_id ORDER BY h2.pos ROWS UNBOUNDED PRECEDING)), "
    f"h4 AS (SELECT *, c IN {_listed(_STOP)} AS hard, c IN {_listed(prosody.SOFT)} AS soft, gap >= 160 AS pause FROM h3), "
    "ca AS (SELECT rec_id, CAST(pos AS BIGINT) AS pos, concat_ws('+', CASE WHEN cue THEN 'cue' END, CASE WHEN hard THEN 'hard' END, CASE WHEN pause THEN 'pause' END, CASE WHEN soft THEN 'soft' END) AS reasons, CAST(CASE WHEN pause THEN gap ELSE 0 END AS BIGINT) AS pause_ms, CAST(quotes AS BIGINT) AS quotes, CAST(brackets AS BIGINT) AS brackets, "
    "round((CASE WHEN hard THEN 1.2 ELSE -0.6 END + CASE WHEN pause THEN 0.8 * (0.5 + 0.5 * least(gap / 160, 3)) ELSE 0 END + CASE WHEN cue THEN 0.5 ELSE 0 END - CASE WHEN quotes > 0 THEN 1.0 ELSE 0 END - CASE WHEN brackets > 0 THEN 0.7 ELSE 0 END)::DOUBLE, 6) AS score "
    "FROM h4 WHERE pos < n AND (hard OR soft OR cue OR pause)), tn AS (SELECT rec_id, CAST(max(pos) AS BIGINT) AS n FROM h4 GROUP BY rec_id)"
)
_LEN = "CASE WHEN {x} < 6 THEN -1.2::DOUBLE * (1 + (6 - {x}) / 6) WHEN {x} > 26 THEN -0.9::DOUBLE * (1 + ({x} - 26) / 26) ELSE CASE WHEN {x} <= 18 THEN -0.42::DOUBLE ELSE 0 END + CASE WHEN {x} >= 14 THEN 0.225::DOUBLE ELSE 0 END END"
_BEST = (
    f"{_CAND}, j0 AS (SELECT rec_id, pos, reasons, score, reasons LIKE '%hard%' AS fixed FROM ca UNION ALL SELECT rec_id, n, 'end', 0, true FROM tn), "
    "j1 AS (SELECT *, coalesce(max(CASE WHEN fixed THEN pos END) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM j0), "
    "j2 AS (SELECT rec_id, lo, max(pos) AS hi FROM j1 GROUP BY ALL), j3 AS (SELECT rec_id, lo, unnest(range(lo + 26, hi, 26)) AS pos FROM j2), "
    "j4 AS (SELECT rec_id, lo, pos, reasons, score FROM j1 UNION ALL SELECT rec_id, lo, pos, 'none', -0.3 FROM j3 WHERE (rec_id, pos) NOT IN (SELECT (rec_id, pos) FROM j1)), "
    "j5 AS (SELECT rec_id, lo, list(pos ORDER BY pos) AS ps, list(score ORDER BY pos) AS ss, list(reasons ORDER BY pos) AS rs FROM j4 GROUP BY ALL), "
    "v AS (SELECT rec_id, lo, [lo] || ps AS ps, ss, rs, 1 AS k, [0.0::DOUBLE] AS vs, [0] AS bs FROM j5 UNION ALL "
    "SELECT rec_id, lo, ps, ss, rs, k + 1, vs || [-best.back.neg], bs || [best.back.j] FROM (SELECT *, list_min([{'back': {'neg': -t, 'j': j}} FOR t, j IN ts]) AS best FROM "
    f"(SELECT *, list_transform(vs, lambda a, j: round(a + {_LEN.format(x='(ps[k + 1] - ps[j])')} + ss[k], 6)) AS ts FROM v WHERE k < len(ps)))), "
    "f AS (SELECT rec_id, ps, rs, bs, len(ps) AS z FROM v WHERE k = len(ps) UNION ALL SELECT rec_id, ps, rs, bs, bs[z] FROM f WHERE bs[z] > 1) "
    "SELECT rec_id, ps[bs[z]] AS lo, ps[z] AS hi, rs[z - 1] AS reasons FROM f"
)

ORACLES = {
    "g08_clauses": f"WITH RECURSIVE {_CLAUSES}",
    "g10_break_candidates": f"WITH RECURSIVE {_CAND} SELECT * FROM ca",
    "g11_best_breaks": f"WITH RECURSIVE {_BEST}",
}
