"""Queries of lines found in streams and of their review, on relations N, D, W and T."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.operators import align, matching
from takeweave.plans.fixtures import T, W, table, takes, words
from takeweave.queries.text import _FOLD, _GRAMS, ALIASES

LOW = 0.5


def _words(s, d, name, key):
    return table(s, d, name).select(key, align.folded_words(F.col("text")).alias("words"))


def _lines(s, d):
    return _words(s, d, "benchmark", "item_id")


def _stream(s, d):
    return _words(s, d, "documents", "doc_id")


def _five(s, d):
    return words(s, d).select("rec_id", F.col("idx").alias("id"), F.col("idx").alias("start"), F.lit(5).cast("long").alias("n_words"))


def _reviewed(s, d):
    t = takes(s, d)
    lost = F.col("k") == "error"
    return t.select("rec_id", F.col("cand_id").alias("no"), F.when(~lost, F.col("t0")).alias("t0"), F.when(~lost, F.col("t1")).alias("t1"), "score", F.concat("k", F.lit(" "), "cand_id").alias("text"))


def _totals(s, d):
    return takes(s, d).groupBy("rec_id").agg(F.max("t1").alias("total_ms"))


QUERIES = {
    "m01_token_stream": lambda s, d: matching.token_stream(words(s, d), ALIASES),
    "j13_alias_hits": lambda s, d: matching.alias_hits(_stream(s, d), "doc_id", {"we": ["the", "of the"], "it": ["this"]}),
    "m04_fast_candidates": lambda s, d: matching.fast_candidates(_lines(s, d), _stream(s, d)),
    "m10_partial": lambda s, d: matching.partial_matches(_lines(s, d), _stream(s, d)),
    "m11_sentence_hits": lambda s, d: matching.sentence_hits(_lines(s, d), _stream(s, d)),
    "a13_review_stats": lambda s, d: matching.review_stats(_lines(s, d), matching.sentence_hits(_lines(s, d), _stream(s, d))),
    "m13_hit_times": lambda s, d: matching.hit_times(_five(s, d), words(s, d)),
    "m14_relaxed": lambda s, d: matching.relaxed_matches(_lines(s, d), _stream(s, d)),
    "m17_review_points": lambda s, d: matching.review_points(_reviewed(s, d), LOW),
    "k04_sentence_markers": lambda s, d: matching.sentence_markers(_reviewed(s, d), LOW),
    "k07_sentence_edit_list": lambda s, d: matching.sentence_edit_list(_reviewed(s, d), _totals(s, d), LOW),
}

_TOKEN = "CASE WHEN lower(text) IN ('teh', 'thhe') THEN 'the' WHEN lower(text) = 'annd' THEN 'and' WHEN lower(text) = 'an an' THEN 'and' WHEN lower(text) = 'off' THEN 'of' END"
_LV = (
    f"l AS (SELECT item_id, {_FOLD} AS ws FROM benchmark), st AS (SELECT doc_id, {_FOLD} AS ws FROM documents), "
    "lk AS (SELECT item_id, k, i AS o, array_to_string(ws[i+1:i+k], ' ') AS gram FROM (SELECT item_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM l, range(3, 6) r(k) WHERE len(ws) >= k)), "
    "sk AS (SELECT doc_id, k, i AS pos, array_to_string(ws[i+1:i+k], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM st, range(3, 6) r(k) WHERE len(ws) >= k))"
)
_OCC = "oc AS (SELECT lg.item_id, sg.doc_id, CAST(sg.pos AS BIGINT) AS start, CAST(len(l.ws) AS BIGINT) AS n_words, 1.0::DOUBLE AS score, 'strict' AS kind FROM lg JOIN sg USING (gram) JOIN l ON l.item_id = lg.item_id JOIN st ON st.doc_id = sg.doc_id WHERE lg.o = 0 AND st.ws[sg.pos+1:sg.pos+len(l.ws)] = l.ws)"
_PART = (
    "dg AS (SELECT item_id, doc_id, pos, pos - o AS d, o - row_number() OVER (PARTITION BY item_id, doc_id, pos - o ORDER BY o) AS isl FROM lg JOIN sg USING (gram)), "
    "rn AS (SELECT item_id, doc_id, count(*) + 2 AS run, min(pos) AS start FROM dg GROUP BY item_id, doc_id, d, isl), "
    "bs AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY run DESC, doc_id, start) = 1), "
    "pm AS (SELECT item_id, doc_id, CAST(start AS BIGINT) AS start, CAST(run AS BIGINT) AS n_words, round(run / len(ws), 9) AS score FROM bs JOIN l USING (item_id) WHERE 100 * run >= 50 * len(ws))"
)
_HITS = f"{_GRAMS}, {_OCC}, {_PART}, hits AS (SELECT * FROM oc UNION ALL SELECT *, 'fuzzy' FROM pm WHERE item_id NOT IN (SELECT item_id FROM oc))"
_REV = f"{T}, q AS (SELECT rec_id, cand_id AS no, CASE WHEN k <> 'error' THEN t0 END AS t0, CASE WHEN k <> 'error' THEN t1 END AS t1, t1 AS t1x, score, k || ' ' || cand_id AS text FROM t), rp AS (SELECT rec_id, no, coalesce(t0, max(t1) OVER (PARTITION BY rec_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ms, CASE WHEN t0 IS NULL THEN 'no_match' WHEN score < {LOW} THEN 'low_conf' END AS reason FROM q)"


def _relaxed_sql() -> str:
    parts, before = [f"WITH l AS (SELECT item_id, {_FOLD} AS ws FROM benchmark), st AS (SELECT doc_id, {_FOLD} AS ws FROM documents)"], []
    for stage, (n, ratio) in enumerate(((5, 0.35), (4, 0.46), (3, 0.55)), 1):
        free = " AND ".join(["true", *[f"item_id NOT IN (SELECT item_id FROM f{b})" for b in before]])
        parts.append(
            f"a{stage} AS (SELECT item_id, i AS o, array_to_string(ws[i+1:i+{n}], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(0, len(ws) - {n - 1})) AS i FROM l WHERE len(ws) >= {n} AND {free})), "
            f"b{stage} AS (SELECT doc_id, i AS pos, array_to_string(ws[i+1:i+{n}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {n - 1})) AS i FROM st WHERE len(ws) >= {n})), "
            f"c{stage} AS (SELECT item_id, doc_id, greatest(pos - o, 0) AS start, count(*) AS hits FROM a{stage} JOIN b{stage} USING (gram) GROUP BY 1, 2, 3), "
            f"e{stage} AS (SELECT c.*, array_to_string(l.ws, ' ') AS x, array_to_string(st.ws[start+1:start+len(l.ws)], ' ') AS y, levenshtein(x, y) AS dist FROM c{stage} c JOIN l USING (item_id) JOIN st USING (doc_id)), "
            f"f{stage} AS (SELECT item_id, doc_id, CAST(start AS INTEGER) AS start, CAST(dist AS INTEGER) AS dist, hits, {stage} AS stage FROM e{stage} WHERE dist <= greatest(length(x), length(y)) * {ratio}::DOUBLE QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY dist, start DESC) = 1)"
        )
        before.append(stage)
    return ", ".join(parts) + " SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3"


ORACLES = {
    "m01_token_stream": f"WITH {W}, a AS (SELECT rec_id, idx, {_TOKEN} AS named, coalesce(named, lower(text)) AS token FROM w), b AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM a) SELECT rec_id, idx, token, hi - length(token) AS lo, hi, named IS NOT NULL AS alias_hit FROM b",
    "j13_alias_hits": f"WITH st AS (SELECT doc_id, {_FOLD} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS v FROM st UNION ALL SELECT doc_id, array_to_string(ws[i+1:i+2], ' ') FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 1)) AS i FROM st)), al(canonical, variant) AS (VALUES ('we', 'the'), ('we', 'of the'), ('it', 'this')) SELECT doc_id, canonical, variant, count(*) AS n FROM u JOIN al ON v = variant GROUP BY ALL",
    "m04_fast_candidates": f"WITH {_LV}, h AS (SELECT item_id, doc_id, lk.k AS k, greatest(pos - o, 0) AS start, count(*) AS hits FROM lk JOIN sk ON lk.k = sk.k AND lk.gram = sk.gram GROUP BY ALL), m AS (SELECT * FROM h QUALIFY k = max(k) OVER (PARTITION BY item_id, doc_id)) SELECT item_id, doc_id, CAST(start AS INTEGER) AS start, CAST(k AS INTEGER) AS k, hits FROM m",
    "m10_partial": f"WITH {_GRAMS}, {_PART} SELECT * FROM pm",
    "m11_sentence_hits": f"WITH {_HITS} SELECT * FROM hits",
    "a13_review_stats": f"WITH {_HITS}, per AS (SELECT item_id, max(score) AS score, min(kind) AS kind, count(*) AS spans, max(n_words) AS longest FROM hits GROUP BY item_id) SELECT count(*) AS lines, count(*) FILTER (score >= 0.8) AS matched, count(*) FILTER (score < 0.8) AS low_conf, count(*) FILTER (score IS NULL) AS unmatched, count(*) FILTER (kind = 'strict') AS strict, count(*) FILTER (kind = 'fuzzy') AS fuzzy, CAST(coalesce(sum(spans), 0) AS BIGINT) AS spans, coalesce(max(longest), 0) AS longest FROM l LEFT JOIN per USING (item_id)",
    "m13_hit_times": f"WITH {W}, x AS (SELECT *, max(idx) OVER (PARTITION BY rec_id) AS top FROM w) SELECT a.rec_id, a.idx AS id, a.start_ms AS s_ms, b.end_ms AS e_ms FROM x a JOIN x b ON a.rec_id = b.rec_id AND b.idx = least(a.idx + 4, a.top)",
    "m14_relaxed": _relaxed_sql(),
    "m17_review_points": f"WITH {_REV} SELECT * FROM rp WHERE reason IS NOT NULL",
    "k04_sentence_markers": f"WITH {_REV} SELECT rec_id, 'L' || no AS name, t0 AS at_ms, left(text, 64) AS comment FROM q WHERE t0 IS NOT NULL UNION ALL SELECT rec_id, 'R' || no, at_ms, CASE WHEN reason = 'low_conf' THEN '[review-low] ' ELSE '[review] ' END || left(text, 64) FROM rp JOIN q USING (rec_id, no) WHERE reason IS NOT NULL",
    "k07_sentence_edit_list": f"WITH {_REV}, kp AS (SELECT rec_id, t0 AS s_ms, t1 AS e_ms FROM q WHERE t0 IS NOT NULL AND score >= {LOW}) SELECT * FROM kp UNION ALL SELECT rec_id, 0, max(t1x) FROM q WHERE rec_id NOT IN (SELECT rec_id FROM kp) GROUP BY rec_id",
}
