"""Queries of whole chains (best path, keep-last, sentence review) and of the steps between texts and times, on relations T and W."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from takeweave.operators import align, matching
from takeweave.operators import intervals as iv
from takeweave.operators import retake as rt
from takeweave.plans.fixtures import T, W, table, takes, words
from takeweave.queries.intervals import _CL, _M, _MONO, _NEAR, _TOT, DAY, GAP, HOUR, SHORT, _b, _iv, _totals
from takeweave.queries.text import _FOLD, _GRAMS, _lines, _stream
from takeweave.sources import readers
from takeweave.streaming import jobs

LOW = 0.5
LIMIT = 1_200_000
#: Letter classes of the weighted distance: vowels, stops, hisses, nasals and liquids.
CLASSES = ("eiouydgpktzcnr", "aaaaabbbbbssml")


def _long_takes(s, d):
    return takes(s, d).withColumn("length", F.floor((F.col("t1") - F.col("t0")) / 1000))


def _best_path(s, d):
    return rt.path_values(rt.best_path(rt.clusters(_long_takes(s, d), DAY))).select("rec_id", F.round("value", 6).alias("value"))


def _keep_last(s, d):
    keeps = rt.keep_last_pipeline(_long_takes(s, d), _b(s, d), DAY, snap_ms=HOUR, gap_ms=GAP, min_ms=SHORT)
    return rt.keep_ratio(keeps, _iv(s, d))


def _keep_last_cuts(s, d):
    keeps = rt.keep_last_pipeline(_long_takes(s, d), _b(s, d), DAY, snap_ms=HOUR, gap_ms=GAP, min_ms=SHORT)
    return iv.split_long(iv.complement(keeps, _totals(s, d)), DAY)


def _review(s, d):
    hits = takes(s, d).withColumn("length", 3 * F.length("k"))
    return rt.sentence_review_pipeline(hits, _b(s, d), _totals(s, d), gap_ms=DAY, span_gap_ms=HOUR, snap_ms=HOUR, join_ms=GAP, min_ms=SHORT, low=LOW)


def _offsets(s, d):
    hi = F.sum(F.length("text")).over(Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return words(s, d).select("rec_id", "idx", (hi - F.length("text")).alias("lo"), hi.alias("hi"))


def _touched(s, d):
    o = _offsets(s, d)
    return matching.tokens_of_spans(o.select("rec_id", F.col("idx").alias("id"), (F.col("lo") + 1).alias("lo"), (F.col("hi") + 4).alias("hi")), o)


def _union(s, d):
    of = lambda k: takes(s, d).where(F.col("k") == k).select("rec_id", F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"))
    return iv.union_merged(of("click"), of("error"), _totals(s, d))


def _turn_pairs(s, d):
    plain = F.regexp_replace(F.translate(F.lower("text"), align.ACCENTED, align.PLAIN), "[^ -~]", "?")
    nxt = F.lead(plain).over(Window.partitionBy("conv_id").orderBy("turn", "role", plain))
    pairs = table(s, d, "conversations").select("conv_id", "turn", plain.alias("a"), nxt.alias("b")).where("b is not null")
    return pairs.select("conv_id", "turn", align.weighted_distance(F.col("a"), F.col("b"), CLASSES).alias("dist"))


def _sweep(s, d):
    lines = _turns(s, d)
    stream = lines.groupBy("rec_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "words"))), lambda x: x["words"])).alias("words"))
    return align.backward_sweep(lines, stream)


def _turns(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("no"), align.folded_words(F.col("text")).alias("words"))


def _bare_words(c):
    """Words of a text with other letters than a to z as x: the SQL's edit distance counts bytes."""
    return F.transform(align.folded_words(c), lambda w: F.regexp_replace(w, "[^a-z0-9]", "x"))


def _whole(s, d):
    """Sentences of the turns looked for in the words of all turns of their conversation: repeated ones have more matches than one."""
    stops = F.regexp_extract_all("text", F.lit("[^.!?\n]+"), F.lit(0))
    c = table(s, d, "conversations")
    lines = c.select(F.col("conv_id").alias("rec_id"), "turn", F.posexplode(stops).alias("p", "t")).select("rec_id", (F.col("turn") * 100_000 + F.col("p")).alias("no"), _bare_words(F.col("t")).alias("words"))
    turns = c.select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("no"), _bare_words(F.col("text")).alias("words"))
    stream = turns.groupBy("rec_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "words"))), lambda x: x["words"])).alias("words"))
    return align.whole_windows(lines, stream)


def _silences(s, d):
    t = takes(s, d).withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("t0", "t1", "cand_id")))
    second = lambda c: (F.col(c) / 1000).cast("string")
    rows = F.array(F.struct((F.col("n") * 2).alias("line_no"), F.concat(F.lit("[silencedetect] silence_start: "), second("t0")).alias("line")), F.struct((F.col("n") * 2 + 1).alias("line_no"), F.concat(F.lit("[silencedetect] silence_end: "), second("t1"), F.lit(" | silence_duration: 1")).alias("line")))
    return readers.silences(t.select("rec_id", F.explode(rows).alias("r")).select("rec_id", "r.*"))


def _mapping(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("vs"))
    return readers.mapping(j.select(F.col("r_regionkey").alias("rec_id"), F.to_json(F.create_map("r_name", "vs")).alias("content")))


def _greedy(s, d):
    return matching.greedy_order(takes(s, d).select("rec_id", F.col("cand_id").alias("line"), F.col("t0").alias("s"), F.col("t1").alias("e")))


QUERIES = {
    "m12_whole_windows": _whole,
    "d04_best_path": _best_path,
    "d10_keep_last_pipeline": _keep_last,
    "d10_keep_last_cuts": _keep_last_cuts,
    "d11_sentence_review": _review,
    "i11_fold_short": lambda s, d: iv.folded(_iv(s, d), SHORT),
    "i13_split_at_boundaries": lambda s, d: iv.split_at_boundaries(_iv(s, d), _b(s, d), LIMIT),
    "u01_pauses_and_silences": _union,
    "j06_tokens_of_spans": _touched,
    "p04_score_gate": lambda s, d: rt.score_gate(takes(s, d)).select("rec_id", "cand_id"),
    "o02_top_missing_grams": lambda s, d: align.top_missing_grams(_lines(s, d), _stream(s, d)),
    "m07_weighted_distance": _turn_pairs,
    "m09_backward_sweep": _sweep,
    "m15_greedy_order": _greedy,
    "s03_numbered_lines": lambda s, d: readers.numbered_lines(table(s, d, "documents").select(F.col("doc_id").alias("rec_id"), F.col("text").alias("content"))),
    "s08_mapping": _mapping,
    "s09_silences": _silences,
    "t03_last_takes": lambda s, d: jobs.finished(jobs.last_takes(jobs.event_stream(s, d)), "complete"),
}

_CTES = _CL.removeprefix("WITH ")
_FOLDED = (
    f"fo AS (SELECT rec_id, s_ms, e_ms, row_number() OVER (PARTITION BY rec_id ORDER BY s_ms, e_ms) AS rn FROM m), "
    f"fd AS (SELECT rec_id, rn, s_ms, e_ms, 1 AS gid FROM fo WHERE rn = 1 UNION ALL SELECT n.rec_id, n.rn, CASE WHEN least(n.e_ms - n.s_ms, p.e_ms - p.s_ms) < {SHORT} THEN p.s_ms ELSE n.s_ms END, "
    f"CASE WHEN least(n.e_ms - n.s_ms, p.e_ms - p.s_ms) < {SHORT} THEN greatest(p.e_ms, n.e_ms) ELSE n.e_ms END, p.gid + CASE WHEN least(n.e_ms - n.s_ms, p.e_ms - p.s_ms) < {SHORT} THEN 0 ELSE 1 END FROM fd p JOIN fo n ON n.rec_id = p.rec_id AND n.rn = p.rn + 1), "
    "fr AS (SELECT rec_id, s_ms, e_ms FROM fd QUALIFY row_number() OVER (PARTITION BY rec_id, gid ORDER BY rn DESC) = 1)"
)
_SNAPPED = f"sn AS (SELECT t.rec_id, t.t0, t.t1, {_NEAR.format(x='t.t0')} AS sb, {_NEAR.format(x='t.t1')} AS eb FROM {{src}} t), z AS (SELECT rec_id, CASE WHEN sb BETWEEN t0 AND t1 THEN sb ELSE t0 END AS s_ms, greatest(CASE WHEN sb BETWEEN t0 AND t1 THEN sb ELSE t0 END, CASE WHEN eb BETWEEN t0 AND t1 THEN eb ELSE t1 END) AS e_ms FROM sn), x AS (SELECT rec_id, greatest(s_ms - 80, 0) AS s_ms, e_ms + 120 AS e_ms FROM z WHERE e_ms > s_ms)"
_KEEPS = f"WITH RECURSIVE {_CTES}, kl AS (SELECT * FROM r WHERE is_last), {_MONO.format(src='kl')}, mk AS (SELECT * FROM mono WHERE ok), {_SNAPPED.format(src='mk')}, {_M.format(gap=GAP)}, {_FOLDED}"
_EDGES = "ed AS (SELECT rec_id, s_ms, e_ms FROM fr UNION ALL SELECT rec_id, total_ms, total_ms FROM tot), cp AS (SELECT rec_id, coalesce(max(e_ms) OVER (PARTITION BY rec_id ORDER BY s_ms, e_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s_ms AS b FROM ed)"
_GATED = _CTES.replace(", a AS (", f", gt AS (SELECT * FROM t WHERE score >= {LOW}), a AS (", 1).replace("FROM t WINDOW", "FROM gt WINDOW", 1)
_PLAIN = f"regexp_replace(translate(lower(text), '{align.ACCENTED}', '{align.PLAIN}'), '[^ -~]', '?', 'g')"
_KEYED = f"translate({{c}}, '{CLASSES[0]}', '{CLASSES[1]}')"

_BARE_WORDS = f"list_filter(list_transform({_FOLD}, lambda w: regexp_replace(w, '[^a-z0-9]', 'x', 'g')), lambda w: w <> '')"
_WHOLE = (
    f"tn AS (SELECT conv_id AS rec_id, turn AS no, {_BARE_WORDS} AS ws FROM conversations), sn AS (SELECT conv_id, turn * 100000 + generate_subscripts(ts, 1) - 1 AS no, unnest(ts) AS text FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?\\n]+') AS ts FROM conversations)), "
    f"l AS (SELECT rec_id, no, len(ws) AS n, array_to_string(ws, '') AS x, CASE WHEN len(ws) <= 6 THEN 2 ELSE greatest(1, CAST(round(len(ws) * 0.2) AS INTEGER)) END AS slack, CASE WHEN len(ws) <= 6 THEN 75 ELSE 80 END AS need FROM (SELECT conv_id AS rec_id, no, {_BARE_WORDS} AS ws FROM sn) WHERE len(ws) > 0), "
    "sw AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY no, i) - 1 AS idx, w FROM (SELECT rec_id, no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tn)), st AS (SELECT rec_id, list(w ORDER BY idx) AS ws FROM sw GROUP BY rec_id), "
    "nn AS (SELECT DISTINCT rec_id, n, slack FROM l), win AS (SELECT rec_id, n, idx AS start, unnest(range(greatest(n - slack, 1), n + slack + 1)) AS k FROM nn JOIN sw USING (rec_id)), "
    "ty AS (SELECT rec_id, n, start, k, array_to_string(ws[start + 1:start + k], '') AS y FROM win JOIN st USING (rec_id) WHERE start + k <= len(ws)), "
    "tx AS (SELECT rec_id, no, x, y, need, start, k, greatest(length(x), length(y)) AS m FROM ty JOIN l USING (rec_id, n)), "
    "ok AS (SELECT *, CASE WHEN 100 * abs(length(x) - length(y)) <= (100 - need) * m THEN levenshtein(x, y) END AS e FROM tx) "
    "SELECT rec_id, no, CAST(start AS INTEGER) AS start, CAST(k AS INTEGER) AS n_words, CAST(100 * (m - e) // m AS INTEGER) AS percent, count(*) OVER (PARTITION BY rec_id, no) - 1 AS earlier FROM ok WHERE 100 * (m - e) >= need * m QUALIFY row_number() OVER (PARTITION BY rec_id, no ORDER BY start + k DESC, e / m, k DESC) = 1"
)
#: SQL of m12_whole_windows: every window against every line, too slow to register; the tests hold the query against plain Python on a fixture.
WHOLE_SQL = f"WITH {_WHOLE}"
ORACLES = {
    "d04_best_path": f"WITH RECURSIVE {_CTES}, ord AS (SELECT rec_id, t0, t1, CAST(coalesce(score, 0) + least(0.2, 0.01 * greatest(floor((t1 - t0) / 1000), 0)) + 0.05 * greatest(rank, 1) + CASE WHEN is_last THEN 0 ELSE -0.1 END AS DOUBLE) AS w, row_number() OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id) AS rn FROM r), "
    "dp AS (SELECT rec_id, rn, [{'v': w, 't1': t1}] AS st FROM ord WHERE rn = 1 UNION ALL SELECT n.rec_id, n.rn, list_append(p.st, {'v': n.w + greatest(0::DOUBLE, coalesce(list_max(list_transform(list_filter(p.st, lambda y: y.t1 <= n.t0 + 20), lambda y: y.v + CASE WHEN n.t0 - y.t1 > 3600000 THEN -0.2::DOUBLE ELSE 0::DOUBLE END)), 0::DOUBLE)), 't1': n.t1}) FROM dp p JOIN ord n ON n.rec_id = p.rec_id AND n.rn = p.rn + 1) "
    "SELECT rec_id, round(list_max(list_transform(st, lambda y: y.v)), 6) AS value FROM dp QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY rn DESC) = 1",
    "d10_keep_last_pipeline": _KEEPS + ", kk AS (SELECT rec_id, CAST(sum(e_ms - s_ms) AS BIGINT) AS keep_ms FROM fr GROUP BY rec_id), tt AS (SELECT rec_id, max(t1) - min(t0) AS total_ms FROM t GROUP BY rec_id) SELECT tt.rec_id, coalesce(keep_ms, 0) AS keep_ms, total_ms, CASE WHEN total_ms > 0 THEN greatest(0.0, least(1.0, 1 - coalesce(keep_ms, 0) / total_ms)) ELSE 0.0 END AS cut_ratio FROM tt LEFT JOIN kk USING (rec_id)",
    "d10_keep_last_cuts": _KEEPS + f", {_TOT}, {_EDGES}, pc AS (SELECT rec_id, b, unnest(generate_series(a, b - 1, {DAY})) AS s FROM cp WHERE b > a) SELECT rec_id, s AS s_ms, least(s + {DAY}, b) AS e_ms FROM pc",
    "d11_sentence_review": f"WITH RECURSIVE {_GATED}, fin AS (SELECT * FROM r WHERE is_last OR 3 * length(k) < 12), a2 AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id) > {HOUR} THEN 1 ELSE 0 END AS f2 FROM fin), b2 AS (SELECT *, sum(f2) OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id ROWS UNBOUNDED PRECEDING) AS span FROM a2), "
    f"sp AS (SELECT rec_id, min(t0) AS t0, max(t1) AS t1 FROM b2 GROUP BY rec_id, span), {_SNAPPED.format(src='sp')}, {_M.format(gap=GAP)}, {_FOLDED}, {_TOT} SELECT * FROM fr UNION ALL SELECT rec_id, 0, total_ms FROM tot WHERE total_ms > 0 AND rec_id NOT IN (SELECT rec_id FROM fr)",
    "i11_fold_short": f"WITH RECURSIVE {T}, m AS (SELECT rec_id, t0 AS s_ms, t1 AS e_ms FROM t), {_FOLDED} SELECT * FROM fr",
    "i13_split_at_boundaries": f"WITH RECURSIVE {T}, pts AS (SELECT rec_id, list(DISTINCT t0) AS ps FROM t WHERE k = 'error' GROUP BY rec_id), rc AS (SELECT t.rec_id, cand_id, t0 AS a, t1 AS e, coalesce(ps, []) AS ps FROM t LEFT JOIN pts USING (rec_id) WHERE t1 > t0 UNION ALL SELECT rec_id, cand_id, coalesce(list_max(list_filter(ps, lambda p: p >= a + 1500 AND p <= least(e - 1500, a + {LIMIT}))), a + {LIMIT}), e, ps FROM rc WHERE e - a > {LIMIT}) SELECT rec_id, a AS s_ms, coalesce(lead(a) OVER (PARTITION BY rec_id, cand_id ORDER BY a), e) AS e_ms FROM rc",
    "u01_pauses_and_silences": f"WITH {T}, {_TOT}, x AS (SELECT rec_id, greatest(t0, 0) AS s_ms, least(t1, total_ms) AS e_ms FROM t JOIN tot USING (rec_id) WHERE k IN ('click', 'error') AND least(t1, total_ms) > greatest(t0, 0)), {_M.format(gap=0)} SELECT rec_id, s_ms, e_ms FROM m",
    "j06_tokens_of_spans": f"WITH {W}, o AS (SELECT rec_id, idx, CAST(sum(length(text)) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, length(text) AS n FROM w) SELECT a.rec_id, a.idx AS id, min(b.idx) AS first_idx, max(b.idx) AS last_idx FROM o a JOIN o b ON a.rec_id = b.rec_id AND b.hi - b.n < a.hi + 4 AND b.hi > a.hi - a.n + 1 AND b.n > 0 GROUP BY ALL",
    "p04_score_gate": f"WITH {T} SELECT rec_id, cand_id FROM t WHERE score >= 0.78",
    "o02_top_missing_grams": f"WITH {_GRAMS} SELECT gram, count(DISTINCT item_id) AS lines FROM lg WHERE gram NOT IN (SELECT gram FROM sg) GROUP BY gram ORDER BY lines DESC, gram LIMIT 20",
    "m07_weighted_distance": f"WITH p AS (SELECT conv_id, turn, {_PLAIN} AS a, lead({_PLAIN}) OVER (PARTITION BY conv_id ORDER BY turn, role, {_PLAIN}) AS b FROM conversations) SELECT conv_id, turn, CAST(0.25 * levenshtein(a, b) + 0.75 * levenshtein({_KEYED.format(c='a')}, {_KEYED.format(c='b')}) AS DOUBLE) AS dist FROM p WHERE b IS NOT NULL",
    "m09_backward_sweep": f"WITH ln AS (SELECT conv_id AS rec_id, turn AS no, {_FOLD} AS ws FROM conversations), sm AS (SELECT rec_id, flatten(list(ws ORDER BY no, ws)) AS sw FROM ln GROUP BY rec_id), wn AS (SELECT rec_id, no, ws, sw, greatest(len(ws), 6) AS sz FROM ln JOIN sm USING (rec_id)), st AS (SELECT *, unnest(generate_series(greatest(len(sw) - sz, 0), 0, -(sz // 2))) AS start FROM wn), "
    "ds AS (SELECT rec_id, no, start, array_to_string(ws, ' ') AS a, array_to_string(sw[start+1:start+sz], ' ') AS b, levenshtein(a, b) AS dist FROM st) SELECT rec_id, no, CAST(start AS INTEGER) AS start, CAST(dist AS INTEGER) AS dist FROM ds WHERE dist <= greatest(length(a), length(b)) * 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY rec_id, no ORDER BY start DESC) = 1",
    "m15_greedy_order": f"WITH RECURSIVE {T}, go AS (SELECT rec_id, cand_id AS line, t0 AS s, t1 AS e, row_number() OVER (PARTITION BY rec_id ORDER BY cand_id, t0, t1) AS rn FROM t), gr AS (SELECT rec_id, rn, line, s, e, e AS upto, true AS ok FROM go WHERE rn = 1 UNION ALL SELECT n.rec_id, n.rn, n.line, n.s, n.e, CASE WHEN n.s < p.upto THEN p.upto ELSE n.e END, n.s >= p.upto FROM gr p JOIN go n ON n.rec_id = p.rec_id AND n.rn = p.rn + 1) SELECT rec_id, line, s, e FROM gr WHERE ok",
    "s03_numbered_lines": "WITH a AS (SELECT doc_id AS rec_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents) SELECT rec_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS text, contains(unnest(ls), chr(65533)) AS replaced FROM a",
    "s08_mapping": "SELECT r_name AS key, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey",
    "s09_silences": f"WITH {T}, x AS (SELECT rec_id, t0 AS s_ms, t1 AS e_ms FROM t WHERE t1 > t0), {_M.format(gap=1)} SELECT rec_id, s_ms, e_ms FROM m",
    "t03_last_takes": "WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) > 86400000000 THEN 1 ELSE 0 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, event_type, epoch_us(min(ts)) // 1000 AS start_ms, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM b GROUP BY user_id, event_type, g",
}
