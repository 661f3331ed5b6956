"""Queries of windows, intervals and takes, on relations T, B, C, W and G."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from takeweave.operators import intervals as iv
from takeweave.operators import retake as rt
from takeweave.plans.fixtures import G, T, W, doc_lines, takes, words

DAY, HOUR, GAP, SHORT, LONG = 86_400_000, 3_600_000, 600_000, 300_000, 7_200_000


def _iv(s, d):
    return takes(s, d).select("rec_id", F.col("cand_id").alias("id"), F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"))


def _b(s, d):
    return takes(s, d).where("k = 'error'").select("rec_id", F.col("t0").alias("b"))


def _cuts(s, d):
    return takes(s, d).where("k = 'click'").select("rec_id", F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"))


def _totals(s, d):
    return takes(s, d).groupBy("rec_id").agg(F.max("t1").alias("total_ms"))


def _prev_end(s, d):
    w = Window.partitionBy("rec_id").orderBy("t0", "t1", "cand_id").rowsBetween(Window.unboundedPreceding, -1)
    return takes(s, d).select("rec_id", "cand_id", F.max("t1").over(w).alias("at_ms"))


def _segments(s, d):
    a = F.when(F.col("k") == "click", "cut").when((F.col("k") == "view") & (F.col("rec_id") % 2 == 0), "keep")
    return takes(s, d).select("rec_id", F.col("t0").alias("s_ms"), F.col("t1").alias("e_ms"), a.alias("action")).where("action is not null")


QUERIES = {
    "w01_word_gaps": lambda s, d: iv.word_gaps(words(s, d)),
    "w02_char_offsets": lambda s, d: words(s, d).select("rec_id", "idx", F.sum(F.length("text")).over(Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)).alias("ch_hi")),
    "w04_d02_clusters": lambda s, d: rt.clusters(takes(s, d), DAY).select("cand_id", "cluster", "rank", "is_last"),
    "d03_keep_last": lambda s, d: rt.keep_last(takes(s, d), DAY).select("rec_id", "cand_id"),
    "w05_last_by_gap": lambda s, d: rt.last_by_gap(takes(s, d), HOUR).select("rec_id", "cand_id"),
    "w06_previous_end": _prev_end,
    "i01_clamp": lambda s, d: iv.clamp(_iv(s, d), DAY, 20 * DAY),
    "i02_pauses": lambda s, d: iv.pauses(words(s, d)),
    "i03_merge": lambda s, d: iv.merge(_iv(s, d)),
    "i04_keeps_of_edit_list": lambda s, d: iv.keeps_of_edit_list(_segments(s, d), _totals(s, d)),
    "i05_complement": lambda s, d: iv.complement(_iv(s, d), _totals(s, d)),
    "i06_j08_nearest": lambda s, d: iv.nearest(takes(s, d).where("k <> 'error'").select("rec_id", F.col("cand_id").alias("id"), F.col("t0").alias("x")), _b(s, d), HOUR),
    "i07_snap": lambda s, d: iv.snap(_iv(s, d), _b(s, d), HOUR, SHORT),
    "i09_pad": lambda s, d: iv.pad(_iv(s, d)),
    "i10_merge_padded": lambda s, d: iv.merge(iv.pad(_iv(s, d)), GAP),
    "i12_split_long": lambda s, d: iv.split_long(_iv(s, d), HOUR),
    "j09_active_at": lambda s, d: iv.active_at(_b(s, d).select("rec_id", F.monotonically_increasing_id().alias("id"), F.col("b").alias("x")), _iv(s, d)).groupBy("rec_id").agg(F.count("*").alias("n"), F.sum("iv_id").alias("sum_iv")),
    "d07_monotonic": lambda s, d: rt.monotonic(takes(s, d)).select("rec_id", "cand_id"),
    "d08_adjacent_spans": lambda s, d: rt.adjacent_spans(takes(s, d), HOUR),
    "d09_merged_cuts": lambda s, d: iv.merge(_cuts(s, d)).groupBy("rec_id").agg(F.count("*").alias("n_cuts"), F.sum(F.col("e_ms") - F.col("s_ms")).alias("cut_ms")),
    "a15_region_summary": lambda s, d: takes(s, d).groupBy("rec_id").agg(F.count("*").alias("total"), F.count_if(F.col("k") != "click").alias("n_keep"), F.sum(F.when(F.col("k") != "click", F.col("t1") - F.col("t0")).otherwise(0)).alias("keep_ms")),
    "p03_regions": lambda s, d: takes(s, d).where("t1 > t0").select("rec_id", "cand_id", F.when(F.col("k").isin("click", "error"), "delete").when(F.col("k") == "view", "undecided").otherwise("keep").alias("state")),
    "p10_times": lambda s, d: takes(s, d).select("cand_id", F.format_string("%02d:%02d:%02d,%03d", F.expr("t1 div 3600000"), F.expr("t1 div 60000 % 60"), F.expr("t1 div 1000 % 60"), F.expr("t1 % 1000")).alias("srt")),
    "d_flagship_keep_last_lines": lambda s, d: rt.last_lines(doc_lines(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"), F.sum(F.when(F.col("kept"), F.length("line")).otherwise(0)).alias("kept_chars")),
    "d05_last_lines": lambda s, d: rt.last_lines(doc_lines(s, d)).where("not kept").select("doc_id", "n"),
}

_M = "o AS (SELECT rec_id, s_ms, e_ms, CASE WHEN s_ms > max(e_ms) OVER (PARTITION BY rec_id ORDER BY s_ms, e_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS f FROM x), i AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY s_ms, e_ms ROWS UNBOUNDED PRECEDING) AS g FROM o), m AS (SELECT rec_id, min(s_ms) AS s_ms, max(e_ms) AS e_ms, count(*) AS members FROM i GROUP BY rec_id, g)"
_X = "x AS (SELECT rec_id, t0 AS s_ms, t1 AS e_ms FROM t)"
_CL = f"WITH {T}, a AS (SELECT *, CASE WHEN t0 - lag(t0) OVER q > {DAY} THEN 1 ELSE 0 END AS f FROM t WINDOW q AS (PARTITION BY rec_id, k ORDER BY t0, t1, cand_id)), c AS (SELECT *, sum(f) OVER (PARTITION BY rec_id, k ORDER BY t0, t1, cand_id ROWS UNBOUNDED PRECEDING) AS cluster FROM a), r AS (SELECT *, row_number() OVER q AS rank, lead(cand_id) OVER q IS NULL AS is_last FROM c WINDOW q AS (PARTITION BY rec_id, k, cluster ORDER BY t0, t1, cand_id))"
_TOT = "tot AS (SELECT rec_id, max(t1) AS total_ms FROM t GROUP BY rec_id)"
_COMP = "ed AS (SELECT rec_id, s_ms, e_ms FROM m UNION ALL SELECT rec_id, total_ms, total_ms FROM tot), cp AS (SELECT rec_id, coalesce(max(e_ms) OVER (PARTITION BY rec_id ORDER BY s_ms, e_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s_ms AS b FROM ed)"
_NEAR = "(SELECT arg_min(b.t0, struct_pack(d := abs(b.t0 - {x}), v := b.t0)) FROM t b WHERE b.k = 'error' AND b.rec_id = t.rec_id AND abs(b.t0 - {x}) <= 3600000)"
_KEY = "lower(trim(regexp_replace(line, '[^\\p{L}\\p{N}]+', ' ', 'g')))"
_LL = f"WITH {G}, a AS (SELECT *, {_KEY} AS key FROM g), b AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY doc_id, key ORDER BY n) > 50 THEN 1 ELSE 0 END AS f FROM a), c AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, key ORDER BY n ROWS UNBOUNDED PRECEDING) AS cl FROM b), r AS (SELECT *, (lead(n) OVER (PARTITION BY doc_id, key, cl ORDER BY n) IS NULL) OR length(key) < 12 AS kept FROM c)"
_MONO = "ord AS (SELECT rec_id, cand_id, t0, t1, row_number() OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id) AS rn FROM {src}), mono AS (SELECT rec_id, cand_id, t0, t1, rn, t1 AS last_end, true AS ok FROM ord WHERE rn = 1 UNION ALL SELECT o.rec_id, o.cand_id, o.t0, o.t1, o.rn, CASE WHEN o.t0 < p.last_end - 20 THEN p.last_end ELSE o.t1 END, NOT (o.t0 < p.last_end - 20) FROM mono p JOIN ord o ON o.rec_id = p.rec_id AND o.rn = p.rn + 1)"

ORACLES = {
    "w01_word_gaps": f"WITH {W} SELECT rec_id, idx, start_ms - lag(end_ms) OVER (PARTITION BY rec_id ORDER BY idx) AS gap_ms FROM w",
    "w02_char_offsets": f"WITH {W} SELECT rec_id, idx, CAST(sum(length(text)) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ch_hi FROM w",
    "w04_d02_clusters": _CL + " SELECT cand_id, CAST(cluster AS BIGINT) AS cluster, CAST(rank AS INTEGER) AS rank, is_last FROM r",
    "d03_keep_last": _CL + " SELECT rec_id, cand_id FROM r WHERE is_last",
    "w05_last_by_gap": f"WITH {T}, a AS (SELECT *, lead(t0) OVER (PARTITION BY rec_id, k ORDER BY t0, t1, cand_id) AS nx FROM t) SELECT rec_id, cand_id FROM a WHERE nx IS NULL OR nx - t1 > {HOUR}",
    "w06_previous_end": f"WITH {T} SELECT rec_id, cand_id, max(t1) OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at_ms FROM t",
    "i01_clamp": f"WITH {T} SELECT rec_id, cand_id AS id, greatest(t0, {DAY}) AS s_ms, least(t1, {20 * DAY}) AS e_ms FROM t WHERE least(t1, {20 * DAY}) > greatest(t0, {DAY})",
    "i02_pauses": f"WITH {W}, a AS (SELECT rec_id, lag(end_ms) OVER (PARTITION BY rec_id ORDER BY idx) AS s_ms, start_ms AS e_ms FROM w) SELECT * FROM a WHERE e_ms - s_ms >= 450",
    "i03_merge": f"WITH {T}, {_X}, {_M.format(gap=0)} SELECT * FROM m",
    "i04_keeps_of_edit_list": f"WITH {T}, {_TOT}, kp AS (SELECT DISTINCT rec_id FROM t WHERE k = 'view' AND rec_id % 2 = 0), x AS (SELECT rec_id, t0 AS s_ms, t1 AS e_ms FROM t WHERE (k = 'view' AND rec_id % 2 = 0) OR (k = 'click' AND rec_id NOT IN (SELECT rec_id FROM kp))), {_M.format(gap=0)}, {_COMP} SELECT rec_id, s_ms, e_ms FROM m WHERE rec_id IN (SELECT rec_id FROM kp) UNION ALL SELECT rec_id, a, b FROM cp WHERE b > a AND rec_id NOT IN (SELECT rec_id FROM kp)",
    "i05_complement": f"WITH {T}, {_TOT}, {_X}, {_M.format(gap=0)}, {_COMP} SELECT rec_id, a AS s_ms, b AS e_ms FROM cp WHERE b > a",
    "i06_j08_nearest": f"WITH {T} SELECT rec_id, cand_id AS id, t0 AS x, {_NEAR.format(x='t.t0')} AS b FROM t WHERE k <> 'error'",
    "i07_snap": f"WITH {T}, s AS (SELECT rec_id, cand_id AS id, t0, t1, {_NEAR.format(x='t.t0')} AS sb, {_NEAR.format(x='t.t1')} AS eb FROM t), z AS (SELECT *, coalesce(sb, t0) AS s_ms, coalesce(eb, t1) AS e_ms FROM s) SELECT rec_id, id, s_ms, e_ms, CASE WHEN sb IS NOT NULL AND eb IS NOT NULL THEN 'both' WHEN sb IS NOT NULL THEN 'start' WHEN eb IS NOT NULL THEN 'end' ELSE 'no-snap' END AS label, CASE WHEN e_ms <= s_ms THEN 'invalid' WHEN e_ms - s_ms < {SHORT} THEN 'too-short' ELSE 'ok' END AS flag FROM z",
    "i09_pad": f"WITH {T} SELECT rec_id, cand_id AS id, greatest(t0 - 80, 0) AS s_ms, t1 + 120 AS e_ms FROM t",
    "i10_merge_padded": f"WITH {T}, x AS (SELECT rec_id, greatest(t0 - 80, 0) AS s_ms, t1 + 120 AS e_ms FROM t), {_M.format(gap=GAP)} SELECT * FROM m",
    "i12_split_long": f"WITH {T}, a AS (SELECT rec_id, t1, unnest(generate_series(t0, t1 - 1, {HOUR})) AS s FROM t WHERE t1 > t0) SELECT rec_id, s AS s_ms, least(s + {HOUR}, t1) AS e_ms FROM a",
    "j09_active_at": f"WITH {T}, b AS (SELECT rec_id, t0 AS x FROM t WHERE k = 'error'), h AS (SELECT b.rec_id, (SELECT arg_min(c.cand_id, struct_pack(a := c.t0, b := c.cand_id)) FROM t c WHERE c.rec_id = b.rec_id AND b.x BETWEEN c.t0 AND c.t1 + 50) AS v FROM b) SELECT rec_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_iv FROM h GROUP BY rec_id",
    "d07_monotonic": f"WITH RECURSIVE {T}, {_MONO.format(src='t')} SELECT rec_id, cand_id FROM mono WHERE ok",
    "d08_adjacent_spans": f"WITH {T}, a AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id) > {HOUR} THEN 1 ELSE 0 END AS f FROM t), b AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY t0, t1, cand_id ROWS UNBOUNDED PRECEDING) AS span FROM a) SELECT rec_id, CAST(span AS BIGINT) AS span, min(t0) AS s_ms, max(t1) AS e_ms, string_agg(CAST(cand_id AS VARCHAR), ',' ORDER BY t0, t1, cand_id) AS ids, array_to_string(list_slice(list(CAST(cand_id AS VARCHAR) ORDER BY t0, t1, cand_id), 1, 3), '/') AS preview FROM b GROUP BY rec_id, span",
    "d09_merged_cuts": f"WITH {T}, x AS (SELECT rec_id, t0 AS s_ms, t1 AS e_ms FROM t WHERE k = 'click'), {_M.format(gap=0)} SELECT rec_id, count(*) AS n_cuts, CAST(sum(e_ms - s_ms) AS BIGINT) AS cut_ms FROM m GROUP BY rec_id",
    "a15_region_summary": f"WITH {T} SELECT rec_id, count(*) AS total, count(*) FILTER (WHERE k <> 'click') AS n_keep, CAST(sum(CASE WHEN k <> 'click' THEN t1 - t0 ELSE 0 END) AS BIGINT) AS keep_ms FROM t GROUP BY rec_id",
    "p03_regions": f"WITH {T} SELECT rec_id, cand_id, CASE WHEN k IN ('click', 'error') THEN 'delete' WHEN k = 'view' THEN 'undecided' ELSE 'keep' END AS state FROM t WHERE t1 > t0",
    "p10_times": f"WITH {T} SELECT cand_id, printf('%02d:%02d:%02d,%03d', t1 // 3600000, t1 // 60000 % 60, t1 // 1000 % 60, t1 % 1000) AS srt FROM t",
    "d_flagship_keep_last_lines": _LL + " SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE kept) AS n_kept, CAST(sum(CASE WHEN kept THEN length(line) ELSE 0 END) AS BIGINT) AS kept_chars FROM r GROUP BY doc_id",
    "d05_last_lines": _LL + " SELECT doc_id, n FROM r WHERE NOT kept",
}
