"""Queries of batch reports, on relations D, G, W, T and P."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.operators import pairing, records, reports
from takeweave.plans.fixtures import G, P, T, W, doc_lines, paths, table, takes, words
from takeweave.queries.intervals import DAY, HOUR
from takeweave.queries.records import _LAST, _STATS
from takeweave.queries.text import _KITS


def _counters(s, d):
    n = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    return table(s, d, "documents").select((F.col("lang") == "en").alias("ok"), n(",").alias("commas"), n("\n").alias("breaks"))


def _mixed(s, d):
    return table(s, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit("the "), F.lit("the中 ")), F.lit("a"), F.lit("+")).alias("text"))


def _n_lines(s, d):
    return doc_lines(s, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def _turn_lines(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.explode(F.split("text", "\n")).alias("line"))


def _items(s, d):
    return doc_lines(s, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.col("line") != F.trim("line")).alias("changed")).select(F.when(F.col("n_lines") > 1, "ok").otherwise("single").alias("status"), "n_lines", "changed")


def _run(window):
    return lambda s, d: records.take_stats(takes(s, d), window).select("rec_id", "cut_ms", (F.col("total") - F.col("kept")).alias("unaligned"))


def _logs(s, d):
    return records.take_stats(takes(s, d), DAY).select(F.col("rec_id").alias("log_id"), F.concat(F.lit("Takes: "), "total", F.lit("\nKEPT="), "kept", F.lit(" kept = 0; cut_ms :"), "cut_ms").alias("text"))


def _rendered(s, d):
    st = records.take_stats(takes(s, d), DAY)
    return st.select((2 * F.col("cut_ms") < F.col("total_ms")).alias("ok"), F.col("kept").alias("segments"), (F.col("total_ms") - F.col("cut_ms")).alias("keep_ms"))


def _regions(s, d):
    state = F.when(F.col("k").isin("click", "error"), "delete").when(F.col("k") == "view", "undecided").otherwise("keep")
    return takes(s, d).select("rec_id", "cand_id", "t0", "t1", state.alias("state"))


def _stem_lines(s, d):
    return _n_lines(s, d).select(F.concat(F.lit("s"), "doc_id").alias("stem"), "n_lines")


def _requests(s, d):
    d = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("stem"))
    return d.select("id", F.concat("stem", F.lit(".wav")).alias("path"))


def _catalog(s, d):
    p = paths(s, d)
    return p.select(F.when(F.col("path").endswith(".flac"), F.col("path")).when(F.col("path").endswith(".txt"), F.concat(F.lit("in/x/"), "path")).otherwise(F.concat(F.lit("in/"), "path")).alias("path")).unionByName(p.where("path like '%1.wav'"))


def _settings(s, d):
    items = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("preset"), F.when(F.col("n_chars") > 2000, 50).alias("window"), F.when(F.col("n_chars") < 200, "none").alias("policy"))
    presets = s.createDataFrame([("en", 30, "safe"), ("de", None, "aggressive")], "preset string, window int, policy string")
    return reports.resolved_settings(items, presets, {"window": F.lit(20), "policy": F.lit("last")})


def _heard(s, d, role):
    return table(s, d, "conversations").where(F.col("role") == role).select(F.col("conv_id").alias("rec_id"), "text")


QUERIES = {
    "a11_alignability": lambda s, d: reports.alignability(_heard(s, d, "user"), _heard(s, d, "assistant")),
    "a02_change_counters": lambda s, d: reports.change_counters(_counters(s, d), ["commas", "breaks"]),
    "a08_suspicious": lambda s, d: reports.suspicious(_mixed(s, d)),
    "a14_acceptance": lambda s, d: reports.acceptance(_n_lines(s, d).withColumn("mode", F.when(F.col("doc_id") > 50, "align").otherwise("plain")), 10),
    "a16_line_sanity": lambda s, d: reports.line_sanity(words(s, d), _turn_lines(s, d)),
    "a17_health": lambda s, d: reports.health(_items(s, d)),
    "a18_drift": lambda s, d: reports.drift(_run(DAY)(s, d), _run(HOUR)(s, d)),
    "a19_log_metrics": lambda s, d: reports.log_metrics(_logs(s, d), ["takes", "kept", "cut_ms", "lost"]),
    "a21_render_totals": lambda s, d: reports.render_totals(_rendered(s, d)),
    "k08_region_rows": lambda s, d: reports.region_rows(_regions(s, d)),
    "j11_k12_assembled": lambda s, d: reports.assembled(pairing.kits(paths(s, d)), _stem_lines(s, d), _stem_lines(s, d).select("stem", (F.col("n_lines") > 2).alias("done"))),
    "j05_sources": lambda s, d: reports.resolved_sources(_requests(s, d), _catalog(s, d), "in"),
    "p08_p09_settings": _settings,
    "p12_rename_plan": lambda s, d: reports.rename_plan(paths(s, d), delete="0", replace={"s1": "take 1"}, pattern=("[5-9]$", ""), case="upper", separator="-", prefix="r_"),
    "p13_relative_path": lambda s, d: paths(s, d).select("path", reports.relative_path(F.when(F.col("path").endswith(".txt"), F.concat(F.lit("/data\\in/"), "path")).otherwise(F.concat(F.lit("/other/"), "path")), "/data/in").alias("rel")),
}

_END = "(\\.words\\.json|\\.canonical\\.txt|\\.align\\.txt|\\.norm\\.txt|\\.txt|\\.wav|\\.flac|\\.m4a|\\.mp3)$"
_NL = "nl AS (SELECT doc_id, count(*) AS n_lines FROM g GROUP BY doc_id)"
_MX = "x AS (SELECT doc_id, replace(replace(text, 'the ', 'the中 '), 'a', '+') AS text FROM documents)"
_CT = "ct AS (SELECT CASE WHEN path LIKE '%.flac' THEN path WHEN path LIKE '%.txt' THEN 'in/x/' || path ELSE 'in/' || path END AS f FROM p UNION SELECT path FROM p WHERE path LIKE '%1.wav')"
_REL = f"WITH {P}, a AS (SELECT path, replace(CASE WHEN path LIKE '%.txt' THEN '/data\\in/' || path ELSE '/other/' || path END, '\\', '/') AS x FROM p)"


def _two(ms: int, n: int) -> str:
    return f"r{n} AS ({_LAST.format(ms=ms, src='t')}), s{n} AS ({_STATS.format(src=f'r{n}')})"


_S1 = f"WITH {T}, {_two(DAY, 1)}"
_GRAMS_OF = (
    "cs AS (SELECT conv_id, role, list_filter(string_split(regexp_replace(text, '\\s+', '', 'g'), ''), lambda c: c <> '') AS c FROM conversations WHERE role IN ('user', 'assistant')), "
    "gr AS (SELECT conv_id, role, unnest(c) AS gram FROM cs UNION ALL SELECT conv_id, role, unnest(list_transform(list_zip(c[1:len(c) - 1], c[2:]), lambda p: p[1] || p[2])) FROM cs WHERE len(c) > 1), "
    "cn AS (SELECT conv_id, gram, count(*) FILTER (role = 'user') AS t, count(*) FILTER (role = 'assistant') AS w FROM gr GROUP BY ALL), "
    "sm AS (SELECT conv_id, sum(t) FILTER (length(gram) = 1) AS n, sum(least(t, w)) FILTER (length(gram) = 1) AS chars, sum(t) FILTER (contains('，。？！：；——…,.?!:;', gram) AND length(gram) = 1) AS marks, sum(least(t, w)) FILTER (contains('，。？！：；——…,.?!:;', gram) AND length(gram) = 1) AS marked, coalesce(sum(t) FILTER (length(gram) = 2), 0) AS pairs, coalesce(sum(t) FILTER (length(gram) = 2 AND w > 0), 0) AS paired FROM cn GROUP BY conv_id)"
)
ORACLES = {
    "a11_alignability": f"WITH {_GRAMS_OF} SELECT conv_id AS rec_id, CASE WHEN n > 0 THEN round((chars / n + CASE WHEN marks > 0 THEN marked / marks ELSE 1 END + paired / greatest(pairs, 1)) / 3 * 100, 2) ELSE 0 END AS score FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') LEFT JOIN sm USING (conv_id)",
    "a02_change_counters": "SELECT count(*) FILTER (lang = 'en') AS n_ok, CAST(coalesce(sum(length(text) - length(replace(text, ',', ''))) FILTER (lang = 'en'), 0) AS BIGINT) AS commas, CAST(coalesce(sum(length(text) - length(replace(text, chr(10), ''))) FILTER (lang = 'en'), 0) AS BIGINT) AS breaks FROM documents",
    "a08_suspicious": f"WITH {_MX}, m AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: regexp_matches(w, '\\p{{Han}}') AND regexp_matches(w, '\\p{{Latin}}')) AS m FROM x) SELECT doc_id, CAST(length(regexp_replace(text, '[^\\p{{Cc}}]|[\\n\\t\\r]', '', 'g')) AS INTEGER) AS controls, CAST(length(regexp_replace(text, '[^\\p{{S}}]', '', 'g')) AS INTEGER) AS symbols, CAST(len(m) AS INTEGER) AS mixed, coalesce(array_to_string(list_sort(list_distinct(m))[1:8], ' '), '') AS examples FROM m",
    "a14_acceptance": f"WITH {G}, {_NL}, r AS (SELECT CASE WHEN doc_id <= 50 THEN 'mode' WHEN n_lines < 10 THEN 'lines' ELSE '' END AS reason FROM nl) SELECT CASE WHEN reason = '' THEN 'PASS' ELSE 'FAIL' END AS verdict, reason, count(*) AS n FROM r GROUP BY ALL",
    "a16_line_sanity": f"WITH {W}, a AS (SELECT rec_id, count(*) AS n_words FROM w GROUP BY 1), b AS (SELECT conv_id AS rec_id, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM conversations GROUP BY 1) SELECT rec_id, coalesce(n_words, 0) AS n_words, coalesce(n_lines, 0) AS n_lines, 2 * coalesce(n_lines, 0) > 3 * coalesce(n_words, 0) AS suspicious FROM a FULL JOIN b USING (rec_id)",
    "a17_health": f"WITH {G}, i AS (SELECT CASE WHEN count(*) > 1 THEN 'ok' ELSE 'single' END AS status, count(*) AS n_lines, max(line <> trim(line)) AS changed FROM g GROUP BY doc_id) SELECT status, count(*) AS items, CAST(sum(n_lines) AS BIGINT) AS lines, count(*) FILTER (changed) AS changed FROM i GROUP BY ROLLUP (status)",
    "a18_drift": f"{_S1}, {_two(HOUR, 2)} SELECT rec_id, s1.cut_ms AS cut_a, s2.cut_ms AS cut_b, CASE WHEN greatest(s1.total - s1.kept, s2.total - s2.kept) > 2 THEN 'unaligned' WHEN 100 * abs(s1.cut_ms - s2.cut_ms) > 10 * s1.cut_ms THEN 'drift' ELSE 'ok' END AS verdict FROM s1 JOIN s2 USING (rec_id)",
    "a19_log_metrics": f"{_S1} SELECT rec_id AS log_id, total AS takes, kept, cut_ms, CAST(NULL AS BIGINT) AS lost FROM s1",
    "a21_render_totals": f"{_S1} SELECT count(*) FILTER (2 * cut_ms < total_ms) AS items, CAST(coalesce(sum(kept) FILTER (2 * cut_ms < total_ms), 0) AS BIGINT) AS segments, CAST(coalesce(sum(total_ms - cut_ms) FILTER (2 * cut_ms < total_ms), 0) AS BIGINT) AS keep_ms FROM s1",
    "k08_region_rows": f"WITH {T}, r AS (SELECT *, CASE WHEN k = 'view' THEN 'undecided' ELSE 'keep' END AS state FROM t WHERE k NOT IN ('click', 'error')) SELECT rec_id, cand_id || ',' || t0 || ',' || t1 || ',' || state AS comma, cand_id || ';' || t0 || ';' || t1 || ';' || state AS semicolon FROM r",
    "j11_k12_assembled": f"WITH {_KITS}, {G}, {_NL} SELECT stem, coalesce(n_lines, 0) AS n_lines, CAST((words IS NOT NULL)::INT + (script IS NOT NULL)::INT + (audio IS NOT NULL)::INT AS INTEGER) AS n_files, coalesce(audio, script) AS source, CASE WHEN words IS NULL OR script IS NULL THEN 'failed' WHEN audio IS NULL THEN 'no-audio' WHEN NOT coalesce(n_lines > 2, false) THEN 'pending' ELSE 'ok' END AS status FROM kt LEFT JOIN nl ON stem = 's' || doc_id",
    "j05_sources": f"WITH {P}, {_CT}, st AS (SELECT lower(regexp_replace(regexp_extract(f, '([^/]*)$', 1), '{_END}', '')) AS stem, min(f) AS v FROM ct GROUP BY 1), r AS (SELECT doc_id AS id, 's' || doc_id || '.wav' AS path, 's' || doc_id AS stem FROM documents) SELECT id, coalesce(a.f, b.f, v) AS source, CASE WHEN a.f IS NOT NULL THEN 'exact' WHEN b.f IS NOT NULL THEN 'base' WHEN v IS NOT NULL THEN 'stem' ELSE 'missing' END AS how FROM r LEFT JOIN ct a ON a.f = path LEFT JOIN ct b ON b.f = 'in/' || path LEFT JOIN st USING (stem)",
    "p08_p09_settings": "SELECT doc_id AS id, CASE WHEN n_chars > 2000 THEN 50 WHEN lang = 'en' THEN 30 ELSE 20 END AS window, CASE WHEN n_chars < 200 THEN 'none' WHEN lang = 'en' THEN 'safe' WHEN lang = 'de' THEN 'aggressive' ELSE 'last' END AS policy FROM documents",
    "p12_rename_plan": f"WITH {P}, a AS (SELECT path AS old, regexp_extract(path, '{_END}', 0) AS e, replace(replace(regexp_replace(path, '{_END}', ''), '0', ''), 's1', 'take 1') AS x FROM p), b AS (SELECT old, e, 'r_' || regexp_replace(upper(trim(regexp_replace(x, '[5-9]$', ''))), '[ _-]+', '-', 'g') AS s FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY s, e ORDER BY old) - 1 AS n FROM b) SELECT old, s || CASE WHEN n > 0 THEN '(' || n || ')' ELSE '' END || e AS new FROM c",
    "p13_relative_path": f"{_REL} SELECT path, CASE WHEN starts_with(x, '/data/in/') THEN substr(x, 10) ELSE x END AS rel FROM a",
}
