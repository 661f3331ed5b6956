"""Queries of text rules, segmentation, alignment, pairing and reports, on relations D, G, N, W and P."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from takeweave.functions import text as tx
from takeweave.operators import align, pairing, segment
from takeweave.plans.fixtures import G, P, doc_lines, paths, table

ALIASES = {"the": ["teh", "thhe"], "and": ["annd", "an an"], "of": ["off"]}


def _noisy(s, d):
    t = F.replace("text", F.lit(", "), F.lit(",\t　"))
    t = F.replace(F.replace(t, F.lit(". "), F.lit(".  ")), F.lit(" the "), F.lit(" the​ "))
    return table(s, d, "documents").select("doc_id", F.replace(t, F.lit("\n"), F.lit("\r\n")).alias("text"))


_X = "x AS (SELECT doc_id, replace(replace(replace(replace(text, ', ', ',' || chr(9) || chr(12288)), '. ', '.' || chr(160) || ' '), ' the ', ' the' || chr(8203) || ' '), chr(10), chr(13) || chr(10)) AS text FROM documents)"


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _map(f, source=_docs):
    return lambda s, d: source(s, d).select("doc_id", f(F.col("text")).alias("out"))


def _lines(s, d):
    return table(s, d, "benchmark").select("item_id", align.folded_words(F.col("text")).alias("words"))


def _stream(s, d):
    return table(s, d, "documents").select("doc_id", align.folded_words(F.col("text")).alias("words"))


def _grep(s, d):
    g = doc_lines(s, d).withColumn("hit", F.col("line").rlike("(?i)licensed|token"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("n"))
    return g.withColumn("before", before).where("hit").select("doc_id", "n", tx.preview(F.col("line")).alias("preview"), tx.preview(F.col("before")).alias("before"))


def _lengths(s, d):
    return segment.sentences(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("lo"), F.expr("percentile(length(text), 0.5)").alias("med"), F.expr("percentile(length(text), 0.95)").alias("p95"), F.max(F.length("text")).alias("hi"))


def _chars(s, d):
    count = lambda df, name: df.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias(name))
    return count(_docs(s, d), "a").join(count(table(s, d, "benchmark"), "b"), "c", "full").select("c", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def _overlap(s, d):
    return _chars(s, d).agg(F.sum(F.least("a", "b")).alias("both"), F.round(F.sum(F.least("a", "b")) / F.sum("b"), 9).alias("coverage"))


QUERIES = {
    "f01_fold_width": _map(tx.fold_width, _noisy),
    "f02_map_chars": _map(lambda c: tx.map_chars(c, delete="*#", pairs={"|": "/", "&": " and "})),
    "f04_collapse": _map(tx.collapse, _noisy),
    "f07_mark_style": _map(lambda c: tx.mark_style(c, "cjk")),
    "f08_trim_lines": _map(tx.trim_lines),
    "f13_substitute": _map(lambda c: tx.substitute(c, ALIASES)),
    "f16_alignment_form": _map(tx.alignment_form),
    "f20_match_tokens": lambda s, d: _docs(s, d).select("doc_id", F.size(tx.match_tokens(F.col("text"))).alias("n")),
    "f21_export_form": _map(tx.export_form, _noisy),
    "f18_f19_canonical_spans": lambda s, d: doc_lines(s, d).withColumn("len", F.length(tx.canonical_form(F.col("line")))).select("doc_id", "n", (F.sum("len").over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).alias("lo"), "len"),
    "f22_corpus_stats": lambda s, d: _noisy(s, d).withColumn("o", tx.export_form(F.col("text"))).agg(F.count("*").alias("docs"), F.count_if(F.col("o") != F.col("text")).alias("changed"), F.sum(F.length("text")).alias("before"), F.sum(F.length("o")).alias("after")),
    "f23_invalid_lines": lambda s, d: doc_lines(s, d).where(F.col("line").contains("\t") | (F.col("line") != F.trim("line"))).select("doc_id", "n"),
    "f09_merged_wraps": lambda s, d: segment.merged_wraps(doc_lines(s, d)),
    "p05_short_lines": lambda s, d: doc_lines(s, d).withColumn("len", F.length(tx.canonical_form(F.col("line")))).groupBy("doc_id").agg(F.count_if(F.col("len") < 12).alias("short"), F.count("*").alias("n")),
    "p06_ascii_share": lambda s, d: doc_lines(s, d).select("doc_id", "n", F.round(tx.ascii_share(F.col("line")), 9).alias("share")),
    "p07_grep": _grep,
    "p11_preview": lambda s, d: doc_lines(s, d).select("doc_id", "n", tx.preview(F.col("line")).alias("out")),
    "a05_sentence_lengths": _lengths,
    "a06_stop_rate": lambda s, d: doc_lines(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("line").rlike("[.!?]$")).alias("stops")),
    "a07_space_deltas": lambda s, d: _noisy(s, d).select("doc_id", F.regexp_count("text", F.lit("\n")).alias("breaks"), F.regexp_count("text", F.lit("\t")).alias("tabs"), F.regexp_count("text", F.lit("　")).alias("wide"), (F.length("text") - F.length(tx.collapse(F.col("text")))).alias("gone")),
    "a09_char_difference": _chars,
    "a10_overlap": _overlap,
    "g01_hard_stops": lambda s, d: segment.sentences(_docs(s, d)),
    "g04_depth_split": lambda s, d: segment.depth_split(_docs(s, d)),
    "g06_packed_pieces": lambda s, d: segment.packed_pieces(_docs(s, d)).select("doc_id", F.size("pieces").alias("n"), F.array_max(F.transform("pieces", lambda x: F.length(x))).alias("longest")),
    "m03_anchors": lambda s, d: align.anchors(_lines(s, d), _stream(s, d)),
    "m05_gram_jaccard": lambda s, d: align.gram_jaccard(_lines(s, d), _stream(s, d), least=0.01),
    "m08_match_lines": lambda s, d: align.match_lines(_lines(s, d), _stream(s, d)),
    "a12_match_summary": lambda s, d: align.match_lines(_lines(s, d), _stream(s, d)).groupBy("item_id").agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"), F.count_if(F.col("dist") == 0).alias("exact")),
    "j12_missing_grams": lambda s, d: align.missing_grams(_lines(s, d), _stream(s, d)),
    "j10_unmatched": lambda s, d: _lines(s, d).join(align.match_lines(_lines(s, d), _stream(s, d)), "item_id", "left_anti").select("item_id"),
    "p02_s07_catalog": lambda s, d: pairing.catalog(paths(s, d)),
    "j01_kits": lambda s, d: pairing.kits(paths(s, d)),
    "j14_bundles": lambda s, d: pairing.bundles(paths(s, d)),
    "j04_reconcile": lambda s, d: pairing.reconcile(table(s, d, "orders").select("o_custkey"), table(s, d, "customer").select("c_custkey")),
    "a20_completeness": lambda s, d: pairing.kits(paths(s, d)).select("stem", F.when(F.col("words").isNull(), "FAIL").when(F.col("script").isNull() | F.col("audio").isNull(), "WARN").otherwise("OK").alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n")),
    "u02_distinct_lines": lambda s, d: doc_lines(s, d).select("line").distinct().agg(F.count("*").alias("n")),
}

_STOP = ".!?。！？…；;"
_CLOSE = "\"''\\)\\]}”’」』）】》"
_FW = "(SELECT string_agg(chr(CAST(c AS INTEGER)), '' ORDER BY c) || chr(12288) FROM range(65281, 65375) r(c))"
_HW = "(SELECT string_agg(chr(CAST(c AS INTEGER)), '' ORDER BY c) || ' ' FROM range(33, 127) r(c))"
_SP = "[ \\t\\r\\n\\x0b\\f 　   ]+"
_FOLD = f"string_split(trim(regexp_replace(translate(lower(text), '{align.ACCENTED}', '{align.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_GRAMS = (
    f"l AS (SELECT item_id, {_FOLD} AS ws FROM benchmark), st AS (SELECT doc_id, {_FOLD} AS ws FROM documents), "
    "lg AS (SELECT item_id, i AS o, array_to_string(ws[i+1:i+3], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(0, len(ws) - 2)) AS i FROM l WHERE len(ws) >= 3)), "
    "sg AS (SELECT doc_id, i AS pos, array_to_string(ws[i+1:i+3], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS i FROM st WHERE len(ws) >= 3)), "
    "an AS (SELECT item_id, doc_id, greatest(pos - o, 0) AS start, count(*) AS hits FROM lg JOIN sg USING (gram) GROUP BY ALL), "
    "ac AS (SELECT * FROM an)"
)
_MATCH = _GRAMS + (
    ", mw AS (SELECT ac.*, array_to_string(l.ws, ' ') AS a, array_to_string(st.ws[start+1:start+len(l.ws)], ' ') AS b FROM ac JOIN l USING (item_id) JOIN st USING (doc_id)), "
    "md AS (SELECT *, levenshtein(a, b) AS dist FROM mw), mm AS (SELECT * FROM md WHERE dist <= greatest(length(a), length(b)) * 0.35 QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY dist, start DESC) = 1)"
)
_PCAT = P + ", c AS (SELECT path, lower(regexp_replace(path, '(\\.words\\.json|\\.canonical\\.txt|\\.align\\.txt|\\.norm\\.txt|\\.txt|\\.wav|\\.flac|\\.m4a|\\.mp3)$', '')) AS stem, CASE WHEN path LIKE '%.words.json' THEN 'words' WHEN path LIKE '%.canonical.txt' THEN 'canonical' WHEN path LIKE '%.align.txt' THEN 'align' WHEN path LIKE '%.norm.txt' THEN 'norm' WHEN path LIKE '%.txt' THEN 'text' ELSE 'audio' END AS kind FROM p)"
_KITS = _PCAT + ", kt AS (SELECT stem, min(path) FILTER (WHERE kind='words') AS words, coalesce(min(path) FILTER (WHERE kind='align'), min(path) FILTER (WHERE kind='norm'), min(path) FILTER (WHERE kind='text')) AS script, min(path) FILTER (WHERE kind='audio') AS audio FROM c WHERE kind <> 'canonical' GROUP BY stem)"
_SENT = f"s0 AS (SELECT doc_id, generate_subscripts(ps, 1) AS p, unnest(ps) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[^{_STOP}]+[{_STOP}]*[{_CLOSE}]*') AS ps FROM documents)), s1 AS (SELECT doc_id, p, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM s0), s2 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS sent_no, text FROM s1 WHERE text <> '')"
_CANON = "regexp_replace(lower(line), '[^\\p{L}\\p{N}]', '', 'g')"
_CHARS = "a AS (SELECT c, count(*) AS a FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c), b AS (SELECT c, count(*) AS b FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '' GROUP BY c), ab AS (SELECT coalesce(a.c, b.c) AS c, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.c = b.c)"
_EXPORT = f"regexp_replace(translate(trim(regexp_replace(regexp_replace(translate(text, {_FW}, {_HW}), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}​-‏⁠﻿­]', '', 'g'), '{_SP}', ' ', 'g')), '，。！？：；（）', ',.!?:;()'), '(,),+|(!)!+|(\\?)\\?+|(:):+|(;);+', '\\1\\2\\3\\4\\5', 'g')"

ORACLES = {
    "f01_fold_width": f"WITH {_X} SELECT doc_id, translate(text, {_FW}, {_HW}) AS out FROM x",
    "f02_map_chars": "SELECT doc_id, replace(translate(text, '|*#', '/'), '&', ' and ') AS out FROM documents",
    "f04_collapse": f"WITH {_X} SELECT doc_id, trim(regexp_replace(text, '{_SP}', ' ', 'g')) AS out FROM x",
    "f07_mark_style": "SELECT doc_id, regexp_replace(translate(text, ',.!?:;()', '，。！？：；（）'), '(，)，+|(。)。+|(！)！+|(？)？+|(：)：+|(；)；+|(（)（+|(）)）+', '\\1\\2\\3\\4\\5\\6\\7\\8', 'g') AS out FROM documents",
    "f08_trim_lines": "SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS out FROM documents",
    "f13_substitute": "SELECT doc_id, replace(replace(replace(replace(replace(text, 'an an', 'and'), 'annd', 'and'), 'thhe', 'the'), 'off', 'of'), 'teh', 'the') AS out FROM documents",
    "f16_alignment_form": f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(text, {_FW}, {_HW})), '[{_STOP}]', ' ', 'g'), '[^\\p{{L}}\\p{{N}} \\n\\t]', '', 'g'), '[ \\n\\t]+', ' ', 'g')) AS out FROM documents",
    "f20_match_tokens": "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+|[^\\sa-z0-9_]')) AS INTEGER) AS n FROM documents",
    "f21_export_form": f"WITH {_X} SELECT doc_id, {_EXPORT} AS out FROM x",
    "f18_f19_canonical_spans": f"WITH {G}, a AS (SELECT doc_id, n, CAST(length({_CANON}) AS INTEGER) AS len FROM g) SELECT doc_id, n, CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - len AS BIGINT) AS lo, len FROM a",
    "f22_corpus_stats": f"WITH {_X}, o AS (SELECT text, {_EXPORT} AS o FROM x) SELECT count(*) AS docs, count(*) FILTER (WHERE o <> text) AS changed, CAST(sum(length(text)) AS BIGINT) AS before, CAST(sum(length(o)) AS BIGINT) AS after FROM o",
    "f23_invalid_lines": f"WITH {G} SELECT doc_id, n FROM g WHERE contains(line, chr(9)) OR line <> trim(line)",
    "f09_merged_wraps": f"WITH {G}, a AS (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM g), q AS (SELECT *, sum(CASE WHEN b IS NULL OR b = '' OR regexp_matches(b, '[{_STOP}][{_CLOSE}]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS par FROM a), r AS (SELECT doc_id, CAST(par AS BIGINT) AS par_no, string_agg(trim(line), ' ' ORDER BY n) AS text FROM q GROUP BY doc_id, par) SELECT * FROM r WHERE trim(text) <> ''",
    "p05_short_lines": f"WITH {G} SELECT doc_id, count(*) FILTER (WHERE length({_CANON}) < 12) AS short, count(*) AS n FROM g GROUP BY doc_id",
    "p06_ascii_share": f"WITH {G}, a AS (SELECT doc_id, n, regexp_replace(line, '\\s', '', 'g') AS z FROM g) SELECT doc_id, n, CASE WHEN length(z) > 0 THEN round(length(regexp_replace(z, '[^\\x21-\\x7e]', '', 'g')) / length(z), 9) ELSE 0.0 END AS share FROM a",
    "p07_grep": f"WITH {G}, a AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM g) SELECT doc_id, n, CASE WHEN length(line) > 48 THEN substr(line, 1, 48) || '…' ELSE line END AS preview, CASE WHEN length(b) > 48 THEN substr(b, 1, 48) || '…' ELSE b END AS before FROM a WHERE regexp_matches(line, '(?i)licensed|token')",
    "p11_preview": f"WITH {G} SELECT doc_id, n, CASE WHEN length(line) > 48 THEN substr(line, 1, 48) || '…' ELSE line END AS out FROM g",
    "a05_sentence_lengths": f"WITH {_SENT} SELECT doc_id, count(*) AS n, CAST(min(length(text)) AS INTEGER) AS lo, quantile_cont(length(text), 0.5) AS med, quantile_cont(length(text), 0.95) AS p95, CAST(max(length(text)) AS INTEGER) AS hi FROM s2 GROUP BY doc_id",
    "a06_stop_rate": f"WITH {G} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '[.!?]$')) AS stops FROM g GROUP BY doc_id",
    "a07_space_deltas": f"WITH {_X} SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS breaks, CAST(length(text) - length(replace(text, chr(9), '')) AS INTEGER) AS tabs, CAST(length(text) - length(replace(text, chr(12288), '')) AS INTEGER) AS wide, CAST(length(text) - length(trim(regexp_replace(text, '{_SP}', ' ', 'g'))) AS INTEGER) AS gone FROM x",
    "a09_char_difference": f"WITH {_CHARS} SELECT c, a, b FROM ab",
    "a10_overlap": f"WITH {_CHARS} SELECT CAST(sum(least(a, b)) AS BIGINT) AS both, round(sum(least(a, b)) / sum(b), 9) AS coverage FROM ab",
    "g01_hard_stops": f"WITH {_SENT} SELECT doc_id, sent_no, text FROM s2",
    "g04_depth_split": "WITH ch AS (SELECT doc_id, generate_subscripts(cs, 1) AS p, unnest(cs) AS c FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents)), a AS (SELECT *, sum(CASE WHEN c IN ('(', '[', '{', '（', '【') THEN 1 WHEN c IN (')', ']', '}', '）', '】') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS dp FROM ch), b AS (SELECT *, CASE WHEN c IN (',', ';', '，', '；', '。') AND dp <= 0 THEN 1 ELSE 0 END AS cut FROM a), e AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM b) SELECT doc_id, CAST(q AS BIGINT) AS piece_no, string_agg(c, '' ORDER BY p) AS text FROM e GROUP BY doc_id, q",
    "m03_anchors": f"WITH {_GRAMS} SELECT item_id, doc_id, CAST(start AS INTEGER) AS start, hits FROM ac",
    "m05_gram_jaccard": f"WITH {_GRAMS}, ca AS (SELECT item_id, gram, count(*) AS ca FROM lg GROUP BY ALL), cb AS (SELECT doc_id, gram, count(*) AS cb FROM sg GROUP BY ALL), na AS (SELECT item_id, sum(ca) AS na FROM ca GROUP BY ALL), nb AS (SELECT doc_id, sum(cb) AS nb FROM cb GROUP BY ALL), j AS (SELECT item_id, doc_id, sum(least(ca, cb)) AS inter FROM ca JOIN cb USING (gram) GROUP BY ALL) SELECT item_id, doc_id, CAST(inter AS BIGINT) AS inter, round(inter / (na + nb - inter), 9) AS jaccard FROM j JOIN na USING (item_id) JOIN nb USING (doc_id) WHERE round(inter / (na + nb - inter), 9) >= 0.01",
    "m08_match_lines": f"WITH {_MATCH} SELECT item_id, doc_id, CAST(start AS INTEGER) AS start, CAST(dist AS INTEGER) AS dist, hits FROM mm",
    "a12_match_summary": f"WITH {_MATCH} SELECT item_id, count(*) AS docs, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (WHERE dist = 0) AS exact FROM mm GROUP BY item_id",
    "j12_missing_grams": f"WITH {_GRAMS} SELECT item_id, count(*) AS missing FROM lg WHERE gram NOT IN (SELECT gram FROM sg) GROUP BY item_id",
    "j10_unmatched": f"WITH {_MATCH} SELECT item_id FROM l WHERE item_id NOT IN (SELECT item_id FROM mm)",
    "p02_s07_catalog": f"WITH {_PCAT} SELECT path, stem, kind FROM c",
    "j01_kits": f"WITH {_KITS} SELECT * FROM kt",
    "j14_bundles": f"WITH {_PCAT} SELECT stem, " + ", ".join(f"coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE kind='{k}'), '') AS \"{k}\"" for k in ("words", "canonical", "align", "norm", "text", "audio")) + " FROM c GROUP BY stem",
    "j04_reconcile": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer), j AS (SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k) SELECT side, count(*) AS n, min(key) AS least FROM j GROUP BY side",
    "a20_completeness": f"WITH {_KITS} SELECT CASE WHEN words IS NULL THEN 'FAIL' WHEN script IS NULL OR audio IS NULL THEN 'WARN' ELSE 'OK' END AS verdict, count(*) AS n FROM kt GROUP BY 1",
    "u02_distinct_lines": f"WITH {G} SELECT count(DISTINCT line) AS n FROM g",
}
