"""Queries of near keys, stacks and the rule splitter, on relations D and G."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.operators import align, nearkeys, rules
from takeweave.plans.fixtures import G, doc_lines, table
from takeweave.queries.text import _FOLD, _FW, _HW, _SENT, _STOP

LENGTHS = {"least": 20, "most": 60, "hard": 80}


def _keyed_lines(s, d):
    key = F.array_join(align.folded_words(F.col("line")), " ")
    return doc_lines(s, d).select(F.col("doc_id").alias("rec_id"), "n", key.alias("key"))


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _cuts(s, d):
    layers = rules.hard_layers(_docs(s, d))
    return layers.select("doc_id", "layer_no", F.posexplode(rules.length_cuts(F.col("text"), lengths=LENGTHS)).alias("p", "text")).select("doc_id", "layer_no", F.col("p").cast("long").alias("p"), "text")


QUERIES = {
    "d01_near_keys": lambda s, d: nearkeys.line_keys(_keyed_lines(s, d)),
    "g05_hard_layers": lambda s, d: rules.hard_layers(_docs(s, d)),
    "g06_length_cuts": _cuts,
    "g05_g07_rule_lines": lambda s, d: rules.rule_lines(_docs(s, d), LENGTHS),
    "g12_alignment_sentences": lambda s, d: rules.alignment_sentences(_docs(s, d)).select("doc_id", "sent_no", "text", "folded", F.size("tokens").alias("n_tokens")),
}

# Lines in the order of their first places; each is compared with the keys that none before it has taken.
_KEYS = (
    f"{G}, k0 AS (SELECT doc_id, n, array_to_string({_FOLD.replace('lower(text)', 'lower(line)')}, ' ') AS k FROM g), k1 AS (SELECT doc_id, n, CASE WHEN k = '' THEN '_' ELSE k END AS key FROM k0), "
    "k2 AS (SELECT doc_id, key, min(n) AS n FROM k1 GROUP BY ALL), k3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM k2), "
    "r AS (SELECT doc_id, i, key, [{'n': n, 'k': key}] AS heads, {'n': n, 'k': key} AS own FROM k3 WHERE i = 1 UNION ALL "
    "SELECT doc_id, i, key, CASE WHEN own IS NULL THEN heads || [me] ELSE heads END, coalesce(own, me) FROM (SELECT k3.doc_id, k3.i, k3.key, r.heads, {'n': k3.n, 'k': k3.key} AS me, "
    "[h FOR h IN r.heads IF CASE WHEN abs(length(h.k) - length(k3.key)) * 100 > 15 * greatest(length(h.k), length(k3.key)) THEN false ELSE levenshtein(h.k, k3.key) * 100 <= 15 * greatest(length(h.k), length(k3.key)) END][1] AS own "
    "FROM r JOIN k3 ON r.doc_id = k3.doc_id AND k3.i = r.i + 1)) "
    "SELECT k1.doc_id AS rec_id, k1.n, k1.key, r.own.k AS line_key, r.own.n AS first FROM k1 JOIN r USING (doc_id, key)"
)

_listed = lambda chars: "(" + ", ".join("'" + c.replace("'", "''") + "'" for c in dict.fromkeys(chars)) + ")"
_KINDS = rules.PAIRS | {rules.STRAIGHT: rules.STRAIGHT}
_CLOSER = " ".join(f"WHEN '{o}' THEN '{c}'" for o, c in _KINDS.items())
_CLOSERS = _listed([*rules.PAIRS.values(), rules.STRAIGHT])
# The stack of each document as a string of the closers that it waits for, from mark to mark.
_LAYERS = (
    "d0 AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS cs FROM documents), d1 AS (SELECT doc_id, unnest(range(1, len(cs) + 1)) AS i, unnest(cs) AS c FROM d0 WHERE len(cs) > 0), "
    f"d2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS m FROM d1 WHERE c IN {_listed(_KINDS)} OR c IN {_CLOSERS}), "
    "st AS (SELECT doc_id, 0::BIGINT AS m, 0::BIGINT AS i, '' AS stack FROM d0 UNION ALL SELECT d2.doc_id, d2.m, d2.i, CASE WHEN right(stack, 1) = c THEN left(stack, length(stack) - 1) "
    f"ELSE stack || CASE c {_CLOSER} ELSE '' END END FROM st JOIN d2 ON d2.doc_id = st.doc_id AND d2.m = st.m + 1), "
    "d3 AS (SELECT d1.doc_id, d1.i, d1.c, last_value(st.stack IGNORE NULLS) OVER o = '' AS free FROM d1 LEFT JOIN st ON st.doc_id = d1.doc_id AND st.i = d1.i AND st.m > 0 WINDOW o AS (PARTITION BY d1.doc_id ORDER BY d1.i ROWS UNBOUNDED PRECEDING)), "
    f"d4 AS (SELECT *, c IN {_listed(rules.HARD)} AND coalesce(free, true) AS stop, c IN {_CLOSERS} AS closes FROM d3), "
    # a run of closers right behind a stop belongs to it
    "d5 AS (SELECT *, coalesce(last_value(CASE WHEN NOT closes THEN stop END IGNORE NULLS) OVER o, false) AS ended FROM d4 WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)), "
    "d6 AS (SELECT *, CASE WHEN NOT closes AND lag(ended, 1, false) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM d5), "
    "d7 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS layer FROM d6), "
    "d8 AS (SELECT doc_id, layer, trim(string_agg(c, '' ORDER BY i)) AS text FROM d7 GROUP BY ALL), "
    "la AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY layer) AS layer_no, text FROM d8 WHERE text <> '')"
)
_SPACED = "(CASE WHEN substr(text, {x} + 1, 1) = ' ' THEN {x} + 1 ELSE {x} END)"
# Where the piece that ends at hi leaves the next one to begin: spaces go, one soft mark stays with the piece before.
_CUTS = (
    f"{_LAYERS}, b0 AS (SELECT *, CAST(length(text) AS BIGINT) AS n FROM la), "
    f"b1 AS (SELECT doc_id, layer_no, text, n, list_filter(range(1, n + 1), lambda i: substr(text, i, 1) IN {_listed(rules.SOFT + ' ')}) AS ms FROM b0), "
    "b2 AS (SELECT doc_id, layer_no, 0::BIGINT AS p, 0::BIGINT AS lo, 0::BIGINT AS hi, 0::BIGINT AS nxt, 0::BIGINT AS extra FROM b1 UNION ALL "
    f"SELECT doc_id, layer_no, p + 1, lo, hi, CASE WHEN substr(text, sp + 1, 1) IN {_listed(rules.SOFT)} THEN {_SPACED.format(x='(sp + 1)')} ELSE sp END, CASE WHEN hi < n AND substr(text, sp + 1, 1) IN {_listed(rules.SOFT)} THEN sp + 1 ELSE 0 END FROM "
    f"(SELECT *, {_SPACED.format(x='hi')} AS sp FROM (SELECT b2.doc_id, b2.layer_no, b2.p, b2.nxt AS lo, b1.text, b1.n, CASE WHEN n - nxt <= {LENGTHS['most']} THEN n ELSE "
    f"coalesce(list_max([m FOR m IN ms IF m > nxt + {LENGTHS['least']} AND m <= nxt + {LENGTHS['most'] + 1}]), list_min([m FOR m IN ms IF m > nxt + {LENGTHS['most'] + 1} AND m <= nxt + {LENGTHS['hard']}]), least(n, nxt + {LENGTHS['hard']})) END AS hi "
    "FROM b2 JOIN b1 ON b1.doc_id = b2.doc_id AND b1.layer_no = b2.layer_no WHERE b2.nxt < b1.n))), "
    "cu AS (SELECT b2.doc_id, b2.layer_no, b2.p - 1 AS p, rtrim(substr(text, lo + 1, hi - lo)) || CASE WHEN extra > 0 THEN substr(text, extra, 1) ELSE '' END AS text FROM b2 JOIN b1 USING (doc_id, layer_no) WHERE b2.p > 0)"
)

_ALONE = f"translate(text, '{''.join([*rules.PAIRS.values(), rules.STRAIGHT])}', '') = ''"
_OPEN = "length({x}) < " + str(LENGTHS["least"]) + " AND right({x}, 1) NOT IN " + _listed(rules.HARD + rules.SOFT)
_RULES = (
    f"{_CUTS}, e0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY layer_no, p) AS r, text FROM cu), "
    f"e1 AS (SELECT *, sum(CASE WHEN {_ALONE} AND r > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS g FROM e0), "
    "e2 AS (SELECT doc_id, g AS i, string_agg(text, '' ORDER BY r) AS text FROM e1 GROUP BY ALL), "
    "e3 AS (SELECT doc_id, i, 1::BIGINT AS line, text AS cur FROM e2 WHERE i = 1 UNION ALL SELECT doc_id, i, CASE WHEN joins THEN line ELSE line + 1 END, CASE WHEN joins THEN cur || text ELSE text END FROM "
    f"(SELECT e2.doc_id, e2.i, e3.line, e3.cur, e2.text, ({_OPEN.format(x='cur')}) AND ({_OPEN.format(x='e2.text')}) AS joins FROM e3 JOIN e2 ON e2.doc_id = e3.doc_id AND e2.i = e3.i + 1)), "
    "e4 AS (SELECT doc_id, line, arg_max(cur, i) AS text FROM e3 GROUP BY ALL), "
    f"e5 AS (SELECT doc_id, line, generate_subscripts(ps, 1) AS p, trim(unnest(ps)) AS text FROM (SELECT doc_id, line, regexp_extract_all(text, '[^{rules.HARD}]*[{rules.HARD}]|[^{rules.HARD}]+') AS ps FROM e4)) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, p) AS line_no, text FROM e5 WHERE text <> ''"
)

_PLAIN = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(text, {_FW}, {_HW})), '[{_STOP}]', ' ', 'g'), '[^\\p{{L}}\\p{{N}} \\n\\t]', '', 'g'), '[ \\n\\t]+', ' ', 'g'))"

ORACLES = {
    "d01_near_keys": f"WITH RECURSIVE {_KEYS}",
    "g05_hard_layers": f"WITH RECURSIVE {_LAYERS} SELECT doc_id, layer_no, text FROM la",
    "g06_length_cuts": f"WITH RECURSIVE {_CUTS} SELECT doc_id, layer_no, p, text FROM cu",
    "g05_g07_rule_lines": f"WITH RECURSIVE {_RULES}",
    "g12_alignment_sentences": f"WITH {_SENT}, f AS (SELECT doc_id, sent_no AS sn, text, {_PLAIN} AS folded FROM s2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sn) AS sent_no, text, folded, CAST(len(regexp_extract_all(folded, '[a-z0-9_]+|[^\\sa-z0-9_]')) AS INTEGER) AS n_tokens FROM f WHERE folded <> ''",
}
