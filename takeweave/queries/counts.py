"""Queries of counted text rules, Unicode forms, breaks, spacing and export flags, on relation D with marks, widths and spaces put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from takeweave.functions import counted as ct
from takeweave.functions import text as tx
from takeweave.plans.fixtures import table

ALIASES = {"the": ["teh", "thhe"], "and": ["annd", "an an", "nnd"], "of": ["off"]}
MAP = {"|": "/", "&": " and ", "$": "USD", "—": "-"}


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


#: What is put into the texts: (plain, odd) pairs that no later pair touches.
ODD = [
    (". ", "。。 "), (" in ", " ｉｎ "), (" the ", " teh "), ("\u00e9", "e\u0301"), ("fi", "\ufb01"), ("; ", "；—— "), ("\n", " \t\r\n"),
    (" on ", "\u200b on\ufeff "), ("ffe", "\ufb00e"), (" a ", " 中 文 a "), (" \u00e4", "\u00a0\u00e4"), (" de ", " \u216b ....de "),
]


def _odd(s, d):
    t = F.col("text")
    for plain, odd in ODD:
        t = F.replace(t, F.lit(plain), F.lit(odd))
    return _docs(s, d).select("doc_id", t.alias("text"))


RULES = [ct.removed_bom(), ct.removed_controls(), ct.deleted_chars("*#"), ct.mapped_chars(MAP), ct.substituted(ALIASES), ct.styled_marks("en"), ct.single_marks(), ct.collapsed_lines()]


def _one(rules):
    return lambda s, d: ct.counted(_odd(s, d), rules)


QUERIES = {
    "f02_map_counts": _one([ct.deleted_chars("*#e"), ct.mapped_chars(MAP)]),
    "f07_zh_counts": _one([ct.styled_marks("zh"), ct.single_marks()]),
    "f07_en_counts": _one([ct.styled_marks("en"), ct.single_marks()]),
    "f13_alias_hits": _one([ct.substituted(ALIASES)]),
    "f22_rule_counts": _one(RULES),
    "f22_corpus_counts": lambda s, d: ct.corpus_counts(ct.counted(_odd(s, d), RULES)),
    "f01_nfkc": lambda s, d: _odd(s, d).select("doc_id", ct.nfkc(F.col("text")).alias("out")),
    "f01_nfkc_cjk_marks": lambda s, d: _odd(s, d).select("doc_id", ct.nfkc(F.col("text"), cjk_marks=True).alias("out")),
    "f05_soft_breaks": lambda s, d: _docs(s, d).select("doc_id", tx.join_soft_breaks(F.col("text")).alias("out")),
    "f06_spacing": lambda s, d: _odd(s, d).select("doc_id", ct.spaced_blocks(tx.cjk_spacing(F.col("text"))).alias("out")),
    "f21_export_flags": lambda s, d: _odd(s, d).select("doc_id", ct.export_text(F.col("text"), MAP, "*#", ascii_brackets=True, keep_wide_brackets=False, hard_collapse=False, space_blocks=True).alias("out")),
}

_q = lambda x: "'" + x.replace("'", "''") + "'"
_expr = "text"
for _plain, _new in ODD:
    _expr = f"replace({_expr}, {' || '.join('chr(' + str(ord(ch)) + ')' for ch in _plain)}, {' || '.join('chr(' + str(ord(ch)) + ')' for ch in _new)})"
_X = f"x AS (SELECT doc_id, {_expr} AS text FROM documents)"
_FROM, _TO = ct.STYLES["en"]
_ZW = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}\\x{ad}\\x{200b}-\\x{200f}\\x{2060}\\x{feff}]"
_MAPPED = "replace(replace(replace(translate({t}, '|—', '/-'), '$', chr(983040)), '&', ' and '), chr(983040), 'USD')"
_times = lambda t, v: f"(length({t}) - length(replace({t}, {_q(v)}, ''))) // {len(v)}"


def _styled(style: str) -> tuple[str, str]:
    """(new text, count) of a text t in a style: ellipses aside, dashes, then single marks."""
    source, target = ct.STYLES[style]
    dots, dash = ct.ELLIPSIS[style], ct.DASH[style]
    rest = f"regexp_replace(t, '{ct.ELLIPSES}', chr(983040), 'g')"
    new = f"replace(translate(regexp_replace({rest}, '{ct.DASHES}', '{dash}', 'g'), {_q(source)}, {_q(target)}), chr(983040), '{dots}')"
    bare = f"replace({rest}, chr(983040), '')"
    count = f"length({bare}) - length(translate({bare}, {_q(source)}, '')) + len([e FOR e IN regexp_extract_all(t, '{ct.ELLIPSES}') IF e <> '{dots}']) + len([e FOR e IN regexp_extract_all(t, '{ct.DASHES}') IF e <> '{dash}'])"
    return new, count


# the backreferences of one replacement end at nine
_SINGLES = "regexp_replace(regexp_replace({t}, '(，)，+|(。)。+|(！)！+|(？)？+|(：)：+|(；)；+|(（)（+|(）)）+', '\\1\\2\\3\\4\\5\\6\\7\\8', 'g'), '(,),+|(!)!+|(\\?)\\?+|(:):+|(;);+', '\\1\\2\\3\\4\\5', 'g')"


def _style_sql(style: str) -> str:
    new, count = _styled(style)
    return f"WITH {_X}, a AS (SELECT doc_id, text AS t FROM x), b AS (SELECT doc_id, t, {new} AS u, {count} AS n FROM a), c AS (SELECT *, {_SINGLES.format(t='u')} AS v FROM b) SELECT doc_id, v AS out, length(t) AS len_before, length(v) AS len_after, CAST(n AS BIGINT) AS punct_changes, length(u) - length(v) AS repeats_removed FROM c"


def _alias_steps(first: str) -> tuple[str, str]:
    """Common table expressions that replace one variant each from ``first``(doc_id, t, n), and the last one's name."""
    pairs = sorted(((v, k) for k, vs in ALIASES.items() for v in vs), key=lambda p: (-len(p[0]), p[0]))
    steps, at = [], first
    for i, (v, k) in enumerate(pairs):
        steps.append(f"al{i} AS (SELECT * REPLACE (replace(t, {_q(v)}, {_q(k)}) AS t, alias_hits + {_times('t', v)} AS alias_hits) FROM {at})")
        at = f"al{i}"
    return ", ".join(steps), at


_ALIAS, _LAST = _alias_steps("a4")
_NEW, _COUNT = _styled("en")
_LINES = "string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
_FULL = (
    f"{_X}, a0 AS (SELECT doc_id, text AS t, length(text) AS len_before FROM x), a1 AS (SELECT doc_id, len_before, regexp_replace(t, '^\\x{{feff}}+', '') AS t, CASE WHEN starts_with(t, chr(65279)) THEN 1 ELSE 0 END AS bom_removed FROM a0), "
    f"a2 AS (SELECT * REPLACE (regexp_replace(t, '{_ZW}', '', 'g') AS t), length(t) - length(regexp_replace(t, '{_ZW}', '', 'g')) AS removed_zw FROM a1), a3 AS (SELECT * REPLACE (translate(t, '*#', '') AS t), length(t) - length(translate(t, '*#', '')) AS deleted FROM a2), "
    f"a4 AS (SELECT * REPLACE ({_MAPPED.format(t='t')} AS t), length(t) - length(translate(t, '|&$—', '')) AS mapped, 0::BIGINT AS alias_hits FROM a3), {_ALIAS}, "
    f"a5 AS (SELECT * REPLACE ({_NEW} AS t), {_COUNT} AS punct_changes FROM {_LAST}), a6 AS (SELECT * REPLACE ({_SINGLES.format(t='t')} AS t), length(t) - length({_SINGLES.format(t='t')}) AS repeats_removed FROM a5), "
    f"a7 AS (SELECT *, {_LINES} AS ol FROM a6), a8 AS (SELECT *, [trim(regexp_replace(l, '[ \\t\\f\\x0b]+', ' ', 'g')) FOR l IN ol] AS nl FROM a7), "
    "fc AS (SELECT doc_id, array_to_string(nl, chr(10)) AS out, len_before, length(array_to_string(nl, chr(10))) AS len_after, CAST(bom_removed AS BIGINT) AS bom_removed, removed_zw, deleted, mapped, alias_hits, CAST(punct_changes AS BIGINT) AS punct_changes, repeats_removed, CAST(len([1 FOR o, i IN ol IF o <> nl[i]]) AS BIGINT) AS space_collapses FROM a8)"
)
_COUNTS = ("bom_removed", "removed_zw", "deleted", "mapped", "alias_hits", "punct_changes", "repeats_removed", "space_collapses")
_NFKC = "nfc_normalize(replace(replace(replace(replace(replace(replace(replace(translate(text, 'ｉｎ；', 'in;'), '\ufb01', 'fi'), '\ufb00', 'ff'), '\u216b', 'XII'), '\u2026', '...'), chr(160), ' '), '\u00b2', '2'), chr(65279), chr(65279)))"
_C = "\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}"

ORACLES = {
    "f02_map_counts": f"WITH {_X}, a AS (SELECT doc_id, text AS t, translate(text, '*#e', '') AS u FROM x) SELECT doc_id, {_MAPPED.format(t='u')} AS out, length(t) AS len_before, length({_MAPPED.format(t='u')}) AS len_after, length(t) - length(u) AS deleted, length(u) - length(translate(u, '|&$—', '')) AS mapped FROM a",
    "f07_zh_counts": _style_sql("zh"),
    "f07_en_counts": _style_sql("en"),
    "f13_alias_hits": f"WITH {_X}, a4 AS (SELECT doc_id, text AS t, length(text) AS len_before, 0::BIGINT AS alias_hits FROM x), {_ALIAS} SELECT doc_id, t AS out, len_before, length(t) AS len_after, alias_hits FROM {_LAST}",
    "f22_rule_counts": f"WITH {_FULL} SELECT * FROM fc",
    "f22_corpus_counts": f"WITH {_FULL} SELECT count(*) AS docs, count(*) FILTER ({' + '.join(_COUNTS)} > 0) AS changed, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("len_before", "len_after", *_COUNTS)) + " FROM fc",
    "f01_nfkc": f"WITH {_X} SELECT doc_id, {_NFKC} AS out FROM x",
    "f01_nfkc_cjk_marks": f"WITH {_X} SELECT doc_id, translate({_NFKC}, '{ct.NARROW_MARKS}', '{ct.WIDE_MARKS}') AS out FROM x",
    # letters and digits on both sides: a space; the SQL has no look-around, so two passes of captures stand for it
    "f05_soft_breaks": "WITH a AS (SELECT doc_id, regexp_replace(text, '[ \\t]*\\r?\\n[ \\t]*', chr(10), 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([A-Za-z0-9])[\\n\\t]+([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])[\\n\\t]+([A-Za-z0-9])', '\\1 \\2', 'g') AS t FROM a) SELECT doc_id, regexp_replace(t, '[\\n\\t]+', '', 'g') AS out FROM b",
    "f06_spacing": f"WITH {_X}, a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([{_C}]) +([{_C}])', '\\1\\2', 'g'), '([{_C}]) +([{_C}])', '\\1\\2', 'g') AS t FROM x), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, ' +([，。！？：；（）])', '\\1', 'g'), '([，。！？：；（）]) +', '\\1', 'g') AS t FROM a) SELECT doc_id, regexp_replace(regexp_replace(t, '([A-Za-z0-9])\\s+([{_C}])', '\\1 \\2', 'g'), '([{_C}])\\s+([A-Za-z0-9])', '\\1 \\2', 'g') AS out FROM b",
}
