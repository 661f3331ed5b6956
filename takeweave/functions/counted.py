"""Text rules that tell how often they changed something, and Unicode forms from tables.

A :class:`Rule` is a small function on one text; :func:`counted` runs the rules one after the other on the texts of Arrow batches where they lie.
String searches pass over what a rule leaves alone many times faster than ``translate`` and regular expressions over columns.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import ne
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from takeweave.functions import text as tx

# Marks of the styles and their counterparts, one to one; dashes and ellipses of a style.
STYLES = {
    "ascii": ("，。！？：；（）【】《》「」“”‘’", ",.!?:;()[]<>\"\"\"\"''"),
    "cjk": (",.!?:;()[]<>", "，。！？：；（）【】《》"),
    "zh": (",.!?:;()[]<>", "，。！？：；（）【】《》"),
    "en": ("，。！？：；（）【】《》", ",.!?:;()[]<>"),
}
DASHES, ELLIPSES = "[‒–—―－﹘﹣]+", "\\.{3,}|。{3,}|．{3,}|…+"
DASH = {"ascii": "-", "en": "-", "cjk": "——", "zh": "——"}
ELLIPSIS = {"ascii": "...", "en": "...", "cjk": "……", "zh": "……"}
# Control and format characters but line breaks and tabs, as a class of a regular expression.
CONTROLS = (
    "\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\xad\\u0600-\\u0605\\u061c\\u06dd\\u070f\\u08e2\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u2066-\\u206f"
    "\\ufeff\\ufff9-\\ufffb\\U000110bd\\U000110cd\\U00013430-\\U00013438\\U0001bca0-\\U0001bca3\\U0001d173-\\U0001d17a\\U000e0001\\U000e0020-\\U000e007f"
)
NARROW_MARKS, WIDE_MARKS = ",.?!:;()[]", "，。？！：；（）【】"


class Rule(NamedTuple):
    """``apply``: text -> (new text, how often it changed)."""

    name: str
    apply: Callable[[str], tuple[str, int]]


def _fewer(new: Callable[[str], str]) -> Callable[[str], tuple[str, int]]:
    """``new`` with the number of characters that go."""

    def apply(t: str) -> tuple[str, int]:
        u = new(t)
        return u, len(t) - len(u)

    return apply


def _translation(source: str, target: str = "") -> Callable[[str], str]:
    """As ``translate`` of columns: characters one by one, all at once; those without a counterpart go."""
    pairs = {}
    for i, c in enumerate(source):
        pairs.setdefault(c, target[i : i + 1])
    if not set(pairs) & set(target):
        return lambda t: _replaced_all(t, pairs)
    found = re.compile("[" + "".join(map(re.escape, pairs)) + "]")
    return lambda t: found.sub(lambda m: pairs[m[0]], t)


def _replaced_all(t: str, pairs: dict[str, str]) -> str:
    for k, v in pairs.items():
        t = t.replace(k, v)
    return t


def removed_bom() -> Rule:
    def apply(t: str) -> tuple[str, int]:
        u = t.lstrip("\ufeff")
        return u, int(len(u) < len(t))

    return Rule("bom_removed", apply)


def removed_controls() -> Rule:
    """Control and format characters but line breaks and tabs."""
    found = re.compile(f"[{CONTROLS}]")
    return Rule("removed_zw", _fewer(lambda t: found.sub("", t)))


def deleted_chars(chars: str) -> Rule:
    return Rule("deleted", _fewer(_translation(chars)))


def mapped_chars(pairs: dict[str, str], name: str = "mapped") -> Rule:
    """Single characters by strings of any length (F02), all at once: no target is mapped again. A character that maps to itself doesn't count."""
    pairs = {k: v for k, v in pairs.items() if k != v}
    single = {k: v for k, v in pairs.items() if len(v) == 1}
    longer = {k: v for k, v in pairs.items() if len(v) != 1}
    if any(len(k) != 1 for k in pairs):
        raise ValueError("only single characters are mapped")
    held = dict(zip(longer, map(chr, range(0xF0000, 0xF0000 + len(longer))), strict=True))
    at_once = _translation("".join(single) + "".join(held), "".join(single.values()) + "".join(held.values()))
    last = {held[k]: v for k, v in longer.items()}
    return Rule(name, lambda t: (_replaced_all(at_once(t), last), sum(map(t.count, pairs))))


def styled_marks(style: str) -> Rule:
    """Marks of a style (F07): each mark, dash run and ellipsis that is not yet in it counts once."""
    source, target = STYLES[style]
    dash, dots = DASH[style], ELLIPSIS[style]
    marks, held = _translation(source, target), chr(0xF0000)
    # DASHES and ELLIPSES in a form that begins with a character or class: such places are searched for many times faster
    dashes, ellipses = re.compile(DASHES[:-1] + DASHES[:-1] + "*"), re.compile("\\.\\.\\.+|。。。+|．．．+|……*")

    def apply(t: str) -> tuple[str, int]:
        n = 0
        if any(x in t for x in DASHES[1:-2]):
            n += sum(x != dash for x in dashes.findall(t))
            t = dashes.sub(dash, t)
        if any(x in t for x in ("...", "。。。", "．．．", "…")):
            n += sum(x != dots for x in ellipses.findall(t))
            t = ellipses.sub(held, t)
        return marks(t).replace(held, dots), n + sum(map(t.count, source))

    return Rule("punct_changes", apply)


def single_marks() -> Rule:
    """Repeated marks once (F07): the count is that of the marks that go."""

    def new(t: str) -> str:
        for x in tx.CJK_MARKS + ",!?:;":
            while x + x in t:
                t = t.replace(x + x, x)
        return t

    return Rule("repeats_removed", _fewer(new))


def _lines(t: str) -> str:
    return t.replace("\r\n", "\n").replace("\r", "\n")


def _one_space(t: str) -> str:
    while "  " in t:
        t = t.replace("  ", " ")
    return t


def collapsed_lines() -> Rule:
    """Lines trimmed and their runs of blanks made one space (F08); the count is that of changed lines."""

    def apply(t: str) -> tuple[str, int]:
        t = _lines(t)
        new = _one_space(_replaced_all(t, {"\t": " ", "\f": " ", "\x0b": " "})).replace(" \n", "\n").replace("\n ", "\n").strip(" ")
        return new, sum(map(ne, t.split("\n"), new.split("\n")))

    return Rule("space_collapses", apply)


def substituted(aliases: dict[str, list[str]], longest_first: bool = True) -> Rule:
    """Variants to their canonical form, the longest first or in the given order (F13); each place replaced counts."""
    pairs = [(v, k) for k, vs in aliases.items() for v in vs if v and v != k]
    pairs = sorted(pairs, key=lambda p: (-len(p[0]), p[0])) if longest_first else pairs

    def apply(t: str) -> tuple[str, int]:
        n = 0
        for v, k in pairs:
            hits = t.count(v)
            if hits:
                t, n = t.replace(v, k), n + hits
        return t, n

    return Rule("alias_hits", apply)


def texts_of(column: pa.Array) -> list[str | None]:
    """The texts of a column; what is not UTF-8 becomes the replacement character, as it does inside the JVM."""
    return [b if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.large_binary()).to_pylist()]


def counted(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, out, len_before, len_after and one long a rule: how often it changed the text (F22). A null text gives nulls."""
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rules need names of their own")
    names = ["len_before", "len_after", *[r.name for r in rules]]
    steps = [r.apply for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs, counts = [], [[] for _ in names]
            for t in texts_of(batch.column(1)):
                found = [None] * len(names)
                if t is not None:
                    found[0] = len(t)
                    for i, step in enumerate(steps, 2):
                        t, found[i] = step(t)
                    found[1] = len(t)
                outs.append(t)
                for column, n in zip(counts, found, strict=True):
                    column.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outs, batch.schema.field(1).type), *[pa.array(c, pa.int64()) for c in counts]], [key, "out", *names])

    d = docs.select(key, F.col(text).cast("string").alias("out"))
    schema = StructType([d.schema[0], d.schema[1], *[StructField(n, LongType()) for n in names]])
    return d.mapInArrow(run, schema)


def corpus_counts(counts: DataFrame) -> DataFrame:
    """One row (F22): docs, changed, and the sums of all lengths and counts of :func:`counted`; changed counts the documents that any rule changed."""
    names = [c for c in counts.columns[1:] if c != "out"]
    rules = [c for c in names if not c.startswith("len_")]
    any_change = sum((F.coalesce(F.col(c), F.lit(0)) for c in rules), F.lit(0)) > 0
    return counts.agg(F.count("*").alias("docs"), F.count_if(any_change).alias("changed"), *[F.sum(c).alias(c) for c in names])


@lru_cache(1)
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Compatibility forms of single characters (to one, to several) and compositions of a character with a mark, from the character database."""
    one, many, composed = {}, {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) in ("Cn", "Co"):
            continue
        n = unicodedata.normalize("NFKC", c)
        if n != c:
            (one if len(n) == 1 else many)[c] = n
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.normalize("NFC", d) == c and not 0xAC00 <= code < 0xD7A4:
            first = unicodedata.normalize("NFC", d[:-1])
            if len(first) == 1:
                composed[first + d[-1]] = c
    return one, many, composed


def nfkc(c: Column, cjk_marks: bool = False) -> Column:
    """Compatibility composition by tables (F01); with ``cjk_marks`` ASCII marks go back to their wide forms.

    Characters with a form of one character are translated; of the others only those that the text holds are looked up. Then
    characters and the marks behind them are composed, one mark a round, three rounds. Two things of the full form are left out: marks in
    another than the canonical order are not reordered, and conjoining Hangul letters are not joined to syllables.
    """
    one, many, composed = _tables()
    out = F.translate(c, "".join(one), "".join(one.values()))
    # The tables are searched only where a text has characters that may be in them.
    out = _let(out, lambda t: F.when(t.rlike("[^\\x00-\\xA0\\xC0-\\x{FF}\\x{4E00}-\\x{9FFF}]"), _replaced(t, F.split(t, ""), many)).otherwise(t))
    for _ in range(3):
        out = _let(out, lambda t: F.when(t.rlike("\\p{M}"), _replaced(t, F.regexp_extract_all(t, F.lit("(?s)(?=(.\\p{M}))"), F.lit(1)), composed)).otherwise(t))
        out = _let(out, lambda t: F.when(t.rlike("\\p{M}\\p{M}"), _composed_over(t, composed)).otherwise(t))
    return F.translate(out, NARROW_MARKS, WIDE_MARKS) if cjk_marks else out


@lru_cache(1)
def _classes() -> tuple[str, str]:
    """Combining marks, and a character that stands for the class of each."""
    marks = [chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]
    return "".join(marks), "".join(chr(0xE000 + unicodedata.combining(m)) for m in marks)


def _composed_over(t: Column, table: dict[str, str]) -> Column:
    """A character composed with the second of two marks behind it, where it did not compose with the first and that is of another class."""
    keys, values = (F.split(F.lit("\x00".join(x)), "\x00") for x in (table, table.values()))
    at = lambda x, i: F.substring(x, i, 1)
    place = lambda x: F.array_position(keys, F.concat(at(x, 1), at(x, 3))).cast("int")
    kind = lambda m: F.translate(m, *_classes())
    found = F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(.\\p{M}\\p{M}))"), F.lit(1)))
    found = F.filter(found, lambda x: (kind(at(x, 2)) != kind(at(x, 3))) & (place(x) > 0))
    return F.aggregate(found, t, lambda a, x: F.replace(a, x, F.concat(F.get(values, place(x) - 1), at(x, 2))))


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _replaced(t: Column, found: Column, table: dict[str, str]) -> Column:
    """``t`` with those of ``found`` that are keys of ``table`` replaced: the table is searched once for each different key that the text holds."""
    keys, values = (F.split(F.lit("\x00".join(x)), "\x00") for x in (table, table.values()))
    present = F.array_intersect(found, keys)
    return F.aggregate(present, t, lambda a, k: F.replace(a, k, F.get(values, F.array_position(keys, k).cast("int") - 1)))


def spaced_blocks(c: Column) -> Column:
    """One space between a run of ASCII letters or digits and CJK text that stand apart."""
    return F.regexp_replace(F.regexp_replace(c, f"([A-Za-z0-9])\\s+(?=[{tx.CJK}])", "$1 "), f"(?<=[{tx.CJK}])\\s+([A-Za-z0-9])", " $1")


_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_BLANK, _CJK, _KANA = "[ \\t\\n\\x0b\\f\\r]", "\u3400-\u9fff\uf900-\ufaff", "\u3040-\u30ff"
_WIDE = "\u00a0\u2000-\u200d\u3000\ufeff"
_HARD = re.compile(f"[ \\t\\r\\n\\f\\x0b{_WIDE}]+")
_ODD_BLANKS = re.compile(f"[\\t\\f\\x0b\u1680\u180e\u202f\u205f{_WIDE}]")
_AROUND_BREAKS = re.compile(f"\\n{_BLANK}*|{_BLANK}*\\n")
_LINE_ENDS = re.compile("(?:\\A|(?<=[\\n\\x85])) +| +(?=[\\n\\x85]|\\Z)")
_INSIDE_CJK = re.compile(f"([{_CJK}{_KANA}]){_BLANK}+(?=[{_CJK}{_KANA}])")
_BEFORE_CJK, _BEHIND_CJK = re.compile(f"([A-Za-z0-9]){_BLANK}+(?=[{_CJK}])"), re.compile(f"([{_CJK}]){_BLANK}+(?=[A-Za-z0-9])")
_EXPORT_DASHES, _MANY_DOTS = re.compile("[‒–—―﹘﹣][‒–—―﹘﹣]*"), re.compile("\\.{4,}")


def _joined_lines(t: str) -> str:
    """Trimmed lines as one: a space where the two that meet end and begin with an ASCII letter or digit."""
    out, last = [], ""
    for line in t.split("\n"):
        line = line.strip(" ")
        if line[:1] in _ALNUM and last[-1:] in _ALNUM:
            out.append(" ")
        out.append(line)
        last = line
    return "".join(out)


def export_text(c: Column, char_map: dict[str, str] | None = None, delete: str = "", drop_ascii_brackets: bool = True, keep_wide_brackets: bool = True, ascii_brackets: bool = False, collapse_lines: bool = True, hard_collapse: bool = True, space_blocks: bool = False) -> Column:
    """The export form with all its flags (F21), in the published order: characters, hard collapse, soft breaks, white space, brackets, spacing, dashes and dots.

    ``keep_wide_brackets`` leaves （） alone whatever the map says; ``ascii_brackets`` makes them ( ) where they are not kept.
    """
    mapped = mapped_chars({k: v for k, v in (char_map or {}).items() if not (keep_wide_brackets and k in "（）")}).apply
    kept, narrow, blanks, bare = _translation(delete), _translation("（）", "()"), _translation("\t\u00a0\u2028\u2029\u200b", "    "), _translation("()[]{}")

    def exported(t: str) -> str:
        t = mapped(kept(t))[0]
        if ascii_brackets and not keep_wide_brackets:
            t = narrow(t)
        if hard_collapse:
            t = _HARD.sub(" ", t).strip(" ")
        if collapse_lines:
            t = _one_space(_joined_lines(_ODD_BLANKS.sub(" ", _lines(t)))).strip(" ")
        t = blanks(_lines(t))
        t = _AROUND_BREAKS.sub("\n", t) if "\n" in t else t
        t = _LINE_ENDS.sub("", t) if "\n" in t or "\x85" in t else t.strip(" ")
        t = _INSIDE_CJK.sub("\\1", _one_space(t)).strip(" ")
        t = bare(t) if drop_ascii_brackets else t
        if space_blocks and any(x in t for x in ("  ", "\n", "\f", "\x0b")):  # single spaces stay as they are
            t = _BEHIND_CJK.sub("\\1 ", _BEFORE_CJK.sub("\\1 ", t))
        t = _EXPORT_DASHES.sub("-", t)
        return (_MANY_DOTS.sub("...", t) if "...." in t else t).strip(" ")

    @F.arrow_udf("string")
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else exported(t) for t in texts_of(texts)], texts.type)

    return column(c)
