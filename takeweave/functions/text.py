"""Text rules as column expressions for corpus jobs: each takes and returns string columns and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and pairs of the rules.
CJK = "\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}"
ZERO_WIDTH = "​‌‍⁠﻿"
STOPS = ".!?。！？…；;"
CLOSERS = "\"')\\]}”’」』）】》"
WIDE_SPACES = " 　   "
ASCII_MARKS, CJK_MARKS = ",.!?:;()", "，。！？：；（）"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def fold_width(c: Column) -> Column:
    """Full-width ASCII and the ideographic space to their narrow forms."""
    # Translating makes a string for each character: only texts that have one of the characters are.
    return F.when(c.rlike("[\\x{FF01}-\\x{FF5E}\\x{3000}]"), F.translate(c, FULL_WIDTH, HALF_WIDTH)).otherwise(c)


def map_chars(c: Column, delete: str = "", pairs: dict[str, str] | None = None) -> Column:
    """Delete characters and map others, one to one by translate, one to many by replace."""
    one = {k: v for k, v in (pairs or {}).items() if len(v) == 1}
    c = F.translate(c, "".join(one) + delete, "".join(one.values()))
    for k, v in (pairs or {}).items():
        if len(v) != 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_controls(c: Column) -> Column:
    """Control and format characters but line breaks and tabs go."""
    return F.regexp_replace(c, "[\\p{Cc}\\p{Cf}&&[^\\n\\r\\t]]", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space, outer space goes."""
    return F.trim(F.regexp_replace(c, f"[ \\t\\r\\n\\x0b\\f{WIDE_SPACES}]+", " "))


def join_soft_breaks(c: Column) -> Column:
    """A line break between ASCII letters or digits becomes a space, any other break goes."""
    c = F.regexp_replace(c, "[ \\t]*\\r?\\n[ \\t]*", "\n")
    c = F.regexp_replace(c, "(?<=[A-Za-z0-9])[\\n\\t]+(?=[A-Za-z0-9])", " ")
    c = F.regexp_replace(c, f"(?<=[A-Za-z0-9{CJK}])[\\n]+(?=[A-Za-z0-9{CJK}])", "")
    return F.regexp_replace(c, "[\\n\\t]+", "")


def cjk_spacing(c: Column) -> Column:
    """No space between CJK characters or beside CJK marks."""
    c = F.regexp_replace(c, f"(?<=[{CJK}]) +(?=[{CJK}])", "")
    return F.regexp_replace(F.regexp_replace(c, f" +(?=[{CJK_MARKS}])", ""), f"(?<=[{CJK_MARKS}]) +", "")


def mark_style(c: Column, style: str) -> Column:
    """Marks in ASCII or CJK form, repeated ones once."""
    c = F.translate(c, CJK_MARKS, ASCII_MARKS) if style == "ascii" else F.translate(c, ASCII_MARKS, CJK_MARKS)
    return F.regexp_replace(c, f"([{CJK_MARKS},!?:;])\\1+", "$1")


def trim_lines(c: Column) -> Column:
    """Each line trimmed, runs of blank lines become one."""
    lines = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(lines, "\n{3,}", "\n\n")


def substitute(c: Column, aliases: dict[str, list[str]]) -> Column:
    """Variants to their canonical form, longest variant first."""
    pairs = sorted(((v, k) for k, vs in aliases.items() for v in vs), key=lambda p: (-len(p[0]), p[0]))
    for variant, canonical in pairs:
        c = F.replace(c, F.lit(variant), F.lit(canonical))
    return c


def alignment_form(c: Column) -> Column:
    """Lower case, zero-width characters gone, stops to spaces, other marks gone, space collapsed (F16)."""
    c = F.regexp_replace(F.lower(fold_width(c)), f"[{ZERO_WIDTH}]", "")
    c = F.regexp_replace(c, f"[{STOPS}]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^\\p{L}\\p{N} \\n\\t]", ""), "[ \\n\\t]+", " "))


def canonical_form(c: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")


def match_tokens(c: Column) -> Column:
    """Runs of ASCII word characters, other characters one by one."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+|[^\\sa-z0-9_]"), F.lit(0))


def export_form(c: Column) -> Column:
    """Width, controls, hard collapse and ASCII marks in this order."""
    return mark_style(collapse(strip_controls(fold_width(c))), "ascii")


def ascii_share(c: Column) -> Column:
    """Share of ASCII among the characters that are not white space."""
    solid = F.regexp_replace(c, "\\s", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, "[^\\x21-\\x7e]", "")) / F.length(solid)).otherwise(0.0)


def preview(c: Column, n: int = 48) -> Column:
    """At most ``n`` characters, an ellipsis where text is cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def hard_stops(c: Column) -> Column:
    """Pieces that end in their stop marks and closers."""
    return F.regexp_extract_all(c, F.lit(f"[^{STOPS}]+[{STOPS}]*[{CLOSERS}]*"), F.lit(0))


# Abbreviations whose dot ends no sentence, number signs and unit words.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "etc", "e.g", "i.e")
NUMBER_SIGNS, NUMBER_DIGITS = "零〇一二三四五六七八九两", "001234567892"
UNITS = (("毫秒", "ms"), (" milliseconds", "ms"), ("秒", "s"), (" seconds", "s"), ("分钟", "min"), (" minutes", "min"), ("小时", "h"), (" hours", "h"))
HELD_DOT = chr(0xE000)


def compatibility_pairs() -> tuple[str, str]:
    """Radicals and compatibility ideographs with the character that NFKC gives them."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for r in (range(0x2E80, 0x2FE0), range(0xF900, 0xFB00)) for c in r]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def compatibility(c: Column) -> Column:
    """Compatibility characters to their plain form."""
    return F.translate(c, *compatibility_pairs())


def unmapped(c: Column) -> Column:
    """Number of characters of the compatibility ranges that have no plain form."""
    return F.length(F.regexp_replace(compatibility(c), "[^\\x{2E80}-\\x{2FDF}\\x{F900}-\\x{FAFF}]", ""))


def mixed_width(c: Column) -> Column:
    """Narrow digits, lower case, one space between CJK and Latin letters or digits."""
    c = F.lower(F.translate(c, FULL_WIDTH[15:25], HALF_WIDTH[15:25]))
    return F.regexp_replace(F.regexp_replace(c, f"([{CJK}])([a-z0-9])", "$1 $2"), f"([a-z0-9])([{CJK}])", "$1 $2")


def unit_form(c: Column) -> Column:
    """Lower case, number signs as digits, unit words as their short forms."""
    c = F.translate(F.lower(c), NUMBER_SIGNS, NUMBER_DIGITS)
    for word, unit in UNITS:
        c = F.replace(c, F.lit(word), F.lit(unit))
    return c


def hold_dots(c: Column) -> Column:
    """Dots inside addresses, domains and numbers and after abbreviations as a private character."""
    for _ in range(2):
        c = F.regexp_replace(c, "([A-Za-z0-9])\\.([A-Za-z0-9])", f"$1{HELD_DOT}$2")
    known = "|".join(a.replace(".", HELD_DOT) for a in ABBREVIATIONS)
    return F.regexp_replace(c, f"(^|[^A-Za-z])({known})\\.", f"$1$2{HELD_DOT}")


def hold_inner_dots(c: Column) -> Column:
    """White space collapsed, dots before anything but the end or a capital as a private character."""
    return F.regexp_replace(F.regexp_replace(c, "[ \\n\\t]+", " "), "\\.( ?[^A-Z .])", f"{HELD_DOT}$1")


def release_dots(c: Column) -> Column:
    return F.replace(c, F.lit(HELD_DOT), F.lit("."))
