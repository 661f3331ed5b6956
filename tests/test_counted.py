"""Counted rules, Unicode forms and export flags on fixed examples, against the character database, and on nulls and long texts."""

import random
import unicodedata

from pyspark.sql import functions as F

from takeweave.functions import counted as ct
from takeweave.functions import text as tx


def out(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def row(spark, rules, text):
    return ct.counted(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, deleted int"), rules).first().asDict()


def test_counts_of_each_rule(spark):
    rules = [ct.removed_bom(), ct.removed_controls(), ct.deleted_chars("*"), ct.mapped_chars({"a": "b", "b": "c", "&": "and", "x": "x"}), ct.substituted({"good": ["gd"]}), ct.styled_marks("ascii"), ct.single_marks(), ct.collapsed_lines()]
    got = row(spark, rules, "﻿ab*​ x & gd，，好……—— \n  z\t q \nend")
    assert got == {
        "doc_id": 1, "out": "bc x and good,好...-\nz q\nend", "len_before": 32, "len_after": 27, "bom_removed": 1, "removed_zw": 1, "deleted": 1, "mapped": 3, "alias_hits": 1,
        "punct_changes": 4, "repeats_removed": 1, "space_collapses": 2,
    }
    assert set(row(spark, rules, None).values()) == {1, None}
    empty = row(spark, rules, "")
    assert empty["out"] == "" and sum(empty[r.name] for r in rules) == 0
    total = ct.corpus_counts(ct.counted(spark.createDataFrame([(1, "a*"), (2, "zz"), (3, None)], "doc_id long, text string"), rules)).first()
    assert (total["docs"], total["changed"], total["deleted"], total["mapped"], total["len_before"]) == (3, 1, 1, 1, 4)


def test_styles_there_and_back(spark):
    for style, given, want, n in (("zh", "a,b. c...(d)--", "a，b。 c……（d）--", 5), ("en", "好，吗？——…", "好,吗?-...", 4), ("ascii", "“x”", '"x"', 2), ("en", "a, b... c-", "a, b... c-", 0), ("zh", "——", "——", 0)):
        got = row(spark, [ct.styled_marks(style)], given)
        assert (got["out"], got["punct_changes"]) == (want, n)


def test_aliases_in_order_or_longest_first(spark):
    assert row(spark, [ct.substituted({"X": ["ab", "abc"]})], "abc ab")["out"] == "X X"
    assert row(spark, [ct.substituted({"X": ["ab", "abc"]}, longest_first=False)], "abc ab")["out"] == "Xc X"
    assert row(spark, [ct.substituted({"X": ["X", ""]})], "aXa")["alias_hits"] == 0


def test_each_character_has_its_compatibility_form(spark):
    chars = [chr(c) for c in range(0x20, 0x30000) if  not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    chars = [c for c in chars if not 0xAC00 <= ord(c) < 0xD7A4]
    texts = ["\n".join(chars[i : i + 500]) for i in range(0, len(chars), 500)]
    wrong = [c for t, u in zip(texts, out(spark, ct.nfkc, *texts), strict=True) for c, d in zip(t.split("\n"), u.split("\n"), strict=True) if d != unicodedata.normalize("NFKC", c)]
    assert wrong == []


def test_marks_compose_behind_their_letters(spark):
    rng = random.Random(8)
    marks = ["̣", "̂", "́", "̈", "̧"]
    texts = []
    for _ in range(200):
        t = ""
        for _ in range(rng.randint(0, 8)):
            own = sorted(rng.sample(marks, rng.choice([0, 0, 1, 2])), key=unicodedata.combining)
            t += rng.choice("aeoucnAEＡｅﬁ½中㍿ ") + "".join(own)
        texts.append(t)
    # two marks of one class stay in their order in both forms
    assert out(spark, ct.nfkc, *texts) == [unicodedata.normalize("NFKC", t) for t in texts]
    assert out(spark, lambda c: ct.nfkc(c, cjk_marks=True), "Ａ，b．(c)", None, "") == ["A，b。（c）", None, ""]
    long = "ｅ́" * 20_000
    assert out(spark, ct.nfkc, long) == ["é" * 20_000]


def test_export_flags(spark):
    # published examples of the export form
    assert out(spark, ct.export_text, "A  B\tC\nD", "中文  中文", "[注]正文(旁白)", "等—等....好", None, "") == ["A B C D", "中文中文", "注正文旁白", "等-等...好", None, ""]
    assert out(spark, lambda c: ct.export_text(c, {"（": "(", "）": ")"}), "（旁白）") == ["（旁白）"]
    assert out(spark, lambda c: ct.export_text(c, keep_wide_brackets=False, ascii_brackets=True, drop_ascii_brackets=False), "（旁白）") == ["(旁白)"]
    assert out(spark, lambda c: ct.export_text(c, hard_collapse=False), "人类\n如今", "Hello\nWorld", "第\n1章") == ["人类如今", "Hello World", "第1章"]
    assert out(spark, lambda c: ct.export_text(c, hard_collapse=False, collapse_lines=False), "a\n\n b") == ["a\nb"]
    assert out(spark, lambda c: ct.spaced_blocks(tx.cjk_spacing(c)), "中 文 abc  中，  文") == ["中文 abc 中，文"]
