"""The rule splitter: hard layers outside quotes and brackets, cuts by length, short lines joined, hard marks enforced."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.functions import text as tx
from takeweave.operators import segment

# Openers and closers of the splitter, marks that end a line and marks behind which a long one may be cut.
PAIRS = dict(zip("（〔［【《〈「『“‘([{", "）〕］】》〉」』”’)]}", strict=True))
HARD = "。！？!?；;…."
SOFT = "，,、：:—"
STRAIGHT = '"'
LENGTHS = {"least": 8, "most": 24, "hard": 32}


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in dict.fromkeys(chars)) + "]"


def _layers(t: str, hard: str, kind: dict[str, str], marks: re.Pattern) -> Iterator[str]:
    """The layers of one text: a stack of the closers that it waits for, from mark to mark; the cut behind a hard mark waits for the closers behind it."""
    closers, stack, lo, at, ended = frozenset(kind.values()), [], 0, 0, False
    for m in marks.finditer(t):
        i, c = m.start(), m.group()
        if ended and (i > at or c not in closers):
            yield t[lo:at]
            lo, ended = at, False
        if stack and stack[-1] == c:
            stack.pop()
        elif c in kind:
            stack.append(kind[c])
        if c not in closers:
            ended = c in hard and not stack
        at = i + 1
    if ended and at < len(t):
        yield t[lo:at]
        lo = at
    yield t[lo:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"))


def _layer_walk(hard: str, pairs: dict[str, str]) -> Callable[[str], Iterator[str]]:
    kind = pairs | {STRAIGHT: STRAIGHT}
    marks = re.compile(_class(hard + "".join(kind) + "".join(kind.values())))
    return lambda t: (x for x in (y.strip(" ") for y in _layers(t, hard, kind, marks)) if x)


def hard_layers(docs: DataFrame, hard: str = HARD, pairs: dict[str, str] = PAIRS) -> DataFrame:
    """(doc_id, layer_no, text): texts cut behind hard marks that lie in no open bracket or quote.

    Closers right behind such a mark stay with it. Each opener waits for its own closer; other closers count for nothing; the
    straight double quote opens and closes in turn, the apostrophe is a letter. White space is collapsed, blank layers are dropped;
    a null text has none. Each text is walked where it lies: no row for each mark, nothing shuffled.
    """
    p = segment.walked(_texts(docs), _layer_walk(hard, pairs)).select("doc_id", F.posexplode("xs").alias("p", "text"))
    return p.select("doc_id", (F.col("p") + 1).cast("long").alias("layer_no"), "text")


def length_cuts(text: Column, soft: str = SOFT, lengths: dict[str, int] = LENGTHS) -> Column:
    """Pieces of a text without line breaks (G06), each found from where the last one ended.

    What is longer than ``most`` is cut behind the last soft mark or space from ``least`` to ``most`` characters on, else behind
    the next one before ``hard``, else at ``hard``. A soft mark that would begin the next piece stays behind; outer spaces go, blank pieces
    too. Each next cut depends on the last, so this is a chain of pointers over one text: linear in its marks, as an Arrow batch.
    """
    cuts = _length_walk(soft, lengths)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else list(cuts(t)) for t in texts])

    return cut(text)


def _length_walk(soft: str, lengths: dict[str, int]) -> Callable[[str], Iterator[str]]:
    least, most, hard = lengths["least"], lengths["most"], lengths["hard"]
    if not 0 < least <= most <= hard:
        raise ValueError("least, most and hard must rise")
    mark = re.compile(f"[{re.escape(soft)} ]")

    def cuts(t: str) -> Iterator[str]:
        t = t.strip(" ")
        return iter([t] if t else []) if len(t) <= most else _chain(t, [m.end() for m in mark.finditer(t)], soft, least, most, hard)

    return cuts


def _chain(t: str, ends: list[int], soft: str, least: int, most: int, hard: int):
    s = 0
    while s < len(t):
        if len(t) - s <= most:
            yield t[s:]
            return
        i = bisect.bisect_right(ends, s + min(most + 1, hard)) - 1
        if i < 0 or ends[i] <= s + least:
            i += 1
            e = ends[i] if i < len(ends) and ends[i] <= min(s + hard, len(t)) else min(s + hard, len(t))
        else:
            e = ends[i]
        piece, s = t[s:e].rstrip(" "), e
        while s < len(t) and t[s] == " ":
            s += 1
        if piece and s < len(t) and t[s] in soft:
            piece, s = piece + t[s], s + 1
        while s < len(t) and t[s] == " ":
            s += 1
        if piece:
            yield piece


def short_joined(lines: DataFrame, least: int = LENGTHS["least"], marks: str = HARD + SOFT) -> DataFrame:
    """(doc_id, line_no, text) of lines(doc_id, pos, text): neighbours shorter than ``least`` joined, never at a mark.

    A line of closers alone joins the one before whatever their lengths. The rest is a fold that only runs through neighbours that are
    all short and end in no mark: such islands are found by windows, and the fold takes one of them, not a document.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    closers = "".join(dict.fromkeys([*PAIRS.values(), STRAIGHT]))
    sums = lambda c: F.sum(c.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    l = lines.select("doc_id", "pos", F.trim("text").alias("text")).where("text <> ''")
    guard = F.col("text").rlike(f"^{_class(closers)}+$")
    l = l.withColumn("_n", sums(~guard | F.lag("pos").over(order).isNull()))
    l = l.groupBy("doc_id", "_n").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))
    open_end = (F.length("text") < least) & ~F.contains(F.lit(marks), F.right("text", F.lit(1)))
    l = l.withColumn("_o", open_end)
    goes_on = F.col("_o") & F.coalesce(F.lag("_o").over(order), F.lit(False))
    l = l.withColumn("_island", sums(~goes_on))
    one = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when((F.size(acc) > 0) & (F.length(last) < least), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, x)))).otherwise(F.concat(acc, F.array(x)))

    g = l.groupBy("doc_id", "_island").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("xs"))
    g = g.select("doc_id", "_island", F.posexplode(F.aggregate("xs", one, step)).alias("_p", "text"))
    return g.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_island", "_p")).cast("long").alias("line_no"), "text")


def _joined(lines: Iterable[str], least: int, marks: str, closers: str) -> Iterator[str]:
    """Lines of one text joined as :func:`short_joined` does it."""
    whole: list[list[str]] = []
    for x in lines:
        if whole and not x.strip(closers):
            whole[-1].append(x)
        else:
            whole.append([x])
    held = None
    for x in map("".join, whole):
        is_open = len(x) < least and x[-1] not in marks
        if held is not None and is_open:
            x, held = held + x, None
        elif held is not None:
            yield held
            held = None
        if is_open and len(x) < least:
            held = x
        else:
            yield x
    if held is not None:
        yield held


def rule_lines(docs: DataFrame, lengths: dict[str, int] = LENGTHS, hard: str = HARD, soft: str = SOFT) -> DataFrame:
    """(doc_id, line_no, text): the whole splitter (G05): hard layers, length cuts, short lines joined, and at last a cut behind every hard mark.

    The last step cuts inside brackets too: no line goes on behind a hard mark. Null and blank texts have no line. All steps follow
    each other on one text where it lies.
    """
    layers, cuts = _layer_walk(hard, PAIRS), _length_walk(soft, lengths)
    closers = "".join(dict.fromkeys([*PAIRS.values(), STRAIGHT]))
    ends = re.compile(f"[^{_class(hard)[1:-1]}]*{_class(hard)}|[^{_class(hard)[1:-1]}]+")

    def lines(t: str) -> Iterator[str]:
        for line in _joined((x for layer in layers(t) for x in cuts(layer)), lengths["least"], hard + soft, closers):
            yield from (x for x in (y.strip(" ") for y in ends.findall(line)) if x)

    p = segment.walked(_texts(docs), lines).select("doc_id", F.posexplode("xs").alias("p", "text"))
    return p.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "text")


def alignment_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, text, folded, tokens): sentences for alignment with the text to show beside the folded one (G12); those without a letter or digit go."""
    both = F.transform(segment.sentence_array(F.col("text")), lambda x: F.struct(x.alias("text"), tx.alignment_form(x).alias("folded")))
    s = docs.select("doc_id", F.posexplode(F.filter(both, lambda x: x["folded"] != "")).alias("p", "x"))
    return s.select("doc_id", (F.col("p") + 1).cast("long").alias("sent_no"), "x.text", "x.folded", tx.match_tokens(F.col("x.folded")).alias("tokens"))
