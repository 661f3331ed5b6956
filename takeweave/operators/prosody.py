"""Where a text may be broken into lines: clauses, scored break candidates, and the best sequence of breaks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.functions import text as tx
from takeweave.operators import scopes, segment

# Marks behind which a line may break, words that begin a clause, and marks that enclose text.
SOFT = "，,、：:—"
CONNECTIVES = ("但是", "不过", "然而", "然后", "而且", "以及", "所以", "因此", "如果", "因为", "还是", "还有", "就是")
QUOTE_OPENS, QUOTE_CLOSES = '“‘「『【《"', '”’」』】》"'
BRACKET_OPENS, BRACKET_CLOSES = "([{【「〈（［“", ")]}】」〉）］”"
# Weights of a break and of the length of a line.
WEIGHTS = {"hard": 1.2, "soft": -0.6, "pause": 0.8, "cue": 0.5, "quote": -1.0, "bracket": -0.7, "short": -1.2, "long": -0.9}
LENGTHS = {"least": 6, "most": 26, "join": 18, "split": 14}


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in dict.fromkeys(chars)) + "]"


def _behind(chars: str, phrases: tuple[str, ...]) -> str:
    """Pattern of the places behind a character of ``chars`` or a phrase."""
    return "|".join([f"(?<={_class(chars)})", *[f"(?<=\\Q{p}\\E)" for p in phrases]])


def clause_split(sents: DataFrame, phrases: tuple[str, ...] = CONNECTIVES, marks: str = SOFT + ";；", least: int = 6, most: int = 48) -> DataFrame:
    """(doc_id, sent_no, clause_no, text) of sents(doc_id, sent_no, text), cut behind phrases and weak marks.

    A cut is made where at least ``least`` characters have passed since the last one. Where ``most`` are reached, the cut is behind the
    last phrase or mark that came too early, else one character before. Clauses are trimmed, blank ones dropped; a null or blank text has
    none. ``least`` must be below ``most``. Each sentence is walked where it lies, in time linear in its length.
    """
    if not 0 < least < most:
        raise ValueError("least must be positive and below most")
    mark = re.compile(_class(marks)) if marks else None

    def places(t: str) -> Iterator[tuple[int, int]]:
        """(end, length) of the marks and phrases; a phrase that an earlier end cuts counts for nothing."""
        found = {m.end(): 1 for m in mark.finditer(t)} if mark else {}
        behind: dict[int, int] = {}
        for p in phrases:
            i = t.find(p)
            while i >= 0:
                behind[i + len(p)] = behind.get(i + len(p), 0) | 1 << len(p)
                i = t.find(p, i + 1)
        at = 0
        for e in sorted(found.keys() | behind.keys()):
            sizes = behind.get(e, 0) & ((1 << (e - at + 1)) - 1)
            yield e, sizes.bit_length() - 1 if sizes else found.get(e, 0)
            at = e
        if at < len(t):
            yield len(t), 0

    def cuts(t: str) -> Iterator[int]:
        last = held = 0
        for end, size in places(t):
            begin = end - size
            over = last + most - 1 < begin
            if over:
                if held > last:
                    yield held
                    last = held
                while last + most - 1 < begin:
                    last += most - 1
                    yield last
            if size and end - last >= least:
                yield end
                last, held = end, 0
            elif size:
                held = end
            elif over:
                held = 0
        yield len(t)

    def clauses(t: str) -> Iterator[str]:
        lo = 0
        for hi in cuts(t):
            x, lo = t[lo:hi].strip(" "), hi
            if x:
                yield x

    s = segment.walked(sents, clauses, ("doc_id", "sent_no")).select("doc_id", "sent_no", F.posexplode("xs").alias("p", "text"))
    return s.select("doc_id", "sent_no", (F.col("p") + 1).cast("long").alias("clause_no"), "text")


def break_candidates(words: DataFrame, hard: str = tx.STOPS, soft: str = SOFT, cues: tuple[str, ...] = (), pause_ms: int = 160, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(rec_id, pos, reasons, pause_ms, quotes, brackets, score): where the words of a recording, joined by single spaces, may break.

    words(rec_id, idx, text, start_ms, end_ms). A place behind a hard or soft mark, a cue, or a word that a pause of ``pause_ms`` or more
    follows is one candidate with all its reasons, joined by + in alphabetical order; the ends of the text are none. quotes and brackets
    tell how deep the place lies inside them, by one stack each: an opening mark waits for its own closing mark, any other closing mark counts
    for nothing, the straight double quote opens and closes in turn, the apostrophe is a letter. Words that are null or blank are left
    out. The windows share one exchange on rec_id; the stacks read the marks alone.
    """
    enclosing = "".join(dict.fromkeys(QUOTE_OPENS + QUOTE_CLOSES + BRACKET_OPENS + BRACKET_CLOSES))
    marks = hard + soft + enclosing
    by_word = Window.partitionBy("rec_id").orderBy("idx")
    w = words.where("trim(text) <> ''").select(
        "rec_id", "idx", (F.row_number().over(by_word) - 1).alias("_w"), F.greatest(F.lead("start_ms").over(by_word) - F.col("end_ms"), F.lit(0)).alias("_gap"), F.filter(F.split("text", _behind(marks, cues)), lambda x: x != "").alias("_ps")
    )
    p = w.select("rec_id", "_w", "_gap", F.size("_ps").alias("_n"), F.posexplode("_ps").alias("_p", "_x"))
    order = Window.partitionBy("rec_id").orderBy("_w", "_p").rowsBetween(Window.unboundedPreceding, 0)
    ch = F.right("_x", F.lit(1))
    has = lambda chars: F.contains(F.lit(chars), ch)
    p = p.select("*", (F.sum(F.length("_x")).over(order) + F.col("_w")).alias("pos"))
    kinds = {"_q": dict(zip(QUOTE_OPENS, QUOTE_CLOSES, strict=True)), "_b": dict(zip(BRACKET_OPENS, BRACKET_CLOSES, strict=True))}
    at = scopes.depths(p.select("rec_id", "pos", ch.alias("ch")).where(F.contains(F.lit(enclosing), F.col("ch"))), "rec_id", kinds)
    p = p.join(at, ["rec_id", "pos"], "left")
    depth = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(order), F.lit(0))
    pause = F.coalesce((F.col("_p") == F.col("_n") - 1) & (F.col("_gap") >= pause_ms), F.lit(False))
    cue = F.col("_x").rlike("(" + "|".join(f"\\Q{c}\\E" for c in cues) + ")$") if cues else F.lit(False)
    p = p.select(
        "rec_id", "pos", F.max("pos").over(Window.partitionBy("rec_id")).alias("_end"), has(hard).alias("hard"), (has(soft) & ~has(hard)).alias("soft"), cue.alias("cue"), pause.alias("pause"),
        F.when(pause, F.col("_gap")).otherwise(0).cast("long").alias("pause_ms"), depth("_q").alias("quotes"), depth("_b").alias("brackets"),
    )
    p = p.where("pos < _end and (hard or soft or cue or pause)")
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.col(r), r) for r in ("cue", "hard", "pause", "soft")])), "+")
    held = 0.5 + 0.5 * F.least(F.col("pause_ms") / float(max(pause_ms, 1)), F.lit(3.0))
    plus = lambda on, value: F.when(on, value).otherwise(F.lit(0.0))
    score = F.when(F.col("hard"), F.lit(weights["hard"])).otherwise(F.lit(weights["soft"])) + plus(F.col("pause"), weights["pause"] * held) + plus(F.col("cue"), F.lit(weights["cue"]))
    score = score + plus(F.col("quotes") > 0, F.lit(weights["quote"])) + plus(F.col("brackets") > 0, F.lit(weights["bracket"]))
    return p.select("rec_id", "pos", reasons.alias("reasons"), "pause_ms", "quotes", "brackets", F.round(score, 6).alias("score"))


def _length_score(n: Column, lengths: dict[str, int], weights: dict[str, float]) -> Column:
    least, most = lengths["least"], lengths["most"]
    inside = F.when(n <= lengths["join"], F.lit(weights["short"] * 0.35)).otherwise(F.lit(0.0)) + F.when(n >= lengths["split"], F.lit(abs(weights["long"]) * 0.25)).otherwise(F.lit(0.0))
    return F.when(n < least, weights["short"] * (1.0 + (least - n) / float(least))).when(n > most, weights["long"] * (1.0 + (n - most) / float(most))).otherwise(inside)


def best_breaks(candidates: DataFrame, totals: DataFrame, lengths: dict[str, int] = LENGTHS, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(rec_id, lo, hi, reasons): the lines of the best sequence of breaks.

    candidates as :func:`break_candidates` gives them, totals(rec_id, n) with the length of each text. Hard candidates always break.
    Between two of them the sum of the scores of breaks and line lengths is greatest, scores compared to six decimals; among equal sums
    the longest last line wins. Every ``most`` characters a place without a candidate is offered at half the soft cost (reasons: none).
    Recordings without text have no line. The fold compares the candidates of one span between hard marks with each other: quadratic in
    those, whatever the recording's length.
    """
    ends = totals.where("n > 0").select("rec_id", F.col("n").cast("long").alias("pos"), F.lit("end").alias("reasons"), F.lit(0.0).alias("score"))
    c = candidates.select("rec_id", F.col("pos").cast("long").alias("pos"), "reasons", "score").unionByName(ends)
    fixed = F.col("reasons").contains("hard") | (F.col("reasons") == "end")
    before = Window.partitionBy("rec_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("lo", F.coalesce(F.max(F.when(fixed, F.col("pos"))).over(before), F.lit(0)))
    spans = c.groupBy("rec_id", "lo").agg(F.sort_array(F.collect_list(F.struct("pos", "score", "reasons"))).alias("own"))
    most = lengths["most"]
    last = F.element_at("own", -1)["pos"]
    synth = F.when(F.col("lo") + most < last, F.sequence(F.col("lo") + most, last - 1, F.lit(most).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    synth = F.array_except(synth, F.transform("own", lambda x: x["pos"]))
    offered = F.transform(synth, lambda q: F.struct(q.alias("pos"), F.lit(weights["soft"] * 0.5).alias("score"), F.lit("none").alias("reasons")))
    spans = spans.select("rec_id", "lo", F.sort_array(F.concat("own", offered)).alias("points"))

    first = F.array(F.struct(F.col("lo").alias("pos"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("prev"), F.lit("").alias("reasons")))

    def step(acc: Column, x: Column) -> Column:
        total = lambda a: F.round(a["sum"] + _length_score(x["pos"] - a["pos"], lengths, weights) + x["score"], 6)
        best = F.array_max(F.transform(acc, lambda a: F.struct(total(a).alias("sum"), (-a["pos"]).alias("back"))))
        return F.concat(acc, F.array(F.struct(x["pos"].alias("pos"), best["sum"].alias("sum"), (-best["back"]).alias("prev"), x["reasons"].alias("reasons"))))

    line = "array<struct<lo: bigint, hi: bigint, reasons: string>>"
    spans = spans.select("rec_id", F.reverse(F.aggregate("points", first, step)).alias("way"))
    start = F.struct(F.get("way", F.lit(0))["pos"].alias("at"), F.expr(f"cast(array() as {line})").alias("lines"))

    def back(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["prev"].alias("lo"), x["pos"].alias("hi"), x["reasons"].alias("reasons")))
        return F.when((x["pos"] == acc["at"]) & (x["prev"] >= 0), F.struct(x["prev"].alias("at"), F.concat(acc["lines"], one).alias("lines"))).otherwise(acc)

    return spans.select("rec_id", F.explode(F.aggregate("way", start, back)["lines"]).alias("x")).select("rec_id", "x.*")
