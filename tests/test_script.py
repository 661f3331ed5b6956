"""From script lines to cuts, and overlapping keeps: plain-Python twins, fixed recordings, nulls and long rows."""

import random

from pyspark.sql import functions as F

from takeweave.operators import intervals as iv
from takeweave.operators import overlaps, ownmatch, retake
from takeweave.queries import script


def words_of(text, rec=1, step=300):
    return [(rec, i, w, step * i, step * i + 250) for i, w in enumerate(text.split())]


WORDS = "rec_id long, idx long, text string, start_ms long, end_ms long"
LINES = "rec_id long, no long, words array<string>"


def plain_windows(line, text, n, cap, latest):
    q, hits, windows = min(n, len(line)), 0, []
    for o in range(len(line) - q + 1):
        gram, places, at = line[o : o + q], [], len(text)
        if latest:
            while (at := text.rfind(gram, 0, at)) >= 0:
                places.append(at)
        else:
            places = [p for p in range(len(text) - q + 1) if text[p : p + q] == gram]
        for p in places:
            hits += 1
            w = (max(0, p - len(line)), min(len(text), p + len(line)))
            if w not in windows:
                windows.append(w)
            if len(windows) >= cap:
                return windows, hits
    return windows, hits


def test_anchor_windows_against_a_search(spark):
    rng = random.Random(6)
    texts = {r: [rng.choice(["aa", "ab", "aaaa", "b", "cab", "aba" * 60, "-"]) for _ in range(rng.choice([0, 3, 40, 300]))] for r in range(5)}
    lines = [(r, i, rng.choice(["aaaa", "ab ab", "a", "aaaaaaaaaa", "cabab", "zz", "", None, "abaabaabaaba"])) for r in texts for i in range(6)]
    w = spark.createDataFrame([(r, i, t, 0, 0) for r, ts in texts.items() for i, t in enumerate(ts)], WORDS).repartition(5)
    l = spark.createDataFrame([(*x, "") for x in lines], "rec_id long, no long, text string, gram string")
    canon = {r: "".join(t for t in ts if t != "-") for r, ts in texts.items()}
    for cap, latest in ((7, True), (10_000, True), (7, False)):
        want = set()
        for r, i, t in lines:
            line = (t or "").replace(" ", "")
            if line and canon[r]:
                windows, hits = plain_windows(line, canon[r], 6, cap, latest)
                want |= {(r, i, lo, hi, hits) for lo, hi in windows}
        assert {tuple(x) for x in ownmatch.anchor_windows(l, w, cap=cap, latest=latest).collect()} == want
    assert ownmatch.anchor_windows(l.limit(0), w).collect() == []
    assert ownmatch.anchor_windows(l, w.limit(0)).collect() == []


def test_latest_anchors_use_whole_turns(spark, tmp_path):
    turns = {(1, 0): "said before " * 9 + "and the end of a long turn", (1, 1): "x " * 40, (1, 2): "short", (2, 0): "one turn only, " * 12, (3, 0): "a b", (3, 1): "", (3, 2): "zq " * 50 + "the end of a long turn"}
    spark.createDataFrame([(*k, "user", v) for k, v in turns.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    canon = lambda x: "".join(c for c in x if c.isalnum())
    want = set()
    for (r, i), t in turns.items():
        if canon(t):
            windows, hits = plain_windows(canon(t), "".join(canon(x) for (o, _), x in sorted(turns.items()) if o == r), 6, script.CAP, True)
            want |= {(r, i, lo, hi, hits) for lo, hi in windows}
    got = {tuple(x) for x in script.QUERIES["m03_latest_anchors"](spark, str(tmp_path)).collect()}
    assert got == want  # before only the first 60 characters of a turn were looked for
    assert max(hi - lo for _, _, lo, hi, _ in got) > 120


def test_anchor_windows_of_long_lines_against_a_search(spark):
    rng = random.Random(12)
    text = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = {1: text(900, "ab"), 2: text(300, "abcdefgh"), 3: "a" * 400, 4: text(150, "ab")}
    lines = [(r, i, x) for r, t in texts.items() for i, x in enumerate([t, t[20:140], text(100, "xy") + t[5:60], "a" * 120, text(160, "ab"), t[-len(t) // 2 :], "xy" * 90, t * 2, None])]
    lines.append((2, None, text(100, "xy") + texts[2][:40]))
    w = spark.createDataFrame([(r, i, t[i : i + 3], 0, 0) for r, t in texts.items() for i in range(0, len(t), 3)], WORDS).repartition(5)
    l = spark.createDataFrame(lines, "rec_id long, no long, text string")
    for cap, latest in ((7, True), (10_000, True), (3, False)):
        want = set()
        for r, i, t in lines:
            windows, hits = plain_windows(t, texts[r], 6, cap, latest) if t else ([], 0)
            want |= {(r, i, lo, hi, hits) for lo, hi in windows}
        assert {tuple(x) for x in ownmatch.anchor_windows(l, w, cap=cap, latest=latest).collect()} == want
    # two lines of one number are one search, in the order of the offset and the place
    assert ownmatch._search(["abcabc", "bc"], "abcabcbc", 2, 9, True) == ([(4, 8), (2, 6), (0, 8), (0, 3), (0, 6), (0, 7)], 14)


def test_own_matches_take_the_latest_and_tell_why(spark):
    said = "one two three four five six " + "x " * 600 + "one two three four fife six end"
    w = spark.createDataFrame(words_of(said), WORDS)
    lines = [(1, 1, "one two three four five six".split()), (1, 2, "nothing like this".split()), (1, 3, "one two three apples oranges bananas".split()), (1, 4, []), (2, 1, "one two three".split()), (1, 5, "three four fife six end".split())]
    got = {(r["rec_id"], r["no"]): r for r in ownmatch.own_matches(spark.createDataFrame(lines, LINES), w).collect()}
    assert (got[1, 1]["start"], got[1, 1]["dist"], got[1, 1]["reason"], got[1, 1]["windows"]) == (0, 0, None, 2)
    assert got[1, 5]["start"] == 608 and got[1, 5]["score"] == 1.0
    assert {k: r["reason"] for k, r in got.items() if r["reason"]} == {(1, 2): "no-anchor", (1, 3): "distance", (1, 4): "no-anchor", (2, 1): "no-anchor"}
    relaxed = ownmatch.relaxed_own_matches(spark.createDataFrame(lines, LINES), w)
    assert {(r["rec_id"], r["no"]): r["method"] for r in relaxed.collect() if r["method"]} == {(1, 1): "anchor", (1, 5): "anchor", (1, 3): "relaxed-3"}
    assert [tuple(r) for r in ownmatch.match_summary(relaxed).orderBy("rec_id").collect()][0][:6] == (1, 5, 2, 1, 2, 0)


def test_a_retake_is_cut(spark):
    """The line is said twice with a slip the first time: the later take stays, and what lies before it is cut."""
    said = "we start right here today um we start right here today and then we go on to the end"
    lines = [(1, 1, "we start right here today".split()), (1, 2, "we start right here toda".split()), (1, 3, "and then we go on to the end".split())]
    w, l = spark.createDataFrame(words_of(said), WORDS), spark.createDataFrame(lines, LINES)
    takes = ownmatch.takes_of_lines(ownmatch.relaxed_own_matches(l, w), l, w)
    assert {(r["cand_id"], r["k"], r["t0"]) for r in takes.collect()} == {(1, "westartrightheretoday", 1800), (2, "westartrightheretoday", 1800), (3, "andthenwegoontotheend", 3300)}
    keeps = retake.keep_last_pipeline(takes, w.where("false").select("rec_id", F.col("end_ms").alias("b")), 60_000)
    assert [tuple(r) for r in keeps.collect()] == [(1, 1720, 5770)]
    total = w.groupBy("rec_id").agg(F.max("end_ms").alias("total_ms"))
    assert [tuple(r) for r in iv.complement(keeps, total).collect()] == [(1, 0, 1720)]


def plain_chains(keeps, least, bridges):
    """The fold on one recording's keeps [(pos, words, s, e)]: chains of places, the kept place of each, and its span."""
    out, held = [], None
    for pos, words, s, e in keeps:
        if bridges and not words:
            if held:
                out.append([[held[0]], held[0], set(), held[1], held[2]])
            held = (pos, s, e)
            continue
        if out:
            places, _, before, ps, pe = out[-1]
            union = words | before
            meets = min(pe, e) - max(ps, s) > 0 or (held and s - pe <= max(0, held[2] - held[1]) + 50)
            if (not union or 100 * len(words & before) // len(union) >= least) and meets and s >= ps:
                if held:
                    places, ps, pe = [*places, held[0]], min(ps, held[1]), max(pe, held[2])
                out[-1], held = [[*places, pos], pos, words, min(ps, s), max(pe, e)], None
                continue
        if held:
            out.append([[held[0]], held[0], set(), held[1], held[2]])
            held = None
        out.append([[pos], pos, words, s, e])
    if held:
        out.append([[held[0]], held[0], set(), held[1], held[2]])
    return {(k, s, e, len(p) - 1) for p, k, _, s, e in out}


def test_chains_against_the_fold(spark):
    rng = random.Random(11)
    rows = []
    for rec in range(40):
        at = 0
        for pos in range(rng.randint(1, 40)):
            at += rng.randint(-50, 400)
            text = rng.choice(["a b c d e f g", "a b c d e f h", "a b c d e f g i", "", None, "x y"])
            rows.append((rec, pos, text, at, at + rng.choice([0, 100, 300, 900])))
    rows += [(99, i, "same words here", 10 * i, 10 * i + 15) for i in range(20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec_id long, pos long, text string, s_ms long, e_ms long, near int").repartition(6)
    for policy, least, bridges in (("safe", 85, False), ("aggressive", 75, True)):
        chained = overlaps.chains(df, policy)
        assert chained.count() == len(rows)
        got = {(r["rec_id"], r["pos"], r["s_ms"], r["e_ms"], r["n_merged"]) for r in overlaps.merged(chained).collect()}
        want = set()
        for rec in {r[0] for r in rows}:
            own = [(pos, set((t or "").split()), s, e) for r, pos, t, s, e in rows if r == rec]
            want |= {(rec, *x) for x in plain_chains(own, least, bridges)}
        assert got == want
    none = overlaps.totals(overlaps.chains(df.where("rec_id < 3"), "none")).collect()
    assert all(r["before"] == r["after"] and r["removed"] == 0 for r in none)
    assert overlaps.chains(df.limit(0)).collect() == []
    with_null = spark.createDataFrame([(None, 1, "a", 0, 1, 1), (1, 1, "a", None, 1, 1)], df.schema)
    assert overlaps.chains(with_null).collect() == []


def test_no_step_of_own_matches_broadcasts_what_explode_made(spark):
    lines = spark.createDataFrame([(1, 1, ["a", "b", "c"])], LINES)
    blocks = ownmatch.word_blocks(spark.createDataFrame([(1, i, w, i, i + 1) for i, w in enumerate("abcd")], "rec_id long, idx long, text string, start_ms long, end_ms long"), 3)
    assert "BroadcastExchange" not in ownmatch._best_windows(lines, blocks, 3, 0.35)._jdf.queryExecution().executedPlan().toString()
