"""Line breaks, whole-window alignment, marker tables and text shares on small cases: nulls, empty tables, ties, brute force."""

from pyspark.sql import functions as F

from takeweave.operators import align, prosody, reports
from takeweave.sources import readers, sinks

WORDS = "rec_id long, idx long, text string, start_ms long, end_ms long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_clauses_of_long_short_and_missing_texts(spark):
    text = "一二三四五六，七，八九" + "十" * 12
    df = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "   "), (4, 1, "短")], "doc_id long, sent_no long, text string")
    got = rows(prosody.clause_split(df, least=5, most=10), "doc_id", "clause_no", "text")
    # the comma after 七 comes too early and is taken when ten characters are reached; then nine at a time
    assert got == [(1, 1, "一二三四五六，"), (1, 2, "七，"), (1, 3, "八九" + "十" * 7), (1, 4, "十" * 5), (4, 1, "短")]
    assert prosody.clause_split(df.where("false")).isEmpty()


def test_candidates_know_pauses_and_depth(spark):
    ws = [(1, 0, "say,", 0, 100), (1, 1, None, 100, 150), (1, 2, "“so,", 150, 200), (1, 3, "yes”.", 600, 700), (1, 4, "(a,", 700, 800), (1, 5, "b)", 800, 900), (1, 6, "c)", 900, 950)]
    c = prosody.break_candidates(spark.createDataFrame(ws, WORDS), pause_ms=160)
    assert rows(c, "pos", "reasons", "pause_ms", "quotes", "brackets", "score") == [
        (4, "soft", 0, 0, 0, -0.6),
        (9, "pause+soft", 400, 1, 1, round(-0.6 + 0.8 * (0.5 + 0.5 * 2.5) - 1.7, 6)),
        (15, "hard", 0, 0, 0, 1.2),
        (19, "soft", 0, 0, 1, -1.3),
    ]
    empty = spark.createDataFrame([], WORDS)
    assert prosody.break_candidates(empty).isEmpty()


def test_best_breaks_equal_all_sequences(spark):
    points = [(4, -0.6), (9, 0.3), (17, -0.6), (21, -0.1), (30, 0.5), (33, -1.3)]
    n = 45
    c = spark.createDataFrame([(1, p, "soft", s) for p, s in points], "rec_id long, pos long, reasons string, score double")
    t = spark.createDataFrame([(1, n), (2, 0)], "rec_id long, n long")
    got = [(lo, hi) for lo, hi in rows(prosody.best_breaks(c, t), "lo", "hi")]
    score = dict(points) | {26: -0.3, n: 0.0}

    def length(x):
        if x < 6:
            return -1.2 * (1 + (6 - x) / 6)
        if x > 26:
            return -0.9 * (1 + (x - 26) / 26)
        return (-0.42 if x <= 18 else 0) + (0.225 if x >= 14 else 0)

    inner = sorted(set(score) - {n})
    ways = []
    for mask in range(1 << len(inner)):
        cut = [0, *[p for i, p in enumerate(inner) if mask >> i & 1], n]
        ways.append((round(sum(length(b - a) + score[b] for a, b in zip(cut, cut[1:])), 6), cut))
    best = max(ways)[0]
    cut = [0, *[hi for _, hi in got]]
    assert [lo for lo, _ in got] == cut[:-1] and cut[-1] == n
    assert round(sum(length(b - a) + score[b] for a, b in zip(cut, cut[1:])), 6) == best


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_whole_windows_equal_brute_force(spark):
    stream = {1: ("the quick brown fox jumps over a lazy dog and the quik brown fox jumped over lazy dogs once more " * 9).split(), 2: ["so"], 3: []}
    lines = [(1, 1, "quick brown fox jumps over a lazy dog".split()), (1, 2, "the quack brown".split()), (1, 3, "nothing like this here at all today".split()), (1, 4, ["", "dogs", "once"]), (2, 1, ["so"]), (2, 2, None), (3, 1, ["x"]), (4, 1, ["so"])]
    want = []
    for rec, no, ws in lines:
        ws, st, found = [w for w in ws or [] if w], stream.get(rec, []), []
        if not ws:
            continue
        slack, need = (2, 75) if len(ws) <= 6 else (max(1, int(len(ws) * 0.2 + 0.5)), 80)
        a = "".join(ws)
        for s in range(len(st)):
            for n in range(max(1, len(ws) - slack), len(ws) + slack + 1):
                if s + n <= len(st):
                    b = "".join(st[s : s + n])
                    m, d = max(len(a), len(b)), distance(a, b)
                    if 100 * (m - d) >= need * m:
                        found.append((s + n, -d / m, n, s, 100 * (m - d) // m))
        if found:
            x = max(found)
            want.append((rec, no, x[3], x[2], x[4], len(found) - 1))
    got = align.whole_windows(spark.createDataFrame(lines, "rec_id long, no long, words array<string>"), spark.createDataFrame([(k, v) for k, v in stream.items()], "rec_id long, words array<string>"))
    assert rows(got, "rec_id", "no", "start", "n_words", "percent", "earlier") == sorted(want)
    assert len(want) >= 4


def test_marker_tables_of_any_header(spark):
    files = [("a", "State,In,Out,Title\nDELETE,1.5,2,x\n\nodd,,3,\"y, \"\"z\"\"\"\nkeep,5,4,w"), ("b", None), ("c", ""), ("d", "Colour\nred")]
    got = rows(readers.markers(spark.createDataFrame(files, "rec_id string, content string")), "rec_id", "row", "name", "s_ms", "e_ms", "note", "state")
    assert got == [("a", 1, "x", 1500, 2000, "", "delete"), ("a", 3, 'y, "z"', 0, 3000, "", "keep"), ("a", 4, "w", 5000, 5000, "", "keep"), ("d", 1, "", 0, 0, "", "keep")]


def test_alignability_of_equal_missing_and_foreign_texts(spark):
    t = spark.createDataFrame([(1, "ab, c"), (2, None), (3, "xyz"), (4, "q")], "rec_id long, text string")
    w = spark.createDataFrame([(1, "ab,c"), (3, "zzz"), (5, "x")], "rec_id long, text string")
    assert rows(reports.alignability(t, w), "rec_id", "score") == [(1, 100.0), (2, 0.0), (3, round((1 / 3 + 1 + 0) / 3 * 100, 2)), (4, round(100 / 3, 2))]


def test_text_variants_keep_one_line_a_row(spark, tmp_path):
    lines = spark.createDataFrame([("a\nb",), (None,), ("",)], "line string")
    path = str(tmp_path / "v")
    sinks.text_variants(lines, {"own": lines["line"]}, path)
    assert sorted(r[0] for r in spark.read.text(path + "/variant=own").collect()) == ["", "", "a b"]


def test_backward_sweep_deals_its_comparisons_by_number(spark):
    words = [f"w{i % 37}" for i in range(700)]
    lines = spark.createDataFrame([(1, no, words[at : at + n]) for no, (at, n) in enumerate([(0, 3), (255, 9), (511, 20), (690, 10)])], "rec_id long, no long, words array<string>")
    got = align.backward_sweep(lines, spark.createDataFrame([(1, words)], "rec_id long, words array<string>"))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for no, (at, n) in enumerate([(0, 3), (255, 9), (511, 20), (690, 10)]):
        line, size = words[at : at + n], max(len(words[at : at + n]), 6)
        for s in range(max(700 - size, 0), -1, -(size // 2)):
            a, b = " ".join(line), " ".join(words[s : s + size])
            if no not in want and distance(a, b) <= 0.35 * max(len(a), len(b)):
                want[no] = (s, distance(a, b))
    assert {r["no"]: (r["start"], r["dist"]) for r in got.collect()} == want


def test_near_windows_equal_all_windows_for_lines_of_several_words(spark):
    import random

    from takeweave.functions import nearends

    r = random.Random(5)
    word = lambda: "".join(r.choice("abé中") for _ in range(r.randint(1, 5)))
    data = []
    for i, size in enumerate((1, 2, 9, 30, 50, 3)):
        text = [word() for _ in range(60)]
        line = "".join(text[7 : 7 + size])[:150]
        data.append((i, line[: len(line) // 2] + "b" + line[len(line) // 2 + 1 :], text, len(line) // 5))
    df = spark.createDataFrame(data, "i long, a string, ws array<string>, k int")
    got = df.select("i", nearends.near_windows(df["a"], F.array_join("ws", nearends.GAP), F.lit(20), df["k"]).alias("x"))
    for i, found in rows(got, "i", "x"):
        _, a, ws, k = data[i]
        want = []
        for s in range(20):
            for n in range(1, len(ws) - s + 1):
                b = "".join(ws[s : s + n])
                if abs(len(a) - len(b)) <= k and (d := distance(a, b)) <= k:
                    want.append([s, n, len(b), d])
        assert sorted(found) == sorted(want) != []
    assert max(len(a) for _, a, _, _ in data) > 128


def test_whole_windows_compare_only_what_may_match(spark):
    # two letters: each line shares short pieces with nearly every window, and is near to few
    words = ["ab"[i * i % 7 % 2] + "ba"[i * i % 11 % 2] + "ab"[i * i % 13 % 2] + f"{i * i % 997 % 3}" for i in range(900)]
    lines = spark.createDataFrame([(1, no, words[no : no + 14]) for no in range(0, 880, 44)], "rec_id long, no long, words array<string>")
    got = align.whole_windows(lines, spark.createDataFrame([(1, words)], "rec_id long, words array<string>"))
    assert "rec_id#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "gram" not in plan and "levenshtein" not in plan
    assert {no for (no,) in rows(got.where("start >= no"), "no")} == set(range(0, 880, 44))


def test_backward_sweep_reads_all_lines_of_a_row_together(spark, monkeypatch):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé中") for _ in range(r.randint(1, 6)))
    texts = {1: [word() for _ in range(150)], 2: ["ab"] * 40, 3: [""], 4: [], 5: [word() for _ in range(3)], 6: None}
    lines = [(1, i, texts[1][at : at + n][: n - i % 3] + ["b"] * (i % 2)) for i, (at, n) in enumerate([(0, 9), (140, 30), (60, 3), (70, 40), (3, 20), (20, 21), (99, 5), (31, 70), (0, 150)])]
    lines += [(2, i, ["ab"] * n) for i, n in enumerate([1, 4, 6, 30])] + [(rec, i, ws) for rec in (3, 4, 5, 6, 7) for i, ws in enumerate([[""], texts[5], texts[5][:2] + ["中"], None, []])]
    monkeypatch.setattr(align, "SWEEP_CHARS", 90)
    monkeypatch.setattr(align, "SWEEP_WORDS", 16)
    got = align.backward_sweep(spark.createDataFrame(lines, "rec_id long, no long, words array<string>"), spark.createDataFrame(list(texts.items()), "rec_id long, words array<string>"))
    assert "levenshtein" not in got._jdf.queryExecution().executedPlan().toString()  # before each window was a row with a table of edits of its own
    want = {}
    for rec, no, line in lines:
        text = texts.get(rec)
        if line is None or text is None:
            continue
        size = max(len(line), 6)
        for s in range(max(len(text) - size, 0), -1, -(size // 2)):
            a, b = " ".join(line), " ".join(text[s : s + size])
            if (rec, no) not in want and distance(a, b) <= 0.35 * max(len(a), len(b)):
                want[rec, no] = (s, distance(a, b))
    assert {(r["rec_id"], r["no"]): (r["start"], r["dist"]) for r in got.collect()} == want
    assert len(want) > 14
