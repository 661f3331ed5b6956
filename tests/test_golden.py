"""Cases of the published behaviour, and empty inputs."""

import random

from pyspark.sql import functions as F

from takeweave.functions import text as tx
from takeweave.operators import intervals as iv
from takeweave.operators import retake as rt
from takeweave.operators import segment
from takeweave.sources import readers


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_soft_breaks(spark):
    for given, want in (("人类\n如今", "人类如今"), ("ABC\n中文", "ABC中文"), ("Hello\nWorld", "Hello World"), ("第\n1章", "第1章"), ("Hello\tWorld", "Hello World")):
        assert one(spark, tx.join_soft_breaks, given) == want
        assert one(spark, tx.join_soft_breaks, want) == want


def test_pieces(spark):
    d = spark.createDataFrame([(1, "你好世界！再会？保重。"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.text for r in segment.sentences(d).orderBy("doc_id", "sent_no").collect()] == ["你好世界！", "再会？", "保重。"]
    g = spark.createDataFrame([(1, "开场白，（括号，不断）然后，结束。")], "doc_id long, text string")
    assert [r.text for r in segment.depth_split(g).orderBy("piece_no").collect()] == ["开场白，", "（括号，不断）然后，", "结束。"]


def test_clusters_and_path(spark):
    rows = [(1, 10, "a", 0, 1000, 0.5), (1, 11, "a", 5000, 6000, 0.9), (1, 12, "a", 60000, 61000, 0.7)]
    t = spark.createDataFrame(rows, "rec_id long, cand_id long, k string, t0 long, t1 long, score double")
    c = {r.cand_id: (r.cluster, r["rank"], r.is_last) for r in rt.clusters(t, 10000).collect()}
    assert c == {10: (0, 1, False), 11: (0, 2, True), 12: (1, 1, True)}
    assert [r.cand_id for r in rt.best_path(t).orderBy("t0").collect()] == [10, 11, 12]  # one row a take, so that no recording is one array
    assert rt.monotonic(t.where("false")).isEmpty()


def test_best_path_equals_the_plain_search(spark):
    """Random recordings with overlaps and long gaps: the value of a search over all earlier takes, and a chain that is worth it."""
    rng, rows = random.Random(4), []
    for rec in range(12):
        at = 0
        for c in range(25):
            at += rng.choice([50, 400, 900, 9000])
            rows.append((rec, rec * 100 + c, rng.choice("ab"), at, at + rng.choice([300, 800, 2000]), round(rng.random() - 0.3, 3), rng.randrange(40)))
    t = spark.createDataFrame(rows, "rec_id long, cand_id long, k string, t0 long, t1 long, score double, length long")
    ranked = rt.clusters(t, 3000)
    path = rt.best_path(ranked, gap_ms=5000).collect()
    told = {r.rec_id: (r.n, r.value) for r in rt.path_values(rt.best_path(ranked, gap_ms=5000)).collect()}
    takes = {}
    for r in ranked.collect():
        worth = r.score + min(0.2, 0.01 * r.length) + 0.05 * r["rank"] + (0 if r.is_last else -0.1)
        takes.setdefault(r.rec_id, []).append((r.t0, r.t1, r.cand_id, worth))
    step = lambda a, b: -0.2 if b[0] - a[1] > 5000 else 0.0
    for rec, own in takes.items():
        own.sort()
        best = []
        for x in own:
            best.append(x[3] + max([0.0, *[v + step(p, x) for p, v in zip(own, best) if p[1] <= x[0] + 20]]))
        chain = sorted(x for x in own if x[2] in {r.cand_id for r in path if r.rec_id == rec})
        assert all(a[1] <= b[0] + 20 for a, b in zip(chain, chain[1:]))
        value = sum(x[3] for x in chain) + sum(step(a, b) for a, b in zip(chain, chain[1:]))
        assert told[rec][0] == len(chain) and abs(value - max(best)) < 1e-9 and abs(told[rec][1] - value) < 1e-9


def test_intervals_edge_cases(spark):
    x = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (2, 5, 5)], "rec_id long, s_ms long, e_ms long")
    assert sorted(map(tuple, iv.merge(x).collect())) == [(1, 0, 20, 2), (1, 30, 40, 1), (2, 5, 5, 1)]
    totals = spark.createDataFrame([(1, 50), (3, 7)], "rec_id long, total_ms long")
    assert sorted(map(tuple, iv.complement(x.where("rec_id = 1"), totals).collect())) == [(1, 20, 30), (1, 40, 50), (3, 0, 7)]
    assert iv.merge(x.where("false")).isEmpty()


def test_edit_list_falls_back_to_actions(spark):
    f = spark.createDataFrame([("a", '{"segments":[{"start":2,"end":1}],"actions":[{"type":"cut","start":1,"end":2.5,"reason":"x"}]}'), ("b", "{}"), ("c", None)], "rec_id string, content string")
    assert [tuple(r) for r in readers.edit_lists(f).collect()] == [("a", 1000, 2500, "cut", "x")]


def test_silences(spark):
    log = spark.createDataFrame([("a", 1, "silence_start: 1.5"), ("a", 2, "silence_end: 2.25 | x"), ("a", 3, "silence_end: 1")], "rec_id string, line_no int, line string")
    assert [tuple(r) for r in readers.silences(log).collect()] == [("a", 1500, 2250)]
