"""Near keys, stacks, the rule splitter: fixed examples, plain-Python twins, nulls, ties and long rows."""

import random
import re

from pyspark.sql import functions as F

from takeweave.operators import nearkeys, prosody, rules, scopes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def first_keys(rows):
    """{(rec, key): (line_key, first)} by comparing every new key with all that were followed before."""
    out, heads = {}, {}
    for rec, n, key in sorted(rows, key=lambda r: (r[0], r[1])):
        if (rec, key) not in out:
            near = [h for h in heads.setdefault(rec, []) if 100 * distance(h[0], key) <= 15 * max(len(h[0]), len(key))]
            if not near:
                heads[rec].append((key, n))
            out[rec, key] = near[0] if near else (key, n)
    return out


def test_line_keys_follow_the_first_seen(spark):
    rng = random.Random(3)
    rows = []
    for rec in range(6):
        bases = ["".join(rng.choice("abcde fghij") for _ in range(rng.choice([5, 8, 20, 60, 400]))) for _ in range(8)]
        for n in range(60):
            key = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(key) // 6))):
                at = rng.randrange(len(key) + 1)
                key[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "y"])
            rows.append((rec, n, "".join(key) or "_"))
    want = first_keys(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "rec_id long, n long, key string, first int").repartition(5)
    got = nearkeys.line_keys(df).collect()
    assert len(got) == len(rows)
    assert {(r["rec_id"], r["key"]): (r["line_key"], r["first"]) for r in got} == want
    assert sum(k != v[0] for (_, k), v in want.items()) > 50


def test_near_pairs_of_small_and_large_recordings_agree_and_broadcast_nothing(spark, monkeypatch):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcd\n") for _ in range(n)) for n in (7, 9, 14, 30, 30)]
    keys = {(rec, b[:at] + rng.choice("x\n") + b[at + rng.randint(0, 1) :]) for rec in range(3) for b in bases for at in rng.sample(range(len(b)), 6)}
    df = spark.createDataFrame([(rec, n, key) for n, (rec, key) in enumerate(sorted(keys))], "rec_id long, n long, key string")
    want = sum(100 * distance(a, b) <= 15 * max(len(a), len(b)) for r, a in keys for s, b in keys if r == s and a < b)
    small = nearkeys.near_pairs(df)
    assert "BroadcastExchange" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(nearkeys, "FEW", 0)
    assert sorted(small.collect()) == sorted(nearkeys.near_pairs(df).collect())
    assert small.count() == want > 10


def test_line_keys_of_empty_and_repeated_lines(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, "_"), (1, 4, "abcdefghij"), (1, 5, "abcdefghix"), (1, 5, "abcdefghix"), (2, 9, "abcdefghix"), (None, 1, "q")], "rec_id long, n long, key string")
    got = sorted(tuple(r) for r in nearkeys.line_keys(df, 5).collect())
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(1, 1, "_", 1), (1, 2, "_", 1), (1, 3, "_", 1), (1, 4, "abcdefghij", 4), (1, 5, "abcdefghix", 5), (1, 5, "abcdefghix", 5), (2, 9, "abcdefghix", 9)]
    assert nearkeys.line_keys(df).where("n = 5 and rec_id = 1 and first = 4").count() == 2
    assert nearkeys.line_keys(df.limit(0)).collect() == []
    one = df.select(nearkeys.initials(F.lit("Ab Cd"), ("abcd", "xxyy")).alias("k")).first()[0]
    assert one == "xxyy"


def stack_depths(text, pairs):
    stack, out = [], []
    for ch in text:
        if stack and stack[-1] == ch:
            stack.pop()
        elif ch in pairs:
            stack.append(pairs[ch])
        out.append(len(stack))
    return out


def test_stacks_wait_for_their_own_closer(spark):
    pairs = {"“": "”", "「": "」", '"': '"', "(": ")"}
    rng = random.Random(9)
    texts = {1: "“「”」", 2: "”」)", 3: '"("(")', 4: "".join(rng.choice("“”「」\"()") for _ in range(3000))}
    df = spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "rec_id long, pos long, ch string").repartition(7)
    got = {}
    for r in scopes.depths(df, "rec_id", {"d": pairs}).orderBy("rec_id", "pos").collect():
        got.setdefault(r["rec_id"], []).append(r["d"])
    assert got == {k: stack_depths(t, pairs) for k, t in texts.items()}
    assert got[1] == [1, 2, 2, 1]
    assert scopes.depths(df.limit(0), "rec_id", {"d": pairs}).collect() == []


def test_break_candidates_use_the_stacks(spark):
    words = spark.createDataFrame([(1, i, t, 100 * i, 100 * i + 90) for i, t in enumerate(["“a", "「b,", "c”", "d,", "e」,", "f”,", "g"])], "rec_id long, idx long, text string, start_ms long, end_ms long")
    got = {r["pos"]: (r["quotes"], r["brackets"]) for r in prosody.break_candidates(words).collect()}
    # “ waits for ”, but 「 is on top until its own closer comes.
    assert got == {6: (2, 2), 12: (2, 2), 16: (1, 1), 20: (0, 0)}


def test_hard_layers(spark):
    rows = [(1, "他说（你好。真的！）然后走了。好？！”完"), (2, None), (3, "  "), (4, 'He said "no. never." Then left.'), (5, "a)b. c"), (6, "it's. don't.")]
    got = {}
    for r in rules.hard_layers(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "layer_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {1: ["他说（你好。真的！）然后走了。", "好？", "！”", "完"], 4: ['He said "no. never." Then left.'], 5: ["a)b.", "c"], 6: ["it's.", "don't."]}


def test_length_cuts(spark):
    lengths = {"least": 2, "most": 6, "hard": 9}
    rows = [("abcd,efgh,ij",), ("abcdefghijklmnopqrstu",), ("short",), (None,), ("",), ("ab cdefgh ,x",), ("a" * 50_000,), ("一二三，四五六七八九十",)]
    df = spark.createDataFrame(rows, "text string").select("text", rules.length_cuts(F.col("text"), lengths=lengths).alias("x"))
    got = {r["text"]: r["x"] for r in df.collect()}
    assert got["abcd,efgh,ij"] == ["abcd,", "efgh,", "ij"]
    assert got["abcdefghijklmnopqrstu"] == ["abcdefghi", "jklmnopqr", "stu"]
    assert got["short"] == ["short"] and got[None] is None and got[""] == []
    assert got["ab cdefgh ,x"] == ["ab", "cdefgh,", "x"]
    assert [len(p) for p in got["a" * 50_000]] == [9] * 5555 + [5]
    assert got["一二三，四五六七八九十"] == ["一二三，", "四五六七八九十"]


def test_short_lines_join_but_not_at_marks(spark):
    rows = [(1, i, t) for i, t in enumerate(["ab", "cd", "efghi", "jk", "l.", "m", "”）", "no", "pq"])]
    got = [r["text"] for r in rules.short_joined(spark.createDataFrame(rows, "doc_id long, pos long, text string"), least=5).orderBy("line_no").collect()]
    assert got == ["abcd", "efghi", "jk", "l.", "m”）no", "pq"]


def test_rule_lines_keep_every_character(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lines = rules.rule_lines(docs, {"least": 20, "most": 60, "hard": 80})
    solid = lambda c: F.regexp_replace(c, "\\s", "")
    joined = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("t"))
    assert docs.join(joined, "doc_id").where(solid("text") != solid("t")).isEmpty()
    assert lines.where(F.col("text").rlike("[。！？!?；;….].")).isEmpty()
    assert lines.where("length(text) > 81").isEmpty()


def test_rule_lines_walk_texts_where_they_lie(spark):
    rng = random.Random(17)
    texts = ["".join(rng.choice("ab  c，.。！)（”“\"x:") for _ in range(rng.choice([3, 40, 300]))) for _ in range(120)] + ["))" * 3000, "。" * 500, None, " ", "”", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lengths = {"least": 5, "most": 12, "hard": 16}
    got = rules.rule_lines(docs, lengths)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()  # before: a row for each mark, shuffled and sorted
    layers = rules.hard_layers(docs).select("doc_id", "layer_no", F.posexplode(rules.length_cuts(F.col("text"), lengths=lengths)).alias("p", "text"))
    joined = rules.short_joined(layers.select("doc_id", F.struct("layer_no", "p").alias("pos"), "text"), 5)
    want = {}
    for r in joined.orderBy("doc_id", "line_no").collect():
        want.setdefault(r["doc_id"], []).extend(x.strip(" ") for x in re.findall("[^。！？!?；;….]*[。！？!?；;….]|[^。！？!?；;….]+", r["text"]) if x.strip(" "))
    lines = {}
    for r in got.orderBy("doc_id", "line_no").collect():
        lines.setdefault(r["doc_id"], []).append(r["text"])
        assert r["line_no"] == len(lines[r["doc_id"]])
    assert lines == want
