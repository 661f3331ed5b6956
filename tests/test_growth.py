"""Steps whose work must grow with the input alone: what is grouped, written or compared, on small cases."""

from pyspark.sql import functions as F

from takeweave.functions import counted as ct
from takeweave.functions import foreign
from takeweave.functions import text as tx
from takeweave.operators import align, matching, ownmatch, prosody, rules, segment
from takeweave.session import joined_in_place


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gram_jaccard_groups_shared_grams_only(spark):
    lines = spark.createDataFrame([(1, "a b c d".split()), (2, "x y".split()), (3, None), (4, "a b c a b c".split())], "item_id long, words array<string>")
    stream = spark.createDataFrame([(1, "a b c a b c q".split()), (1, "a b c".split()), (2, ["z"]), (3, None), (4, "k l m n".split())], "doc_id long, words array<string>")
    got = align.gram_jaccard(lines, stream, least=0.01)
    assert "LeftSemi" in plan(got)  # before the n-grams of all texts were grouped
    # doc 1 has abc three times, bca, cab, bcq once: six in all, its rows together
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, round(1 / 7, 9)), (4, 1, 4, round(4 / 6, 9))]


def test_relaxed_matches_run_each_step_once(spark):
    lines = spark.createDataFrame([(1, "one two three four five six".split()), (2, "red green blue grey".split()), (3, "up down left".split()), (4, "no such words here".split())], "item_id long, words array<string>")
    stream = spark.createDataFrame([(1, "zero one two three four five six seven red green blue grey up down left up".split())], "doc_id long, words array<string>")
    got = matching.relaxed_matches(lines, stream)
    assert sorted(map(tuple, got.select("item_id", "start", "dist", "stage").collect())) == [(1, 1, 0, 1), (2, 8, 0, 2), (3, 12, 0, 3)]
    assert "levenshtein" not in plan(got)  # steps are written; before each step held those before it once more


def test_match_lines_bounds_the_distance(spark):
    lines = spark.createDataFrame([(1, "a b c ddddddddd".split())], "item_id long, words array<string>")
    stream = spark.createDataFrame([(1, "a b c eeeeeeeee a b c ddddddeee".split())], "doc_id long, words array<string>")
    got = align.match_lines(lines, stream, ratio=0.35)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 4, 3, 1)]
    assert "most#" in plan(got) or "Some(" in plan(got)


def test_missing_grams_group_those_of_the_lines_only(spark):
    lines = spark.createDataFrame([(1, "a b c d".split()), (2, "x y z".split()), (3, None)], "item_id long, words array<string>")
    stream = spark.createDataFrame([(1, "q a b c".split()), (2, None), (3, "p q r s t".split())], "doc_id long, words array<string>")
    for got, want in ((align.missing_grams(lines, stream), [(1, 1), (2, 1)]), (align.top_missing_grams(lines, stream), [("b c d", 1), ("x y z", 1)])):
        assert "LeftSemi" in plan(got)  # before the n-grams of all texts were made distinct
        assert sorted(map(tuple, got.collect())) == want


def test_fast_candidates_equal_runs_of_each_length_in_one_pass(spark):
    lines = [(1, "a a a a a b".split()), (2, "x y z".split()), (2, "p q r s".split()), (3, None), (4, "k l m n o".split())]
    texts = [(1, "b a a a a a a b x y z".split()), (1, "x y z p q r s".split()), (2, "k l m n x k l m n o".split()), (3, None)]
    want = {}
    for k in (3, 4, 5):
        for item, ws in lines:
            for doc, ts in texts:
                for o in range(len(ws or []) - k + 1):
                    for p in range(len(ts or []) - k + 1):
                        if ws[o : o + k] == ts[p : p + k]:
                            key = (item, doc, max(p - o, 0), k)
                            want[key] = want.get(key, 0) + 1
    top = {}
    for item, doc, _, k in want:
        top[item, doc] = max(top.get((item, doc), 0), k)
    got = matching.fast_candidates(spark.createDataFrame(lines, "item_id long, words array<string>"), spark.createDataFrame(texts, "doc_id long, words array<string>"))
    assert sorted(tuple(r[c] for c in ("item_id", "doc_id", "start", "k", "hits")) for r in got.collect()) == sorted((*key, n) for key, n in want.items() if top[key[:2]] == key[3])
    assert plan(got).count("Generate posexplode") == 2  # before: once a length on both sides


def test_alias_hits_read_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "of the of the the this".split()), (2, ["of"]), (3, None), (4, [])], "doc_id long, words array<string>")
    got = matching.alias_hits(docs, "doc_id", {"we": ["the", "of the"], "it": ["this"], "us": ["the"]})
    assert sorted(map(tuple, got.collect())) == [(1, "it", "this", 1), (1, "us", "the", 3), (1, "we", "of the", 2), (1, "we", "the", 3)]
    assert plan(got).count("Generate") == 1  # before: once a size


def test_sentences_and_clauses_are_numbered_where_their_text_lies(spark):
    docs = spark.createDataFrame([(1, "Go,  e.g. 3.5 km\tnorth. 7, and 8!? ”x"), (2, None), (3, " ."), (4, "12. 12")], "doc_id long, text string").repartition(2)
    s = segment.sentences(docs)
    clauses = prosody.clause_split(s, (" and",), least=3, most=9)
    folded = rules.alignment_sentences(docs)
    for got in (s, clauses, folded, segment.protected_sentences(docs)):
        assert "Window" not in plan(got)  # before: each sentence was shuffled to be numbered
    assert sorted(map(tuple, s.collect())) == [(1, 1, "Go, e."), (1, 2, "g."), (1, 3, "3."), (1, 4, "5 km north."), (1, 5, "7, and 8!?"), (1, 6, "”x"), (3, 1, "."), (4, 1, "12."), (4, 2, "12")]
    assert [r["text"] for r in clauses.where("sent_no = 5").orderBy("clause_no").collect()] == ["7, and", "8!?"]
    assert [tuple(r)[:2] for r in folded.where("doc_id = 4").orderBy("sent_no").collect()] == [(4, 1), (4, 2)]


def test_runs_of_words_meet_where_their_recording_lies(spark):
    lines = spark.createDataFrame([(1, 1, "a b c d".split()), (1, 2, []), (2, 1, ["", "x", "y", ""]), (3, 1, None)], "rec_id long, no long, words array<string>")
    dealt = ownmatch._by_recording(lines, "words")
    assert sorted(dealt.collect(), key=lambda r: r[:2]) == sorted(lines.collect(), key=lambda r: r[:2])  # words travel as texts and come back whole
    blocks = spark.createDataFrame([(1, 0, 5, "z a b c d".split()), (2, 0, 3, ["x", "y", ""])], "rec_id long, b long, own int, ws array<string>")
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    with joined_in_place(spark):
        got = ownmatch.own_windows(dealt, ownmatch._by_recording(blocks, "ws"), 3)
        assert "ENSURE_REQUIREMENTS" not in got._jdf.queryExecution().executedPlan().toString()  # before: the runs of all words were shuffled
    assert spark.conf.get(name) == before
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 2), (2, 1, 0, 1)]


def test_counted_rules_and_export_form_make_no_column_passes(spark):
    texts = ["".join(chr(c) for c in range(i, i + 512) if not 0xD800 <= c < 0xE000) for i in range(0, 0x110000, 512)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    rules = [ct.removed_controls(), ct.mapped_chars({"|": "/", "&": " and "}), ct.styled_marks("en"), ct.collapsed_lines()]
    for got in (ct.counted(docs, rules), docs.select(ct.export_text(F.col("text"), {"|": "/"}, "*#"))):
        assert "regexp" not in plan(got) and "translate" not in plan(got)  # before one pass of each for each rule and count
    alone = ct.counted(docs, [ct.removed_controls()]).select("doc_id", "out")
    assert alone.exceptAll(docs.select("doc_id", tx.strip_controls(F.col("text")).alias("out"))).isEmpty()
    blanks = ct.counted(spark.createDataFrame([(1, " a \t b\r\n \n\rc\f\n d ")], "doc_id long, text string"), [ct.collapsed_lines()]).first()
    assert (blanks["out"], blanks["space_collapses"]) == ("a b\n\n\nc\nd", 4)


def test_foreign_parts_are_found_in_bytes(spark):
    given = ["a (b（c）d) e", "中(ab)文（x y z中）", "(((x)))（", "中文 abc", "中文  ", "中abc\n", ")(", None, "", "\U00020000 ab", "(中a)（中文a）x(中)", "é(é)", "。 ~"]
    want = ["a (b（c）", "中文（x y z中）", "()（", "中文", "中文  ", "中abc\n", ")(", None, "", "\U00020000 ab", "（中文a）x(中", "é(é)", "。"]
    df = spark.createDataFrame(list(enumerate(given)), "i long, t string").coalesce(1)
    got = df.orderBy("i").select(foreign.drop_foreign(F.col("t"), tail=True).alias("o"))
    assert "regexp" not in plan(got)  # before two regular expressions ran for each part
    assert [r.o for r in got.collect()] == want


def test_anchor_windows_make_runs_of_lines_once(spark):
    lines = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "Need, le!"), (2, 1, "x")], "rec_id long, no int, text string")
    words = spark.createDataFrame([(1, i, f"w{i}q") for i in range(3000)] + [(1, 3000, "needle"), (1, 3001, "aaaaaaaaa"), (2, 0, "yxz"), (3, 0, "needle")], "rec_id long, idx int, text string")
    asked = spark.createDataFrame([(1, 6, "needle"), (1, 4, "aaaa"), (2, 1, "x")], "rec_id long, q int, gram string")
    runs = ownmatch._text_grams(words, asked, 6)
    assert {(r.rec_id, r.gram) for r in runs.collect()} >= {(1, "needle"), (1, "aaaa"), (2, "x")}
    assert runs.count() < 200  # before each of the 30,000 runs of both sizes was a row
    got = ownmatch.anchor_windows(lines, words)
    assert "Union" not in plan(got)  # before both sides of a union made all runs
    size = sum(len(f"w{i}q") for i in range(3000)) + 15
    assert sorted(map(tuple, got.collect())) == [(1, 1, size - 12, size - 4, 2), (1, 1, size - 8, size, 2), (1, 2, size - 21, size - 9, 1), (2, 1, 0, 2, 1)]
