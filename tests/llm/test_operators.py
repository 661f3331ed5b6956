"""Small cases of the operators: nulls, empty and odd texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeweave.llm import chat, decontaminate, histogram, htmltext, neardup, pack, pii, quality, tokenfile, warc
from takeweave.session import new_path

WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(WORDS[:60])
NEAR = " ".join([*WORDS[:30], "other", *WORDS[31:60]])
TEXTS = [(0, BASE), (1, BASE), (2, NEAR), (3, None), (4, ""), (5, "one two"), (6, "One  two"), (7, " ".join(WORDS[100:160])), (7, " ".join(WORDS[100:160])), (None, BASE), (8, "x" * 50000), (9, "a.b@c.de " * 30 + " +1 (555) 555-1234")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i else None, None if i == 2 else "s", 1, "x", 2) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, kept string, _row long")


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got[0] == (56, 0, True) and got[1] == (56, 0, False) and got[2] == (56, 0, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (1, 5, True) and got[6] == (1, 5, False) and got[None][1:] == (None, True)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 3, 4, 5, 7, 8, 9]
    assert neardup.near_duplicates(docs.where("false")).isEmpty()


def test_deduplicated_tells_rows_of_one_id_apart(spark):
    text = lambda a: " ".join(f"v{i}" for i in range(a, a + 40))
    near = text(0).replace("v20", "other").split()
    rows = [(1, text(0), 1), (1, text(100), 2), (1, text(100), 3), (5, " ".join(["new", *text(200).split()]), 4), (5, text(300), 5), (4, text(200), 6), (6, "", 7), (6, None, 8), (None, text(0), 9), (0, " ".join(near[:19] + near[21:]), 10)]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _n long"), percent=60)
    left = sorted(r["_n"] for r in kept.collect())
    assert left in ([2, 5, 6, 7, 8, 9, 10], [3, 5, 6, 7, 8, 9, 10])


def test_near_duplicates_without_signatures(spark):
    """Pairs that meet on their shingles are told by the full sets, however few coordinates agree; long lists are dealt out."""
    text = lambda a, n: " ".join(f"v{i}" for i in range(a, a + n))
    rows = [(i, f"{text(0, 60)} {text(1000 + 100 * i, 12)}") for i in range(1500)] + [(2000, text(0, 60))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neighbour_rounds=0).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i, _ in rows}


def test_token_files_ids(spark):
    """The least int64 is an id, nulls are counted apart, and an id of very many rows is spread over tasks."""
    low = -(1 << 63)
    rows = [(None, f"text {i}") for i in range(300)] + [(low, "low")] + [(3, f"other {i}") for i in range(300)] + [(9, None)]
    path = new_path(spark, "t")
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, parts=6, shard_ids=64)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [low] + [3] * 300 + [9]
    assert got[-1].n_tokens == 1 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    manifest = spark.read.parquet(f"{path}/_manifest")
    assert manifest.groupBy("part").agg(F.sum("docs").alias("n")).agg(F.max("n")).first()[0] < 300


def test_pack_and_tokens(docs, spark):
    pieces = pack.pack(docs, window=64).collect()
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    assert sum(p.length for p in pieces if p.doc_id == 0) == next(p.doc_tokens for p in pieces if p.doc_id == 0)
    path = new_path(spark, "t")
    tokenfile.write_tokens(docs, path)
    rows = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert sum(r.n_tokens for r in rows) == sum(p.length for p in pieces)
    assert rows[4].n_tokens == 1
    totals = histogram.context_totals(histogram.length_histogram(docs))
    assert totals.first().total_tokens == sum(r.n_tokens for r in rows)
    assert histogram.truncated_total(totals, 10).first()[0] == sum(min(10, r.n_tokens) for r in rows)
    assert pack.pack(docs.where("false")).isEmpty()
    empty = new_path(spark, "t")
    tokenfile.write_tokens(docs.where("false"), empty)
    assert tokenfile.read_tokens(spark, empty).isEmpty()


def test_quality(docs):
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert got[3].base_failed and not got[3].kept and got[7].kept and got[9].base_failed
    out = quality.filtered(docs)
    assert out.columns == docs.columns and out.where("doc_id = 3").isEmpty()
    assert quality.verdicts(docs.where("false")).isEmpty()


def test_quality_thresholds_follow_the_source(spark):
    """What is usual in one source is too much in another; a document is judged by its own group."""
    plain = [("plain", " ".join(WORDS[i : i + 40])) for i in range(100)]
    priced = [("priced", " ".join(f"{w} $" if k % 4 == i % 3 else w for k, w in enumerate(WORDS[i : i + 40]))) for i in range(100)]
    rows = [*plain, *priced, ("plain", priced[0][1])]
    d = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    gone = {r.doc_id for r in quality.verdicts(d, prior_docs=5).where("not kept").collect()}
    assert gone == {200}
    limits = {r.source: r for r in quality.thresholds(quality.sketch(quality.measured(d, "text").select("lang", "source", "_m")), 5).collect()}
    assert limits["priced"].symbol_ppm > 2 * limits["plain"].symbol_ppm
    lone = quality.thresholds(quality.sketch(quality.measured(d.where("doc_id < 101"), "text").select("lang", "source", "_m"))).collect()
    few = {r.source: r.symbol_ppm for r in lone}
    assert few["plain"] <= few["priced"] < limits["priced"].symbol_ppm  # one document leans on its language


def test_decontaminate(spark):
    item = " ".join(WORDS[:40])
    near = " ".join([*WORDS[:20], "changed", *WORDS[21:40]])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "rare short item"), (5, item.upper())], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b c " + item + " d e"), (2, near), (3, " ".join(WORDS[:25])), (4, None), (5, "x rare short item y"), (6, "quite other text " * 20)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 2)) for r in decontaminate.contaminated(d, bench).collect()}
    assert got[1, 1] == (3, 1.0) and (1, 5) in got and got[2, 1][1] > 0.75 and (5, 4) in got and {k[0] for k in got} == {1, 2, 5}
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [3, 4, 6]
    twice = spark.createDataFrame([(None, item), (None, "a clean text of no item at all"), (7, item), (7, "another clean text with an id that repeats"), (8, None)], "doc_id long, text string")
    assert sorted(r.text or "" for r in decontaminate.clean(twice, bench).collect()) == ["", "a clean text of no item at all", "another clean text with an id that repeats"]
    assert decontaminate.contaminated(d, bench.where("false")).isEmpty() and decontaminate.contaminated(d.where("false"), bench).isEmpty()


def test_decontaminate_in_blocks(spark, monkeypatch):
    """A benchmark of many blocks gives what one block gives; items of equal text are each reported."""
    texts = [" ".join(f"i{i}w{j}" for j in range(30)) for i in range(40)]
    bench = spark.createDataFrame([*enumerate(texts), (100, texts[3]), (101, texts[3])], "item_id long, text string")
    d = spark.createDataFrame([(i, f"before it {t} and after") for i, t in enumerate(texts[::2] + texts[3:4])], "doc_id long, text string")
    rows = lambda: sorted((r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontaminate.contaminated(d, bench).collect())
    once = rows()
    assert len(once) == 23 and {r[1] for r in once if r[0] == 20} == {3, 100, 101}
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 400)
    assert rows() == once


def test_pii(docs):
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[9].n_email == 30 and got[9].n_phone == 1 and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert "@" not in out[9].text and out[9].n_chars == len(out[9].text) and out[3].text is None and out[0].text == BASE
    assert pii.report(docs.where("false")).isEmpty()


def test_pii_gate_of_wider_email(spark):
    texts = ["joe at example [dot] com", "joe at example(dot)com", "joe[at]example[dot]com", "joe at example dot com", "joe(at)example dot com"]
    rows = pii.candidates(spark.createDataFrame([(t,) for t in texts], "_text string")).collect()
    assert {r._text: [x.m for x in r._more] for r in rows} == {t: [t] for t in texts}


def test_pii_secrets_and_accounts(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = {1: f'see token = "{key}" there', 2: "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI7K7MDENGbPxRfiCY", 3: "pay to DE89 3704 0044 0532 0130 00 now", 4: "DE88 3704 0044 0532 0130 00", 5: "the token of love: none", 6: None, 7: "", 8: "password: 4111111111111111x", 9: "a" * 100_000}
    rows = spark.createDataFrame(list(texts.items()) * 2, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(rows).collect()}
    assert {d: r.spans for d, r in got.items() if r.n_added} == {1: "secret:13:53", 2: "secret:22:51", 3: "iban:7:34", 8: "card:10:26,secret:10:27"}
    assert [got[d].n_secret for d in (1, 3, 6, 9)] == [1, 0, 0, 0]
    out = {r.doc_id: r.text for r in pii.redacted(rows).collect()}
    assert out[1] == 'see token = "[SECRET]" there' and key not in out[1] and out[8] == "password: [CARD]" and out[6] is None


def test_pii_model_equals_numpy(spark):
    """EM over vote patterns and the naive Bayes weights, told again with numpy."""
    rng = np.random.default_rng(3)
    names = [f"v_{n}" for n in pii.LABELERS]
    feats = [f"f_{n}" for n in pii.FEATURES]
    rows = []
    for _ in range(400):
        true = rng.random() < 0.4
        votes = [int(x) if rng.random() < 0.7 else -1 for x in (rng.random(len(names)) < (0.85 if true else 0.25))]
        rows.append((4, *votes, *[str(int(x)) for x in rng.integers(0, 3, len(feats)) + (1 if true else 0)]))
    spans = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} int" for n in names) + ", " + ", ".join(f"{n} string" for n in feats))
    params = pii.reliabilities(spans.groupBy("k", *names).agg(F.count("*").cast("double").alias("n")))
    v = np.array([r[1 : 1 + len(names)] for r in rows])
    prior, alpha, beta = 0.5, np.full(len(names), 0.8), np.full(len(names), 0.2)

    def posterior():
        odds = np.log(prior / (1 - prior)) + np.where(v == 1, np.log(alpha / beta), np.where(v == 0, np.log((1 - alpha) / (1 - beta)), 0)).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(pii.EM_ROUNDS):
        p = posterior()[:, None]
        prior = min(0.99, max(0.01, (p.sum() + 1) / (len(v) + 2)))
        alpha = ((p * (v == 1)).sum(0) + 8) / ((p * (v >= 0)).sum(0) + 10)
        beta = (((1 - p) * (v == 1)).sum(0) + 2) / (((1 - p) * (v >= 0)).sum(0) + 10)
    got = params["secret"]
    assert got[0] == pytest.approx(prior) and [got[1][n] for n in pii.LABELERS] == pytest.approx(list(alpha)) and [got[2][n] for n in pii.LABELERS] == pytest.approx(list(beta))
    p = posterior()
    f = np.array([r[1 + len(names) :] for r in rows])
    score = np.full(len(v), np.log((p.sum() + 1) / ((1 - p).sum() + 1)))
    for j in range(len(feats)):
        for x in set(f[:, j]):
            own = f[:, j] == x
            score[own] += np.log((p[own].sum() + 0.5) / (p.sum() + 4)) - np.log(((1 - p)[own].sum() + 0.5) / ((1 - p).sum() + 4))
    told = [r.score for r in spans.withColumn("i", F.monotonically_increasing_id()).withColumn("score", pii.classifier(spans, params)).orderBy("i").collect()]
    assert told == pytest.approx(list(score))


def test_warc(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (5, "u", ""), (6, "u", "é" * 1000), (None, "n", "same")]
    path = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, roll_bytes=600, shards=2)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()}
    assert got == {1: (4, "response", None), 3: (4, "revisit", 1), None: (4, "revisit", 1), 2: (0, "response", None), 5: (0, "revisit", 2), 6: (2000, "response", None)}
    assert gzip.decompress(warc.page_record(1, "u", b"x", None, None)).startswith(b"WARC/1.1\r\nWARC-Type: response")
    big = [(i // 3 if i % 2 else None, f"http://{i}", f"page {i % 50} " * (i % 40)) for i in range(600)] + [(7, "http://same", "x" * 900)] * 200
    frame = spark.createDataFrame(big, "page_id long, url string, html string")

    def files(df, n):
        path = new_path(spark, "w")
        warc.write_warc(df, path, roll_bytes=2000, shards=n, shard_bytes=9000)
        assert warc.read_warc(spark, path).count() == len(big)
        return {f.name: f.read_bytes() for f in pathlib.Path(path.removeprefix("file://")).glob("*.warc.gz")}

    once = files(frame.repartition(3), 2)
    assert len(once) > 20 and once == files(frame.orderBy(F.desc("url")).repartition(11), 7) == files(frame.coalesce(1), 5)
    other = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), other)
    assert warc.read_warc(spark, other).isEmpty()


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>One <b>two</b>\n three<br>four<p>Next<div class='comments'><p>first!</p></div></article><script>x<y</script><footer>f"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (2, "u", ""), (3, "u", "<" * 5000 + "a")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(rows).collect()}
    assert got[1] == "Head & line\nOne two three four\nNext" and got[2] == ""
    assert htmltext.extract(rows.where("false")).isEmpty()


def test_html_broken_markup():
    tree = htmltext.grow(*htmltext.labelled_rows())
    text = lambda body: htmltext.main_text(f"<article><p>{' '.join(WORDS[:9])}</p>{body}</article><footer><p>foot</p></footer>", tree).split("\n")[1:]
    a, b = " ".join(WORDS[10:22]), " ".join(WORDS[30:44])
    for broken in ("<svg/>", "<svg>", "<select>", "<iframe src=x>", "<a href=y>", "<canvas>", "<video>", "<math>", "</svg>", "<span class='note'>"):
        assert text(f"<p>{a} {broken}</p><p>{b}</p>") == [a, b], broken
    assert text(f"<p>{a} <svg><text>no</text></svg></p><p>{b} <iframe>no</iframe><iframe>no</iframe>") == [a, b]
    assert text(f"<p>{a} <span class=ad>buy now</span> {b}</p>") == [f"{a} {b}"]
    assert text(f"<ul><li>{a}<li>{b}</ul><script>if (a < b) '</p>'") == [a, b]
    assert text(f"<p>{a}<div hidden>secret words</div><p>{b}") == [a, b]
    plain = htmltext.main_text(f"<ul><li><a href=x>home</a><li><a href=y>news</a></ul><p>{' '.join(WORDS[:70])}<p>{b}<p>{a} {a}<p>top", tree)
    assert plain.split("\n") == [" ".join(WORDS[:70]), b, f"{a} {a}"]
    assert htmltext.main_text("<svg>" * 50_000 + "<p>" + "<a>" * 50_000 + "x" * 200_000, tree) == ""
    assert len(htmltext.main_text("<article>" + f"<p>{a} <svg/>" * 20_000, tree).split("\n")) == 20_000


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "yo"), (2, 0, "system", "x"), (None, None, None, "n")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.conv_id, r.speaker): r for r in out}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = got[1, "ann"]
    assert [ann.text[int(a) : int(b)] for a, b in (m.split(":") for m in ann.masks.split(","))] == ["hi<|end|>"] and "<|user name=bob|>\nyo" in ann.text
    assert got[1, "bob"].n_own_turns == 2


def test_chat_large_parts(spark):
    rows = [(None, i % 8, "ann" if i % 3 else "bob", f"t{i % 50}") for i in range(2000)] + [(1, None, "ann", f"n{i}") for i in range(700)] + [(1, 3, "cy", "same")] * 600 + [(2, 0, "ann", "hi"), (2, 1, "bob", "yo")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert max(r.n_turns for r in out) == 256
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv, speakers in ((None, ("ann", "bob")), (1, ("ann", "cy")), (2, ("ann", "bob"))):
        for speaker in speakers:
            text, masks = "", []
            for _, _, role, t in sorted((r for r in rows if r[0] == conv), key=order):
                text += "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
                if role == speaker:
                    masks.append(f"{len(text)}:{len(text) + len(t) + 7}")
                text += t + "<|end|>\n"
            own = sorted((r for r in out if (r.conv_id, r.speaker) == (conv, speaker)), key=lambda r: (r.part, r.start))
            assert "".join(r.text for r in own) == text and [m for r in own for m in r.masks.split(",") if m] == masks
            at = 0
            for r in own:
                assert r.start == at
                at += len(r.text)


def test_pipeline_keeps_clean_documents(spark, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_dedup", "decontaminate", "pii", "pack"]
    d = docs.drop("kept", "_row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.columns == d.columns
    assert out.where(F.col("doc_id") == 0).count() == 1


def test_near_duplicates_leave_no_sets_behind(spark):
    from pathlib import Path

    from takeweave import session
    from takeweave.llm import neardup

    top = Path(session.shared_dir(spark).removeprefix("file:")) / "takeweave"
    old = set(top.glob("*")) if top.exists() else set()
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(words[:50] + [f"x{i}"])) for i in range(6)] + [(9, "a b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: 0 for i in range(6)} | {9: 9}
    left = {p.name.rsplit("-", 1)[0] for p in set(top.glob("*")) - old}
    assert left and not left & {"sets", "signatures", "postings", "exact-lists"}
