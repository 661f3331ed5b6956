"""The queries of the operators on the smallest tables, whole, against plain Python or against their SQL."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from takeweave.llm import decontaminate, pii
from takeweave.llm.queries import ORACLES, QUERIES, table

SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text or "" for r in table(spark, SF, "benchmark").collect()}


def encoded(text):
    return np.array([*LIB.encode(text, add_special_tokens=False).ids, 1], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def shingles(text):
    w = WORD.findall(text.translate(ASCII_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(texts):
    """Component of each document: all pairs that share a shingle are compared."""
    sets, posted, root = {d: shingles(t) for d, t in texts.items()}, defaultdict(list), {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(sets):
        for e in {e for s in sets[d] for e in posted[s]}:
            both = len(sets[d] & sets[e])
            if 100 * both >= 75 * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            posted[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in texts}


def grams(words, n):
    return [tuple(words[i : i + 5]) for i in range(n - 4)] if n >= 5 else [tuple(words)]


def leaks(texts, items):
    """(doc, item) -> best similarity over all windows as long as the item."""
    out, folded = {}, {d: WORD.findall(t.lower()) for d, t in texts.items()}
    for item, text in items.items():
        own = WORD.findall(text.lower())
        if not own:
            continue
        n, want = len(own), Counter(grams(own, len(own)))
        for d, w in folded.items():
            k = min(5, n)
            if len(w) < k:
                continue
            seq = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            if want.keys().isdisjoint(seq):
                continue
            width, have, both, best = min(n, len(w)) - k + 1, Counter(), 0, 0.0
            for i, g in enumerate(seq):
                have[g] += 1
                both += have[g] <= want[g]
                if i >= width:
                    old = seq[i - width]
                    both -= have[old] <= want[old]
                    have[old] -= 1
                if i >= width - 1:
                    best = max(best, both / (want.total() + width - both))
            if best >= 0.75:
                out[d, item] = best
    return out


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    spans = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


def check_packed(pieces, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids, at = encoded(texts[d]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


def test_html_text(spark):
    """These pages have one article without furniture inside, so plain cutting tells its text."""
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    got = QUERIES["op2_html_text"](spark, SF).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        article = re.search("<article>(.*?)</article>", pages[r.page_id].html or "", re.S)
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", article[1] if article else "")
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_token_files(spark, texts):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, SF).collect()}
    at, want = 0, {}
    for d in sorted(texts):
        ids = encoded(texts[d])
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_token_counts(spark, texts):
    lengths = [len(encoded(t)) for t in texts.values()]
    got = {r.length: r for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.rank_below) == (lengths.count(n), sum(x >= n for x in lengths), sum(x < n for x in lengths))
        assert (r.tokens_at_least, r.total_tokens, r.truncated_tokens) == (sum(x for x in lengths if x >= n), sum(lengths), sum(min(x, n) for x in lengths))


def test_decontaminate(spark, texts, items):
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    assert got == {k: round(v, 9) for k, v in leaks(texts, items).items()}


def test_personal_data(spark, texts):
    for r in QUERIES["op8_pii"](spark, SF).collect():
        base = personal(texts[r.doc_id])
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in PATTERNS]
        assert set(base) <= set(r.spans.split(","))


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_near_duplicates"](spark, SF).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in groups(texts).items()}


def test_pack(spark, texts):
    check_packed(QUERIES["op10_pack"](spark, SF).collect(), texts)


def redacted(text, spans):
    out, at = "", 0
    for kind, s, e in (x.split(":") for x in spans.split(",") if x):
        if int(s) >= at:
            out, at = out + text[at : int(s)] + f"[{kind.upper()}]", int(e)
        at = max(at, int(e))
    return out + text[at:]


def test_pipeline(spark, texts, items):
    """Every stage's decisions told in plain Python, on what the stage before kept, down to the packed ids."""
    good = {r.doc_id for r in QUERIES["op1_quality"](spark, SF).where("kept").collect()}  # itself held against SQL above
    left = {d: t for d, t in texts.items() if d in good}
    left = {d: left[d] for d, (_, c) in groups(left).items() if c == d}
    bad = {d for d, _ in leaks(left, items)}
    left = {d: t for d, t in left.items() if d not in bad}
    rows = spark.createDataFrame(sorted(left.items()), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(rows).collect()}
    check_packed(corpus_pipeline.run(spark, SF).collect(), {d: redacted(t, spans[d]) for d, t in left.items()})


def test_decontaminate_moved_passages(spark):
    """Leaks whose halves or sentences are swapped, with text around, within, and of their own words again."""
    word = lambda a, n: [f"v{i}" for i in range(a, a + n)]
    own = {1: word(0, 48), 2: word(100, 45), 3: word(200, 30) + word(200, 30), 4: word(300, 3), 5: ["a"] * 40}
    around = lambda xs, k=36: [f"x{i}" for i in range(k)] + xs + [f"y{i}" for i in range(40)]
    a, b, c = own[2][:15], own[2][15:30], own[2][30:]
    docs = {
        1: around(own[1][24:] + own[1][:24]),
        2: around(c + a + b),
        3: around(a + b + c, 300),
        4: around(own[3][:50] + word(200, 30)),
        5: around(own[4], 0),
        6: ["a"] * 50,
        7: own[1][:44],
        8: around(own[1][:22] + ["new"] + own[1][22:46], 230),
        9: own[1][24:] + ["one"] * 30 + own[1][:24],
        10: own[2][3:] * 3,
    }
    docs, items = ({k: " ".join(v) for k, v in t.items()} for t in (docs, own))
    got = {}
    frames = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string"), spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    for r in decontaminate.contaminated(*frames).collect():
        got[r.doc_id, r.item_id] = round(r.similarity, 9)
    want = {k: round(v, 9) for k, v in leaks(docs, items).items()}
    assert {(1, 1), (2, 2)} <= set(want)
    assert got == want


def test_decontaminate_replaced_tails(spark):
    """Leaks whose tail is other text, down to the similarity that counts: none is lost by the distance of its fingerprint."""
    rng = np.random.default_rng(7)
    docs, items = {}, {}
    for i in range(160):
        n = (50, 100, 200)[i % 3]
        own = [f"i{i}.{j}" for j in range(n)]
        keep = n - (n - 4) // 7
        items[i] = " ".join(own)
        docs[i] = " ".join(own[:keep] + [f"d{x}" for x in rng.integers(0, 10**9, 60)])
    frames = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string"), spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    rows = decontaminate.contaminated(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i in items} == set(leaks(docs, items))
    assert max(r.hamming for r in rows) > 15
