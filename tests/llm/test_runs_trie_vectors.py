"""Operators 11 to 13 against plain Python and SQL, with nulls, ties, copies and long rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from takeweave.llm import covertree, periodic, prefixtrie
from takeweave.llm import queries as training

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        for s in range(n - q):
            if s and w[s - 1] == w[s - 1 + q]:
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            size = e + q - s
            if size >= max(6, 4 * q) and not any(all(w[i] == w[i + d] for i in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite=True):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


def rows(df, *order):
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(3):
            letters, w = rng.choice([1, 2, 3, 9]), []
            while len(w) < rng.randint(0, 50):
                w += ([str(rng.randrange(letters)) for _ in range(rng.randint(1, 5))] * rng.choice([1, 1, 4, 6]))[: rng.randint(1, 30)]
            texts.append([x.encode() for x in w])
        assert periodic.runs_of_texts(texts) == [plain_runs(t) for t in texts]


def test_periodic_runs_on_rows(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 120))) + rng.choice(["", "\t\n x y" * 9])) for i in range(120)]
    docs += [(None, "a b " * 6), (7, None), (8, ""), (9, " \x0b\x0c\r\n\t "), (3, "k " * 50), (3, "k " * 50), (-4, "é é é é " * 5), (11, "w " * 20000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_runs int")
    assert rows(periodic.periodic_runs(df), *RUN_COLUMNS) == sorted((plain_row(*d) if len(d[1] or "") < 9999 else plain_row_of_one_word(*d) for d in docs), key=repr)
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    text = {r["doc_id"]: r["text"] for r in periodic.collapsed(df.where("doc_id in (3, 7, 11)")).collect()}
    assert text == {3: "k", 7: "", 11: "w"}


def plain_row_of_one_word(doc_id, text):
    n, sha = len(text.split()), lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, 1, 0, n, 1, 1000 * n, sha(f"0,{n},1\n"), sha("w"))


def test_a_whole_table_of_documents(spark):
    got = rows(training.QUERIES["op11_periodic_runs"](spark, SF), *RUN_COLUMNS)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    by_id = {r[0]: r for r in got}
    small = [d for d in docs if len((d["text"] or "").split()) <= 700]
    assert len(small) > 150
    for d in small:
        assert by_id[d["doc_id"]] == plain_row(d["doc_id"], d["text"])


def test_splitting_is_only_a_filter():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 12, 3000)
    words[500:560] = np.tile([1, 2, 3], 20)
    whole = periodic.lag_scan(words)
    parts = [(int(p[0]) + s, m, q) for p in periodic.split_segments(words, np.zeros(3000, int)) for s, m, q in periodic.lag_scan(words[p])]
    assert sorted(whole) == sorted(parts)
    assert (500, 60, 3) in whole or any(s <= 500 and s + m >= 560 and q == 3 for s, m, q in whole)


TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def by_sql(table, name):
    con = duckdb.connect()
    con.register(name, table)
    rel = con.sql(training.ORACLES[{"conversations": "op12_prefix_trie", "embeddings": "op13_near_vectors"}[name]])
    at = [rel.columns.index(c) for c in (TRIE_COLUMNS if name == "conversations" else VECTOR_COLUMNS)]
    return sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_trie_by_shards(spark, monkeypatch, shards):
    monkeypatch.setattr(prefixtrie, "SHARD_ROWS", 1)
    monkeypatch.setattr(prefixtrie, "_BLOCK", 7)
    rng = random.Random(1)
    data = []
    for c in range(160):
        if c % 20 == 0 and c % 3 == 0:
            continue  # a family without its first conversation: some members lose all turns
        common = rng.random() < 0.4
        for t in range(3 if common else rng.randint(1, 6)):
            data.append((c, None if t == 0 and c % 9 == 0 else t, "user" if common else rng.choice(["user", "assistant", None]), f"same {t}" if common else rng.choice(["a b", "c", "", None, "d e f"]), c))
    for t in range(70):
        data += [(c, t, "user", "long", 0) for c in (200, 220, 240)]
    data += [(-7, 1, "u", "x", 0), (300, 1, "u", "twice", 0), (300, 1, "u", "twice", 0)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth int").repartition(4)
    want = by_sql(df.toArrow(), "conversations")
    assert rows(prefixtrie.prefix_trie(df, shards), *TRIE_COLUMNS) == want
    with_null = df.unionByName(spark.createDataFrame([(None, 1, "u", "x", 0)], df.schema))
    assert rows(prefixtrie.prefix_trie(with_null, shards), *TRIE_COLUMNS) == want
    assert prefixtrie.prefix_trie(df.limit(0), shards).collect() == []


def test_trie_of_the_table(spark):
    got = rows(training.QUERIES["op12_prefix_trie"](spark, SF), *TRIE_COLUMNS)
    assert got == by_sql(spark.read.parquet(f"{SF}/conversations.parquet").toArrow(), "conversations")


VECTOR_COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def plain_links(ids, vectors, cosine=0.9):
    usable = [i for i, v in enumerate(vectors) if ids[i] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(ids))}
    for d in {len(vectors[i]) for i in usable}:
        at = [i for i in usable if len(vectors[i]) == d]
        u = np.array([np.array(vectors[i]) / max(map(abs, vectors[i])) for i in at])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for k, row in enumerate(u @ u.T >= cosine):
            near[at[k]] = {at[j] for j in np.flatnonzero(row)} - {at[k]}
    out, done = [], {}
    for i in range(len(ids)):
        if i not in done:
            seen, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            done |= dict.fromkeys(seen, min((ids[j] for j in seen if ids[j] is not None), default=None))
        out.append((ids[i], len(near[i]), done[i], ids[i] is None or done[i] == ids[i]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,sample", [(60, 8), (8192, 512)])
def test_vectors_against_all_pairs(spark, block, sample):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 6))
    vectors = [(centres[k] + rng.normal(size=6) * rng.choice([0, 0.05, 0.3, 0.6])).tolist() for k in rng.integers(0, 30, 350)]
    vectors += [(centres[0] + rng.normal(size=6) * 0.02).tolist() for _ in range(200)] + [vectors[3]] * 40
    vectors += [[0.0] * 6, None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), *[1.0] * 5], [1.0, 2.0], [2e-200, 4e-200], [3e200, 6e200], [-0.0, 0.0], [1.0] * 5]
    ids = list(range(len(vectors)))
    ids[5], ids[9] = None, 8
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, block string").repartition(5)
    assert rows(covertree.near_vectors(df, block=block, sample=sample), *VECTOR_COLUMNS) == plain_links(ids, vectors)


def test_vectors_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = rows(training.QUERIES["op13_near_vectors"](spark, SF), *VECTOR_COLUMNS)
    assert got == by_sql(table.toArrow(), "embeddings")
    assert covertree.near_vectors(table.limit(0)).collect() == []
