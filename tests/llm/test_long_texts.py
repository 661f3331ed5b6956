"""Personal data in a text of very many spans, and in secrets of any length."""

import re

from takeweave.llm import pii


def test_spans_of_a_long_text(spark):
    n = 6000
    words = [f"user{i}@mail{i % 7}.org é token = \"abc{i}defghijk\"" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "say token: " + "a1B2" * 1500 + " end"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert (got[1]["n_email"], got[3]["n_email"], got[4]["spans"]) == (n, 0, "")
    places = [tuple(x.split(":")) for x in got[1]["spans"].split(",")]
    want = [("email", str(m.start()), str(m.end())) for m in re.finditer(r"\S+@\S+", " ".join(words))]
    assert [p for p in places if p[0] == "email"] == want
    assert got[1]["n_secret"] == n
    text = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert text[1] == " ".join(['[EMAIL] é token = "[SECRET]"'] * n)
    assert text[3] is None and text[4] == ""


def test_a_secret_of_any_length(spark):
    rows = [(i, f"login here, token: {('a1B2' * 5000)[:n]} end of it") for i, n in enumerate([20, 24, 28, 32, 40, 4096, 4097, 20_000])]
    got = {r["doc_id"]: r["n_secret"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(got.values())) == 1
