"""Pieces outside brackets: by a walk inside each text, without a row for each character."""

from takeweave.operators import segment


def test_depth_split_walks_texts_where_they_lie(spark):
    texts = ["a,b(c,d),e", ")x,(y,z", "(([,;", "", None, "no marks", ",,", "é𝒳，（a，b）。\nc", "a,", "]" * 3 + "([{,}]);x"]
    want = []
    for n, t in enumerate(texts):
        depth, piece, no = 0, "", 0
        for c in t or "":
            depth += (c in "([{（【") - (c in ")]}）】")
            piece += c
            if c in ",;，；。" and depth <= 0:
                want.append((n, no, piece))
                piece, no = "", no + 1
        if piece:
            want.append((n, no, piece))
    df = segment.depth_split(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
