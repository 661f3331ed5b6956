"""Landed files: a stream broken off in the middle gives after its restart what one batch gives; and the health report's totals."""

import json

import pytest
from pyspark.sql import functions as F

from takeweave.functions import counted as ct
from takeweave.operators import health
from takeweave.sources import readers
from takeweave.streaming import landing


def test_a_restart_gives_no_row_twice(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"S{i}.txt").write_text("﻿" * (i % 2) + f"text {i}*  with  blanks\n" * (i + 1), encoding="utf-8")
    (tmp_path / "in" / "other.bin").write_bytes(b"x")
    rules = [ct.deleted_chars("*"), ct.collapsed_lines()]
    seen = []

    def broken(files):
        """Fails in the third batch, when rows of it are already written."""
        seen.append(1)
        done = ct.counted(files, rules, "rec_id", "content")
        if len(seen) == 3:
            done.write.mode("overwrite").parquet(f"{out}/batch=2")
            raise RuntimeError("lost")
        return done

    stream = landing.landing_files(spark, folder, files_per_trigger=1)
    with pytest.raises(Exception, match="lost"):
        landing.start(stream, broken, out, state).awaitTermination()
    (tmp_path / "in" / "S9.txt").write_text("late*", encoding="utf-8")
    for _ in range(2):  # the second run finds nothing new
        landing.start(landing.landing_files(spark, folder, files_per_trigger=1), lambda f: ct.counted(f, rules, "rec_id", "content"), out, state).awaitTermination()
    want = ct.counted(readers.whole_files(spark, folder + "/*.txt"), rules, "rec_id", "content")
    assert sorted(landing.landed(spark, out).collect()) == sorted(want.collect())
    assert landing.landed(spark, out).count() == 7


def test_landed_word_lists(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        words = [{"text": f"w{k}", "start": k / 2, "end": k / 2 + 0.4} for k in range(4)] + [{"text": " ", "start": 0, "end": 1}, {"text": "z", "start": 5, "end": 5}]
        (tmp_path / "in" / f"r{i}.words.json").write_text(json.dumps({"words": words} if i else words))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = landing.landing_files(spark, str(tmp_path / "in"), "*.json", files_per_trigger=2)
    landing.start(stream, landing.landed_words, out, state).awaitTermination()
    got = landing.landed(spark, out)
    assert got.count() == 12
    assert sorted(got.collect()) == sorted(landing.landed_words(readers.whole_files(spark, str(tmp_path / "in"))).collect())


def test_health_levels(spark):
    texts = spark.createDataFrame([(1, "a\nb."), (2, None), (2, "x"), (3, "c")], "rec_id long, text string")
    sentences = spark.createDataFrame([(1, "Ab."), (1, "c. d"), (2, "x")], "rec_id long, text string")
    summary = spark.createDataFrame([(1, 5, 2, 2, 0, 1, 9), (2, 4, 0, 1, 3, 0, 2)], "rec_id long, n_lines long, anchor long, relaxed long, no_anchor long, distance long, anchor_hits long")
    r = health.report(health.normalise_block(texts), health.split_block(sentences), health.align_block(summary))
    got = {(x["level"], x["status"], x["rec_id"]): x for x in r.collect()}
    assert set(got) == {("item", "ok", 1), ("item", "review", 2), ("item", "missing", 3), ("status", "ok", None), ("status", "review", None), ("status", "missing", None), ("all", None, None)}
    one, total = got["item", "ok", 1], got["all", None, None]
    assert (one["orig_len"], one["norm_len"], one["removed_newlines"], one["sentences"], one["stops"], one["inner_stops"], one["stop_rate"], one["match_rate"]) == (4, 4, 1, 2, 1, 1, 50.0, 80.0)
    assert (total["items"], total["sentences"], total["lines"], total["unmatched"], total["len_median"], total["len_max"]) == (3, 3, 9, 4, None, 4)
    empty = health.report(*(f(x.limit(0)) for f, x in ((health.normalise_block, texts), (health.split_block, sentences), (health.align_block, summary))))
    assert empty.collect() == []
    assert texts.select(F.count("*")).first()[0] == 4
