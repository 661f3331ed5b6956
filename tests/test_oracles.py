"""Every registered query with SQL gives the SQL's rows on the smallest tables; the rest run and keep their invariants."""

import os

import duckdb
import pytest

from takeweave.queries import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_fold_and_pack_invariants(spark):
    folded = QUERIES["i11_fold_short"](spark, SF).collect()
    by_rec = {}
    for r in folded:
        by_rec.setdefault(r["rec_id"], []).append(r["e_ms"] - r["s_ms"])
    assert all(n >= 300_000 or len(v) == 1 for v in by_rec.values() for n in v)
    assert QUERIES["g06_packed_pieces"](spark, SF).where("longest > 200").isEmpty()
    assert QUERIES["d04_best_path"](spark, SF).where("n < 1").isEmpty()


def test_pieces_join_to_the_text(spark):
    pieces = {r["doc_id"]: r["joined"] for r in QUERIES["g05_g07_g09_pieces"](spark, SF).collect()}
    want = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", r"regexp_replace(text, '\\s+', ' ') as t").collect()
    assert pieces == {r["doc_id"]: r["t"] for r in want}


def test_greedy_order_never_steps_back(spark):
    end = {}
    for r in QUERIES["m15_greedy_order"](spark, SF).orderBy("rec_id", "line").collect():
        assert r["s"] >= end.get(r["rec_id"], 0)
        end[r["rec_id"]] = r["e"]
    assert end
