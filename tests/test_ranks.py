"""Ranks under several scores at once, against sorted lists and SQL, and what they write."""

import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from dualview.operators import ranking, ranks, settled
from dualview.plans.catalog import ORACLES, QUERIES
from oracle import assert_same


def order(score, id):
    return (score is None, score is not None and math.isnan(score), 0 if score is None or math.isnan(score) else score, id is None, id or "")


@pytest.mark.parametrize("parts,spans", [(None, None), (1, 1), (7, 3), (40, 9)])
def test_ranks_by_each_score(spark, monkeypatch, parts, spans):
    monkeypatch.setattr(ranks, "HELD", 300)
    monkeypatch.setattr(ranks, "PIECE", 64)
    r = random.Random(4)
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), -2.5, 0.1 + 0.2]
    data = [(r.choice(["", "a", "é", "\U0001f600", "z-1", None, f"{i}", f"{i}-1"]), r.choice([*odd, r.random(), float(r.randrange(5))]), round(r.random() * 100, 2)) for i in range(900)]
    data += [("same", 1.0, float(i % 2)) for i in range(600)]
    df = spark.createDataFrame(data, "key string, x double, y double").repartition(3)
    got = ranks.ranked_by_each(df, "key", ["x", "y"], parts, spans).collect()
    assert all(g["n"] == len(data) and g["rank_percentile"] == g["rank"] / len(data) for g in got)
    for i, model in enumerate(("x", "y"), 1):
        own = sorted(((x[i], x[0]) for x in data), key=lambda x: order(*x))
        assert [g["id"] for g in sorted((g for g in got if g["model"] == model), key=lambda g: g["rank"])] == [id for _, id in own]
        assert sorted(g["rank"] for g in got if g["model"] == model) == list(range(1, len(data) + 1))


@pytest.mark.parametrize("large", [False, True])
def test_null_scores_rank_as_in_sql(spark, monkeypatch, tmp_path, small, large):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_linenumber > 2 THEN l_extendedprice END AS l_extendedprice, CASE WHEN l_partkey % 3 > 0 THEN l_shipdate END AS l_shipdate) FROM '{small}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    if large:
        for module, name, value in ((ranking, "BELIEVED", -1), (ranking, "RANGE", 1000), (ranks, "PART", 900), (ranks, "SPAN", 2000)):
            monkeypatch.setattr(module, name, value)
    assert_same(QUERIES["rank_percentile"](spark, str(tmp_path)), con, ORACLES["rank_percentile"])


def test_a_row_is_written_once_for_all_scores(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(settled, "scratch", lambda _, name: f"{tmp_path}/{name}-{len(os.listdir(tmp_path))}")
    monkeypatch.setattr(ranking, "BELIEVED", -1)
    monkeypatch.setattr(ranking, "RANGE", 1 << 20)
    rows = QUERIES["rank_percentile"](spark, "/root/testdata/sf0.01").count() // 3
    assert 0 < sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 40 * rows


def test_numbers_come_back():
    r = np.random.default_rng(1)
    for x in (np.zeros(0), r.integers(-(2**62), 2**62, 500) / 1.0, np.array([np.nan, -0.0, np.inf, -np.inf, 5e-324, -1.5]), np.round(r.random(500) * 1e5, 2), np.full(9, 7.0)):
        keys = ranks.score_keys(pa.array(x, pa.float64(), from_pandas=False))
        assert (ranks.expanded_scores(ranks.squeezed_scores(keys)) == keys).all()
        assert (ranks.expanded_scores(ranks.squeezed_scores(np.unique(keys), True), True) == np.unique(keys)).all()
    whole = np.array([-(2**63), 2**63 - 1, 0, -1], dtype=np.int64)
    assert (ranks.expanded(ranks.squeezed(whole)) == whole).all()
    assert (ranks.expanded(ranks.squeezed(np.sort(whole), True), True) == np.sort(whole)).all()
    for ids in (pa.array([], pa.string()), pa.array([None, "", "é", "x" * 70, None]), pa.array(["a", "b", None, "c"]).slice(1)):
        assert ranks.expanded_ids(*ranks.squeezed_ids(ids)).to_pylist() == ids.to_pylist()


def test_an_id_that_is_several_bounds_is_dealt_out():
    assert ranks.cuts(pa.array(["a", *["b"] * 90, "c", None]), ["b", "b", "b"]) == [0, 31, 61, 91, 93]
    assert ranks.cuts(pa.array(["a", "c"]), ["b", "d"]) == [0, 1, 2, 2]
    assert ranks.cuts(pa.array([None, None], pa.string()), ["b"]) == [0, 0, 2]
