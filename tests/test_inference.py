"""Queries on whole tables against plain computations."""

import time
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualview.operators import draws, logistic
from dualview.operators import resample as P
from dualview.plans.catalog import QUERIES
from dualview.plans.tables import documents, items


def test_logistic_uses_every_row(spark, small):
    got = {(r["model"], r["term"]): r["coefficient"] for r in logistic.coefficients(items(spark, small), "flag", ["price", "qty", "day"], "discordant").collect()}
    rows = items(spark, small).select("flag", "price", "qty", "day", "discordant").toPandas()
    assert rows["flag"].value_counts().max() > 2000
    for flag, some in rows.groupby("flag"):
        w = logistic.fit(some[["price", "qty", "day"]].to_numpy(float), some["discordant"].to_numpy(float))
        assert [got[flag, t] for t in ("price", "qty", "day", "intercept")] == pytest.approx(w, abs=1e-8)
    assert len(got) == 4 * rows["flag"].nunique()


def test_hypergeometric_uses_every_row(spark):
    sf = "/root/testdata/sf0.01"
    rows = documents(spark, sf).select("id", "discordant")
    n = rows.count()
    assert n > 300
    top = P.hash_sample(rows, "id", n // 10, 7)
    assert sorted(r["id"] for r in P.first_by_hash(rows, "id", n // 10, 7).collect()) == sorted(r["id"] for r in top.collect())
    got = QUERIES["hypergeometric_p"](spark, sf).first()
    assert (got["n"], got["marked"], got["hits"]) == (n, rows.where("discordant").count(), top.where("discordant").count())


def exact(population, marked, drawn):
    low, high = max(0, drawn - (population - marked)), min(marked, drawn)
    return {k: comb(marked, k) * comb(population - marked, drawn - k) / comb(population, drawn) for k in range(low, high + 1)}


@pytest.mark.parametrize("population,marked,drawn", [(287, 31, 29), (10, 3, 4), (5000, 700, 500), (40, 40, 7), (40, 0, 7), (9, 5, 9), (1, 1, 1), (2000, 3, 1999)])
def test_hypergeometric_window_and_tail(population, marked, drawn):
    want = exact(population, marked, drawn)
    first, p = draws.hypergeometric(population, marked, drawn)
    got = {first + i: x for i, x in enumerate(p)}
    assert all(got.get(k, 0) == pytest.approx(x, rel=1e-8, abs=1e-25) for k, x in want.items()) and set(got) <= set(want)
    for k in [*range(min(want) - 1, max(want) + 2)][:: max(1, len(want) // 40)]:
        assert draws.hypergeometric_tail(population, marked, drawn, k) == pytest.approx(sum(x for j, x in want.items() if j >= k), rel=1e-7, abs=1e-300)
    bounds = [min(k for k in want if sum(x for j, x in want.items() if j <= k) >= level) for level in (0.025, 0.975)]
    assert draws.hypergeometric_bounds(population, marked, drawn) == bounds


def test_closed_forms_of_large_tables_take_no_time():
    began = time.perf_counter()
    assert 0.4 < draws.hypergeometric_tail(10**11, 10**10, 10**10, 10**9) < 0.6
    low, high = draws.hypergeometric_bounds(10**11, 10**10, 10**10)
    assert 10**9 - 60_000 < low < 10**9 - 50_000 and 10**9 + 50_000 < high < 10**9 + 60_000
    assert 0 < draws.hypergeometric_tail(10**9, 10**6, 10**6, 1900) < 1e-100
    first, p = draws.binomial(10**11, 0.25)
    assert abs((first + np.arange(len(p))) @ p - 2.5e10) < 1
    assert time.perf_counter() - began < 5


def test_bootstrap_means_follow_the_multinomial(spark):
    cells = spark.createDataFrame([("a", -1.0, 30), ("a", 0.0, 50), ("a", 2.5, 20), ("b", 1.0, 7), ("c", None, 9), ("c", 0.0, 0), (None, 0.0, 5), (None, 1.0, 5)], "g string, v double, n long")
    rows = P.bootstrap_means(cells, ["g"], "v", "n", 2000, 5).toPandas()
    assert {g: len(x) for g, x in rows.groupby("g", dropna=False)} == {"a": 2000, "b": 2000, None: 2000} or rows["g"].isna().sum() == 2000
    assert (rows[rows["g"] == "b"]["mean"] == 1).all()
    own = rows[rows["g"] == "a"]["mean"]
    data = np.repeat([-1.0, 0.0, 2.5], [30, 50, 20])
    assert abs(own.mean() - data.mean()) < 4 * data.std() / 10 / 2000**0.5 and own.std() == pytest.approx(data.std() / 10, rel=0.06)
    brute = np.random.default_rng(1).choice(data, (20_000, 100)).mean(axis=1)
    assert np.abs(np.quantile(own, [0.1, 0.5, 0.9]) - np.quantile(brute, [0.1, 0.5, 0.9])).max() < 0.02
    again = P.bootstrap_means(cells.repartition(5), ["g"], "v", "n", 2000, 5).toPandas()
    assert sorted(map(str, rows.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    with pytest.raises(Exception, match="more than 1000 values"):
        P.bootstrap_means(spark.range(1500).select(F.lit("a").alias("g"), F.col("id").alias("v"), F.lit(1).alias("n")), ["g"], "v", "n", 3, 5).collect()


def test_permuted_hits_follow_shuffles(spark):
    counts = spark.createDataFrame([("a", 60, 25, 10), ("b", 5, 0, 3), ("c", 5, 5, 3)], "g string, n long, marked long, drawn long")
    hits = P.permuted_hits(counts, ["g"], 2000, 9).toPandas()
    assert set(hits[hits["g"] == "b"]["hits"]) == {0} and set(hits[hits["g"] == "c"]["hits"]) == {3}
    r = np.random.default_rng(3)
    labels = np.arange(60) < 25
    brute = np.bincount([r.permutation(labels)[:10].sum() for _ in range(20_000)], minlength=11) / 20_000
    own = np.bincount(hits[hits["g"] == "a"]["hits"], minlength=11) / 2000
    assert np.abs(own - brute).max() < 0.04


def test_shuffled_places_are_permutations():
    keys = logistic.replicate_keys(1, 50)
    for n in (1, 2, 3, 7, 64, 1000):
        out = logistic.shuffled(np.arange(n), n, keys)
        assert out.shape == (n, 50) and all(sorted(out[:, r]) == list(range(n)) for r in range(50))
    seen = logistic.shuffled(np.arange(5), 1000, logistic.replicate_keys(2, 4000))
    assert abs(seen.mean() - 499.5) < 10 and abs(np.corrcoef(seen[:-1].ravel(), seen[1:].ravel())[0, 1]) < 0.03


def test_rank_permutations_equal_refits(spark):
    r = np.random.default_rng(7)
    rows = [(g, i, float(r.normal()), float(r.exponential()), bool(r.random() < 0.3 + 0.3 * (i > 60))) for g in "ab" for i in range(120)] + [("c", 1, 1.0, 1.0, True), ("c", 2, 2.0, 1.0, True), ("a", 999, None, 1.0, True), (None, 5, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "g string, i long, u double, v double, y boolean").repartition(5)
    got = logistic.rank_permutations(df, "g", ["u", "v"], "y", ["i"], 12, 3).toPandas().set_index(["model", "rep"])["coefficient"]
    assert len(got) == 26
    keys = logistic.replicate_keys(3, 12)
    for g in "ab":
        own = [x for x in rows if x[0] == g and x[2] is not None]
        n, y = len(own), np.array([x[4] for x in own], dtype=float)
        places = logistic.shuffled(np.arange(n), n, keys)
        for rep in range(-1, 12):
            rank = (np.arange(n) if rep < 0 else places[:, rep]) + 1
            w = logistic.fit(np.column_stack(([x[2] for x in own], [x[3] for x in own], rank / n)), y)
            assert got[g, rep] == pytest.approx(w[2], abs=1e-8)
    p = {x["model"]: x["p_value"] for x in logistic.permuted_p(spark.createDataFrame([("m", -1, -0.5), ("m", 0, 0.5), ("m", 1, 0.1), ("m", 2, -0.7)], "model string, rep int, coefficient double")).collect()}
    assert p == {"m": 0.75}


def test_refits_are_dealt_by_their_work_and_places_stay_the_same():
    # 600,000 rows may be one small file, yet are 1.2e9 cells
    assert logistic.task_count(600_000, 2000) > 100 and logistic.task_count(0, 2000) == 1
    assert logistic.CELLS * 8 <= 1 << 18
    # Feistel rounds one place at a time
    n, keys = 300, logistic.replicate_keys(5, 3)
    for i in range(n):
        for r, found in enumerate(logistic.shuffled(np.array([i]), n, keys)[0]):
            x = i
            while True:
                left, right = x >> 5, x & 31
                for k in keys[r].tolist():
                    mixed = (right + k) * 0x9E3779B97F4A7C15 % (1 << 64)
                    mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
                    left, right = right, left ^ (mixed >> 32 & 31)
                x = left << 5 | right
                if x < n:
                    break
            assert x == found
