"""Ranks found by brackets, and running sums streamed over ranges, against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from dualview.operators import ranking, selection


def rows(n=900, seed=2):
    r = random.Random(seed)
    out = [("a", r.choice([None, 1.0, 1.0, 1.0, r.random(), float("inf"), -3.5]), f"{i:05d}") for i in range(n)]
    out += [("b", 7.0, "same")] * 400 + [(None, float(i), "x") for i in range(50)] + [("c", None, None)]
    r.shuffle(out)
    return out


def order(x):
    return (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "")


def at(data, group, rank):
    own = sorted((x for x in data if x[0] == group), key=order)
    return own[rank - 1][1:] if 1 <= rank <= len(own) else None


RANKS = {"first": lambda n: F.lit(1), "tenth": lambda n: F.ceil(n * 0.1), "half": lambda n: F.floor(n * 0.5), "last": lambda n: n, "none": lambda n: F.lit(0), "beyond": lambda n: n + 1}


def wanted(n):
    return {"first": 1, "tenth": -(-n // 10), "half": n // 2, "last": n, "none": 0, "beyond": n + 1}


@pytest.mark.parametrize("sample,gather,groups", [(8192, 1 << 16, 4096), (400, 100, 4096), (8192, 1 << 16, 1)])
def test_rank_keys(spark, monkeypatch, sample, gather, groups):
    for name, value in (("SAMPLE", sample), ("GATHER", gather), ("MOST_GROUPS", groups)):
        monkeypatch.setattr(selection, name, value)
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, id string").repartition(5)
    found = {r["g"]: r for r in selection.rank_keys(df, ["g"], ["v", "id"], lambda n: {k: f(n) for k, f in RANKS.items()}).collect()}
    assert set(found) == {"a", "b", "c", None}
    for g, r in found.items():
        n = sum(x[0] == g for x in data)
        assert r["n"] == n
        for name, rank in wanted(n).items():
            got = None if r[name] is None else tuple(r[name])
            assert got == at(data, g, rank), (g, name)


@pytest.mark.parametrize("search", [True, False])
def test_within_equals_ranks(spark, monkeypatch, search):
    monkeypatch.setattr(selection, "SAMPLE", 400)
    monkeypatch.setattr(selection, "GATHER", 100)
    data = [x for x in rows() if x[0] != "b"]
    df = spark.createDataFrame(data, "g string, v double, id string").repartition(3)
    top = lambda n: {"top": ranking.top_size(n, 0.1, 20), "all": n + 5}
    got = {(r["g"], r["id"]): (r["n"], r["top"], r["all"]) for r in selection.within(df, ["g"], ["v", "id"], top, search).collect() if r["g"] == "a"}
    own = sorted((x for x in data if x[0] == "a"), key=order)
    assert got == {("a", x[2]): (900, i < 90, True) for i, x in enumerate(own)}
    free = selection.within(df.where("g = 'a'"), [], ["v", "id"], top, search)
    assert free.where("top").count() == 90 and free.where("n = 900 and all").count() == 900
    assert selection.within(df.limit(0), ["g"], ["v", "id"], top, search).count() == 0


def test_quantiles_by_rank_equal_percentiles(spark, monkeypatch):
    monkeypatch.setattr(selection, "SAMPLE", 400)
    monkeypatch.setattr(selection, "GATHER", 100)
    r = random.Random(3)
    data = [(g, r.choice([None, 5.0, r.gauss(0, 1)])) for g in ("a", "b", "c") for _ in range(r.randint(300, 900))] + [("one", 2.5), ("two", 1.0), ("two", 2.0), ("nil", None)] + [("hot", 1.0)] * 500
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    levels = {"low": 0.025, "middle": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}
    got, want = ({x["g"]: x for x in selection.quantiles(df, ["g"], "v", levels, way).collect()} for way in (True, False))
    assert set(got) == set(want) == {"a", "b", "c", "one", "two", "hot"}
    for g in want:
        assert [got[g][k] for k in levels] == pytest.approx([want[g][k] for k in levels], abs=1e-12), g


def test_atlas_of_a_large_table_equals_that_of_a_small_one(spark, small, monkeypatch):
    from dualview.operators import conditions
    from dualview.plans.tables import items

    pairs = items(spark, small)
    cases = {"all": F.lit(True), "near": F.col("gap") <= 0.02, "none": F.lit(False), "one": F.col("discordant")}
    want = conditions.selection_atlas(pairs, cases).orderBy("place").collect()
    monkeypatch.setattr(conditions, "RANGE", 0)
    got = conditions.selection_atlas(pairs, cases).orderBy("place").collect()
    assert [x.asDict() for x in got] == [x.asDict() for x in want]


@pytest.mark.parametrize("ranges", [1, 2, 9, 40])
def test_running_sums_over_ranges(spark, ranges):
    r = random.Random(5)
    data = [(r.choice(["a", "a", "a", "b", None]), i % 50, i, r.choice([None, 1.5, -2.0, 0.25]), r.randint(0, 3)) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, k long, id long, x double, m long").repartition(7)
    out = ranking.running_sums(df, ["g"], ["k", "id"], {"sx": F.col("x"), "sm": F.col("m"), "rank": F.lit(1)}, ranges, "n").collect()
    assert len(out) == len(data)
    want = {}
    for g in {x[0] for x in data}:
        sx, sm = 0.0, 0
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2]))
        for i, x in enumerate(own):
            sx, sm = sx + (x[3] or 0), sm + x[4]
            want[x[2]] = (sx, sm, i + 1, len(own))
    for row in out:
        sx, sm, rank, n = want[row["id"]]
        assert (row["sm"], row["rank"], row["n"]) == (sm, rank, n) and (row["sx"] or 0) == pytest.approx(sx)
    free = ranking.running_sums(df, [], ["id"], {"s": F.lit(1)}, ranges).collect()
    assert sorted((x["id"], x["s"]) for x in free) == [(i, i + 1) for i in range(2000)]


def test_ranges_follow_rows_not_the_plan_of_a_join(spark):
    a = spark.range(300).withColumn("s", F.repeat(F.lit("x"), 50)).repartition(2)
    joined = a.join(a.withColumnRenamed("s", "t"), "id").join(a.withColumnRenamed("s", "u"), "id")
    assert ranking.estimated_bytes(joined) < ranking.RANGE


@pytest.mark.parametrize("crowded,deepest", [(64, 6), (2, 6), (1, 2)])
def test_long_token_sets_are_contained_by_rarity(spark, monkeypatch, crowded, deepest):
    from dualview.operators import relations

    monkeypatch.setattr(relations, "CROWDED", crowded)
    monkeypatch.setattr(relations, "DEEPEST", deepest)
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["a-b", 'q"', "é", ""]
    pick = lambda n: [words[min(len(words) - 1, int(r.expovariate(0.12)))] for _ in range(n)]
    items = [(i, pick(r.randint(0, 6))) for i in range(250)] + [(900, None), (901, ["nowhere"]), (902, ["w0"]), (903, ["w0", "w0"])]
    targets = [(i, pick(r.randint(0, 25))) for i in range(120)] + [(500, None), (501, [f"w{i}" for i in range(40)]), (502, [f"w{i}" for i in range(40)])]
    got = sorted((x["t"], x["i"]) for x in relations.contained_in(spark.createDataFrame(items, "i long, s array<string>"), "s", spark.createDataFrame(targets, "t long, w array<string>"), "w").collect())
    want = sorted((t, i) for t, w in targets if w is not None for i, s in items if s and set(s) <= set(w))
    assert len(want) > 500 and got == want


@pytest.mark.parametrize("block", [1 << 17, 13])
def test_tau_b_equals_pairs(spark, block):
    from dualview.operators import kendall

    r = random.Random(4)
    data = [(g, r.choice([None, float("nan"), *([float(r.randint(0, 9))] * 20)]), float(r.randint(0, 30)) if g != "flat" else 1.0) for g in ("a", "b", None, "flat") for _ in range(160)] + [("a", 3.0, 3.0)] * 90
    got = {x["g"]: (x["n"], x["tau"]) for x in kendall.tau_b(spark.createDataFrame(data, "g string, a double, b double").repartition(3), ["g"], "a", "b", block).collect()}
    assert set(got) == {"a", "b", None, "flat"}
    for g in got:
        own = [(a, b) for k, a, b in data if k == g and a is not None and a == a]
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(x[0] - y[0]), sign(x[1] - y[1])) for i, x in enumerate(own) for y in own[:i]]
        bottom = (sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs)) ** 0.5
        assert got[g][0] == len(own)
        assert (got[g][1] is None) if not bottom else got[g][1] == pytest.approx(sum(x * y for x, y in pairs) / bottom, abs=1e-12)
    free = kendall.tau_b(spark.createDataFrame([(float(i), float(-i)) for i in range(50)], "a double, b double"), [], "a", "b", block).first()
    assert (free["n"], free["tau"]) == (50, -1.0)


@pytest.mark.parametrize("name", ["release_grid", "topk_prefix_metrics", "topk_quadrants", "conformal_evalue_release", "rank_bins_overlap", "filtered_benchmark", "median_threshold_f1", "rank_percentile"])
def test_ways_of_large_tables_equal_sql(spark, small, monkeypatch, name):
    from dualview.operators import release
    from dualview.plans.catalog import ORACLES, QUERIES
    from oracle import assert_same, connect

    for module, attribute in ((ranking, "SMALL"), (ranking, "BELIEVED"), (release, "SMALL")):
        monkeypatch.setattr(module, attribute, -1)
    monkeypatch.setattr(selection, "GATHER", 1000)
    assert_same(QUERIES[name](spark, small), connect(small), ORACLES[name])


def test_size_is_that_of_rows_not_of_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ranking, "BELIEVED", 1000, raising=False)
    spark.range(50_000).select(F.lit(1).alias("x")).write.parquet(str(tmp_path / "t"))
    many = spark.read.parquet(str(tmp_path / "t")).select("x", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("y"))
    assert ranking.estimated_bytes(many) == 50_000 * 200 * 16


def test_rank_search_reads_a_table_once_for_each_column(spark):
    read, n = spark.sparkContext.accumulator(0), 3000

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(n).selectExpr("id % 3 AS g", "cast(id % 700 AS double) AS v", "cast(id AS string) AS id").mapInArrow(counted, "g long, v double, id string")
    found = selection.rank_keys(df, ["g"], ["v", "id"], lambda k: {f"r{i}": F.ceil(k * i / 7) for i in range(1, 7)}).collect()
    assert {r["n"] for r in found} == {1000} and all(r[f"r{i}"] for r in found for i in range(1, 7))
    assert read.value == 2 * n


def test_rows_are_held_against_keys_by_broadcast(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "id % 700 AS v", "id")
    plan = selection.within(df, ["g"], ["v", "id"], lambda n: {"top": F.ceil(n / 10)}, True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
