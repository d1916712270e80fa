"""Identities of the operators and one test for each semantic trap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualview.functions import chemistry, scalars
from dualview.operators import conditions as C
from dualview.operators import draws, gates, hull, logistic, metrics, ranking, relations
from dualview.operators.pairs import keep_first, labelled, pair_frame
from dualview.sources import files, lookup


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(f"m{i}", float(a), float(b), float(s)) for i, (a, b, s) in enumerate(zip(rng.integers(0, 9, 400) / 100, rng.integers(0, 9, 400) / 100, rng.integers(0, 40, 400), strict=True))]
    df = spark.createDataFrame(rows, "id string, x double, y double, score double")
    return labelled(pair_frame(df, F.col("id"), F.col("x"), F.col("y"), at=0.02, score=F.col("score"))).cache()


def test_flag_parser_takes_null_for_false(spark):
    df = spark.createDataFrame([("True",), ("false",), ("",), (None,), ("yes",)], "t string")
    assert [r[0] for r in df.select(scalars.flag_of_text(F.col("t"))).collect()] == [True, False, False, False, False]


def test_null_distance_gives_null_label_and_leaves_the_denominator(spark):
    df = spark.createDataFrame([("a", None, 0.0), ("b", 0.0, 0.0)], "id string, x double, y double")
    frame = pair_frame(df, F.col("id"), F.col("x"), F.col("y"))
    assert frame.where("id = 'a'").first()["lab_a"] is None and labelled(frame).count() == 1


def test_negated_nearness_of_null_is_true(spark):
    r = spark.createDataFrame([(None,)], "x double").select(scalars.within(F.col("x"), 1.0), ~scalars.within(F.col("x"), 1.0)).first()
    assert tuple(r) == (False, True)


def test_lenient_double(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.lenient_double(F.col("t"))).collect()] == [1.5, None, None, None]


def test_bins_are_right_closed_and_empty_bins_stay(spark, pairs):
    df = spark.createDataFrame([(0.0,), (0.01,), (0.0101,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.right_closed(F.col("x"), [0, 0.01], ["a", "b", "c"])).collect()] == ["a", "b", "c", "c", None]
    out = C.binned(pairs, {"s": "dist_a"}, [-5, -4, 0.02], ["w", "x", "y", "z"]).orderBy("place").collect()
    assert [r["n"] for r in out][:2] == [0, 0] and out[0]["discordance_rate"] is None


def test_cells_sum_and_sweep_complements(pairs):
    n = pairs.count()
    cell = pairs.agg(*metrics.confusion_counts(F.col("lab_a"), F.col("lab_b"))).first()
    assert sum(cell) == n
    for r in C.threshold_sweep(pairs, (0.0, 0.02, 1.0)).collect():
        assert r["captured_n"] + r["outside_discordant_n"] == r["discordant_n"] and r["flagged_n"] + r["outside_n"] == n


def test_f1_is_symmetric(pairs):
    got = {(r["predictor"], r["truth"]): r for r in metrics.cross_evaluation(pairs, {"a": F.col("lab_a"), "b": F.col("lab_b")}).collect()}
    assert math.isclose(got["a", "b"]["f1"], got["b", "a"]["f1"]) and got["a", "a"]["delta_f1"] == 0


@pytest.mark.parametrize("ranges", [1, 5])
def test_auroc_and_average_precision(pairs, ranges):
    rows = pairs.select(F.lit("m").alias("model"), "score", (-F.col("score")).alias("minus"), "lab_a")
    up = metrics.auroc(rows, ["model"], "score", F.col("lab_a"), ranges).first()["auroc"]
    down = metrics.auroc(rows, ["model"], "minus", F.col("lab_a"), ranges).first()["auroc"]
    assert math.isclose(up + down, 1)
    data = [(r["score"], r["lab_a"]) for r in rows.collect()]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    assert math.isclose(up, sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
    ap = metrics.average_precision(rows, ["model"], "score", F.col("lab_a"), ranges).first()["average_precision"]
    want = sum(sum(y for s, y in data if s == t) / len(pos) * sum(y for s, y in data if s >= t) / sum(s >= t for s, _ in data) for t in {s for s, _ in data})
    assert math.isclose(ap, want)
    assert metrics.auroc(rows.where("lab_a"), ["model"], "score", F.col("lab_a"), ranges).first()["auroc"] is None


def test_ranges_do_not_change_ranks(pairs):
    key = lambda df: sorted((r["id"], r["rank"]) for r in df.collect())
    rows = pairs.select("lab_a", "score", "id")
    assert key(ranking.ranked(rows, ["lab_a"], ["score", "id"], 1)) == key(ranking.ranked(rows, ["lab_a"], ["score", "id"], 7))


def test_balanced_accuracy_variants(spark):
    df = spark.createDataFrame([(5, 0, 2, 0)], "tp long, fp long, fn long, tn long")
    assert math.isclose(metrics.with_metrics(df).first()["balanced_accuracy"], 5 / 14)
    assert math.isclose(metrics.with_metrics(df, absent_is_zero=False).first()["balanced_accuracy"], 5 / 7)


def test_rank_bins_overlap_by_a_row(spark):
    rows = ranking.ranked(spark.range(287).withColumn("g", F.lit(1)), ["g"], ["id"])
    got = {r["bin"]: (r["lo"], r["hi"]) for r in ranking.rank_bins(rows, ["g"]).groupBy("bin").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()}
    assert got == {"top_10": (1, 29), "10_25": (29, 72), "25_50": (72, 144), "50_100": (144, 287)}


def test_top_size_is_capped(spark):
    r = spark.range(1).select(ranking.top_size(F.lit(5), 0.1, 20), ranking.top_size(F.lit(5), 0.1, 20, cap=False)).first()
    assert tuple(r) == (5, 20)


def test_groups_leave_out_null_keys(spark):
    df = spark.createDataFrame([(None, True), ("a", False)], "k string, discordant boolean")
    assert [r["k"] for r in C.group_rates(df, ["k"]).collect()] == ["a"]
    assert relations.status_counts(df, "k").count() == 2


def test_keep_first_follows_the_source_order(spark):
    df = spark.createDataFrame([("a", 1, "train"), ("a", 0, "val")], "id string, source_order int, s string")
    assert keep_first(df, ["id"], ["source_order"]).first()["s"] == "val"


def test_containment_equals_nested_loop(spark):
    items = spark.createDataFrame([(["a"],), (["a", "b"],), (["b", "c"],), (["z"],), (list("abcdefgh"),)], "t array<string>").withColumn("i", F.monotonically_increasing_id())
    targets = spark.createDataFrame([("x", ["b", "a"]), ("y", list("abcdefghi")), ("e", [])], "id string, w array<string>")
    got = {(r["id"], tuple(r["t"])) for r in relations.contained_in(items, "t", targets, "w").collect()}
    assert got == {("x", ("a",)), ("x", ("a", "b")), ("y", ("a",)), ("y", ("a", "b")), ("y", ("b", "c")), ("y", tuple("abcdefgh"))}


def test_reference_sum_is_null_where_a_member_lacks_one(spark):
    items = spark.createDataFrame([("p", {"A": 1.0, "B": 3.0}), ("q", {"A": 1.0, "Z": 1.0})], "id string, m map<string,double>")
    refs = spark.createDataFrame([("A", -1.0), ("B", 0.0)], "e string, v double")
    assert {r["id"]: r["reference_sum"] for r in relations.reference_sums(items, "id", "m", refs, "e", "v").collect()} == {"p": -0.25, "q": None}


def test_formulas():
    assert chemistry.parse("Ca3(PO4)2") == {"Ca": 3, "P": 2, "O": 8}
    assert chemistry.parse("K[Al(SO4)2]") == {"K": 1, "Al": 1, "S": 2, "O": 8}
    assert chemistry.reduced_text("Er2(CuGe)4") == "Cu2ErGe2" and chemistry.anonymous_text("Nb4CoSi") == "ABC4"
    assert chemistry.reduced_text("no formula") == "no formula" and chemistry.reduced_text(None) is None
    assert chemistry.parse_sites(["Na @ 0 0 0", "Cl @ 0.5 0.5 0.5"]) == (["Na", "Cl"], [[0, 0, 0], [0.5, 0.5, 0.5]])
    assert chemistry.parse_sites(["Na 0 0 0"]) is None and chemistry.parse_sites(None) is None


def test_hull_by_hand():
    ends = [({"A": 1}, 0.0), ({"B": 1}, 0.0)]
    assert math.isclose(hull.lowest_energy({"A": 1, "B": 1}, [*ends, ({"A": 1, "B": 3}, -1.0), ({"A": 3, "B": 1}, -1.0)]), -1.0)
    assert math.isclose(hull.lowest_energy({"A": 3, "B": 1}, [*ends, ({"A": 1, "B": 1}, -2.0)]), -1.0)
    assert hull.lowest_energy({"A": 1, "B": 1}, ends[:1]) is None
    assert hull.lowest_energy({"A": 1}, [*ends, ({"A": 2}, -0.5)]) == -0.5


def test_logistic_is_at_a_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    w = logistic.fit(x, y)
    z = np.column_stack(((x - x.mean(0)) / x.std(0), np.ones(200)))
    loss = lambda v: 0.5 * v @ v + np.log1p(np.exp(-(2 * y - 1) * (z @ v))).sum()
    assert all(loss(w) <= loss(w + d) for d in 1e-3 * rng.normal(size=(50, 4))) and w[0] > 0.5


def test_hypergeometric_closed_form():
    assert math.isclose(draws.hypergeometric_tail(287, 31, 29, 5), 0.1887, abs_tol=1e-4)
    assert draws.hypergeometric_tail(10, 3, 4, 0) == pytest.approx(1)


def test_mechanism_classes(spark):
    df = spark.createDataFrame([(None, True, True), (True, True, True), (True, False, True), (True, False, False), (True, True, False)], "a boolean, b boolean, n boolean")
    got = [r[0] for r in df.select(relations.mechanism(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert got == ["common_hull_unavailable", "native_only_discordance", "persistent_discordance", "common_only_discordance", "concordant"]


def test_gates(spark):
    m = spark.createDataFrame([(s, x, v) for s, x, v in [("a", "p", 0.9), ("a", "q", 0.5), ("a", "r", 0.1), ("b", "p", 0.4), ("b", "q", 0.5), ("b", "r", 0.1)]], "source string, model string, f1 double")
    flips = gates.order_flips(m, "source", "model", "f1", "a", "b")
    r = gates.launch_gate(flips, F.lit(300), F.lit(0.5)).first()
    assert (r["order_a"], r["order_b"], r["top_flip"], r["verdict"]) == ("p|q|r", "q|p|r", True, "GO")
    assert gates.launch_gate(flips, F.lit(100), F.lit(0.5)).first()["verdict"] == "NO_GO"
    assert gates.panel_gate(flips, 4).first()["verdict"] == "BLOCKED"


def test_sources_and_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("ok", T.BooleanType())])
    (tmp_path / "a.csv").write_text('id,x,ok\n"a ""q""",1.5,True\nb,,\nc,bad,no\n')
    rows = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), schema).collect()]
    assert rows == [('a "q"', 1.5, True), ("b", None, None), ("c", None, False)]
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("train.csv", "id,x,ok\nt,1,True\n")
        z.writestr("val.csv", "id,x,ok\nv,2,False\n")
    z = files.read_zipped_csv(spark, str(tmp_path / "z.zip"), ["val.csv", "train.csv"], schema)
    assert {(r["id"], r["source_file"], r["source_order"]) for r in z.collect()} == {("v", "val.csv", 0), ("t", "train.csv", 1)}
    (tmp_path / "j.jsonl").write_text('{"id": "a"}\n\nnot json\n{"id": "b"}\n')
    assert files.read_json_lines(spark, str(tmp_path / "j.jsonl"), T.StructType([T.StructField("id", T.StringType())])).where("id is not null").count() == 2
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    files.append_new(one, str(tmp_path / "t"), "id")
    files.append_new(spark.createDataFrame([("b", 2), ("c", 3)], "id string, n int"), str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert files.split_rejects(one, F.col("n") > 1, str(tmp_path / "rejects")).count() == 1
    assert files.manifest(str(tmp_path), lambda n: not n.endswith(".jsonl"))[0][1] == "j.jsonl"
    assert "| a | 1 |" in files.markdown(one, "t")
    with pytest.raises(ValueError):
        files.run_or_record(lambda: (_ for _ in ()).throw(ValueError("x")), spark, str(tmp_path / "fails"), "step")
    assert spark.read.json(str(tmp_path / "fails")).first()["error"] == "ValueError"


def test_lookup_has_errors_as_data(spark):
    def fetch(ids):
        if "boom" in ids:
            raise OSError("down")
        return {i: {"id": i} for i in ids if i != "none"}

    keys = spark.createDataFrame([("a",), ("none",), ("a",), (None,)], "k string").coalesce(1)
    assert {r["k"]: r["status"] for r in lookup.lookup(keys, "k", fetch).collect()} == {"a": "found", "none": "missing_record"}
    assert lookup.fetch_batch(fetch, ["boom"], retries=2, pause=0)[0][2] == "OSError: down"


def test_stream_ingest_resumes(spark, tmp_path):
    from dualview.streaming.ingest import ingest
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType())])
    (tmp_path / "in").mkdir()
    for name, text in (("1", '{"id": "a"}\n{"id": "b"}\n'), ("2", '{"id": "b"}\n{"id": "c"}\n')):
        (tmp_path / "in" / f"{name}.json").write_text(text)
        ingest(spark, str(tmp_path / "in"), schema, "id", str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_structures_match_up_to_shift_and_scale(spark):
    from dualview.operators.structures import STRUCTURE, match_status, similar, structure_match

    salt = {"lattice": [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]], "species": ["Na", "Cl"], "coords": [[0.0, 0.0, 0.0], [0.5, 0.5, 0.5]]}
    moved = {"lattice": [[4.2, 0.0, 0.0], [0.0, 4.2, 0.0], [0.0, 0.0, 4.2]], "species": ["Cl", "Na"], "coords": [[0.75, 0.75, 0.75], [0.25, 0.25, 0.25]]}
    bent = salt | {"coords": [[0.0, 0.0, 0.0], [0.5, 0.0, 0.0]]}
    assert similar(salt, moved) and not similar(salt, bent) and not similar(salt, salt | {"species": ["K", "Cl"]})
    rows = [(True, salt, moved), (True, salt, bent), (True, salt, salt | {"coords": [[0.0, 0.0]]}), (False, salt, salt)]
    df = spark.createDataFrame(rows, "there boolean, a struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>, b struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>")
    assert df.schema["a"].dataType == STRUCTURE
    got = [r[0] for r in df.select(match_status(F.col("there"), structure_match("a", "b"))).collect()]
    assert got[:2] == ["strict_structure_match", "structure_mismatch"] and got[2].startswith("match_error_") and got[3] == "missing_record"


def test_scoring_has_a_status_for_each_row(spark):
    from dualview.operators.scoring import score

    def load():
        def scorer(rows):
            if (rows["x"] < 0).any():
                raise ValueError("negative")
            return rows["x"].to_numpy() * 2

        return scorer

    df = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 1e7)], "id string, x double").coalesce(1)
    got = {r["id"]: (r["score"], r["status"]) for r in score(df, "id", ["x"], load, "m").collect()}
    assert got == {"a": (2.0, "scored"), "b": (None, "failed_ValueError"), "c": (None, "failed_nonfinite_or_nonphysical")}


def test_one_hull_serves_many_compositions():
    import random

    r = random.Random(6)
    phases = [({e: 1}, r.random()) for e in "ABC"] + [({e: r.randint(1, 5) for e in r.sample("ABC", r.randint(2, 3))}, r.uniform(-2, 0)) for _ in range(40)]
    own = hull.Hull("ABC", phases)
    for _ in range(60):
        target = {e: r.randint(1, 6) for e in "ABC"}
        assert own.energy(target) == pytest.approx(hull.lowest_energy(target, phases), abs=1e-9)
    assert 0 < len(own.known) < 40 and own.energy({"Z": 1}) is None and hull.Hull("AB", []).energy({"A": 1}) is None


def test_system_hulls(spark):
    rows = [("s", "1", {"A": 1.0}, 0.0), ("s", "2", {"B": 2.0}, 0.0), ("s", "3", {"A": 1.0, "B": 1.0}, -1.0), ("s", "4", {"A": 2.0, "B": 2.0}, -0.4), ("s", "5", {"A": 3.0, "B": 1.0}, -0.2), ("s", "6", None, 1.0), ("s", "7", {}, 1.0), ("s", "8", {"A": 1.0}, None), ("t", "9", {"A": 1.0, "B": 1.0}, 0.0), (None, "0", {"A": 1.0}, 0.5)]
    df = spark.createDataFrame(rows, "s string, id string, m map<string,double>, e double")
    got = {r["id"]: (None if r["e_above_hull"] is None else round(r["e_above_hull"], 9), r["reason"]) for r in hull.system_hulls(df, df, "s", "m", "e").collect()}
    assert got == {"1": (0, "ok"), "2": (0, "ok"), "3": (0, "ok"), "4": (0.6, "ok"), "5": (0.3, "ok"), "6": (None, "no_composition"), "7": (None, "no_composition"), "8": (None, "no_composition"), "9": (None, "missing_end_member"), "0": (0, "ok")}


def test_first_near_equals_pairs_and_forms_few(spark):
    rng = np.random.default_rng(6)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0]
    rows = [(int(i), "xy"[j], odd[int(o)] if o < 5 else float(v)) for i, j, o, v in zip(rng.integers(0, 500, 700), rng.integers(0, 2, 700), rng.integers(0, 90, 700), rng.choice([*range(-900, 900, 10), 0.5, 50.5, 7.25], 700), strict=True)]
    df = spark.createDataFrame([*rows, (None, "x", 1.0), (3, None, 1.0)], "id int, g string, v double").repartition(3)
    want = {i: min((o for o, h, w in rows for k, g, v in rows if k == i and g == h and o > i and None not in (v, w) and abs(v - w) <= 50), default=None) for i in {r[0] for r in rows}}
    got = relations.first_near(df, ["g"], "id", "v", 50.0, "next").collect()
    assert len(got) == len(rows) + 2
    assert all(r["next"] == want.get(r["id"]) and r["status"] == ("no_match" if want.get(r["id"]) is None else "match") for r in got)
    hot = relations.first_near(spark.range(50_000).select("id", F.lit(1).alias("g"), (F.col("id") % 100).cast("double").alias("v")), ["g"], "id", "v", 50.0, "next")
    assert hot.where("next = id + 1").count() == 50_000 - 1 - 499
