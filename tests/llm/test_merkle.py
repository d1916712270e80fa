import random
import zlib

import pytest
from pyspark.sql import functions as F

from dualview.llm import merkle, registry
from dualview.llm.merkle import digest
from oracle import assert_same, connect

from .conftest import ODD, rows_of


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(tree, i, fanout):
    out = []
    for nodes in tree[:-1]:
        a = i // fanout * fanout
        run = nodes[a : a + fanout]
        out.append("".join(run[: i - a]) + "*" + "".join(run[i - a + 1 :]))
        i //= fanout
    return out


def plain(rows, fanout):
    """(key, leaf, pos, proof, subroot, root) of (key, group, leaf), built level by level over lists."""
    groups = {}
    for key, group, node in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, node))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([n for *_, n in sorted(groups[g])], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    return sorted(
        ((k if some else None, n, i, steps(trees[g], i, fanout) + steps(top, x, fanout), trees[g][-1][0], top[-1][0]) for x, g in enumerate(names) for i, (some, k, n) in enumerate(sorted(groups[g]))), key=str
    )


def got(df):
    return sorted(((r["doc_id"], r["leaf"], r["pos"], r["proof"], r["subroot"], r["root"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    docs = rows_of([(r.choice([None, i, i // 3]), t) for i, t in enumerate(ODD * 4)])
    langs = [None, "", "en", "de", "é", "z", "solo"]
    docs = [(d[0], d[1], r.choice(langs[:6]) if r.random() < 0.7 else "en", *d[3:]) for d in docs]
    return [*docs, (5, "alone", "solo", None, None, *[None] * 13), *[(9, "same", "en", "s", 4, *[None] * 13)] * 30]


def test_equals_plain_tree(spark, rows, empty, monkeypatch):
    df = spark.createDataFrame(rows, empty.schema).repartition(3)
    flat = [(d[0], d[2], leaf([d[0], d[3], d[2], d[4], d[1]])) for d in rows]
    for fanout, bucket, size in ((2, 1024, 1 << 17), (2, 8, 17), (3, 9, 5)):
        monkeypatch.setattr(merkle, "BUCKET", bucket)
        monkeypatch.setattr(merkle, "RANGE", size)
        found = merkle.manifest(df, "doc_id", "lang", registry.LEAF, fanout)
        assert got(found) == plain(flat, fanout)
    held = merkle.verify(found, F.col("leaf")).withColumn("bad", merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root"))
    assert {(r["verified"], r["bad"]) for r in held.collect()} == {(True, False)}
    assert not any(r["verified"] for r in merkle.verify(found, F.lit(None).cast("string")).collect())


def test_empty_table_lone_row_and_fanout(spark, empty):
    assert merkle.manifest(empty, "doc_id", "lang", registry.LEAF).count() == 0
    only = spark.createDataFrame(rows_of([(None, None)]), empty.schema)
    row = merkle.manifest(only, "doc_id", "lang", registry.LEAF).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == []
    with pytest.raises(ValueError):
        merkle.manifest(empty, "doc_id", "lang", registry.LEAF, fanout=1)


def test_leaves_tell_nulls_and_borders_apart(spark):
    values = [(None, ""), ("", None), ("-", ""), ("1:a", ""), ("1:", "a"), ("a", "b"), ("ab", ""), ("é", "")]
    df = spark.createDataFrame(values, "a string, b string")
    assert df.select(merkle.leaf([F.col("a"), F.col("b")]).alias("n")).distinct().count() == len(values)


def test_query_equals_sql_and_finds_what_was_tampered_with(spark, rows, empty, tmp_path, small):
    spark.createDataFrame(rows, empty.schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = connect(small)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.op11_merkle(spark, str(tmp_path)).cache()
    assert_same(df, con, registry.ORACLES["op11_merkle"])
    sizes = {(d[0], leaf([d[0], d[3], d[2], d[4], d[1]])): d[4] for d in rows}
    for r in df.collect():
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and sizes[r["doc_id"], r["leaf"]] is not None
        assert r["verified"] == (not hit)
