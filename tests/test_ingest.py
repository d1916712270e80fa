"""A run of lookups that breaks off and is resumed."""

import json

import pytest
from pyspark.sql import types as T

from dualview.streaming import ingest

SCHEMA = T.StructType([T.StructField("id", T.StringType())])


def service():
    def fetch(ids):  # inside, so that it travels to the workers by value
        if "9" in ids:
            raise TimeoutError("busy")
        return {i: {"v": int(i)} for i in ids if int(i) % 3}

    return fetch


def keys(folder):
    folder.mkdir()
    for n, ids in enumerate((["1", "2", "3", None], ["3", "4", "4"], ["5", "6", "1"], ["9"])):
        (folder / f"{n}.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))
    return str(folder)


def run(spark, path, **more):
    df = ingest.ingest_lookups(spark, str(path / "keys"), SCHEMA, "id", service(), str(path / "out"), str(path / "mark"), retries=1, pause=0, **more)
    return sorted((r["id"], r["record"], r["error"], r["status"]) for r in df.collect())


WANT = [("1", '{"v": 1}', None, "found"), ("2", '{"v": 2}', None, "found"), ("3", None, None, "missing_record"), ("4", '{"v": 4}', None, "found"), ("5", '{"v": 5}', None, "found"), ("6", None, None, "missing_record"), ("9", None, "TimeoutError: busy", "error")]


def test_whole_run(spark, tmp_path):
    keys(tmp_path / "keys")
    assert run(spark, tmp_path) == WANT
    assert run(spark, tmp_path) == WANT


@pytest.mark.parametrize("late", [False, True])
def test_broken_and_resumed_run_gives_the_same_table(spark, tmp_path, monkeypatch, late):
    keys(tmp_path / "keys")
    calls, real = [], ingest.lookup

    def broken(*args):
        calls.append(1)
        if len(calls) == 3:
            if late:  # the folder is written, the batch isn't committed
                real(*args).write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=2"))
            raise RuntimeError("the driver was lost")
        return real(*args)

    monkeypatch.setattr(ingest, "lookup", broken)
    with pytest.raises(Exception, match="driver was lost"):
        run(spark, tmp_path)
    monkeypatch.setattr(ingest, "lookup", real)
    assert run(spark, tmp_path) == WANT
