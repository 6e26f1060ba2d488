from datetime import datetime

from graphloom.streaming import incremental as S
from tests.conftest import rows

T = lambda d: datetime(2024, 1, d)


def put(frame, path, data, schema):
    frame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_captures_once_across_runs(frame, spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put(frame, path, [("a",), ("a",), (None,)], "d string")
    assert rows(S.first_captures(spark, path, ["d"], out, ck)) == [("a",), (None,)]
    put(frame, path, [("a",), ("b",)], "d string")
    assert rows(S.first_captures(spark, path, ["d"], out, ck)) == [("a",), ("b",), (None,)]


def test_upserts(frame, spark, tmp_path):
    path = str(tmp_path / "in")
    put(frame, path, [("a", T(2), "new"), ("b", T(1), "x")], "k string, t timestamp, v string")
    put(frame, path, [("a", T(1), "old"), ("b", None, "y")], "k string, t timestamp, v string")
    assert rows(S.upserting(spark, path, "k", "t", ["v"]).select("k", "v")) == [("a", "new"), ("b", "x")]


def test_windows_and_caps(frame, spark, tmp_path):
    path = str(tmp_path / "in")
    put(frame, path, [(T(1), "x"), (T(1), "x"), (T(2), "x"), (None, "x")], "t timestamp, k string")
    assert [r["n"] for r in S.windowed_counts(spark, path, "t", "k").orderBy("start").collect()] == [2, 1]
    assert rows(S.capped(spark, path, "k", 3, "t")) == [("x", 3, True)]


def test_stale(frame, spark, tmp_path):
    path = str(tmp_path / "in")
    put(frame, path, [("a", "1"), ("b", "2"), ("c", None)], "k string, d string")
    now = frame([("a", "1"), ("b", "9"), ("c", "1")], "k string, d string")
    assert rows(S.stale_captures(spark, path, now, "k", "d")) == [("b", "2"), ("c", None)]


def test_upserts_go_on_after_a_restart(frame, spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "k string, t timestamp, v string"
    run = lambda: rows(S.upserting(spark, path, "k", "t", ["v"], out, ck).select("k", "v"))
    put(frame, path, [("a", T(2), "new"), ("b", T(1), "x"), (None, T(1), "n")], schema)
    assert run() == [("a", "new"), ("b", "x"), (None, "n")] == run()  # a run without new rows changes nothing
    put(frame, path, [("c", T(1), "z"), ("a", T(1), "old")], schema)
    assert run() == [("a", "new"), ("b", "x"), ("c", "z"), (None, "n")]


def test_a_batch_that_runs_twice_changes_nothing(frame, spark, tmp_path):
    from pyspark.sql import functions as F

    m = S.Merged(spark, str(tmp_path), ["k"], lambda d: d.groupBy("k").agg(F.max("v").alias("v")))
    one, two = frame([("a", 1), ("b", 5)], "k string, v int"), frame([("a", 3)], "k string, v int")
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        m.merge(batch, n)
    assert rows(m.table("k string, v int")) == [("a", 3), ("b", 5)]
    assert len(m._list(f"{tmp_path}/b1")) == 2  # the part of a and the mark that it is complete


def test_windows_go_on_after_a_restart(frame, spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put(frame, path, [(T(1), "x"), (T(2), "x")], "t timestamp, k string")
    S.windowed_counts(spark, path, "t", "k", out=out, checkpoint=ck)
    put(frame, path, [(T(2), "x"), (T(9), "y")], "t timestamp, k string")
    assert [(r["k"], r["n"]) for r in S.windowed_counts(spark, path, "t", "k", out=out, checkpoint=ck).orderBy("start").collect()] == [("x", 1), ("x", 2), ("y", 1)]
