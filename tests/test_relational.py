from pyspark.sql import functions as F

from graphloom.operators import relational as R
from graphloom.operators.similarity import similar
from tests.conftest import rows


def test_not_in_with_null(frame):
    left = frame([("a",), ("b",), (None,)], "x string")
    assert rows(R.not_in(left, "x", frame([("a",)], "y string"), "y")) == [("b",)]
    assert R.not_in(left, "x", frame([("a",), (None,)], "y string"), "y").count() == 0
    assert R.not_in(left, "x", frame([], "y string"), "y").count() == 3


def test_longest_prefix(frame):
    p = frame([("a/b/c.py",), ("a/x",), ("ab/c",), (None,)], "path string")
    r = frame([("a", 1), ("a/b", 2), ("a/b", 3)], "root string, ord int")
    assert dict(rows(R.longest_prefix(p, r).where("path is not null"))) == {"a/b/c.py": "a/b", "a/x": "a", "ab/c": None}


def test_majority_is_strict(frame):
    df = frame([("g", "x"), ("g", "x"), ("g", "y"), ("h", "x"), ("h", "y"), ("n", None), ("n", None), ("n", "y")], "g string, v string")
    assert {r["g"]: r["majority"] for r in R.majority(df, ["g"], "v").collect()} == {"g": "x", "h": None, "n": None}


def test_bounds(frame):
    e = frame([(1, "a", "r", "x"), (2, "a", "r", "y"), (3, "a", "r", "z"), (4, "b", "q", "z")], "ord int, guid_source string, id_relation string, guid_target string")
    got = rows(R.bound_breaks(e, frame([("a",), ("b",)], "guid string"), "r", 1, 2))
    assert got == [("a", 3, 3, "over"), ("b", 0, None, "under")]


def test_worst_outcome(frame):
    df = frame([("a", "passed"), ("a", "error"), ("b", None), ("b", "passed")], "k string, o string")
    assert rows(R.worst_outcome(df, ["k"], "o", ["error", "failed", "passed"]).select("k", "outcome")) == [("a", "error"), ("b", "passed")]


def test_upsert_ignores_time(frame):
    old = frame([("a", "x", 1), ("b", "x", 1)], "k string, v string, t int")
    new = frame([("a", "x", 2), ("b", "y", 2), ("c", None, 2)], "k string, v string, t int")
    assert rows(R.upserted(old, new, "k", ("t",))) == [("a", "x", 1), ("b", "y", 2), ("c", None, 2)]


def test_runs(frame):
    df = frame([("u", i, f) for i, f in enumerate([True, True, False, True, True, True, None])], "u string, i int, f boolean")
    assert rows(R.runs(df, ["u"], "i", F.col("f"), 3)) == [("u", 3, 3)]


def test_claimed_twice_counts_an_owner_once(frame):
    df = frame([("a", ["x", "x"]), ("b", ["x", "y"]), ("c", None)], "o string, w array<string>")
    assert rows(R.claimed_twice(df, "o", "w")) == [("x", 2, ["a", "b"])]


def test_similar(frame):
    s = list("abcdefghij")
    df = frame([(1, s), (2, s), (3, s[:9] + ["k"]), (4, s[:8] + ["x", "y"]), (5, None), (6, []), (7, s + [None, "a"])], "id int, p array<string>")
    got = similar(df, "id", "p", 0.8)
    assert rows(got.link.select("first", "second")) == [(1, 3)]
    assert {r["id"]: (r["class"], r["n_copy"], r["n_link"]) for r in got.classes().collect()} == {1: (1, 3, 1), 2: (1, 3, 1), 7: (1, 3, 1), 3: (3, 1, 1), 4: (4, 1, 0)}
    assert {r["id"]: r["group"] for r in got.groups().collect()} == {1: 1, 2: 1, 7: 1, 3: 1, 4: 4}
    assert similar(df.limit(0), "id", "p").link.count() == 0
