from pyspark.sql import functions as F

from graphloom.operators import assurance as A
from graphloom.operators import measure as M
from graphloom.operators import rules as U
from graphloom.operators.facts import FactDatabase
from tests.conftest import rows

ATTR = "guid string, id_self string, status string, has_criteria boolean, verification string, claim string, demands_verdict boolean"
EDGE = "ord bigint, guid_source string, id_relation string, guid_target string, id_target string"


def project(frame, attrs, edges):
    return A.requirements(frame(attrs, ATTR), frame([(i, *e, None) for i, e in enumerate(edges)], EDGE))


def test_gaps_by_status_and_world(frame):
    p = project(frame, [("a", "req_a", "accepted", False, None, None, False), ("p", "req_p", "proposed", False, "test", None, False), ("d", "req_d", "deprecated", False, "test", None, False), ("n", None, None, True, None, None, False)], [])
    open_ = {(r["guid"], r["rule"]): r["severity"] for r in A.gaps(p).collect()}
    closed = {(r["guid"], r["rule"]): r["severity"] for r in A.gaps(p, True).collect()}
    assert open_[("a", "no_criteria")] == "critical" and open_[("a", "not_implemented")] == "advisory" and closed[("a", "not_implemented")] == "critical"
    assert open_[("p", "not_verified")] == "advisory" and ("p", "no_criteria") not in open_
    assert not any(g == "d" for g, _ in open_) and open_.keys() == closed.keys()


def test_shared_verdict(frame):
    attrs = [("a", "req_a", "accepted", True, "test", "evidential", False), ("b", "req_b", "accepted", True, "test", "design", False), ("c", "req_c", "accepted", True, "test", None, False)]
    p = project(frame, attrs, [("t1", "r_verifies", "a"), ("t1", "r_verifies", "b"), ("t2", "r_verifies", "b"), ("t3", "r_verifies", "c"), ("t3", "r_verifies", "elsewhere")])
    got = {r["guid"]: r["severity"] for r in A.gaps(p).where("rule = 'shared_verdict'").collect()}
    assert got == {"a": "critical"}


def test_accept_gate_and_leaves(frame):
    p = project(frame, [("a", "req_a", "proposed", True, "test", None, False), ("k", "req_k", "proposed", True, "test", None, False)], [("a", "r_derives_from", "n"), ("k", "r_derives_from", "a"), ("t", "r_verifies", "a")])
    assert dict(rows(A.accept_gate(p))) == {"a": True, "k": False}


def test_drift_and_evidence(frame):
    s = frame([("d1", "x", "1"), ("d1", "y", "2"), ("d2", "x", "0"), ("d3", "gone", "1")], "record string, subject string, digest string")
    assert dict(rows(A.drifted(s, frame([("x", "1"), ("y", "2")], "subject string, digest string")))) == {"d1": "holds", "d2": "stale", "d3": "stale"}
    req = frame([("test", None, "r1", "d"), ("test", "c", "r1", "d"), ("test", "c", "r2", "d"), ("test", "c", "r3", "d")], "method string, case string, requirement string, digest string")
    evd = frame([("test", None, "r1", "passed", "d"), ("test", "c", "r1", "passed", "old"), ("test", "c", "r2", "failed", "d")], "method string, case string, requirement string, outcome string, digest string")
    got = {(r["case"], r["requirement"]): r["state"] for r in A.evidence_state(req, evd).collect()}
    assert got == {(None, "r1"): "held", ("c", "r1"): "stale", ("c", "r2"): "failed", ("c", "r3"): "absent"}


def test_rates(frame):
    c = frame([("w", "met", ["met", "met", "unmet"]), ("w", "met", ["unmet", "unmet", "met"]), ("m", "unmet", ["unmet"] * 3), (None, "met", ["met"] * 3)], "origin string, verdict string, samples array<string>")
    got = {r["origin"]: r for r in M.rates(c).collect()}
    assert got["w"]["false_positive"] == 0.5 and got["w"]["false_negative"] is None and got["w"]["unanimous"] == 0.0
    assert got["m"]["false_negative"] == 0.0 and got["all"]["cases"] == 4 and None in got


def test_screen_and_odd(frame):
    t = frame([("aa",), ("b",), (None,)], "t string")
    got = {r["t"]: (r["asked"], r["verdict"]) for r in M.screened(t, lambda x: F.length(x) > 1, lambda x, i: F.lit(i == 1), "t", 3).collect()}
    assert got == {"aa": (False, "met"), "b": (True, "unmet"), None: (True, "unmet")}
    try:
        M.odd(4)
        raise AssertionError
    except ValueError:
        pass


def test_stale_and_sweep(frame):
    m = frame([("e1", "m", "1"), ("e2", "m", "0"), ("e3", "x", "1")], "id_eval string, model string, digest string")
    c = frame([("e1", "1", 3), ("e2", "1", 3), ("e3", "1", 3), ("e4", "1", 0)], "id_eval string, digest string, n_case int")
    assert rows(M.stale(m, c, "m")) == [("e2",), ("e3",)]
    f = frame([("e", "i", "breaks rule_a and rule_b"), ("e", "j", "breaks rule_b"), ("e", "j", "nothing")], "id_eval string, item string, message string")
    got = [(r["rule"], r["n"], r["n_item"]) for r in M.sweep(f, ["rule_a"]).collect()]
    assert got == [("rule_b", 2, 2), (None, 1, 1)]


def test_rules_report(frame):
    item = frame([("req_" + "0" * 32, "req_a", "req", "accepted", "req/a", 1), ("req_" + "1" * 32, "BAD", "BAD", "proposed", "req/b", 2), ("req_" + "2" * 32, "req_c", "req", "accepted", "req/c", 3)], "guid string, id_self string, prefix string, status string, location string, ord bigint")
    edge = frame([(1, "req_" + "0" * 32, "r", "gone", "x"), (2, "req_" + "0" * 32, "r", "req_" + "2" * 32, "old")], EDGE)
    d = FactDatabase(item, edge, frame([], "guid_holder string, guid_held string"))
    ctx = U.Context(d, item, frame([], "guid string, id_self string"), (U.Relation("r", domain=("req",), range=("need",), most=1),), {"req": ()}, closed_world=True)
    found, errors = U.run(ctx)
    summary = U.report(found, list(U.RULES), errors)
    got = {r["id_check"]: (r["n_critical"], r["n_advisory"], r["status"]) for r in summary.collect()}
    assert not errors and got["reference"] == (1, 1, "nonconformity") and got["identifier"][0] == 2 and got["rights"][0] == 1
    assert got["trace"] == (0, 0, "ok") and got["relation"][2] == "nonconformity" and U.refused(summary) and not U.refused(summary, True)
    assert "identity" not in {r[0] for r in U.run(ctx, only=("rights",))[0].select("id_check").collect()}


def test_a_raising_rule_is_an_error(frame, monkeypatch):
    def bad(c):
        raise RuntimeError("no")

    monkeypatch.setattr(U, "RULES", {"bad": bad})
    item = frame([], "guid string, id_self string, prefix string, status string, location string, ord bigint")
    ctx = U.Context(FactDatabase(item, frame([], EDGE), frame([], "guid_holder string, guid_held string")), item, item)
    found, errors = U.run(ctx)
    assert found.count() == 0 and "bad" in errors and U.report(found, ["bad"], errors).first()["status"] == "error"


def test_a_rule_that_fails_when_rows_are_read_is_its_own_error(frame, spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.operators import rules as U

    one = spark.createDataFrame([(1,)], "x int")
    good = lambda c: U.finding(one, "good", F.lit("g"), F.lit("p"), U.ADVISORY, F.lit("m"))
    bad = lambda c: U.finding(one, "bad", F.lit("g"), F.lit("p"), U.ADVISORY, F.raise_error(F.lit("no")).cast("string"))
    monkeypatch.setattr(U, "RULES", {"bad": bad, "good": good})
    context = type("C", (), {"spark": spark})()
    found, errors = U.run(context)
    assert [r["id_check"] for r in found.collect()] == ["good"] and list(errors) == ["bad"]
    assert {r["id_check"]: r["status"] for r in U.report(found, ["bad", "good"], errors).collect()} == {"bad": "error", "good": "advisory"}
