import pytest
from pyspark.sql import functions as F

from graphloom.operators import dataflow as W
from graphloom.operators import edits as E
from tests.conftest import rows

ITEM = "guid string, id_self string, prefix string, status string, location string, ord bigint"
EDGE = "ord bigint, guid_source string, id_relation string, guid_target string, id_target string"


@pytest.fixture()
def facts(frame):
    item = frame([("g_a", "t_a", "t", None, "f", 1), ("g_b", "u_a.b", "u", None, "f", 2), ("g_n", None, "", None, "h", 3)], ITEM)
    return E.Facts(item, frame([(1, "g_a", "r", "g_b", "u_a.b"), (2, "g_b", None, "gone", None)], EDGE), frame([("g_a", "g_b")], "guid_holder string, guid_held string"))


def test_edits(facts):
    more = E.add_item(facts, "g_c", "t_c", holder="t_a")
    assert more.item.count() == 4 and more.containment.count() == 2 and facts.item.count() == 3
    linked = E.link(more, "t_c", "r", "g_a", ("r",))
    assert rows(linked.edge.where("guid_source = 'g_c'")) == [(3, "g_c", "r", "g_a", "t_a")]
    assert E.unlink(linked, "t_c", "r", "t_a").edge.count() == 2
    assert E.set_field(facts, "t_a", "status", "accepted").item.where("status = 'accepted'").count() == 1
    for bad in (lambda: E.add_item(facts, "g_a", "x_x"), lambda: E.link(facts, "t_a", "q", "g_b", ("r",)), lambda: E.link(facts, "t_a", "r", "g_b"), lambda: E.unlink(facts, "t_a", "q", "g_b"), lambda: facts.resolve("zz"), lambda: E.set_field(facts, "t_a", "guid", "x")):
        with pytest.raises(E.Refused):
            bad()


def test_rename_cascades_and_repoints(facts):
    f = E.rename(facts, "t_a", "t_z")
    assert {r["id_self"] for r in f.item.collect()} == {"t_z", "u_z.b", None}
    assert f.edge.where("ord = 1").first()["id_target"] == "u_z.b" and f.edge.count() == 2
    with pytest.raises(E.Refused):
        E.rename(E.add_item(facts, "g_q", "t_q"), "t_a", "t_q")


def test_gather_is_idempotent(facts, frame):
    m = frame([("g_b",), ("g_n",), ("g_n",)], "guid string")
    once = E.gathered(facts, "t_a", m)
    assert once.containment.count() == 2 and E.gathered(once, "t_a", m).containment.count() == 2


def test_refresh(facts, frame):
    fresh = E.Facts(frame([("g_x", "t_x", "t", None, "f", 1)], ITEM), frame([], EDGE), frame([], "guid_holder string, guid_held string"))
    f = E.refreshed(facts, "f", fresh)
    assert {r["guid"] for r in f.item.collect()} == {"g_x", "g_n"} and f.edge.count() == 0 and f.containment.count() == 0


def node(made="out", inputs=None, judges=None):
    return W.Node(lambda x: {made: next(iter(x.values()))}, inputs if inputs is not None else {"in": False}, judges or {})


def test_order():
    f = W.Flow({n: node() for n in "dcba"}, [W.Link("b", "out", "a", "in"), W.Link("c", "out", "d", "in")])
    assert f.order() == ["b", "c", "a", "d"]
    with pytest.raises(W.Stop):
        W.Flow({n: node() for n in "ab"}, [W.Link("b", "out", "a", "in"), W.Link("a", "out", "b", "in")]).order()


def test_guards():
    assert W.fires(None, []) and W.fires("met", []) and W.fires("met", ["met"]) and not W.fires("met", ["met", "unmet"])
    assert not W.fires("unmet", []) and W.fires("unmet", ["met", "unmet"])


def test_skip_and_bindings(frame):
    one = frame([(1,)], "x int")
    f = W.Flow({"a": node(judges={"out": lambda d: ["unmet"]}), "b": node(), "c": node()}, [W.Link("a", "out", "b", "in", "met"), W.Link("a", "out", "c", "in", "unmet")])
    state = W.run(f, {("a", "in"): one})
    assert [(n, s) for n, _, s in state.trace] == [("a", "ran"), ("b", "skipped"), ("c", "ran")] and state.status == "completed"
    for bad in ({}, {("b", "in"): one}):
        with pytest.raises(W.Stop):
            W.run(f, bad)


def test_budget_and_park(frame):
    grow = W.Node(lambda x: {"out": (x.get("again") if x.get("again") is not None else x["in"]).withColumn("x", F.col("x") + 1)}, {"in": False, "again": True}, {"out": lambda d: ["met" if d.first()[0] >= 3 else "unmet"]})
    f = W.Flow({"g": grow, "e": node()}, [W.Link("g", "out", "e", "in", "met"), W.Link("g", "out", "g", "again", "unmet", back=True)])
    one = frame([(0,)], "x int")
    done = W.run(f, {("g", "in"): one}, budget=5)
    assert done.passes == {"g": 3, "e": 1} and done.bound[("e", "out")].first()[0] == 3 and done.status == "completed"
    short = W.run(f, {("g", "in"): one}, budget=2)
    assert short.status == "exhausted" and short.passes == {"g": 2}
    parked = W.run(f, {("g", "in"): one}, budget=5, pause_before="e")
    assert parked.status == "parked" and W.run(f, {}, 5, "e", parked).status == "completed"


def test_parked_tables(frame, spark, tmp_path):
    f = W.Flow({"a": node(), "b": node()}, [W.Link("a", "out", "b", "in")])
    p = W.run(f, {("a", "in"): frame([(7,)], "x int")}, pause_before="b")
    W.parked(spark, p, str(tmp_path))
    again = W.unparked(spark, str(tmp_path))
    assert again.queue == ["b"] and again.passes == {"a": 1} and again.trace == [("a", 1, "ran")] and again.status == "parked"
    assert W.run(f, {}, 1, "b", again).bound[("b", "out")].first()[0] == 7


def test_what_fails_when_rows_are_read_stops_by_name(frame):
    bad = W.Node(lambda x: {"out": x["in"].select(F.raise_error(F.lit("no")).alias("x"))}, {"in": False})
    with pytest.raises(W.Stop, match="^a:"):
        W.run(W.Flow({"a": bad}, []), {("a", "in"): frame([(1,)], "x int")})


def test_faults():
    f = W.Flow({"a": node(), "b": node()}, [W.Link("a", "out", "b", "no"), W.Link("a", "out", "b", "in", "met"), W.Link("a", "out", "b", "in"), W.Link("a", "out", "z", "in")])
    assert len(f.faults()) == 4
    assert W.budget_for(["high", None], {"high": 4}) == 4 and W.budget_for([], {"high": 4}, 2) == 2
