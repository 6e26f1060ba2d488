import random

import pytest

from graphloom.operators import graph as G
from graphloom.operators.facts import FactDatabase, ReadOnly, translated
from graphloom.operators.order import numbered
from tests.conftest import rows

ITEM = "guid string, id_self string, prefix string, status string, location string, ord bigint"
EDGE = "ord bigint, guid_source string, id_relation string, guid_target string, id_target string"
HELD = "guid_holder string, guid_held string"


def db(frame, edges, items="abcd", held=(), prefix="t", relation="r"):
    item = frame([(g, f"{prefix}_{g}", prefix, "accepted", "f", i) for i, g in enumerate(items)], ITEM)
    edge = frame([(i, e[0], e[2] if len(e) > 2 else relation, e[1], f"t_{e[1]}") for i, e in enumerate(edges)], EDGE)
    return FactDatabase(item, edge, frame(list(held), HELD))


def steps(df):
    return [(r["depth"], r["id_self"], r["id_from"], r["direction"]) for r in df.orderBy("depth", "pos").collect()]


def test_walk_takes_each_item_once_and_breaks_ties_by_order(frame):
    d = db(frame, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert steps(G.walk(d, "t_a", 3)) == [(0, "t_a", None, None), (1, "t_b", "t_a", "out"), (1, "t_c", "t_a", "out"), (2, "t_d", "t_b", "out")]
    assert steps(G.walk(d, "d", 1, directions=("in",))) == [(0, "t_d", None, None), (1, "t_b", "t_d", "in"), (1, "t_c", "t_d", "in")]


def test_walk_unknown_is_not_empty(frame):
    d = db(frame, [("a", "b"), ("b", "gone", None)])
    assert G.walk(d, "nobody") is None
    assert steps(G.walk(d, "a", 5))[-1] == (2, "gone", "t_b", "out")
    assert steps(G.walk(d, "d", 5)) == [(0, "t_d", None, None)]
    assert [s[1] for s in steps(G.walk(d, "a", 5, ("r",)))] == ["t_a", "t_b"]


def test_walk_ends_on_cycles(frame):
    assert len(steps(G.walk(db(frame, [("a", "b"), ("b", "c"), ("c", "a")]), "a", 50))) == 3


def test_path(frame):
    d = db(frame, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "abcde")
    got = [(r["depth"], r["id_self"], r["id_from"], r["direction"]) for r in G.path(d, "a", "c").orderBy("depth").collect()]
    assert [g[1] for g in got] == ["t_a", "t_b", "t_c"] and got[1][3] == "out"
    assert [r["id_self"] for r in G.path(d, "a", "d").orderBy("depth").collect()] == ["t_a", "t_d"]
    assert G.path(d, "a", "e").count() == 0 and G.path(d, "a", "zz") is None and G.path(d, "a", "t_a").count() == 1


def test_orphans_and_null_relations(frame):
    d = db(frame, [("a", "b", "r_a")], "abc", [("a", "c")], prefix="r")
    alone, unused = G.orphans(d)
    assert rows(alone) == [("a", "r_a")] and rows(unused) == [("r_b",), ("r_c",)]
    assert G.orphans(db(frame, [("a", "b", "r_a"), ("a", "c", None)], "abc", prefix="r"))[1].count() == 0


def test_induced_edges_keep_repeats(frame):
    d = db(frame, [("a", "b"), ("a", "b"), ("b", "c"), ("a", "a")])
    assert rows(G.edges_among(d, frame([("a",), ("b",)], "guid string"))) == [("t_a", "t_a", "r"), ("t_a", "t_b", "r"), ("t_a", "t_b", "r")]


def test_neighbourhood(frame):
    out, into = G.neighbourhood(db(frame, [("a", "b"), ("c", "a")]), "t_a")
    assert rows(out.drop("ord")) == [("r", "t_b")] and rows(into) == [("t_c", "r")]


LINK = "a string, b string"


def test_reach_propagate(frame):
    links = frame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None), ("c", "d")], LINK)
    got = {(r["root"], r["node"]): r["depth"] for r in G.reach(links, frame([("s", "a"), ("t", "d")], "root string, node string")).collect()}
    assert got == {("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 2, ("s", "d"): 3, ("t", "d"): 0}
    lev = frame([("a", "x", 1), ("b", "x", 3), ("b", "y", 2)], "node string, dimension string, level int")
    chain = frame([("a", "b"), ("b", "c"), ("c", "d")], LINK)
    assert rows(G.propagate(chain, lev)) == [("b", "x", 1), ("c", "x", 3), ("c", "y", 2), ("d", "x", 3), ("d", "y", 2)]


def test_cycles_redundancy_levels(frame):
    links = frame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x")], LINK)
    assert rows(G.on_cycles(links)) == [("x", "y"), ("y", "x")]
    assert rows(G.redundant(links)) == [("a", "c")]
    nodes = frame([(n,) for n in "abcdxyz"], "node string")
    assert {r["node"]: r["level"] for r in G.topological_levels(nodes, links).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}


def test_redundancy_inside_a_cycle(frame):
    assert rows(G.redundant(frame([("a", "b"), ("b", "a"), ("a", "c")], LINK))) == [("a", "c")] or rows(G.redundant(frame([("a", "b"), ("b", "a"), ("a", "c")], LINK))) == []


def test_components(frame):
    links = frame([(str(i), str(i + 1)) for i in range(20)] + [("p", "q"), ("q", "p"), ("z", "z")], LINK)
    got = {r["node"]: r["component"] for r in G.components(links).collect()}
    assert got == {**{str(i): "0" for i in range(21)}, "p": "p", "q": "p"}
    assert G.components(frame([], LINK)).count() == 0


def test_expanded_never_reenters(frame):
    got = rows(G.expanded(frame([("a", "b"), ("b", "a"), ("b", "c")], LINK), frame([("a",)], "node string"), 5).select("path", "has_child"))
    assert got == sorted([(["a"], True), (["a", "b"], True), (["a", "b", "c"], False)], key=repr)


def test_drawing(frame):
    d = db(frame, [("a", "b"), ("c", "a")])
    dot = G.drawing(G.walk(d, "a", 1))
    assert dot.startswith("digraph {") and '"t_a" -> "t_b"' in dot and '"t_c" -> "t_a"' in dot
    assert "n0 -->|r| n1" in G.drawing(G.walk(d, "a", 1), "mermaid")
    with pytest.raises(ValueError):
        G.drawing(G.walk(d, "a", 1), "png")


def test_rename_cascade(frame):
    items = frame([("t_a",), ("u_a.b",), ("t_ab",), (None,)], "id_self string")
    assert rows(G.renamed(items, "t_a", "t_z")) == [("t_a", "t_z"), ("u_a.b", "u_z.b")]


def test_database_is_for_reading(frame):
    d = db(frame, [("a", "b")])
    assert d.run("select count(*) as n from item where prefix = ?", ("t",)).first()[0] == 4
    for bad in ("drop view item", "create view x as select 1", "set a=b", "insert into item select * from item"):
        with pytest.raises(ReadOnly):
            d.run(bad)
    with pytest.raises(ValueError):
        db(frame, [], "aa")


def test_dialect():
    assert translated("select group_concat(x, ', ') from t where y like 'LIKE %'") == "select listagg(x, ', ') WITHIN GROUP (ORDER BY x) from t where y ILIKE 'LIKE %'"


def test_numbered(frame):
    got = numbered(frame([(i % 7, i) for i in range(100)], "a int, b int"), "a", "b").orderBy("a", "b").collect()
    assert [r["pos"] for r in got] == list(range(100))
    assert numbered(frame([], "a int, b int"), "a", "b").count() == 0


def reachable(pairs):
    out = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    while True:
        new = {a: bs | {c for b in bs for c in out.get(b, ())} for a, bs in out.items()}
        if new == out:
            return out
        out = new


def test_random_graphs_against_brute_force(frame):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(24):02}", f"n{rng.randrange(24):02}") for _ in range(34)})
    links = frame(pairs, "a string, b string")
    to = reachable(pairs)
    assert rows(G.on_cycles(links)) == [(a, b) for a, b in pairs if a == b or a in to.get(b, ())]

    plain = [(a, b) for a, b in pairs if a != b]
    other = reachable(plain)
    want = [(a, b) for a, b in plain if any(v != b and b in other.get(v, ()) for x, v in plain if x == a)]
    assert want and rows(G.redundant(links)) == want


def test_path_is_the_one_a_walk_finds(frame):
    rng = random.Random(8)
    names = "abcdefghijkl"
    d = db(frame, [(rng.choice(names), rng.choice(names)) for _ in range(14)], names)
    walked = {r["guid"]: r for r in G.walk(d, "a", 20).collect()}
    far = max(walked.values(), key=lambda r: r["depth"])
    want, at = [], far
    while at is not None:
        want.append((at["depth"], at["guid"], at["direction"]))
        at = next((r for r in walked.values() if r["id_self"] == at["id_from"]), None)
    assert far["depth"] > 2 and [(r["depth"], r["guid"], r["direction"]) for r in G.path(d, "a", far["guid"]).orderBy("depth").collect()] == want[::-1]
