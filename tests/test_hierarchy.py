import random

import pytest

from graphloom.operators.hierarchy import descendants, hierarchy, paths
from tests.conftest import rows

C = "ord bigint, guid_held string, guid_holder string, node string, depth int"


def brute(links):
    last = {}
    for o, held, holder, *_ in sorted(links, key=lambda r: r[0]):
        if held is not None:
            last[held] = holder
    names = {x for r in links for x in r[1:3] if x is not None}
    out = []
    for n in names:
        seen, at = [n], n
        while last.get(at) is not None and last[at] not in seen:
            at = last[at]
            seen.append(at)
        out.append((n, "cycle", -1) if last.get(at) is not None else (n, at, len(seen) - 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("task_links", [1, 5, 40, 10_000])
def test_against_brute_force(frame, task_links):
    rng = random.Random(task_links)
    n = 60
    links = [(i, f"n{rng.randrange(n)}", rng.choice([None, *[f"n{rng.randrange(n)}"] * 5]), "x", 1) for i in range(70)]
    links += [(100 + i, f"c{i}", f"c{i + 1}", "x", 1) for i in range(30)]
    links += [(200, "l0", "l1", "x", 1), (201, "l1", "l2", "x", 1), (202, "l2", "l0", "x", 1), (203, "below", "l1", "x", 1), (204, "self", "self", "x", 1), (205, None, "lone", "x", 1)]
    got = rows(hierarchy(frame(links, C), task_links=task_links).select("guid_node", "guid_root", "depth"))
    assert got == brute(links)


def test_paths_and_descendants(frame):
    tree = hierarchy(frame([(1, "b", "a", "", 0), (2, "c", "b", "", 0), (3, "d", "b", "", 0), (4, "x", "y", "", 0), (5, "y", "x", "", 0)], C))
    p = paths(tree)
    assert {r["guid_node"]: r["path"] for r in p.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "d"]}
    assert rows(descendants(p)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]


def test_long_chain(frame):
    tree = hierarchy(frame([(i, f"n{i}", f"n{i + 1}", "", 0) for i in range(200)], C), task_links=50)
    assert tree.agg({"depth": "max"}).first()[0] == 200
    assert max(len(r["path"]) for r in paths(tree).collect()) == 201


def test_empty_and_hub(frame):
    assert hierarchy(frame([], C)).count() == 0
    hub = hierarchy(frame([(i, f"n{i}", "hub", "", 0) for i in range(300)], C), task_links=100)
    assert hub.where("guid_root = 'hub' and depth = 1").count() == 300
