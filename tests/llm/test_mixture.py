import pytest

from graphloom.llm.mixture import mix, plan_mix, shares

DOC, TARGET = "doc_id bigint, text string, source string, copy int, at double", "source string, weight double, max_repeat int"


def corpus(frame):
    rows = [(i, "one two three four five", " Big ", 0, 0.0) for i in range(300)] + [(1000 + i, "one two three", "small", 0, 0.0) for i in range(20)] + [(2000 + i, "one", "SMALL ", 0, 0.0) for i in range(5)]
    return frame(rows + [(5000, None, "big", 0, 0.0), (5001, "", "big", 0, 0.0), (5002, "x", None, 0, 0.0), (5003, "x", "other", 0, 0.0)], DOC)


def test_shares_and_repeats(frame):
    targets = frame([("big", 3.0, 1), ("small", 1.0, 4), ("absent", 1.0, 2), (None, 1.0, 1), ("other", 0.0, 1)], TARGET)
    m = mix(corpus(frame), targets)
    rows = m.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows))) and all(a["at"] <= b["at"] for a, b in zip(rows, rows[1:]))
    tokens = {s: sum(r["n_token"] for r in rows if r["source"] == s) for s in ("big", "small")}
    assert abs(tokens["big"] / sum(tokens.values()) - 0.75) < 0.02 and {r["source"] for r in rows} == {"big", "small"}
    seen = [(r["doc_id"], r["copy"]) for r in rows]
    assert len(seen) == len(set(seen)) and max(c for _, c in seen) <= 4
    out = {(r["source"], r["phase"]): r for r in shares(m, targets).collect()}
    assert out[("absent", None)]["n_token"] == 0 and abs(out[("big", None)]["wanted"] - 0.6) < 1e-9 and len(out) == 15
    assert sum(out[("big", p)]["n_token"] for p in range(4)) == out[("big", None)]["n_token"] == tokens["big"]


def test_schedule_moves_weight(frame):
    targets = frame([("big", 1.0, 1), ("small", 1.0, 9)], TARGET)
    m = mix(corpus(frame), targets, {"big": 0.8, "small": -0.8})
    part = {(r["source"], r["phase"]): r["reached"] for r in shares(m, targets).collect()}
    assert part[("big", 0)] < 0.35 < 0.65 < part[("big", 3)] and abs(part[("big", None)] - 0.5) < 0.03


def test_nothing_in_common(frame):
    t = frame([("zz", 1.0, 1)], TARGET)
    assert mix(corpus(frame), t).count() == 0 and mix(corpus(frame).limit(0), t).count() == 0 and mix(corpus(frame), t.limit(0)).count() == 0


def test_plan():
    p = plan_mix({"a": (100, 10), "b": (10, 10)}, [("a", 0.5, 1), ("b", 0.5, 3), ("a", 0.5, 2)])
    assert p.share == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)} and p.total == pytest.approx(90)
    assert sum(p.share[s] * p.tilt[s] for s in p.share) == pytest.approx(0) and all(abs(t) <= 1 for t in p.tilt.values())
