from datetime import datetime

import numpy as np
import pytest

from graphloom.llm.readability import TOLERANCE, prose, propagate, reading_levels
from tests.conftest import rows

ITEM = "guid string, brief string, description string, recorded_at timestamp, words string, level string"
T = lambda d: datetime(2024, 1, d)
EASY = "we put the cat on the mat and the dog in the box by the door each day so it can rest"
HARD = "epistemological formalisation necessitates institutional traceability of methodological parameterisation through jurisdictional corroboration and computational determination alike of longitudinal verifiability and hierarchical proportionality notwithstanding"
MID = "the template of the register was restored before every handshake so that another ledger reports the budget of the cascade in the archive again"


def table(frame):
    rows = [(f"e{i}", EASY, f"w{i} cat", T(1), "", "") for i in range(12)] + [(f"h{i}", HARD, f"w{i} determination", T(1), "", "") for i in range(12)] + [(f"m{i}", MID, f"w{i} budget", T(1), "", "") for i in range(12)]
    rows += [("h0", EASY, None, datetime(2023, 1, 1), "", ""), ("short", "epistemological formalisation", None, T(1), "", ""), ("none", None, None, None, "", ""), (None, HARD, None, T(1), "", ""), ("h1", HARD, "w1 determination", T(1), "", "")]
    return frame(rows, ITEM)


GRADED = [("e0", "plain"), ("e1", " Plain"), ("m0", "working"), ("h0", "specialist"), ("gone", "plain"), ("h2", "odd"), (None, "plain"), ("m1", None)]


def test_levels(frame):
    got = {r["guid"]: r for r in reading_levels(table(frame), frame(GRADED, "guid string, level string")).collect()}
    assert all(got[f"e{i}"]["level"] == "plain" and got[f"h{i}"]["level"] == "specialist" and got[f"m{i}"]["level"] == "working" for i in range(12))
    assert got["short"]["level"] is None and got["none"]["n_word"] == 0 and None not in got and len(got) == 38
    assert got["e5"]["difficulty"] < got["m5"]["difficulty"] < got["h5"]["difficulty"]


def test_nothing_graded_and_empty(frame):
    none = frame([], "guid string, level string")
    assert {r["level"] for r in reading_levels(table(frame), none).collect()} == {None}
    assert reading_levels(table(frame).limit(0), frame(GRADED, "guid string, level string")).count() == 0


def test_the_last_row_holds(frame):
    got = {r["guid"]: r["n_word"] for r in prose(frame([("a", "x y", None, T(1), "", ""), ("a", "x", None, T(2), "", ""), ("a", "x y z", None, None, "", "")], ITEM)).collect()}
    assert got == {"a": 1}


def test_repeats_change_nothing(frame):
    t, g = table(frame), frame(GRADED, "guid string, level string")
    assert rows(reading_levels(t.unionByName(t), g).select("guid", "level")) == rows(reading_levels(t, g).select("guid", "level"))


def test_rounds_go_on_until_words_settle(frame):
    n = 24
    words = [[2 * i, 2 * i + 1, 2 * i + 2] for i in range(n)]
    fixed = [0.0, *[None] * (n - 2), 1.0]
    docs = frame([(w, f, str(i), 3) for i, (w, f) in enumerate(zip(words, fixed))], "words array<int>, fixed double, guid string, n_word int")
    in_doc = np.zeros((n, 2 * n + 1))
    for i, w in enumerate(words):
        in_doc[i, w] = 1
    mean = in_doc * np.log1p(n / in_doc.sum(0))
    mean /= mean.sum(1, keepdims=True)
    back = (in_doc / in_doc.sum(0)).T
    free = np.array([f is None for f in fixed])
    settled = np.linalg.solve(np.eye(2 * n + 1) - back[:, free] @ mean[free], back[:, ~free] @ np.array([0.0, 1.0]))
    got = {int(r["guid"]): r["score"] for r in propagate(docs, tolerance=1e-9).collect()}
    assert np.allclose([got[i] for i in range(n)], mean @ settled, atol=1e-5)
    got = {int(r["guid"]): r["score"] for r in propagate(docs).collect()}
    assert np.abs(np.array([got[i] for i in range(n)]) - mean @ settled).max() < 100 * TOLERANCE
    with pytest.raises(RuntimeError, match="still move"):
        propagate(docs, rounds=30, tolerance=1e-12)
