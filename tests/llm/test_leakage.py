import random

import pytest

from graphloom.llm import leakage
from graphloom.llm.leakage import leaks
from tests.conftest import rows

DOC, CASE = "doc_id bigint, text string, words int, seed string", "case_id bigint, text string, row int"
W = lambda a, b: " ".join(f"w{i}" for i in range(a, b))


@pytest.mark.parametrize("limit", [10_000_000, 0])
def test_found(frame, limit):
    cases = frame([(1, W(0, 40), 0), (2, W(100, 111), 0), (3, None, 0), (4, "", 0), (5, W(0, 40), 0), (6, W(200, 230), 0)], CASE)
    docs = frame(
        [
            (1, "x y " + W(5, 17).upper().replace(" ", ", ") + " z", 0, ""),
            (2, W(5, 16), 0, ""),
            (3, W(100, 111), 0, ""),
            (4, None, 0, ""),
            (5, "", 0, ""),
            (6, W(200, 210) + " odd " + W(211, 230), 0, ""),
            (7, W(200, 206) + " odd " + W(207, 212), 0, ""),
            (8, W(200, 204) + " odd " + W(205, 208) + " odd " + W(209, 213), 0, ""),
            (9, "q " * 20_000 + W(20, 40), 0, ""),
        ],
        DOC,
    )
    got = {(r["doc_id"], r["case_id"]): (r["longest"], r["covered"]) for r in leaks(docs, cases, limit).collect()}
    assert got == {(1, 1): (12, 12), (1, 5): (12, 12), (6, 6): (19, 29), (7, 6): (6, 11), (9, 1): (20, 20), (9, 5): (20, 20)}
    assert leaks(docs.limit(0), cases, limit).count() == 0 and leaks(docs, cases.limit(0), limit).count() == 0


def test_any_one_substitution_is_tolerated(frame):
    cases = frame([(1, W(0, 12), 0)], CASE)
    docs = frame([(i, " ".join("odd" if j == i else f"w{j}" for j in range(12)), 0, "") for i in range(13)], DOC)
    assert {r["doc_id"] for r in leaks(docs, cases).collect()} == set(range(13))


@pytest.mark.parametrize("bits", [1 << 30, 1 << 12])
def test_both_ways_agree(frame, monkeypatch, bits):
    monkeypatch.setattr(leakage, "FILTER_BITS", bits)  # the smaller one makes shards
    rng = random.Random(3)
    words = [f"v{i}" for i in range(12)]
    case = [(i, " ".join(rng.choice(words) for _ in range(60)), 0) for i in range(12)]
    cut = lambda: (t := rng.choice(case)[1].split())[(a := rng.randrange(40)) : a + rng.randrange(8, 20)]
    doc = [(i, " ".join(["zz", *cut(), "yy", *cut()]), 0, "") for i in range(60)]
    a, b = (rows(leaks(frame(doc, DOC), frame(case, CASE), n)) for n in (10_000_000, 0))
    assert a == b
    grams = {}
    for c, t, _ in case:
        w = t.split()
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(c)
    want = {(d, c) for d, t, *_ in doc for i in range(len(t.split()) - 11) for c in grams.get(tuple(t.split()[i : i + 12]), ())}
    assert {(d, c) for d, c, n, _ in a if n >= 12} == want
