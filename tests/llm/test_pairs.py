import itertools
import random

import numpy as np
import pytest

from graphloom.llm.neardup import alike, band_of, chunks_of, signatures
from graphloom.llm.pairs import within
from tests.conftest import rows

BODY = "body_id bigint, piece array<string>, length int, set int, class string"


def brute(data, t=0.8, least=24):
    sets = [(i, {x for x in p if x is not None}) for i, p, n, *_ in data if p is not None and (n is None or n >= least)]
    sets = [x for x in sets if x[1]]
    return sorted((min(a, b), max(a, b)) for (a, s), (b, r) in itertools.combinations(sets, 2) if len(s & r) >= t * len(s | r) - 1e-9)


def edited(rng, base, n):
    s = list(base)
    for _ in range(n):
        s[rng.randrange(len(s))] = f"new{rng.random()}"
    rng.shuffle(s)
    return s


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(frame, seed):
    rng = random.Random(seed)
    data, k = [], 0
    for size in (1, 2, 3, 5, 9, 10, 20, 50, 120, 300):
        base = [f"{size}.{i}" for i in range(size)]
        for n in (0, 0, 1, 2, size // 20, size // 10, size // 9, size // 5):
            data.append((k, edited(rng, base, min(n, size)) + base[:1], rng.choice([None, 24, 100]), 0, ""))
            k += 1
    data += [(900, ["a", None, "b"], 23, 0, ""), (901, None, 99, 0, ""), (902, [], 99, 0, ""), (903, [None], 99, 0, ""), (904, ["a", "b", "a"], None, 0, ""), (905, ["b", "a", None], None, 0, "")]
    got = sorted(rows(alike(frame(data, BODY)).pairs()))
    assert got == brute(data) and (904, 905) in got


def test_empty(frame):
    assert alike(frame([], BODY)).pairs().count() == 0


def test_many_copies_become_a_star(frame):
    same = [(i, ["x", "y"], None, 0, "") for i in range(30)]
    got = sorted(rows(alike(frame(same, BODY)).pairs(expand=10)))
    assert got == [(0, i) for i in range(1, 30)]


def meets(x, y):
    """Whether a kept chunk of the smaller set equals one of the other, as it is or with one bit cleared on either side."""
    m = chunks_of(band_of(min(len(x), len(y)), 0.8), 0.8)
    v, w = [], []
    for pieces, out in ((x, v), (y, w)):
        value, kept, chunk, bit = signatures(pieces, np.zeros(len(pieces), np.int64), 1, m)
        out.append({(i, int(value[i])) for i in range(m) if kept[i]})
        out.append({(int(c), int(value[c] ^ b)) for c, b in zip(chunk, bit) if kept[c]})
    return bool(v[0] & (w[0] | w[1]) or w[0] & v[1])


def test_every_pair_at_the_threshold_meets():
    rng = np.random.default_rng(0)
    for n in (1, 4, 5, 9, 10, 23, 40, 77, 200):
        for lost in {0, n // 9, n // 5, n // 10, n // 20}:
            for more in (0, n // 9, n // 4, n // 8):
                shared = n - lost
                if shared < 0.8 * (shared + lost + more):
                    continue
                for _ in range(10):
                    x = rng.integers(0, 2**63, n).astype(np.uint64)
                    assert meets(x, np.concatenate((x[lost:], rng.integers(0, 2**63, more).astype(np.uint64))))


def test_unrelated_sets_hardly_meet():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(300)]
    assert sum(meets(x, y) for x, y in itertools.combinations(sets, 2)) <= 10  # of 44,850


def test_classes_count_links(frame):
    base = [f"p{i}" for i in range(20)]
    data = [(1, base, None, 0, ""), (2, base[::-1], None, 0, ""), (3, [*base[:19], "x"], 24, 0, ""), (4, ["z"], None, 0, ""), (5, base, 3, 0, "")]
    assert rows(alike(frame(data, BODY)).classes()) == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)]


def test_bands_of_alike_sizes_touch():
    for n in range(1, 2000):
        for m in range(-(-4 * n // 5), n + 1):
            assert band_of(n, 0.8) - band_of(m, 0.8) in (0, 1)


def test_star_of_variants(frame):
    data = [(1, v, i) for i, v in enumerate([1] * 6 + [2] * 6 + [3])]
    m = frame(data, "class int, variant int, id int")
    full = rows(within(m, True, 100))
    assert len(full) == 36 + 6 + 6 and all(a < b for a, b in full)
    star = rows(within(m, True, 5))
    variant = {i: v for _, v, i in data}
    assert {x for p in star for x in p} == set(variant) and all(variant[a] != variant[b] for a, b in star) and len(star) == len(set(star)) < 14
    assert within(m.limit(0), True).count() == 0


def test_variants_of_a_large_class_are_all_paired(frame):
    data = [("x", v, 10 * v + i) for v in range(4) for i in range(5)]
    got = rows(within(frame(data, "class string, variant int, id int"), True, 10))
    assert {(10 * v, 10 * w) for v in range(4) for w in range(v + 1, 4)} <= set(got)
    assert len(got) == len(set(got)) == 6 + 16 and {x for p in got for x in p} == {i for *_, i in data}
