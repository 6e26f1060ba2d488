from datetime import datetime

import numpy as np
import pytest

from graphloom.functions.bitmap import SIZE, Container
from graphloom.operators.references import missing_references, orphan_report
from tests.conftest import rows

ITEM = "guid string, id_self string, status string, recorded_at timestamp, extra int"
EDGE = "ord bigint, guid_source string, id_relation string, guid_target string, id_target string, recorded_at timestamp, key string"
T = lambda m, d=1: datetime(2024, m, d)


@pytest.fixture(scope="module")
def tables(frame):
    item = frame(
        [
            ("a_1", "A", "accepted", T(1), 1),
            ("a_1", "A", "accepted", T(1), 1),
            ("b_1", "B", "accepted", T(1), 1),
            ("b_1", "B", " DELETED\t", T(3), 1),
            ("c_1", "C", None, T(6, 20), 1),
            ("d_1", None, "x", None, 1),
            (None, "E", "x", T(1), 1),
        ],
        ITEM,
    )
    edge = frame(
        [
            (1, "a_1", "r", " A_1 ", "a", T(2), "k"),
            (2, "a_1", None, "b_1", "B", T(2), "k"),
            (3, "a_1", "r", "c_1", "c", T(6, 10), "k"),
            (4, "a_1", "r", "c_1", "c", T(6, 21), "k"),
            (5, "a_1", "r", "c_1", None, None, "k"),
            (6, None, "r", "zz", " ", T(2), "k"),
            (7, "\xa0", "r", "d_1", "E", T(2), "k"),
            (8, "zz", "r", "zz", "zz", T(2), "k"),
            (9, "zz", "r", "zz", "zz", T(2), "k"),
        ],
        EDGE,
    )
    return edge, item


def test_reasons(tables):
    edge, item = tables
    got = rows(missing_references(edge, item).select("ord", "field", "reason"))
    want = [(2, "guid_target", "deleted"), (2, "id_target", "deleted"), (3, "guid_target", "late"), (3, "id_target", "late"), (6, "guid_target", "missing"), (7, "id_target", "missing")]
    want += [(n, f, "missing") for n in (8, 9) for f in ("guid_source", "guid_target", "id_target")]
    assert got == sorted(want, key=repr)


def test_report_counts_rows_and_keys(tables):
    report = {(r["field"], r["reason"], r["month"]): (r["n_reference"], r["n_key"]) for r in orphan_report(missing_references(*tables)).where("table = 'zz'").collect()}
    assert report[("guid_target", "missing", "2024-02")] == (3, 1)


def test_empty_tables(frame, tables):
    edge, item = tables
    assert missing_references(edge.limit(0), item).count() == 0
    none = missing_references(edge, item.limit(0))
    assert {r["reason"] for r in none.collect()} == {"missing"}


def test_container_against_sets():
    rng = np.random.default_rng(1)
    for n, m in ((10, 10), (5000, 30), (30, 20000), (20000, 20000), (0, 5)):
        a, b = rng.integers(0, SIZE, n), rng.integers(0, SIZE, m)
        assert set(Container.of(a).minus(Container.of(b)).members().tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(Container.of(a).union(Container.of(b)).members().tolist()) == set(a.tolist()) | set(b.tolist())
        assert Container.of(a).nbytes() <= SIZE // 8
