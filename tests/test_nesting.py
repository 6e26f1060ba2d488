import json
from datetime import datetime

from pyspark.sql import functions as F

from graphloom.operators.nesting import nested, parse, shred
from tests.conftest import rows

HELD = "location string, path string, guid_holder string, document string, received_at timestamp, hash string, bridge int"
T = lambda d: datetime(2024, 1, d)


def _rows(frame):
    inner = {"id_self": "c_1", "guid_self": "c_g", "title": "x"}
    whole = {"id_self": "a_1", "guid_self": "a_g", "part": [inner, {"id_self": 7, "deep": inner}, None, []], "opt": {}}
    return frame(
        [
            ("f", "", None, json.dumps(whole), T(2), "h", 1),
            ("f", "", None, json.dumps({"guid_self": "old"}), T(1), "h", 1),
            ("f", "", None, "{broken", T(3), "h", 1),
            ("f", "p.0", "q_g", '{ "title":"x", "guid_self":"c_g","id_self":"c_1" }', T(1), "h", 1),
            ("g", None, None, None, T(1), "h", 1),
            ("g", None, None, "", None, "h", 1),
            (None, "x", "q_g", '[{"id_self":"only"}]', None, "h", 1),
        ],
        HELD,
    )


def test_items_with_holder(frame):
    got = rows(nested(_rows(frame)).items().where("guid_holder is not null").select("location", "path", "guid_holder"))
    assert got == sorted([("f", "part.0", "a_g"), ("f", "part.1.deep", "a_g"), ("f", "p.0", "q_g"), (None, "x.0", "q_g")], key=repr)


def test_identical_objects_are_stored_once(frame):
    n = nested(_rows(frame))
    same = [r for r in n.object.collect() if r["guid_self"] == "c_g"]
    assert len(same) == 1 and json.loads(same[0]["field"]) == {"guid_self": "c_g", "id_self": "c_1", "title": "x"}
    assert n.bridge.where(F.col("hash") == same[0]["hash"]).count() == 3


def test_parents_lead_to_the_top(frame):
    b = {r["ordinal"]: r for r in nested(_rows(frame)).bridge.where("location = 'f' and document_path = ''").collect()}
    assert b[0]["parent"] is None and all(r["parent"] in b for r in b.values() if r["ordinal"])
    assert [b[k]["position"] for k in sorted(b)] == [None, 0, 1, None, None]


def test_empty_table(frame):
    n = nested(_rows(frame).limit(0))
    assert n.bridge.count() == 0 and n.object.count() == 0 and n.items().count() == 0


def test_layout_and_key_order_do_not_matter():
    a, _ = shred({"x": 1, "y": [{"z": None}]}, "", None)
    b, _ = shred(json.loads('{"y":[ {"z":null} ],"x":1}'), "", None)
    assert a[0][5] == b[0][5] and not a[0][6]


def test_parse():
    assert parse("﻿{}") == (True, {}) and parse("NaN") == (False, None) and parse("null") == (True, None) and parse(None) == (False, None)


def test_deep_and_odd_text(frame):
    deep = "[" * 500 + '{"guid_self":"g"}' + "]" * 500
    odd = '{"guid_self":"\\ud800","id_self":"x"}'
    df = frame([("d", "", "h", deep, T(1), "", 0), ("o", "", "h", odd, T(1), "", 0), ("big", "", "h", json.dumps({"guid_self": "b", "t": "x" * 300_000}), T(1), "", 0)], HELD)
    assert nested(df).items().count() == 3
