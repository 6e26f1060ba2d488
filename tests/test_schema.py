from graphloom.functions.schema import Validator, violations
from graphloom.operators import judging as J
from graphloom.operators.facts import FactDatabase
from tests.conftest import rows

S = {
    "type": "object",
    "required": ["a"],
    "properties": {"a": {"type": "string", "pattern": "^x", "maxLength": 3}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "l": {"type": "array", "items": {"$ref": "#/$defs/e"}, "minItems": 1, "uniqueItems": True}, "k": {"enum": [1, "b"]}},
    "additionalProperties": False,
    "$defs": {"e": {"type": ["string", "null"]}},
}


def faults(value, schema=S, **more):
    return sorted(Validator(more).faults(value, schema))


def test_keywords():
    assert faults({"a": "xy", "n": 2, "l": ["p", None], "k": "b"}) == []
    assert faults([]) == [("", "is no object")] and faults({}) == [("", "lacks a")]
    assert faults({"a": "y\n", "z": 1}) == [("a", "does not match its pattern"), ("z", "is not allowed")]
    assert faults({"a": "xxxx", "n": True, "l": [], "k": 2}) == [("a", "is too long"), ("k", "is none of the values allowed"), ("l", "has too few items"), ("n", "is no integer")]
    assert faults({"a": "x", "n": 9, "l": [1, "a", "a"]}) == [("l", "has an item twice"), ("l.0", "is no ['string', 'null']"), ("n", "is too large")]


def test_composition():
    base = {"properties": {"a": {"type": "string"}}}
    s = {"allOf": [{"$ref": "base"}], "properties": {"b": {}}, "unevaluatedProperties": False, "not": {"required": ["c"]}, "propertyNames": {"maxLength": 1}}
    assert faults({"a": "x", "b": 1}, s, base=base) == []
    assert faults({"a": 1, "dd": 1, "c": 0}, s, base=base) == [("", "matches what it must not"), ("a", "is no string"), ("c", "is not declared"), ("dd", "is not declared"), ("dd", "its name is too long")]
    assert Validator({"r": {"$ref": "r", "properties": {"q": {}}}}).declared({"$ref": "r"}) == {"q"}
    assert faults({"t": 1}, {"if": {"required": ["t"]}, "then": {"required": ["u"]}}) == [("", "lacks u")]


def test_violations(frame):
    df = frame([("f", '{"a": "x"}'), ("g", "{}"), ("h", "{"), ("n", None)], "location string, document string")
    assert rows(violations(df, S)) == [("g", "", "lacks a"), ("h", "", "does not parse"), ("n", "", "does not parse")]


def test_tasks(frame):
    item = frame([("a", "t_a", "t"), ("b", "u_b", "u"), ("c", "t_c", "t")], "guid string, id_self string, prefix string")
    edge = frame([(1, "a", "r", "c"), (2, "a", "r", "b"), (3, "b", "r", "gone"), (4, "a", "r", "c")], "ord int, guid_source string, id_relation string, guid_target string")
    db = FactDatabase(item, edge, frame([], "guid_holder string, guid_held string"))
    t = J.tasks(db, [J.Eval("e", types=("u",)), J.Eval("p", relation="r", include=("t",))])
    assert rows(t) == [("e", "b", None), ("p", "a", "c")]
    assert rows(J.tasks(db, [J.Eval("p", relation="r")], frame([("c",)], "guid string"))) == [("p", "a", "c")]
    text = frame([("a", "t_a", "said"), ("b", None, " "), ("c", None, "x")], "guid string, id_self string, said string")
    got = J.rendered(t, text)
    assert [(r["guid"], r["text"]) for r in got.collect()] == [("a", "--- t_a\nsaid\n--- c\nx\n")]
    assert rows(J.cost(got, 5)) == [("p", 1, 5, 21)] and J.tasks(db, []).count() == 0


def test_classes_and_reports(frame):
    s = frame([("a", None), ("b", {"x": True, "y": False})], "guid string, coverage map<string,boolean>")
    assert rows(J.covered_classes(s, ("x", "y", "z")).where("guid = 'b'").select("class", "state")) == [("x", "covered"), ("y", "uncovered"), ("z", "silent")]
    f = frame([("e", "c", None, "m"), ("x", "c", "g", "m")], "id_execution string, id_check string, guid string, message string")
    assert rows(J.reports(f, frame([("e", "failed"), ("x", "parked")], "id_execution string, status string"))) == [("e", "c", '{"id_check":"c","message":"m"}')]
