import hashlib
import json

from graphloom.operators import statements as S
from tests.conftest import rows


def test_undefined_words_see_only_visible_registers(frame):
    subjects = frame([("1", "a", "run"), ("2", "b", "run"), ("3", None, "run"), ("4", "a", "walk"), ("5", "b", "free"), ("6", None, "no"), ("7", "a", None)], "guid string, segment string, term string")
    register = frame([("run", "b"), ("run", "b"), ("walk", "z"), ("free", None), (None, "a")], "term string, segment string")
    visible = frame([("a", "a"), ("a", "b"), ("b", "b")], "root string, node string")
    assert rows(S.undefined(subjects, register, visible).select("guid")) == [("4",), ("6",), ("7",)]
    assert S.undefined(subjects, register.limit(0), visible).count() == 7 and S.undefined(subjects.limit(0), register, visible).count() == 0
    assert rows(S.defining(register).select("term", "segments")) == [("free", [""]), ("run", ["b"]), ("walk", ["z"])]


def test_same_obligation_and_entity(frame):
    m = frame([("s", 1, "a", "store", "The row"), ("s", 2, "b", "store", "a row."), ("s", 3, "c", "store", "rows"), ("t", 1, "d", "store", "row"), (None, 1, "e", "x", "y"), (None, 2, "f", "x", "y")], "set string, ord int, guid string, process string, object string")
    assert rows(S.same_obligation(m)) == [("s", "b", "a")]
    e = frame([("s", "a", "x"), ("s", "b", None), ("u", "c", "x")], "set string, guid string, entity string")
    assert rows(S.off_entity(e, frame([("s", "x"), ("t", None)], "set string, entity string"))) == [("s", "b", None, "x")]


def test_statement_faults(frame):
    word = lambda *w: frame([(x,) for x in w], "word string")
    known = S.known_words(word("kg", None), word("Lorem", ""), word("The XML book", None))
    assert rows(known) == [("kg",), ("lorem",), ("xml",)]
    subjects = frame([("1", "accepted", "perform", "calculation of XML and QRS", "within 5 kg"), ("2", None, "may", "the row", None), ("3", "proposed", None, None, "weighs 7")], "guid string, status string, process string, object string, qualifier string")
    verbs = frame([("calculate", None), ("may", "permission"), (None, "x")], "term string, kind string")
    got = rows(S.statement_faults(subjects, ["kg"], known, verbs))
    assert got == [("1", "acronym", "QRS", "critical"), ("1", "light_verb", "perform", "critical"), ("1", "nominal", "calculation", "critical"), ("2", "permission", "may", "advisory"), ("3", "no_unit", "7", "advisory")]


def digest(x, **form):
    return hashlib.sha256(json.dumps(x, sort_keys=True, **form).encode()).hexdigest()[:8]


def test_digests(frame):
    required = frame([("r", "c"), ("r", None), ("q", "c")], "requirement string, case string")
    claimed = frame([("r", '{"b": 1, "a": "é"}')], "guid string, claim string")
    sources = frame([("c", "k2", "code"), ("d", "k1", "dép"), ("r", "k0", "own")], "guid string, id string, source string")
    links = frame([("c", "d"), ("d", "c"), ("r", "d")], "a string, b string")
    got = {(r[0], r[1]): r[2] for r in S.evidence_digests(required, claimed, sources, links).select("requirement", "case", "digest").collect()}
    both = {"claimed": {"a": "é", "b": 1}, "rests_on": ["dép", "code"]}
    assert got == {("r", "c"): digest(both), ("r", None): digest(both), ("q", "c"): digest({"claimed": {}, "rests_on": ["dép", "code"]})}

    evals = frame([("e", " a  b", None, "s"), ("f", "x", "y", "z")], "id_eval string, criterion string, example string, scope string")
    cases = frame([("e", "t  2", "met", None), ("e", "t 1", "unmet", "written")], "id_eval string, subject string, verdict string, origin string")
    got = dict(map(tuple, S.confidence_digests(evals, cases).collect()))
    compact = {"separators": (",", ":")}
    assert got == {"e": digest({"criterion": "a b", "example": None, "scope": "s", "case": [["t 1", "unmet", "written"], ["t 2", "met", None]]}, **compact), "f": digest({"criterion": "x", "example": "y", "scope": "z", "case": []}, **compact)}

    df = frame([(None, "s\n", None)], "a string, b string, c string")
    assert df.select(S.coverage_digest(df["a"], df["b"], df["c"])).first()[0] == digest(["", "s\n", None])
    now = frame([("r", "v", "1"), ("q", "v", "2")], "requirement string, verifier string, digest string")
    assert rows(S.current_analyses(frame([("r", "v", "1"), ("r", "v", "1"), ("q", "v", "1"), ("z", "v", None)], now.schema), now)) == [("r",)]


def test_session_and_execution_evidence(frame):
    inst = frame([("f[1]", "passed"), ("f[2]", "failed"), ("g", "passed"), ("lost", "passed"), ("h", "odd")], "name string, outcome string")
    fun = frame([("f", "F"), ("g", "G"), ("h", "H")], "name string, guid string")
    ver = frame([("F", "r1"), ("F", "r2"), ("H", "r3")], "case string, requirement string")
    assert rows(S.session_evidence(inst, fun, ver)) == [("F", "r1", "failed", 2, 1), ("F", "r2", "failed", 2, 1), ("H", "r3", "odd", 1, 0)]
    exe = frame([("x", "completed", True), ("y", "completed", None), ("z", "parked", True)], "execution string, status string, kept boolean")
    res = frame([("x", "F", "passed"), ("y", "F", "failed"), ("z", "F", "passed"), ("x", "F", "skipped")], "execution string, case string, outcome string")
    assert rows(S.execution_evidence(exe, res, ver)) == [("F", "r1", "failed", None), ("F", "r1", "passed", "x"), ("F", "r2", "failed", None), ("F", "r2", "passed", "x")]


def test_inherited(frame):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, "top" if i == 0 else "mid" if i == 5 else None) for i in range(12)]
    loop = [("a", "b", None), ("b", "a", None), ("c", "a", None), ("d", "e", None), ("e", "d", "v"), ("o", "gone", None)]
    got = dict(map(tuple, S.inherited(frame(chain + loop, "node string, holder string, x string"), "x").collect()))
    assert got == {f"n{i}": "mid" if i >= 5 else "top" for i in range(12)} | {"a": None, "b": None, "c": None, "d": "v", "e": "v", "o": None}


def test_small_forms(frame):
    df = frame([("a  b", "x a b y"), ("", "x"), (None, "x"), ("q", None)], "q string, s string")
    assert [r["holds"] for r in S.cited(df, "q", "s").collect()] == [True, False, False, False]
    lists = frame([('so: [1, [2]] done',), ("[1] or [2]",), ("none",), (None,), ("[ ] a\n[x]",)], "t string")
    assert [r[0] for r in lists.select(S.first_list("t")).collect()] == ["[1, [2]]", None, None, None, None]
    got = rows(S.filled(frame([("a",), ("b",)], "k string"), frame([("b", 2), ("c", 3)], "k string, v int"), "k"))
    assert got == [("a", None, "dropped"), ("b", 2, "replaced"), ("c", 3, "new")]
    at = frame([("s/mod.py", "A.f", "pyf_mod.a.f"), ("s/mod.py", "", "pym_other"), ("s/mod.py", "g", None)], "filepath string, path string, id_self string")
    assert rows(S.placed(at)) == [("s/mod.py", "", "pym_other", "mod")]
    c = frame([("1", "m"), ("2", "m"), ("2", "n"), ("3", "zz"), ("4", None)], "case string, method string")
    assert rows(S.resolved_cases(c, frame([("m",), ("n",)], "method string"))) == [("1", "m", []), ("2", None, ["several_methods"]), ("3", "zz", ["unknown_method"]), ("4", None, ["no_method"])]
