import json
import os
import subprocess

import pytest

from graphloom.sources import parse as P
from graphloom.sources import sinks as K
from graphloom.sources import tree as T
from tests.conftest import rows


def test_yaml_is_of_version_1_2():
    assert P.from_yaml("a: yes\nb: 2024-01-01\nc: 0o17\nd: 0x1f\ne: ~\nf: 1.5\ng: true") == {"a": "yes", "b": "2024-01-01", "c": 15, "d": 31, "e": None, "f": 1.5, "g": True}
    with pytest.raises(P.Unreadable):
        P.from_yaml("a: 1\na: 2")
    assert P.documents_of("x.yaml", b"\xff\xfea\x00:\x00 \x001\x00") == [("", "document", {"a": 1})]


def test_json_and_comments():
    assert P.from_jsonc('{"a": "// no", /* x */ "b": [1, 2,], // y\n}') == {"a": "// no", "b": [1, 2]}
    for bad in ('{"a": NaN}', "{", ""):
        with pytest.raises(P.Unreadable):
            P.from_json(bad)


def test_xml():
    assert P.from_xml('<a x="1"><b>t</b><b/><c y="2">z</c></a>') == {"a": {"@x": "1", "b": ["t", None], "c": {"@y": "2", "#text": "z"}}}
    for bad in ("<!DOCTYPE a><a/>", '<?xml version="1.0" encoding="x"?><a/>', "<a>t<b/></a>", "<a><b/>t</a>", "<a>"):
        with pytest.raises(P.Unreadable):
            P.from_xml(bad)


SOURCE = '"""Head.\n\n---\nid_self: m\nguid_self: g_m\n...\n"""\n\nclass A:\n    """\n    ---\n    id_self: a\n    guid_self: g_a\n    ...\n    """\n\n    @staticmethod\n    def f(x):\n        """No item."""\n        return x\n'


def test_python_items():
    assert [(a, k, v["id_self"]) for a, k, v in P.from_python(SOURCE)] == [("", "module", "m"), ("A", "class", "a")]
    for bad in ('"""No item."""', "def f(:", '"""\n---\na: 1\n...\nmore\n"""', '"""\n---\na: 1\n"""'):
        with pytest.raises(P.Unreadable):
            list(P.from_python(bad))
    path, kind, source, code = P.definitions_of(SOURCE)[1]
    assert (path, kind) == ("A.f", "function") and source.strip().startswith("@staticmethod") and "No item" not in code


def test_comment_items():
    assert P.documents_of("a.css", b"/*\n---\nid_self: c\n...\n*/ b {}") == [("", "comment", {"id_self": "c"})]
    assert P.documents_of("a.js", b"let a;") == []
    with pytest.raises(P.Unreadable):
        P.documents_of("a.txt", b"")


def test_tree(spark, tmp_path):
    files = {
        "a.yaml": "id_self: t_a\nguid_self: g_a\nstatus: accepted\nrelation:\n- {id_relation: r, guid_target: g_b, id_target: t_b}\npart:\n- {id_self: t_c, guid_self: g_c}\n",
        "_b.py": SOURCE,
        "bad.json": "{",
        ".hidden.json": "{}",
        "n.txt": "x",
        "sub/c.json": '{"k": [1]}',
    }
    for name, text in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = T.read_tree(spark, [str(tmp_path), str(tmp_path / "a.yaml"), str(tmp_path / "nowhere")])
    assert tree.documents.count() == 4
    assert {os.path.basename(r["filepath"]) for r in tree.failures.collect()} == {"bad.json", "nowhere"}
    f = T.facts(tree.documents)
    assert rows(f.item.select("guid", "prefix", "status")) == [("g_a", "a", None), ("g_a", "t", "accepted"), ("g_c", "t", None), ("g_m", "m", None)]
    assert rows(f.edge.select("guid_source", "id_relation", "guid_target", "path")) == [("g_a", "r", "g_b", "relation.0")]
    assert rows(f.containment) == [("g_a", "g_c")]


def test_items_without_a_guid_are_refused_alone(spark, tmp_path):
    from datetime import datetime

    from graphloom.plans.incremental import fact02_tree_facts, fact02_tree_refused

    edge = [{"id_relation": "r", "guid_target": "g_z", "id_target": None}]
    mixed = {"guid_self": "g_a", "id_self": "t_a", "part": [{"id_self": "t_b", "in": {"guid_self": "g_c", "relation": edge}}]}
    day = lambda d: datetime(2024, 1, d)
    data = [
        ("m", "", json.dumps(mixed), day(2)),
        ("m", "", json.dumps({"guid_self": "g_old", "id_self": "t_old"}), day(1)),
        ("m", "", "{", day(3)),
        ("m", "part.0", json.dumps({"guid_self": "g_part"}), day(4)),
        ("n", "", json.dumps({"guid_self": "g_n", "relation": edge}), None),
        ("o", "", None, day(1)),
    ]
    spark.createDataFrame(data, "location string, path string, document string, received_at timestamp").write.parquet(str(tmp_path / "held.parquet"))
    got = fact02_tree_facts(spark, str(tmp_path))
    assert rows(got.where("fact = 'item'").select("location", "guid")) == [("m", "g_a"), ("m", "g_c"), ("n", "g_n")]
    assert rows(got.where("fact = 'edge'").select("guid_source", "path")) == [("g_c", "part.0.in.relation.0"), ("g_n", "relation.0")]
    assert rows(got.where("fact = 'containment'").select("guid_holder", "guid_held")) == [("g_a", "g_c")]
    assert rows(fact02_tree_refused(spark, str(tmp_path))) == [("m", "part.0", "t_b", "no guid")]


def test_leaves_and_references(frame):
    g = "x_" + "a" * 32
    doc = json.dumps({"guid_self": g, "r": {"guid_t": g, "id_t": "n"}, "l": [g], "p": "a\nb", "sql": "a\nb"})
    leaf = T.leaves(frame([("f", "", doc), ("f", "", "{"), (None, None, None)], "location string, path string, document string"))
    assert rows(T.declarations(leaf)) == [("f", "guid_self", g)]
    assert rows(T.references(leaf).select("path", "guid", "id")) == [("r.guid_t", g, "n")]
    assert rows(T.prose(leaf).select("path")) == [("p",)]


def test_bodies(frame):
    src = "def f(a):\n    '''doc'''\n    b = a.x + 1\n    return b\n\ndef g(q):\n    c = q.x + 1\n    return c\n"
    got = T.bodies(frame([("m.py", src), ("n.py", "def ("), (None, None)], "filepath string, node string")).collect()
    assert len(got) == 2 and got[0]["piece"] == got[1]["piece"] and "Attribute:x" in " ".join(got[0]["piece"])


def test_bodies_of_files_without_a_module_row(spark, tmp_path):
    from graphloom.plans.incremental import sim02_bodies

    method, other = "def f(self):\n    return self.x + 1\n", "def f(self):\n    return 2\n"
    whole = "class A:\n    def f(self):\n        return self.x + 1\n    class B:\n        async def g(self):\n            def h():\n                pass\n"
    data = [
        ("m.py", "module", "", whole), ("m.py", "class", "A", whole), ("m.py", "function", "A.f", method), ("m.py", "function", "A.f", method),
        ("c.py", "class", "A", whole), ("f.py", "function", "A.f", method), ("f.py", "function", "A.f", other),
        ("f.py", "function", "A.bad", "def ("), ("f.py", "function", "A.none", None), ("f.js", "function", "f", method), ("n.py", "module", None, method),
    ]
    spark.createDataFrame(data, "filepath string, kind string, path string, node string").write.parquet(str(tmp_path / "definition.parquet"))
    names = ["A.B.g", "A.B.g.h", "A.f"]
    got = sorted(r["name"] for r in sim02_bodies(spark, str(tmp_path)).collect())
    assert got == sorted([f"m.py::{n}" for n in names] + [f"c.py::{n}" for n in names] + ["f.py::A.f", "f.py::A.f", "n.py::f"])


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "x").write_text("1")
    run("add", "x")
    run("commit", "-m", "One\n\nbody")
    (tmp_path / "x").write_text("2")
    (tmp_path / "y").write_text("2")
    assert [r["title"] for r in T.commits(spark, str(tmp_path), 5).collect()] == ["One"]
    assert rows(T.changed_since(spark, str(tmp_path), "HEAD")) == [("x",), ("y",)]


def test_junit(spark):
    text = '<s><testcase classname="c" name="t[1]"/><testcase classname="c" name="t[2]"><failure/></testcase><testcase classname="c" name="u"><skipped/></testcase></s>'
    assert rows(T.junit(spark, text).select("name", "outcome")) == [("t", "failed"), ("u", "skipped")]


def test_sinks(frame, tmp_path):
    df = frame([("a", 1), ("bb", None)], "x string, n int")
    assert K.rows_text(df) == "x   n\na   1\nbb\n2 row(s).\n" and json.loads(K.rows_text(df, "json"))[0] == {"x": "a", "n": 1}
    found = frame([("c", "g", "p", "critical", "<m>")], "id_check string, guid string, path string, severity string, message string")
    summary = frame([("c", 1, 0, "nonconformity")], "id_check string, n_critical int, n_advisory int, status string")
    assert "&lt;m&gt;" in K.report_text(found, summary, "xml") and json.loads(K.report_text(found, summary, "json"))["report"]["check"][0]["n_critical"] == 1
    assert K.report_text(found, summary).startswith("c: nonconformity")
    K.write_text(str(tmp_path / "f"), "x")
    K.write_text(str(tmp_path / "f"), "y")
    assert (tmp_path / "f").read_text() == "y" and len(os.listdir(tmp_path)) == 1


def test_two_databases_do_not_meet(frame):
    from graphloom.operators.facts import FactDatabase

    def make(n):
        item = frame([(f"g{i}", "a_1", "a", None, "f", i) for i in range(n)], "guid string, id_self string, prefix string, status string, location string, ord bigint")
        edge = frame([], "ord bigint, guid_source string, id_relation string, guid_target string, id_target string")
        return FactDatabase(item, edge, frame([], "guid_holder string, guid_held string"))

    one, two = make(2), make(3)
    sql = "SELECT COUNT(*) AS n, GROUP_CONCAT(COALESCE(status, 'GROUP_CONCAT(x'), ', ') AS s FROM item"
    assert [tuple(d.run(sql).first()) for d in (one, two, one)] == [(k, ", ".join(["GROUP_CONCAT(x"] * k)) for k in (2, 3, 2)]
    assert two.run("WITH x AS (SELECT guid FROM item) SELECT count(*) FROM x;").first()[0] == 3


def test_a_stored_database_is_made_anew_when_its_tables_change_or_go(frame, spark, tmp_path):
    from graphloom.plans.facts import database
    from graphloom.session import forget

    item = "guid string, id_self string, status string, location string, ord bigint, recorded_at timestamp"
    put = lambda n: frame([(f"g{i}", "a_1", None, "f", i, None) for i in range(n)], item).write.mode("overwrite").parquet(f"{tmp_path}/item.parquet")
    frame([], "ord bigint, guid_source string, id_relation string, guid_target string, id_target string").write.parquet(f"{tmp_path}/edge.parquet")
    frame([], "ord bigint, guid_holder string, guid_held string").write.parquet(f"{tmp_path}/containment.parquet")
    put(2)
    one = database(spark, str(tmp_path))
    assert database(spark, str(tmp_path)) is one and one.item.count() == 2
    forget(one.edge)
    two = database(spark, str(tmp_path))
    assert two is not one and two.edge.count() == 0
    put(5)
    assert database(spark, str(tmp_path)).item.count() == 5
