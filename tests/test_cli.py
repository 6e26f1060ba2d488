import io
import os

import pytest

from graphloom.cli import main

DATA = "/root/testdata/sf0.001"
if not os.path.isdir(DATA):
    pytest.skip("no test data here", allow_module_level=True)


def call(spark, *argv):
    out = io.StringIO()
    return main(["--data", DATA, *argv], spark, out), out.getvalue()


def test_query(spark):
    code, text = call(spark, "query", "--sql", "select count(*) as n from item")
    assert code == 0 and text.endswith("1 row(s).\n")
    assert call(spark, "query", "--sql", "drop view item")[0] == 2 and call(spark, "query", "--sql", "select nope from item")[0] == 2
    assert call(spark, "query", "nobody")[0] == 1 and call(spark, "query", "sql12_count_items")[0] == 0


def test_walk_and_path(spark):
    name = call(spark, "query", "--sql", "select id_self from item where id_self is not null and guid in (select guid_source from edge) order by 1 limit 1")[1].split("\n")[1]
    code, text = call(spark, "walk", name, "--depth", "1")
    assert code == 0 and text.startswith(name) and "item(s)." in text
    assert call(spark, "walk", "nobody")[0] == 1 and call(spark, "path", name, name)[1].startswith(name)
