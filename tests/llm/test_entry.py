import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_problem_has_queries():
    names = entry.queries()
    assert all(any(re.match(rf"p{n}_", q) for q in names) for n in range(1, 11))
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} <= set(names)


def test_nothing_outside_imports_the_subpackage():
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "graphloom.llm" not in p.read_text(), p
