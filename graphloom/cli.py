"""Read-only commands over a data folder: ``python -m graphloom.cli --data FOLDER walk NAME``.

Exit status 1 stands for a name that isn't known, 2 for a query that can't run.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException

from graphloom.operators import graph as G
from graphloom.operators.facts import ReadOnly
from graphloom.operators.rules import RULES, refused, report
from graphloom.operators.rules import run as run_rules
from graphloom.sources.sinks import report_text, rows_text, walk_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--format", default="text", choices=("text", "json", "xml", "dot", "mermaid"))
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a stored query by name, or a text")
    one = q.add_mutually_exclusive_group(required=True)
    one.add_argument("name", nargs="?")
    one.add_argument("--sql")
    w = sub.add_parser("walk", help="items around one")
    w.add_argument("name")
    w.add_argument("--depth", type=int, default=1)
    w.add_argument("--relation", action="append", default=[])
    w.add_argument("--direction", choices=("out", "in"), action="append")
    t = sub.add_parser("path", help="a shortest path between two items")
    t.add_argument("source")
    t.add_argument("target")
    sub.add_parser("orphans", help="items nothing refers to or holds")
    c = sub.add_parser("check", help="integrity rules")
    c.add_argument("--skip", action="append", default=[])
    sub.add_parser("trace", help="gaps of requirements")
    sub.add_parser("restated", help="bodies that are alike")
    return p


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    """Run one command; what it prints goes to ``out``."""
    from graphloom.plans import load_core
    from graphloom.plans.facts import database
    from graphloom.session import session

    a = parser().parse_args(argv)
    spark, out = spark or session(), out or sys.stdout
    form = "json" if a.format == "json" else "text"
    core = load_core()
    if a.command == "query":
        try:
            if a.name and a.name not in core.queries:
                print(f"no query {a.name}", file=out)
                return 1
            df = core.queries[a.name](spark, a.data) if a.name else database(spark, a.data).run(a.sql)
            out.write(rows_text(df, form))
        except (ReadOnly, PySparkException) as bad:
            print(str(bad).splitlines()[0], file=out)
            return 2
    elif a.command in ("walk", "path"):
        db = database(spark, a.data)
        steps = G.walk(db, a.name, a.depth, tuple(a.relation), tuple(a.direction or ("out", "in"))) if a.command == "walk" else G.path(db, a.source, a.target)
        if steps is None:
            print("no such item", file=out)
            return 1
        if a.format in ("dot", "mermaid"):
            out.write(G.drawing(steps, a.format))
        elif a.command == "path" and steps.isEmpty():
            print("The two are not connected.", file=out)
        else:
            out.write(rows_text(steps, "json") if form == "json" else walk_text(steps))
    elif a.command == "orphans":
        out.write(rows_text(G.orphans(database(spark, a.data))[0].orderBy("guid"), form))
    elif a.command == "check":
        from graphloom.plans.rules import _context

        found, errors = run_rules(_context(spark, a.data, True), tuple(a.skip))
        summary = report(found, [r for r in RULES if r not in a.skip], errors)
        out.write(report_text(found, summary, a.format if a.format in ("json", "xml") else "text"))
        return int(refused(summary))
    else:
        name = {"trace": "prj02_gaps", "restated": "sim01_similar"}[a.command]
        out.write(rows_text(core.queries[name](spark, a.data), form))
    return 0


if __name__ == "__main__":
    sys.exit(main())
