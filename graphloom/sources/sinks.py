"""Writers: rows, reports and files."""

from __future__ import annotations

import json
import os
import tempfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame


def rows_text(df: DataFrame, form: str = "text") -> str:
    """A small result as aligned columns and a count, or as a JSON list [SNK-02]."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if form == "json":
        return json.dumps(rows, indent=2, default=str, ensure_ascii=False) + "\n"
    cells = [df.columns, *[["" if r[c] is None else str(r[c]) for c in df.columns] for r in rows]]
    width = [max(len(x[i]) for x in cells) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(x, width)).rstrip() for x in cells]
    return "\n".join([*lines, f"{len(rows)} row(s)."]) + "\n"


def walk_text(steps: DataFrame) -> str:
    """A walk, indented by depth, with the arrow of each reaching edge and a count [SNK-03]."""
    rows = steps.orderBy("depth", "pos" if "pos" in steps.columns else "id_self").collect()
    arrow = {"out": "->", "in": "<-"}
    lines = ["  " * r["depth"] + (f"{arrow[r['direction']]} {r['id_relation']} " if r["direction"] else "") + r["id_self"] for r in rows]
    return "\n".join([*lines, f"{len(rows)} item(s)."]) + "\n"


def report_text(findings: DataFrame, summary: DataFrame, form: str = "text") -> str:
    """A check report as text, JSON or XML; the XML leaves out what is empty [SNK-01]."""
    by = {r["id_check"]: r.asDict() | {"nonconformity": []} for r in summary.orderBy("id_check").collect()}
    for r in findings.orderBy("id_check", "guid", "path", "message").collect():
        if r["id_check"] in by:
            by[r["id_check"]]["nonconformity"].append({k: r[k] for k in ("guid", "path", "severity", "message")})
    if form == "json":
        return json.dumps({"report": {"check": list(by.values())}}, indent=2, ensure_ascii=False) + "\n"
    if form == "xml":
        tag = lambda k, v: f"<{k}>{escape(str(v))}</{k}>"
        body = []
        for c in by.values():
            inner = "".join(tag(k, v) for k, v in c.items() if k != "nonconformity" and v is not None)
            inner += "".join("<nonconformity>" + "".join(tag(k, v) for k, v in n.items() if v is not None) + "</nonconformity>" for n in c["nonconformity"])
            body.append(f"<check>{inner}</check>")
        return "<report>" + "".join(body) + "</report>\n"
    lines = []
    for c in by.values():
        lines.append(f"{c['id_check']}: {c['status']} ({c['n_critical']} critical, {c['n_advisory']} advisory)")
        lines += [f"  {n['severity']} {n['guid']} {n['path']}: {n['message']}" for n in c["nonconformity"]]
    return "\n".join(lines) + "\n"


def write_text(path: str, text: str) -> None:
    """Replace a file in one step, keeping its mode [SNK-05]."""
    folder = os.path.dirname(os.path.abspath(path))
    mode = os.stat(path).st_mode if os.path.exists(path) else None
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        if mode is not None:
            os.chmod(name, mode)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
