"""Functions paired with their documentation."""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import written

#: Distinct words that documentation must add to the words of the function's name.
LEAST_WORDS = 5
_ROW = "name string, filepath string, path string, signature string, role string, documentation string, n_new int, code string, received_at timestamp"
#: Folders that hold sources, or stubs that declare them, and are no part of a module's name.
ROOTS = ("src", "stubs", "typings")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """Runs of letters, case aside."""
    return {w.casefold() for w in _WORD.findall(text)}


def new_words(name: str, documentation: str | None) -> int:
    """Distinct words that the documentation adds to those of the name."""
    return len(words(documentation) - words(name)) if documentation else 0


def module_name(filepath: str) -> str:
    """The dotted module name of a source or stub file, the same for both."""
    steps = filepath.rpartition(".")[0].split("/")
    if len(steps) > 1 and steps[0] in ROOTS:
        steps = steps[1:]
    steps[0] = steps[0].removesuffix("-stubs")
    if len(steps) > 1 and steps[-1] == "__init__":
        steps = steps[:-1]
    return ".".join(steps)


def data_values(text: str, keys: tuple[str, ...] = ("brief", "description")) -> dict[str, str]:
    """Values of some top-level keys of a data item.

    A value is what follows the key on its line and every deeper line below
    it; block marks and outer quotes aren't part of it.
    """
    lines = text.expandtabs().splitlines()
    depth = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    out: dict[str, list[str]] = {}
    into: list[str] | None = None
    for line in (x[depth:] for x in lines):
        if line[:1].strip():
            key, colon, rest = line.partition(":")
            into = None
            if colon and key.strip().strip("'\"") in keys:
                rest = rest.strip()
                into = out[key.strip().strip("'\"")] = [] if re.fullmatch(r"[|>][+-]?\d*[+-]?( #.*)?", rest) else [rest]
        elif into is not None:
            into.append(line.strip())
    values = {k: "\n".join(v).strip() for k, v in out.items()}
    return {k: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v for k, v in values.items() if v not in ("", "~", "null")}


def data_item(text: str) -> str | None:
    """What stands between a line ``---`` and the next line ``...``, or null."""
    lines = text.splitlines()
    bare = [x.strip() for x in lines]
    if "---" in bare:
        first = bare.index("---")
        if "..." in bare[first:]:
            return "\n".join(lines[first + 1 : bare.index("...", first)])
    return None


def described(text: str) -> str:
    """Brief and description of a data item, one below the other."""
    values = data_values(text)
    return "\n".join(values[k] for k in ("brief", "description") if k in values)


def own_documentation(node: ast.AST) -> str | None:
    """The docstring, or of a docstring that holds a data item its brief and description."""
    body = getattr(node, "body", None)
    if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
        return None
    text = body[0].value.value
    item = data_item(text)
    return text if item is None else described(item)


def signature_of(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Parameters without defaults, annotations or layout: what overloads and copies of a function share."""
    a = node.args
    plain = [x.arg for x in [*a.posonlyargs, *a.args]]
    star = ["*" + a.vararg.arg] if a.vararg else ["*"] if a.kwonlyargs else []
    return ",".join([*plain, *star, *(x.arg for x in a.kwonlyargs), *(["**" + a.kwarg.arg] if a.kwarg else [])])


def definitions(source: str, path: str = "") -> list[tuple[str, str, str | None, str, bool]]:
    """(path, signature, own documentation, code, whether outermost) of each function in a source.

    ``path`` is the dotted path down to the source's own definition, empty
    for a module. A source that doesn't parse gives none.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = re.split(r"\r\n|\r|\n", source)
    above, _, own = path.rpartition(".")
    todo = [(tree, above if path else "", True)]
    out = []
    while todo:
        node, prefix, top = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{child.name}" if prefix else child.name
                if not isinstance(child, ast.ClassDef):
                    first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                    code = "\n".join(lines[first - 1 : child.end_lineno])
                    out.append((name, signature_of(child), own_documentation(child), code, top and (not path or child.name == own)))
                todo.append((child, name, False))
            else:
                todo.append((child, prefix, top))
    return out


def _symbols(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(20_000)
    names = [x.split()[0] for x in _ROW.split(", ")]
    for part in parts:
        out = []
        for filepath, kind, path, node, text, received in part.itertuples(index=False, name=None):
            declared = described(text) if text is not None and kind == "function" else None
            module, stub = module_name(filepath), filepath.endswith(".pyi")
            for name, signature, own, code, outermost in definitions(node, path or ""):
                role, said = "declaration" if stub else "definition", own
                if declared is not None and outermost and name == path:
                    role, said = "declaration" if stub else "both", declared
                out.append((f"{module}.{name}", filepath, name, signature, role, said, new_words(name.rpartition(".")[2], said), code, received))
        yield pd.DataFrame(out, columns=names).astype({k: object for k in names if k not in ("n_new", "received_at")} | {"n_new": "int32", "received_at": "datetime64[us]"})


def symbols(rows: DataFrame) -> DataFrame:
    """The symbol table over all files: every function of every Python source or stub, with the documentation found beside it.

    ``name`` is qualified by the module, so a stub and its source share it.
    ``role`` is ``declaration`` in a stub, ``both`` where a function row
    brings its own data item in ``text``, else ``definition``; ``n_new``
    counts the words that the documentation adds to the function's name.
    """
    python = rows.where("node is not null and (filepath like '%.py' or filepath like '%.pyi')")
    once = python.groupBy("filepath", "kind", "path", "node", "text").agg(F.max("received_at").alias("received_at"))
    return once.mapInPandas(_symbols, _ROW)


def code_pairs(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(filepath, path, signature, documentation, code, declared_in), one row for each documented function.

    Functions of one file, path and normalised signature are one; of its
    deliveries the last whose documentation says something stands, a data
    item of its own going before a docstring, and documentation and code
    are of that one delivery. A definition without documentation is joined
    with the documented declarations of all files on qualified name and
    signature, so an overload only takes what is said of its own parameters;
    ``declared_in`` is the file of such a declaration, else null. What then
    says nothing is dropped. Null sources, other languages and sources that
    don't parse give nothing; null times are least, ties go to the greatest
    documentation and code.
    """
    table = written(symbols(rows))
    enough = F.col("n_new") >= least
    code = table.where("role <> 'declaration'").groupBy("name", "filepath", "path", "signature")
    code = code.agg(F.max(F.struct(enough.alias("says"), (F.col("role") == "both").alias("own"), "received_at", "documentation", "code")).alias("x"))
    said = table.where(F.col("role") != "definition").where(enough).groupBy("name", "signature")
    said = said.agg(F.max(F.struct("received_at", "documentation", "filepath")).alias("y"))
    both = code.join(said, ["name", "signature"], "left").where(F.col("x.says") | F.col("y").isNotNull())
    pick = lambda own, other: F.when(F.col("x.says"), own).otherwise(other)
    return both.select("filepath", "path", "signature", pick(F.col("x.documentation"), F.col("y.documentation")).alias("documentation"), F.col("x.code").alias("code"), pick(F.lit(None), F.col("y.filepath")).alias("declared_in"))
