"""Directories of documents as DataFrames, and the facts in them."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.nesting import parse
from graphloom.session import written
from graphloom.sources.parse import SUFFIX, Unreadable, body_tokens, definitions_of, documents_of

_DEPTH = 100_000
_DOCUMENT = "filepath string, anchor string, kind string, nth int, document string, error string"


def files(roots: list[str]) -> tuple[list[str], list[str]]:
    """(files, roots that don't exist), each file once and sorted [SRC-01, SRC-02, SRC-19].

    A named file is taken whatever its suffix; of a directory the known
    suffixes, without names that begin with a dot.
    """
    found, lost = set(), []
    for root in roots:
        if os.path.isfile(root):
            found.add(root)
        elif os.path.isdir(root):
            for folder, inner, names in os.walk(root):
                inner[:] = sorted(d for d in inner if not d.startswith("."))
                found.update(os.path.join(folder, n) for n in names if not n.startswith(".") and os.path.splitext(n)[1] in SUFFIX)
        else:
            lost.append(root)
    return sorted(found), lost


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                for n, (anchor, kind, value) in enumerate(documents_of(path, data)):
                    out.append((path, anchor, kind, n, json.dumps(value, ensure_ascii=False, default=str), None))
            except (Unreadable, ValueError) as bad:
                out.append((path, "", None, None, None, str(bad)[:2000]))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["filepath", "anchor", "kind", "nth", "document", "error"])


@dataclass
class Tree:
    """documents (filepath, anchor, kind, nth, location, document) and failures (filepath, error) [SRC-18]."""

    documents: DataFrame
    failures: DataFrame


def read_tree(spark: SparkSession, roots: list[str]) -> Tree:
    """Read and parse every file below the roots; a bad file is a failure, never an exception.

    Files are listed by name, since Spark's own listing hides names that
    begin with an underscore, and parsed where they are read.
    """
    names, lost = files(roots)
    slices = max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))
    paths = spark.createDataFrame([(n,) for n in names], "filepath string").repartition(slices)
    blobs = paths.mapInArrow(_blobs, "filepath string, data binary")
    parsed = blobs.mapInArrow(_parse, _DOCUMENT)
    location = F.when(F.col("anchor") == "", F.col("filepath")).otherwise(F.concat_ws("::", "filepath", "anchor"))
    missing = spark.createDataFrame([(r, "no such file or directory") for r in lost], "filepath string, error string")
    return Tree(parsed.where("error is null").select("filepath", "anchor", "kind", "nth", location.alias("location"), "document"), parsed.where("error is not null").select("filepath", "error").unionByName(missing))


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        data = []
        for p in paths:
            try:
                with open(p, "rb") as f:
                    data.append(f.read())
            except OSError:
                data.append(b"\xff")  # unreadable as text, so it becomes a failure
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], names=["filepath", "data"])


def _texts(values) -> list[str | None]:
    """Strings that Arrow can hold; other scalars as JSON."""
    return [None if v is None else (v if isinstance(v, str) else json.dumps(v)).encode("utf-8", "replace").decode() for v in values]


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(_DEPTH)
    kinds = {"what": pa.string(), "location": pa.string(), "nth": pa.int64(), "a": pa.string(), "b": pa.string(), "c": pa.string(), "d": pa.string(), "path": pa.string()}
    for batch in batches:
        out: list[tuple] = []
        for location, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ok, value = parse(text)
            if not ok:
                continue
            n = 0

            def walk(node, path: str, holder: str | None, location=location) -> None:
                nonlocal n
                if isinstance(node, list):
                    for i, x in enumerate(node):
                        walk(x, f"{path}.{i}" if path else str(i), holder)
                if not isinstance(node, dict):
                    return
                guid, own, status = node.get("guid_self"), node.get("id_self"), node.get("status")
                if isinstance(guid, str):
                    n += 1
                    out.append(("item", location, n, guid, own if isinstance(own, str) else None, status if isinstance(status, str) else None, None, path))
                    if holder is not None:
                        out.append(("containment", location, n, holder, guid, None, None, path))
                    holder = guid
                    for i, edge in enumerate(node.get("relation") if isinstance(node.get("relation"), list) else []):
                        if isinstance(edge, dict) and isinstance(edge.get("guid_target"), str):
                            n += 1
                            out.append(("edge", location, n, guid, edge.get("id_relation"), edge["guid_target"], edge.get("id_target"), f"{path}.relation.{i}" if path else f"relation.{i}"))
                elif isinstance(own, str):
                    n += 1
                    out.append(("refused", location, n, own, "no guid", None, None, path))
                for k, x in node.items():
                    walk(x, f"{path}.{k}" if path else k, holder)

            walk(value, "", None)
        cols = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(_texts(c) if k == pa.string() else list(c), k) for c, k in zip(cols, kinds.values())], names=list(kinds))


@dataclass
class TreeFacts:
    item: DataFrame
    edge: DataFrame
    containment: DataFrame
    refused: DataFrame


def last_readable(rows: DataFrame) -> DataFrame:
    """(location, path, document) of the row that holds of each place, from (location, path, document, received_at) rows.

    That is the readable one with the greatest received_at; null times are
    least and ties go to the least text hash, as in ``nested``. A null path
    counts as the whole document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            kept = []
            for i, place in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if place != last and parse(batch.column(2)[i].as_py())[0]:
                    last = place
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int32()))

    key = ["location", "path"]
    flat = rows.select("location", F.coalesce("path", F.lit("")).alias("path"), "document", "received_at").where("document is not null")
    flat = flat.repartition(*key).sortWithinPartitions(*key, F.desc_nulls_last("received_at"), F.xxhash64("document"))
    return flat.select(*key, "document").mapInArrow(run, "location string, path string, document string")


def facts(documents: DataFrame) -> TreeFacts:
    """item, edge and containment of (location, document) rows, in document order [FACT-01, FACT-02, FACT-05, FACT-09].

    Order is by location, then outermost first within a document. An item
    with a readable id but no guid is refused: ``refused`` has its location,
    path, id_self and error, and what it holds counts as held by the nearest
    enclosing item with a guid. Documents are flattened once, into a table
    that is written.
    """
    rows = written(documents.select("location", "document").mapInArrow(_flatten, "what string, location string, nth bigint, a string, b string, c string, d string, path string"))
    place = F.struct("location", "nth")
    item = rows.where("what = 'item'").select(F.col("a").alias("guid"), F.col("b").alias("id_self"), F.substring_index(F.coalesce("b", F.lit("")), "_", 1).alias("prefix"), F.col("c").alias("status"), "location", place.alias("ord"))
    edge = rows.where("what = 'edge'").select(place.alias("ord"), F.col("a").alias("guid_source"), F.col("b").alias("id_relation"), F.col("c").alias("guid_target"), F.col("d").alias("id_target"), "path")
    held = rows.where("what = 'containment'").select(F.col("a").alias("guid_holder"), F.col("b").alias("guid_held"))
    refused = rows.where("what = 'refused'").select("location", "path", F.col("a").alias("id_self"), F.col("b").alias("error"))
    return TreeFacts(item, edge, held, refused)


_LEAF = "location string, path string, step string, kind string, value string, guid_holder string"


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for location, base, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ok, value = parse(text)
            todo = [(value, base or "", "", None)] if ok else []
            while todo:
                node, path, step, holder = todo.pop()
                if isinstance(node, dict):
                    guid = node.get("guid_self")
                    inner = guid if isinstance(guid, str) else holder
                    todo += [(v, f"{path}.{k}" if path else k, k, inner) for k, v in reversed(node.items())]
                elif isinstance(node, list):
                    todo += [(v, f"{path}.{i}" if path else str(i), str(i), holder) for i, v in reversed(list(enumerate(node)))]
                else:
                    kind = "null" if node is None else "boolean" if isinstance(node, bool) else "number" if isinstance(node, (int, float)) else "string"
                    out.append((location, path, step, kind, None if node is None else node if isinstance(node, str) else json.dumps(node), holder))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array([None if x is None else x.encode("utf-8", "replace").decode() for x in c], pa.string()) for c in cols], names=["location", "path", "step", "kind", "value", "guid_holder"])


def leaves(documents: DataFrame) -> DataFrame:
    """(location, path, step, kind, value, guid_holder) of every scalar of (location, path, document) rows [FACT-10, FACT-12].

    ``step`` is the last step of the path, ``guid_holder`` the guid of the
    nearest enclosing item; unreadable documents give nothing.
    """
    return documents.select("location", "path", "document").mapInArrow(_leaves, _LEAF)


def declarations(leaf: DataFrame) -> DataFrame:
    """Every guid declared, with its path [FACT-06]."""
    return leaf.where("step = 'guid_self' and kind = 'string'").select("location", "path", F.col("value").alias("guid"))


def references(leaf: DataFrame) -> DataFrame:
    """Whole strings of guid form in mappings, not declarations, with the readable id beside them [FACT-07, FACT-08]."""
    parent = F.regexp_replace("path", r"(^|\.)[^.]*$", "")
    here = leaf.withColumn("parent", parent)
    refs = here.where((F.col("kind") == "string") & (F.col("step") != "guid_self") & F.col("value").rlike("^[a-z]{1,8}_[0-9a-f]{32}$") & ~F.col("step").rlike("^[0-9]+$"))
    twins = here.where(F.col("step").startswith("id")).select("location", "parent", F.col("step").alias("twin"), F.col("value").alias("id"))
    refs = refs.withColumn("twin", F.regexp_replace("step", "guid", "id"))
    return refs.join(twins, ["location", "parent", "twin"], "left").select("location", "path", F.col("value").alias("guid"), "id", "guid_holder")


def prose(leaf: DataFrame, skip: tuple[str, ...] = ("subject", "sql", "example")) -> DataFrame:
    """Strings with a line break under an item, datum fields aside [FACT-11, FACT-17]."""
    return leaf.where(F.col("value").contains("\n") & F.col("guid_holder").isNotNull() & ~F.arrays_overlap(F.split("path", r"\."), F.array(*[F.lit(s) for s in skip]))).select("location", "path", "guid_holder", "value")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ast

    for batch in batches:
        out = []
        for file, own, text in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError):
                continue
            todo = [(tree, own.rpartition(".")[0])]
            while todo:
                node, above = todo.pop()
                for child in ast.iter_child_nodes(node):
                    inner = above
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        inner = f"{above}.{child.name}" if above else child.name
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        tokens = body_tokens(child)
                        pieces = sorted({" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)})
                        out.append((f"{file}::{inner}", pieces, len(tokens)))
                    todo.append((child, inner))
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.int32())], names=["name", "piece", "length"])


def bodies(sources: DataFrame) -> DataFrame:
    """(name, piece, length) of each function in (filepath, path, node) rows; sources that don't parse are skipped [SIM-02, SIM-03].

    ``name`` is the file and the dotted path, which goes on from the row's
    ``path`` (empty for a module, as where the column is absent). A body
    that comes with its module, its class and by itself is given once;
    different bodies of one path stay.
    """
    path = F.coalesce("path", F.lit("")) if "path" in sources.columns else F.lit("")
    rows = sources.where("node is not null").select("filepath", path.alias("path"), "node").distinct()
    return rows.mapInArrow(_bodies, "name string, piece array<string>, length int").distinct()


def code(rows: DataFrame) -> DataFrame:
    """(filepath, path, kind, source, code) of each definition in (filepath, node) rows [SRC-11, SRC-12]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(name, *d) for d in definitions_of(text or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["filepath", "path", "kind", "source", "code"])

    return rows.select("filepath", "node").mapInArrow(run, "filepath string, path string, kind string, source string, code string")


def commits(spark: SparkSession, root: str, count: int | None = None) -> DataFrame:
    """(ord, hash, title, message) of a repository's log, newest first [SRC-13, SRT-06]."""
    limit = [f"-{count}"] if count is not None else []
    done = subprocess.run(["git", "-C", root, "log", *limit, "--format=%H%x1f%s%x1f%B%x1e"], capture_output=True, text=True, check=True)
    rows = [tuple(r.strip("\n").split("\x1f")) for r in done.stdout.split("\x1e") if r.strip()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, hash string, title string, message string")


def changed_since(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """Files that differ from a commit, and those the working tree adds [SRC-14]."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.split("\0")
    names = {*run("diff", "--name-only", "-z", ref), *run("ls-files", "--others", "--exclude-standard", "-z")} - {""}
    return spark.createDataFrame([(n,) for n in sorted(names)], "filepath string")


def junit(spark: SparkSession, text: str) -> DataFrame:
    """(classname, name, outcome) of a JUnit report; instances of one parametrised test keep their worst outcome [SRC-17, AGG-11]."""
    import re
    import xml.etree.ElementTree as ElementTree

    rows = []
    for case in ElementTree.fromstring(text).iter("testcase"):
        tags = {c.tag for c in case}
        outcome = "error" if "error" in tags else "failed" if "failure" in tags else "skipped" if "skipped" in tags else "passed"
        rows.append((case.get("classname", ""), re.sub(r"\[.*\]$", "", case.get("name", "")), outcome))
    from graphloom.operators.relational import worst_outcome

    return worst_outcome(spark.createDataFrame(rows, "classname string, name string, outcome string"), ["classname", "name"], "outcome", ["error", "failed", "skipped", "passed"])


def indexed(items: DataFrame, column: str, *order: str) -> DataFrame:
    """One row for each value of a column, the last in the given order [FACT-03]."""
    w = Window.partitionBy(column).orderBy(*[F.desc(o) for o in order])
    return items.where(F.col(column).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


__all__ = ["Tree", "TreeFacts", "bodies", "changed_since", "code", "commits", "declarations", "facts", "files", "indexed", "junit", "last_readable", "leaves", "prose", "read_tree", "references"]
