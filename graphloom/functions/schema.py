"""Validation of JSON documents by the schema keywords in use."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Finding = tuple[str, str]

# The names of the types and what Python makes of them.
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    return isinstance(value, TYPES[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


class Validator:
    """A set of schemas by their address; references never leave it [CHK-09, SUP-16]."""

    def __init__(self, schemas: dict[str, dict]) -> None:
        self.schemas = schemas

    def _find(self, ref: str, base: dict) -> tuple[dict, dict]:
        address, _, pointer = ref.partition("#")
        root = self.schemas[address] if address else base
        at = root
        for step in pointer.strip("/").split("/") if pointer.strip("/") else []:
            at = at[step]
        return at, root

    def declared(self, schema: dict, base: dict | None = None, seen: frozenset = frozenset()) -> set[str]:
        """Property names that a schema and all it is composed of declare; reference cycles end [SUP-17]."""
        base = schema if base is None else base
        out = set(schema.get("properties", {}))
        for part in schema.get("allOf", []):
            out |= self.declared(part, base, seen)
        if (ref := schema.get("$ref")) and ref not in seen:
            found, root = self._find(ref, base)
            out |= self.declared(found, root, seen | {ref})
        return out

    def faults(self, value, schema: dict, path: str = "", base: dict | None = None, depth: int = 0) -> Iterator[Finding]:
        """(path, message) of what a value breaks."""
        base = schema if base is None else base
        if depth > 200:
            return
        join = lambda k: f"{path}.{k}" if path else str(k)
        again = lambda v, s, p, b=base: self.faults(v, s, p, b, depth + 1)
        if ref := schema.get("$ref"):
            found, root = self._find(ref, base)
            yield from again(value, found, path, root)
        for part in schema.get("allOf", []):
            yield from again(value, part, path)
        if "not" in schema and not any(True for _ in again(value, schema["not"], path)):
            yield path, "matches what it must not"
        if "if" in schema:
            branch = "else" if any(True for _ in again(value, schema["if"], path)) else "then"
            if branch in schema:
                yield from again(value, schema[branch], path)
        kinds = schema.get("type")
        if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            yield path, f"is no {kinds}"
            return
        if "enum" in schema and value not in schema["enum"]:
            yield path, "is none of the values allowed"
        if "const" in schema and value != schema["const"]:
            yield path, "is not the value required"
        if isinstance(value, str):
            if len(value) < schema.get("minLength", 0):
                yield path, "is too short"
            if len(value) > schema.get("maxLength", len(value)):
                yield path, "is too long"
            if "pattern" in schema and ("\n" in value or not re.search(schema["pattern"], value)):
                yield path, "does not match its pattern"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            if value < schema.get("minimum", value):
                yield path, "is too small"
            if value > schema.get("maximum", value):
                yield path, "is too large"
        if isinstance(value, list):
            if len(value) < schema.get("minItems", 0):
                yield path, "has too few items"
            if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
                yield path, "has an item twice"
            if "items" in schema:
                for i, v in enumerate(value):
                    yield from again(v, schema["items"], join(i))
            if "contains" in schema and not any(not any(True for _ in again(v, schema["contains"], path)) for v in value):
                yield path, "lacks an item it must contain"
        if isinstance(value, dict):
            for k in schema.get("required", []):
                if k not in value:
                    yield path, f"lacks {k}"
            if len(value) < schema.get("minProperties", 0):
                yield path, "has too few fields"
            own = schema.get("properties", {})
            for k, v in value.items():
                if k in own:
                    yield from again(v, own[k], join(k))
                elif schema.get("additionalProperties") is False:
                    yield join(k), "is not allowed"
                elif isinstance(schema.get("additionalProperties"), dict):
                    yield from again(v, schema["additionalProperties"], join(k))
                if "propertyNames" in schema:
                    for _, message in again(k, schema["propertyNames"], ""):
                        yield join(k), f"its name {message}"
            if schema.get("unevaluatedProperties") is False:
                for k in value:
                    if k not in self.declared(schema, base):
                        yield join(k), "is not declared"


def violations(documents: DataFrame, schema: dict, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(location, path, message) of (location, document) rows against a schema, in path order, each once [CHK-09, AGG-19].

    Documents that don't parse are one violation each.
    """
    validator = Validator(schemas or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for location, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = sorted(set(validator.faults(json.loads(text), schema)))
                except (TypeError, ValueError, RecursionError):
                    found = [("", "does not parse")]
                out += [(location, *f) for f in found]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["location", "path", "message"])

    return documents.select("location", "document").mapInArrow(run, "location string, path string, message string")
