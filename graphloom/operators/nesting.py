"""Deeply nested records as flat, linked tables."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import written

OBJECT = "hash binary, id_self string, guid_self string, is_item boolean, field string, n_child int"
BRIDGE = "ordinal int, parent int, position int, path string, guid_holder string, hash binary, is_item boolean"
_DEPTH = 100_000


def _unreadable(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None):
    """(readable, value) of a JSON text; a byte-order mark is allowed, NaN and infinities aren't."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text.removeprefix("﻿"), parse_constant=_unreadable)
    except (ValueError, RecursionError):
        return False, None


_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def shred(value, base: str, holder: str | None) -> tuple[list[tuple], dict[str, tuple]]:
    """Occurrences (see BRIDGE) and distinct objects (see OBJECT) of one value.

    Objects are hashed bottom-up over their keys in order, scalars in
    canonical JSON and the hashes of what they hold, so equal objects have
    equal hashes wherever they sit and however they were laid out. Ordinals
    number the objects from 0, outermost first, in document order; ``parent``
    is the ordinal of the nearest enclosing object (null at the top) and
    ``position`` the place in an enclosing list (null outside lists).
    """
    rows: list[list] = []
    objects: dict[str, tuple] = {}

    def walk(node, path: str, parent: int | None, position: int | None, holder: str | None) -> str:
        """The canonical text of ``node``."""
        if isinstance(node, dict):
            at = len(rows)
            guid, own = node.get("guid_self"), node.get("id_self")
            row = [at, parent, position, path, holder, None, isinstance(own, str) or isinstance(guid, str)]
            rows.append(row)
            inner = guid if isinstance(guid, str) else holder
            parts, flat = [], []
            for k, v in node.items():
                name = _encode(k) + ":"
                if isinstance(v, (dict, list)):
                    parts.append(name + walk(v, f"{path}.{k}" if path else k, at, None, inner))
                else:
                    flat.append(name + _encode(v))
            flat.sort()
            key = hashlib.blake2b(("{" + ",".join(sorted(parts + flat)) + "}").encode("utf-8", "surrogatepass"), digest_size=16).digest()
            row[5] = key
            if key not in objects:
                id_text, guid_text = own if isinstance(own, str) else None, guid if isinstance(guid, str) else None
                objects[key] = (key, id_text, guid_text, row[6], "{" + ",".join(flat) + "}", len(parts))
            return "#" + key.hex()
        if isinstance(node, list):
            return "[" + ",".join([walk(v, f"{path}.{i}" if path else str(i), parent, i, holder) for i, v in enumerate(node)]) + "]"
        return _encode(node)

    walk(value, base, None, None, holder)
    return rows, objects


def _clean(text: str | None) -> str | None:
    """Lone surrogates, which no Arrow string can hold, become U+FFFD."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


def _shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shred the first readable document of each run of equal (location, path)."""
    sys.setrecursionlimit(_DEPTH)
    bridge = pa.list_(pa.struct([("ordinal", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("path", pa.string()), ("guid_holder", pa.string()), ("hash", pa.binary()), ("is_item", pa.bool_())]))
    found = pa.list_(pa.struct([("hash", pa.binary()), ("id_self", pa.string()), ("guid_self", pa.string()), ("is_item", pa.bool_()), ("field", pa.string()), ("n_child", pa.int32())]))
    names_b, names_o = [f.name for f in bridge.value_type], [f.name for f in found.value_type]
    last = None
    for batch in batches:
        location, path, holder, text = (c.to_pylist() for c in batch.columns)
        kept, rows_b, rows_o = [], [], []
        for i, t in enumerate(text):
            if (location[i], path[i]) == last:
                continue
            ok, value = parse(t)
            if ok:
                try:
                    rows, objects = shred(value, path[i], holder[i])
                except RecursionError:
                    continue
                last = location[i], path[i]
                kept.append(i)
                rows_b.append([{n: _clean(x) if isinstance(x, str) else x for n, x in zip(names_b, r)} for r in rows])
                rows_o.append([{n: _clean(x) if isinstance(x, str) else x for n, x in zip(names_o, r)} for r in objects.values()])
        take = lambda values, kind: pa.array([values[i] for i in kept], kind)
        yield pa.RecordBatch.from_arrays(
            [take(location, pa.string()), take(path, pa.string()), pa.array(rows_b, bridge), pa.array(rows_o, found)],
            names=["location", "path", "bridge", "object"],
        )


class Nested:
    """Merkle tables of the documents that hold.

    ``object``: each distinct object once (OBJECT), ``field`` being its
    scalar fields as canonical JSON. ``bridge``: every occurrence (BRIDGE)
    with the ``location`` and ``document_path`` of the row it came from.
    """

    def __init__(self, shredded: DataFrame) -> None:
        self._rows = shredded

    @property
    def bridge(self) -> DataFrame:
        return self._rows.select("location", F.col("path").alias("document_path"), F.inline("bridge"))

    @property
    def object(self) -> DataFrame:
        rows = self._rows.select(F.inline("object"))
        return rows.groupBy("hash").agg(*[F.any_value(c).alias(c) for c in rows.columns if c != "hash"])

    def items(self) -> DataFrame:
        """Occurrences of items, which the bridge tells apart as it is made: no shuffle, whatever the copies of one object."""
        return self.bridge.where("is_item").drop("is_item")


def nested(rows: DataFrame) -> Nested:
    """Shred JSON documents (location, path, guid_holder, document, received_at).

    Of the rows of one (location, path) the readable one with the greatest
    received_at holds (null times are least; ties go to the least content
    hash). A null path counts as the whole document. Unreadable, missing or
    blank documents give nothing; other columns are ignored. A document
    nested deeper than the parser's limit counts as unreadable.
    """
    kinds = T.StructType(
        [
            T.StructField("location", T.StringType()),
            T.StructField("path", T.StringType()),
            T.StructField("bridge", T.ArrayType(T._parse_datatype_string(BRIDGE))),
            T.StructField("object", T.ArrayType(T._parse_datatype_string(OBJECT))),
        ]
    )
    key = ["location", "path"]
    flat = (
        rows.select("location", F.coalesce("path", F.lit("")).alias("path"), "guid_holder", "received_at", "document")
        .where("document is not null")
        .repartition(*key)
        .sortWithinPartitions(*key, F.desc_nulls_last("received_at"), F.xxhash64("document"), "guid_holder")
    )
    return Nested(written(flat.select(*key, "guid_holder", "document").mapInArrow(_shred_batches, kinds)))
