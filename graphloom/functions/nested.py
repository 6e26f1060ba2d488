"""Selecting from and writing into nested JSON by dot path."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.text import path_pattern

_DROP = object()


def _some(patterns: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(path_pattern(p)) for p in patterns]


def _text(steps: tuple[str, ...]) -> str:
    return "".join(s + "." for s in steps)


def pick(value, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()):
    """What of a value the patterns keep: matches with all beneath them and what leads there; then exclusions go [FLT-02].

    No include keeps all. Nothing kept gives None; a kept null stays null.
    """
    keep, drop = _some(include), _some(exclude)

    def walk(node, steps: tuple[str, ...], inside: bool):
        text = _text(steps)
        if steps and any(p.match(text) for p in drop):
            return _DROP
        inside = inside or any(p.match(text) for p in keep)
        if isinstance(node, dict):
            out = {k: r for k, v in node.items() if (r := walk(v, (*steps, k), inside)) is not _DROP}
        elif isinstance(node, list):
            out = [r for i, v in enumerate(node) if (r := walk(v, (*steps, str(i)), inside)) is not _DROP]
        else:
            return node if inside else _DROP
        return out if out or inside else _DROP

    found = walk(value, (), not include)
    return None if found is _DROP else found


def put(value, path: str, new):
    """The value with ``new`` at a path whose parent exists; a list takes one more item at its end [FLT-03]."""
    if not path:
        raise ValueError("no path to write to")
    copy = json.loads(json.dumps(value))
    *above, last = path.split(".")
    at = copy
    for s in above:
        at = at[int(s)] if isinstance(at, list) else at[s]
    if isinstance(at, list):
        i = int(last)
        if i == len(at):
            at.append(new)
        else:
            at[i] = new
    elif isinstance(at, dict):
        at[last] = new
    else:
        raise ValueError(f"{path} leads through a scalar")
    return copy


def selected(document: Column | str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """``pick`` over a JSON column; null for what doesn't parse or leaves nothing."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                found = pick(json.loads(t), include, exclude)
            except (TypeError, ValueError, RecursionError):
                return None
            return None if found is None else json.dumps(found, ensure_ascii=False)

        return text.map(one)

    return run(document)


def with_value(document: Column | str, path: str, new: Column) -> Column:
    """``put`` over JSON columns; null where the parent doesn't exist."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series, value: pd.Series) -> pd.Series:
        def one(t, v):
            try:
                return json.dumps(put(json.loads(t), path, v), ensure_ascii=False)
            except (TypeError, ValueError, KeyError, IndexError, RecursionError):
                return None

        return pd.Series([one(t, v) for t, v in zip(text, value)])

    return run(document, new)
